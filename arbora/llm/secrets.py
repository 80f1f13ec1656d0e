"""Secret scans: exact patterns, and character Markov models compared by log-likelihood ratio. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns (letters of the keywords in either case), with the least length of what each must catch.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the same spans as AKIA[A-Z0-9]+ of 20 characters and more
HEX = "[0-9a-f]{24,}"
#: A string that the models judge: a run of 20 and more of these, with a digit and a letter.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What base spans leave of a run is judged from this length.
LEAST = 16
#: The share of held-out ordinary samples whose score may pass the threshold.
FALSE = 0.001
#: Ordinary identifiers are made of these words by rule (snake, camel, kebab and path case).
WORDS = (
    "user name value index count list array string number result error message handler request response client server config option default "
    "create update delete insert select query table column field record object class method function parameter argument return source target "
    "input output buffer stream reader writer parser token session context manager service factory builder provider listener event callback "
    "thread process queue worker task schedule timer image button window layout panel color width height margin border account customer order "
    "product price total amount payment invoice address street country language version license project module package import export test "
    "document content article section chapter paragraph sentence character the and for with from that this which under about between"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """(sample, random): n random strings (hexadecimal and base32 of either case, base64, base64url and alphanumeric digests) and n ordinary
    identifiers (also long paths, constants, settings, dates and numbers), all by rule. Other values of `first` give other samples."""
    i = F.col("id")
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), i.cast("string")).cast("binary"), 256))
    plain = F.base64(digest)
    b32 = F.translate(plain, BASE64 + "=", BASE32 * 2)
    made = F.when(i % 7 == 0, F.lower(F.hex(digest))).when(i % 7 == 1, plain).when(i % 7 == 2, F.hex(digest)).when(i % 7 == 3, b32)
    made = made.when(i % 7 == 4, F.translate(plain, "+/=", "-_")).otherwise(F.regexp_replace(plain, "[+/=]", ""))
    pick = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m))
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (pick(k, len(WORDS)) + 1).cast("int"))
    a, b, c, d, e = (word(k) for k in (1, 2, 3, 5, 6))
    digits = pick(4, 3000).cast("string")
    tail = F.when(i % 5 == 0, digits).otherwise(F.lit(""))
    date = lambda by: F.concat_ws(by, (pick(7, 60) + 1970).cast("string"), F.lpad((pick(8, 12) + 1).cast("string"), 2, "0"), F.lpad((pick(9, 31) + 1).cast("string"), 2, "0"))
    number = pick(10, 10**10).cast("string")
    named = [
        F.concat_ws("_", a, b, c, tail), F.concat(a, F.initcap(b), F.initcap(c), tail), F.concat_ws("-", a, b, c, tail), F.concat_ws("/", a, b, F.concat(c, tail)),
        F.concat(F.lit("/"), F.concat_ws("/", a, b, date("/"), F.concat_ws("-", c, d, e, digits))), F.upper(F.concat_ws("_", a, b, c, digits)), F.concat(a, F.lit("_"), b, F.lit("="), c, F.initcap(d), digits),
        F.concat_ws("-", date("-"), a, b, F.concat(F.lit("v"), digits)), F.concat_ws("/", a, F.concat(F.lit("id="), number), F.concat_ws("_", b, c, date(""))), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), F.initcap(d), digits, F.upper(e)),
    ]
    kind = F.lit(None).cast("string")
    for k, x in enumerate(named):
        kind = F.when(i % len(named) == k, x).otherwise(kind)
    ids = spark.range(first, first + n)
    return ids.select(made.alias("sample"), F.lit(True).alias("random")).unionByName(ids.select(kind.alias("sample"), F.lit(False).alias("random")))


def code(c: Column) -> Column:
    """1.. for characters of the alphabet, 0 for others."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of first-order transitions, row-major over codes 0..len(ALPHABET).

    Both models are counted in one aggregate over the samples; the table has a fixed size whatever they are. Null samples count nothing.
    """
    k = len(ALPHABET) + 1
    pairs = samples.where("length(sample) > 1").select("random", F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("i"), "sample")
    pairs = pairs.select("random", F.expr(f"instr('{ALPHABET}', substr(sample, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substr(sample, i + 1, 1))").alias("b"))
    seen = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}  # at most 2 * k * k rows
    rows = {(m, a): sum(seen.get((m, a, b), 0) for b in range(k)) for m in (True, False) for a in range(k)}
    p = lambda m, a, b: (seen.get((m, a, b), 0) + smooth) / (rows[m, a] + smooth * k)
    return [math.log(p(True, a, b) / p(False, a, b)) for a in range(k) for b in range(k)]


def ratio(s: Column, table: Column) -> Column:
    """The largest sum of log-likelihood ratios over consecutive transitions of s: a name or path beside a random part takes nothing off."""
    k = len(ALPHABET) + 1
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))

    def step(acc, c):
        here = code(c)
        now = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.greatest(acc["now"] + F.element_at(table, (acc["last"] * k + here + 1).cast("int")), F.lit(0.0)))
        return F.struct(here.alias("last"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(F.split(s, ""), start, step, lambda acc: acc["best"])


def calibrated(spark: SparkSession, table: list[float]) -> float:
    """The threshold that a share FALSE of ordinary samples passes, none of which the table was trained on."""
    held = labelled_samples(spark, 4000, 1_000_000).where("not random")
    return held.agg(F.percentile(ratio(F.col("sample"), F.array(*[F.lit(x) for x in table])), 1 - FALSE)).first()[0]


def found(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Leftmost non-overlapping matches of pattern as structs (s, e, k, m): code points, end exclusive."""
    row = "struct<s:int,e:int,k:int,m:string>"
    none = F.array().cast(f"array<{row}>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.when(gate, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(df: DataFrame, text: str = "text", table: list[float] | None = None, threshold: float | None = None) -> DataFrame:
    """df and `secrets`: an array of (s, e, k, m) by start, then kind; k indexes KINDS, m is the matched text.

    The base kinds are exact. Kind `markov` adds what base spans leave of runs of 20 and more token characters (LEAST
    and more of it), if it holds a digit and a letter and its score (see ratio) is over `threshold` (default: see calibrated).
    The span is the whole of it, so that no end of a secret stays.
    Null and empty texts have none. A df column named `secrets` is replaced; other columns pass.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    table = train(labelled_samples(df.sparkSession)) if table is None else table
    threshold = calibrated(df.sparkSession, table) if threshold is None else threshold
    ratios = F.array(*[F.lit(x) for x in table])
    low = F.lower(body)
    named = F.contains(low, F.lit("token")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("passw")) | F.contains(low, F.lit("key"))
    marked = F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))
    assign = F.filter(found(body, ASSIGN, 0, marked & named), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = found(body, ACCESS, 1, F.contains(body, F.lit("AKIA")))
    hexes = found(body, HEX, 2, F.rlike(body, F.lit(HEX)))
    out = df.withColumn("secrets", F.concat(assign, access, hexes))
    more = found(body, CANDIDATE, 3, F.rlike(body, F.lit(CANDIDATE)))
    base = F.array_sort("secrets")

    def piece(x, s, e):
        return F.struct(s.alias("s"), e.alias("e"), x["k"].alias("k"), F.substring(x["m"], s - x["s"] + 1, e - s).alias("m"))

    def left(x):  # the pieces of a run between the base spans in it
        def step(acc, y):
            return F.struct(F.greatest(acc["at"], y["e"]).alias("at"), F.when(y["s"] > acc["at"], F.concat(acc["out"], F.array(piece(x, acc["at"], y["s"])))).otherwise(acc["out"]).alias("out"))

        inside = F.filter(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
        start = F.struct(x["s"].alias("at"), F.array().cast("array<struct<s:int,e:int,k:int,m:string>>").alias("out"))
        return F.aggregate(inside, start, step, lambda acc: F.when(acc["at"] < x["e"], F.concat(acc["out"], F.array(piece(x, acc["at"], x["e"])))).otherwise(acc["out"]))

    pieces = F.when(F.size("secrets") > 0, F.flatten(F.transform(more, left))).otherwise(more)
    judged = F.filter(pieces, lambda x: (F.length(x["m"]) >= LEAST) & F.rlike(x["m"], F.lit("[0-9]")) & F.rlike(x["m"], F.lit("[A-Za-z]")) & (ratio(x["m"], ratios) > threshold))
    return out.withColumn("secrets", F.array_sort(F.concat("secrets", judged)))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row. Other columns aren't read."""
    s = scan(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "secrets")
    n = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["k"] < 3)
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), n(3).alias("n_markov"))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every secret in the text replaced by `mark`; overlapping spans are replaced once. Nulls stay null."""
    s = scan(df, text)
    row = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def step(acc, x):
        gap = F.substring(body, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("secrets", row, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return s.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(body)).select(*df.columns)


#: Base columns for tests and the oracle, in DuckDB.
BASE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, k, re) AS (VALUES ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{24,}')),
m AS (SELECT doc_id, kind, k, re, text, regexp_extract_all(text, re) AS hits FROM d, p WHERE regexp_matches(text, re)),
w(doc_id, kind, k, hits, i, rest, pos, s, hit) AS (
  SELECT doc_id, kind, k, hits, 0, text, 0, 0, '' FROM m
  UNION ALL
  SELECT doc_id, kind, k, hits, i + 1, substr(rest, strpos(rest, hits[i + 1]) + len(hits[i + 1])), pos + strpos(rest, hits[i + 1]) - 1 + len(hits[i + 1]), pos + strpos(rest, hits[i + 1]) - 1, hits[i + 1]
  FROM w WHERE i < len(hits)),
f AS (SELECT doc_id, kind, k, s, s + len(hit) AS e FROM w WHERE i > 0 AND CASE kind WHEN 'access' THEN len(hit) >= 20 WHEN 'hex' THEN len(hit) >= 24
      ELSE len(regexp_extract(hit, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

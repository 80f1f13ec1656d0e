"""LM scoring by a probabilistic suffix tree over bytes, and a unigram base score over words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, slices, small_batches

#: Longest context, in symbols. Symbols: 0 before the text, 1 + byte, END after it; BITS bits each in a packed gram.
DEPTH, END, BITS = 5, 257, 9
SYMBOLS = 258
#: Grams scored at once, and table rows (16 bytes each) broadcast at once: a larger tree is scored in as many passes as it takes.
BLOCK, PART = 1 << 20, 3_000_000
#: Slots of a scoring worker's memory of grams (16 bytes each): a gram takes the slot its hash names from the one before. It saves time only.
MEMORY = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this length, with at least this share of all tokens, are scored beside the text: at most HOT of them.
HOT, HOT_BYTES = 400_000, 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one array (DEPTH zeros, the words joined by a space, END), and where each text starts."""
    raw = [b" ".join(w) for w in texts]
    n = np.array([len(r) + DEPTH + 1 for r in raw], np.int64)
    starts = np.r_[0, np.cumsum(n)]
    out = np.zeros(starts[-1], np.int64)
    inside = np.ones(starts[-1], bool)
    for k in range(DEPTH):
        inside[starts[:-1] + k] = False
    inside[starts[1:] - 1] = False
    out[inside] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + 1
    out[starts[1:] - 1] = END
    return out, starts


def grams(s: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each symbol of a text: its context, the latest symbol in the high bits, then the symbol.

    So a shorter context of the same gram is a right shift of it, and sorted grams have sorted contexts at every depth.
    """
    key = s[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= s[DEPTH - k : len(s) - k] << (BITS * (DEPTH + 1 - k))
    return key[s[DEPTH:] > 0]


def added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's times."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


def counts(df: DataFrame, text: str) -> DataFrame:
    """(gram, word, n) of all texts: grams with word null and words with gram null, added up in the task before the shuffle."""
    small_batches(df.sparkSession)

    def batch(gram, word, n):
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["gram", "word", "n"])

    def run(batches):
        held: Counter = Counter()
        parts, size = [], 0

        def emptied(keys, times):
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield batch(part, [None] * len(part), times[a : a + 100_000])

        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in slices([t or "" for t in texts]):
                words = [words_of(t) for t in texts[a:z]]
                for w in words:
                    held.update(w)
                parts.append(np.unique(grams(symbols(words)[0]), return_counts=True))
                size += len(parts[-1][0])
                if len(held) > 300_000:
                    yield batch([None] * len(held), list(held), list(held.values()))
                    held.clear()
                if size > 4_000_000:
                    parts = [added(*map(np.concatenate, zip(*parts, strict=True)))]
                    size = len(parts[0][0])
                    if size > 2_500_000:
                        yield from emptied(*parts[0])
                        parts, size = [], 0
        if parts:
            yield from emptied(*added(*map(np.concatenate, zip(*parts, strict=True))))
        if held:
            yield batch([None] * len(held), list(held), list(held.values()))

    return df.select(F.col(text).alias("text")).mapInArrow(lambda batches: released(run(batches)), "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


def totals(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted grams: the contexts, their totals, and each gram's context by index."""
    ctx = grams >> BITS
    new = np.r_[True, ctx[1:] != ctx[:-1]]
    first = np.flatnonzero(new)
    return ctx[first], np.add.reduceat(n, first), np.cumsum(new) - 1


def shorter(grams: np.ndarray) -> np.ndarray:
    """The grams without their oldest symbol."""
    return grams >> (2 * BITS) << BITS | grams & ((1 << BITS) - 1)


def gains(grams: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-likelihood (nats) that each context of the grams gains over its suffix, whose counts are in `below`."""
    _, total, own = totals(grams, n)
    _, under, at = totals(*below)
    i = np.searchsorted(below[0], shorter(grams))
    return np.bincount(own, n * np.log((n / total[own]) / (below[1][i] / under[at[i]])), len(total))


def retained(gram_counts: DataFrame, nats: float, least: int) -> tuple[DataFrame, np.ndarray]:
    """Next-symbol counts of the contexts that the divergence test keeps, and of their suffixes: (pair, depth, gram, n)
    from depth 2, where pair is a context's two latest symbols; and rows (depth, ctx, sym, n) of the root and depth 1.

    A context stays if it was seen `least` times and the log-likelihood it gains over its suffix (its count
    times the Kullback-Leibler divergence) is at least `nats`. This bound is the same at any input size, so the tree grows with the data.
    All contexts under one pair, added up before they are shuffled, are tested together.
    """
    shift = BITS * (DEPTH - 1)
    two = gram_counts.groupBy((F.shiftleft(F.shiftright("gram", BITS * DEPTH), BITS) + F.col("gram").bitwiseAND((1 << BITS) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 258 * 258 rows
    one = added(two["gram"].to_numpy(), two["n"].to_numpy())

    def subtree(table: pa.Table) -> pa.Table:
        pair = table["pair"][0].as_py()
        levels = {DEPTH: added(table["gram"].to_numpy(), table["n"].to_numpy()), 1: one}
        for d in range(DEPTH - 1, 1, -1):
            levels[d] = added(shorter(levels[d + 1][0]), levels[d + 1][1])
        out, longer = [], np.zeros(0, np.int64)
        for d in range(DEPTH, 1, -1):
            g, n = levels[d]
            ctx, total, own = totals(g, n)
            keep = (total >= least) & (gains(g, n, levels[d - 1]) >= nats) | np.isin(ctx, longer)
            longer = ctx[keep] >> BITS
            rows = keep[own]
            out.append((np.full(rows.sum(), d), g[rows], n[rows]))
        depth, g, n = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"pair": pa.array(np.full(len(g), pair), pa.int64()), "depth": pa.array(depth, pa.int32()), "gram": pa.array(g, pa.int64()), "n": pa.array(n, pa.int64())})

    deep = cut(gram_counts.withColumn("pair", F.shiftright("gram", shift)).groupBy("pair").applyInArrow(subtree, "pair long, depth int, gram long, n long"))
    if not len(one[0]):
        return deep, np.zeros((0, 4), np.int64)
    root = added(one[0] & ((1 << BITS) - 1), one[1])
    ctx, total, own = totals(*one)
    longer = deep.select(F.shiftright("pair", BITS).alias("c")).distinct().toArrow()["c"].to_numpy()
    keep = ((total >= least) & (gains(*one, root) >= nats) | np.isin(ctx, longer))[own]
    rows = [np.c_[np.zeros_like(root[0]), np.zeros_like(root[0]), root[0], root[1]], np.c_[np.ones_like(own), ctx[own], one[0] & ((1 << BITS) - 1), one[1]][keep]]
    return deep, np.concatenate(rows)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * _ODD >> np.uint64(64 - MEMORY)).view(np.int64)


class Tree:
    """The suffix tree as sorted tables by depth: contexts with the weight left to their suffix, and grams with their probability.

    A symbol's probability is (n + gamma * p) / (N + gamma), with the counts of its longest retained context and p
    that of the context's suffix. With `own`, only grams whose two latest context symbols it marks are scored.
    """

    def __init__(self, rows, gamma: float = 2.0, own: np.ndarray | None = None):
        rows = np.array(rows, np.int64).reshape(-1, 4)
        p = np.full(SYMBOLS, 1 / (SYMBOLS - 1))
        root = rows[rows[:, 0] == 0]
        n = np.zeros(SYMBOLS)
        n[root[:, 2]] = root[:, 3]
        p = (n + gamma * p) / (n.sum() + gamma)
        self.root, self.levels, self.own, self.memory = np.log10(p), [], own, None
        below = np.arange(SYMBOLS), p
        for d in range(1, int(rows[:, 0].max(initial=0)) + 1):
            r = rows[rows[:, 0] == d]
            g, n = added(r[:, 1] << BITS | r[:, 2], r[:, 3])
            if not len(g):
                break
            ctx, total, at = totals(g, n)
            p = (n + gamma * below[1][np.searchsorted(below[0], shorter(g))]) / (total[at] + gamma)
            self.levels.append((ctx, np.log10(gamma / (total + gamma)), g, np.log10(p)))
            below = g, p

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context; fast if the grams are sorted."""
        sym = keys & ((1 << BITS) - 1)
        out, live = self.root[sym], np.arange(len(keys))
        for d, (ctxs, left, known, p) in enumerate(self.levels, 1):
            ctx = keys[live] >> (BITS * (DEPTH + 1 - d))
            i = np.minimum(np.searchsorted(ctxs, ctx), len(ctxs) - 1)
            hit = ctxs[i] == ctx
            live, ctx, i = live[hit], ctx[hit], i[hit]
            if not len(live):
                break
            g = ctx << BITS | sym[live]
            j = np.minimum(np.searchsorted(known, g), len(known) - 1)
            out[live] = np.where(known[j] == g, p[j], out[live] + left[i])
        return out

    def recalled(self, keys: np.ndarray) -> np.ndarray:
        """logs(keys), in any order: what the memory lacks is sorted, scored once and remembered."""
        if self.memory is None:
            self.memory = np.zeros(1 << MEMORY, np.int64), np.zeros(1 << MEMORY)
        held, value = self.memory  # no gram is 0
        slot = _slots(keys)
        out = value[slot]
        miss = np.flatnonzero(held[slot] != keys)
        if len(miss):
            each, back = np.unique(keys[miss], return_inverse=True)
            p, at = self.logs(each), _slots(each)
            out[miss] = p[back]
            held[at] = each
            mine = held[at] == each  # of new grams in one slot, one stays
            value[at[mine]] = p[mine]
        return out

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text (of its own grams)."""
        s, starts = symbols(texts)
        keys, owner = grams(s), np.repeat(np.arange(len(texts)), np.diff(starts) - DEPTH)
        total = np.zeros(len(texts))
        for a in range(0, len(keys), BLOCK):
            k, o = keys[a : a + BLOCK], owner[a : a + BLOCK]
            if self.own is not None:
                mine = self.own[k >> (BITS * (DEPTH - 1))]
                k, o = k[mine], o[mine]
            total += np.bincount(o, self.recalled(k), len(texts))
        return total


def parts_of(deep: DataFrame, top: np.ndarray):
    """(rows, own) of trees of at most about PART rows (or one pair's) that together score every gram once."""
    held = deep.groupBy("pair").agg(F.count("*").alias("n")).orderBy("pair").toArrow()  # at most 258 * 258 rows
    pair, n = held["pair"].to_numpy(), held["n"].to_numpy()
    part = (np.cumsum(n) - 1) // PART if len(n) else n
    for k in range(int(part.max(initial=0)) + 1):
        own, mine = None, deep
        if part.max(initial=0):
            inside = pair[part == k]
            if not len(inside):
                continue
            own = np.zeros(1 << (2 * BITS), bool)
            last = pair[part > k].min(initial=len(own))
            own[0 if k == 0 else inside[0] : last] = True  # pairs that the tree lacks go with the part before them
            mine = deep.where(F.col("pair").between(int(inside[0]), int(inside[-1])))
        t = mine.select("depth", "gram", "n").toArrow()
        g = t["gram"].to_numpy()
        yield np.concatenate([top, np.c_[t["depth"].to_numpy(), g >> BITS, g & ((1 << BITS) - 1), t["n"].to_numpy()]]), own


def score(df: DataFrame, train: DataFrame, text: str = "text", doc_id: str = "doc_id", nats: float = 20.0, least: int = 8) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of df; the models come from the rows of `train`.

    Tree: see retained and Tree; every text of `train` is counted, and the counts meet in a shuffle. The tree grows with `train`; it goes
    to the tasks in parts of at most about PART rows, each of which scores its share of every text's grams in a pass of its own. score is the log10 probability of the text's words, joined by one space, and the end.
    Base: the sum over tokens (words and one end) of log10((c + 1) / (N + V + 1)). Words with at least N / HOT of the
    tokens (at most HOT words) are looked up beside the text; all others are joined with their counts, so frequent words make no hot key.

    Null texts count as empty: one end token. Rows that repeat a doc_id and text get equal results; null
    doc_ids are scored. An empty `train` leaves uniform symbols and c = N = V = 0; an empty df gives no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    made = cut(counts(train, text))
    trees = [spark.sparkContext.broadcast(Tree(rows, own=own)) for rows, own in parts_of(*retained(made.where("gram is not null").select("gram", "n"), nats, least))]
    known = made.where("word is not null").select("word", F.col("n").alias("c"))
    n_docs = train.count()
    facts = known.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (facts[0] or 0) + n_docs, facts[1] + (n_docs > 0)
    floor = math.log10(total + distinct + 1)
    hot = {r["word"]: r["c"] for r in known.where(F.col("c") * HOT >= total).where(F.octet_length("word") <= HOT_BYTES).collect()}
    frequent = spark.sparkContext.broadcast({bytes(w): math.log10(c + 1) - floor for w, c in hot.items()})
    end = math.log10(n_docs + 1) - floor
    # rows are told apart by hashes of id and text: 96 bits
    key = [F.xxhash64(doc_id, text).alias("h"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1)).cast("long").alias("h2")]
    kind = dict(df.dtypes)[doc_id]
    given = df.select(F.col(doc_id).alias("doc_id"), *key, F.col(text).alias("text"))
    small_batches(spark)

    names = ["doc_id", "h", "h2", "n_tokens", "k", "base", "score"]

    def heads(batches):
        model, look = trees[0].value, frequent.value.get
        for b in batches:
            texts = b.column(3).to_pylist()
            n, k, base, got = [], [], [], []
            for a, z in slices([t or "" for t in texts]):
                words = [words_of(t) for t in texts[a:z]]
                got += model.scores(words).tolist()
                for w in words:
                    found = [x for x in map(look, w) if x is not None]
                    n.append(len(w) + 1)
                    k.append(len(found) + (n_docs > 0))
                    base.append(math.fsum(found) + end)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base, pa.float64()), pa.array(got, pa.float64())], names=names)

    def further(tree):
        def run(batches):
            model = tree.value
            for b in batches:
                texts = b.column(3).to_pylist()
                got = [x for a, z in slices([t or "" for t in texts]) for x in model.scores([words_of(t) for t in texts[a:z]]).tolist()]
                none = [pa.nulls(len(got), t) for t in (pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *none, pa.array(got, pa.float64())], names=names)

        return run

    def rare(batches):
        look = frequent.value
        for b in batches:
            for h, h2, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                left = Counter(w for w in words_of(t) if w not in look)
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(left), pa.int64()), pa.array([h2] * len(left), pa.int64()), pa.array(list(left), pa.binary()), pa.array(list(left.values()), pa.int64())], names=["h", "h2", "word", "times"])

    schema = f"doc_id {kind}, h long, h2 long, n_tokens long, k long, base double, score double"
    head = given.mapInArrow(heads, schema)
    for tree in trees[1:]:
        head = head.unionByName(given.mapInArrow(further(tree), schema))
    head = head.groupBy("h", "h2", "doc_id").agg(F.count("n_tokens").alias("copies"), *[F.max(c).alias(c) for c in ("n_tokens", "k", "base")], (F.sum("score") / F.count("n_tokens")).alias("score"))
    head = cut(head)
    tail = given.select("h", "h2", "text").mapInArrow(rare, "h long, h2 long, word binary, times long").join(known, "word", "left")
    tail = tail.groupBy("h", "h2").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rk"), F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - floor)).alias("rb"))
    out = head.join(tail, ["h", "h2"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_tokens", (F.col("k") + F.coalesce(F.col("rk") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce(F.col("rb") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score")


#: The base columns, for tests, in DuckDB. `train` and `documents` are views; train's rows are those learned from.
BASE_SQL = r"""
WITH w AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM train),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w UNION ALL SELECT NULL, count(*) FROM train HAVING count(*) > 0),
f AS (SELECT sum(c) AS n, count(*) AS v FROM c),
t AS (SELECT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), NULL)) AS w FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM t LEFT JOIN c ON t.w IS NOT DISTINCT FROM c.w, f GROUP BY doc_id
"""

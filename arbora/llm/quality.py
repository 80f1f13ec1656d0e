"""Quality rules: exact text statistics and robust multivariate outliers (minimum covariance determinant)."""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, small, small_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics: log words, mean word length, symbols, digits, repeated lines, repeated windows, distinct words.
FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5", "f6"]
#: Least standard deviation of each statistic in a fit: smaller spreads are no ground to reject. Shares that are bounded (repeated lines
#: by 1, repeated windows by 0.5 after the base rule) have floors at which they can reject on their own.
FLOOR = [0.7, 0.6, 0.25, 0.35, 0.15, 0.08, 0.35]
P = len(FEATURES)
_SPACE = re.compile("[\x20\x09-\x0d]+")
_SYMBOLS = {ord(c): None for c in "#*$%&|<>"}
_DIGITS = {ord(c): None for c in "0123456789"}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of a text and its transformed statistics."""
    text = text or ""
    words = [w for w in _SPACE.split(text) if w]
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(_SYMBOLS))
    digits = len(text) - len(text.translate(_DIGITS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if _SPACE.sub("", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated, ids = 0, {}
    if n >= 3:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : k + n - 2] |= again
            repeated = int(inside.sum())
    distinct = len(ids) if n >= 3 else len(set(words))
    m = max(n, 1)
    f = [math.log1p(n), chars / m, 4 * math.sqrt(symbols / max(chars, 1)), 4 * math.sqrt(digits / max(chars, 1)), dup / max(lines, 1), repeated / m, math.log1p(distinct) - 0.8 * math.log1p(n)]
    return [n, chars, symbols, dup, repeated], f


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (default: all) and each row's counts and features, one pass, no shuffle."""
    keep = df.columns if keep is None else keep
    small_batches(df.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    given = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("body"))
    types = dict(given.dtypes)
    schema = ", ".join([f"{x} {types[x]}" for x in names] + [f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES])

    def run(batches):
        for b in batches:
            got = [statistics(t) for t in b.column(len(names)).to_pylist()]
            cols = [b.column(i) for i in range(len(names))]
            cols += [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            cols += [pa.array([g[1][i] for g in got], pa.float64()) for i in range(P)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *COUNTS, *FEATURES])

    out = given.mapInArrow(lambda batches: released(run(batches)), schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], *COUNTS, *FEATURES)


def chi2_cdf(x: float, k: float) -> float:
    return NormalDist().cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def chi2_quantile(p: float, k: float) -> float:
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """(lang, source, grp): the group whose fit judges a (lang, source): itself if it has `least` rows, else the
    pool of the small sources of its language, else the pool of all such rows; null if that is small too."""
    n = stats.groupBy("lang", "source").count()
    own = F.when(F.col("count") >= least, F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source")))
    n = n.withColumn("own", own)
    pool = n.where("own is null").groupBy("lang").agg(F.sum("count").alias("pooled")).withColumn("lk", F.when(F.col("pooled") >= least, F.to_json(F.struct(F.lit("l").alias("k"), "lang"))))
    rest = pool.where("lk is null").agg(F.sum("pooled")).first()[0] or 0
    last = F.lit("rest") if rest >= least else F.lit(None).cast("string")
    p = pool.select(F.col("lang").alias("l2"), "lk")
    return n.join(p, n["lang"].eqNullSafe(p["l2"]), "left").select("lang", "source", F.coalesce("own", "lk", last).alias("grp"))


def distance() -> F.Column:
    """Squared Mahalanobis distance of the features from a row's fit (center, and inv by rows)."""
    z = [F.col(f) - F.element_at("center", i + 1) for i, f in enumerate(FEATURES)]
    terms = [z[i] * z[j] * F.element_at("inv", i * P + j + 1) * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Starts of a fit, steps before the best one goes on alone, and the most steps in all.
STARTS, TRIED, STEPS = 4, 2, 8
#: Partitions of what has a few rows for each (language, source).
FEW = 4


def moments() -> list:
    """Count, sums and sums of products of the features, as aggregates."""
    return [F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"x{i}_{j}") for i, j in _PAIRS]]


def estimate(pdf: pd.DataFrame, factor: float = 1.0) -> tuple[list, list, float]:
    """(center, inverse covariance by rows, log determinant) of the rows whose moments pdf adds up to; spreads under FLOOR are lifted to it."""
    n = pdf["n"].sum()
    mean = np.array([pdf[f"s{i}"].sum() / n for i in range(P)])
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = pdf[f"x{i}_{j}"].sum() / n - mean[i] * mean[j]
    cov = cov * factor
    cov += np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 0) + 1e-6 * np.square(FLOOR))  # a spread over the floor stays as it is
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def made(sums: DataFrame, by: list[str], make, schema: str) -> DataFrame:
    """make(pdf) of each group's rows, in FEW partitions; all columns but `by` are numbers, which become doubles.

    A group's rows, few as they are, are collected into one, and these are dealt to FEW tasks before they go to Python: where a task
    runs Python for one partition after the other, it holds the Arrow memory of all of them until it ends.
    """
    names = [c for c in sums.columns if c not in by]
    small_batches(sums.sparkSession)
    rows = sums.groupBy(*by).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in names])).alias("rows")).coalesce(FEW)

    def run(pdfs):
        for pdf in pdfs:
            for i in range(len(pdf)):
                yield make(pd.DataFrame(np.stack(pdf["rows"].iloc[i]), columns=names).assign(**{c: pdf[c].iloc[i] for c in by}))

    return rows.mapInPandas(lambda pdfs: released(run(pdfs)), schema)


def fit(stats: DataFrame, share: float = 0.5, least: int = 64) -> DataFrame:
    """Minimum-covariance-determinant fits (lang, source, center, inv) from all rows of `stats`.

    Per group the half of the rows is sought whose covariance has the least determinant. Starts: medians and quartile ranges; mean and
    covariance of all rows; the same of two eighths, dealt by a hash of the statistics. A concentration step keeps the rows nearest by the
    fit so far (the bins of the log distance that reach `share` of the rows) and refits mean and covariance on them. After TRIED steps
    the start of least determinant goes on until the logarithm of its determinant moves by less than 0.01, STEPS steps in all at most. Then the fit is reweighted: mean and covariance of
    all rows within the 0.975 quantile. A step is one aggregate of moments per (group, start, bin), combined before its shuffle, so a hot group
    costs no more than any other; only sums per group and bin reach the Python fit.
    """
    groups = small(cut(grouped(stats, least).coalesce(FEW)))
    rows = stats.alias("t").join(groups.alias("g"), F.expr("t.lang <=> g.lang and t.source <=> g.source")).where("grp is not null").select("grp", *FEATURES)
    q = rows.groupBy("grp").agg(*[F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f) for f in FEATURES])
    scale = [F.greatest((F.element_at(f, 3) - F.element_at(f, 1)) / 1.349, F.lit(s)) for f, s in zip(FEATURES, FLOOR, strict=True)]
    schema = "grp string, start int, center array<double>, inv array<double>, det double, still boolean"
    fits = q.select("grp", F.lit(0).alias("start"), F.array(*[F.element_at(f, 2) for f in FEATURES]).alias("center"), F.array(*[F.lit(0.0) if i != j else 1 / (scale[i] * scale[i]) for i in range(P) for j in range(P)]).alias("inv"), F.lit(float("inf")).alias("det"), F.lit(False).alias("still"))
    alpha = chi2_quantile(share, P)
    factor = share / chi2_cdf(alpha, P + 2)

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf, *[p for k in range(STARTS - 2) if (p := pdf[pdf["eighth"] == k])["n"].sum() > 0]]
        return pd.DataFrame([(pdf["grp"].iloc[0], k, *estimate(p), False) for k, p in enumerate(parts, 1)], columns=["grp", "start", "center", "inv", "det", "still"])

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        inside = pdf[(pdf["n"].cumsum() - pdf["n"]) < share * pdf["n"].sum()]
        center, inv, det = estimate(inside, factor)
        still = abs(det - pdf["det"].iloc[0]) < 0.01
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "start": [pdf["start"].iloc[0]], "center": [center], "inv": [inv], "det": [det], "still": [still]})

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        center, inv, det = estimate(pdf, 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "start": [0], "center": [center], "inv": [inv], "det": [det], "still": [True]})

    eighths = rows.withColumn("eighth", F.pmod(F.xxhash64(*FEATURES), F.lit(8)).cast("int"))
    fits = cut(fits.coalesce(FEW).unionByName(made(eighths.groupBy("grp", "eighth").agg(*moments()), ["grp"], begun, schema)))
    for step in range(STEPS):
        live = fits.where("not still")
        bins = rows.join(small(live), "grp").withColumn("bin", F.floor(F.log2(distance() + 1e-6) * 16).cast("int"))
        fresh = made(bins.groupBy("grp", "start", "bin").agg(*moments(), F.max("det").alias("det")), ["grp", "start"], refit, schema)
        if step == TRIED - 1:  # the best start of each group goes on
            fresh = fresh.groupBy("grp").agg(F.min_by(F.struct(*[c for c in fits.columns if c != "grp"]), F.struct("det", "start")).alias("b")).select("grp", "b.*").withColumn("still", F.lit(False)).coalesce(FEW)
        fits = cut(fresh if step < TRIED else fits.where("still").coalesce(FEW).unionByName(fresh))
        if step >= TRIED and fits.where("not still").isEmpty():
            break
    near = rows.join(small(fits), "grp").where(distance() <= chi2_quantile(0.975, P))
    fits = made(near.groupBy("grp").agg(*moments()), ["grp"], kept, schema)
    return cut(groups.join(small(cut(fits)), "grp", "left").select("lang", "source", "center", "inv"))


def judge(stats: DataFrame, fits: DataFrame, cutoff: float) -> DataFrame:
    """stats with base_failed, distance and kept."""
    f = small(fits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "center", "inv"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.join(f, stats["lang"].eqNullSafe(F.col("_l")) & stats["source"].eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("base_failed", base).withColumn("distance", distance())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).drop("_l", "_s", "center", "inv")


#: Rejected beyond this quantile of the chi-square law of the squared distance.
QUANTILE = 0.99


def quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, quantile: float = QUANTILE, least: int = 64) -> DataFrame:
    """Counts, base rule and robust verdict of every row: the columns of `keep` (default: doc_id), the five
    counts, base_failed, distance, kept.

    Null texts count as empty and fail the base rule. Null languages and sources are groups. Groups under
    `least` rows are pooled (see grouped); where even the pool is small only the base rule judges. Repeated
    rows count each; an empty table gives no rows; columns outside `keep` are not returned, whatever their names.
    """
    keep = ["doc_id"] if keep is None else keep
    plain = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in keep])
    narrow = text not in keep
    stats = with_statistics(plain, "text", [c for c in plain.columns if c != "text"])
    if narrow:  # one pass over the texts; all further steps read the numbers
        stats = cut(stats)
        out = judge(stats, fit(stats, least=least), chi2_quantile(quantile, P))
    else:  # texts are returned: read again rather than shuffled or stored
        fits = fit(cut(stats.select("lang", "source", *COUNTS, *FEATURES)), least=least)
        out = judge(stats, fits, chi2_quantile(quantile, P))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], *COUNTS, "base_failed", "distance", "kept")

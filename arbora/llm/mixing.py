"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, no, target) from (source, source_size): weights repeat `cycle` over the sources by
    code point with null last; the targets share the total by weight, none above `most` times its source.

    The level at which capped sources leave the rest is found in one pass over the sources in order of
    cap / weight: those that the level so far would lift above their cap are capped.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("no", F.row_number().over(w))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.col("no") - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / share)
    capped = F.col("level") * F.col("weight") > F.col("cap")
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return s.withColumn("final", level).select("source", "source_size", "no", F.when(capped, F.col("cap")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def offset(seed: int, no: Column) -> Column:
    """The random offset of a source: 20 bits of an MD5, as a fraction."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), no.cast("string")).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cycle: tuple = (1, 2, 3), most: int = 3, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """How often each row of df enters a mix whose sources meet target shares of all words.

    A document of a source is expected target / source_size times. Systematic sampling: the expected copies
    are summed in order of size (then doc_id) within the source, one random offset is added, and a copy is
    emitted at each integer crossed. Sorting by size keeps a source's words within about one document of its target.
    The order is made by a range partition on (source, size, doc_id), so a hot source spreads over tasks;
    ranks are local row numbers plus counts of earlier partitions.

    Returns doc_id, size, source_size, target, copies, taken and the columns of `keep`. Null texts have no
    words; null sources are one source; a source without words has target 0 and no copies; repeated rows are
    sampled on their own; an empty table gives no rows; other columns are not read.
    """
    keep = [c for c in keep or [] if c != doc_id]
    base = df.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    ranged = cut(base.repartitionByRange(F.col("_source"), F.col("_size"), F.col("_id")).withColumn("_part", F.spark_partition_id()))
    parts = cut(ranged.groupBy("_source", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")))  # a few rows per source and task
    per_source = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    goal = targets(per_source, cycle, most)
    ahead = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_source", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    facts = cut(starts.join(goal, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "_start", "no", "source_size", "target"))
    rank = F.row_number().over(Window.partitionBy("_part", "_source").orderBy("_size", "_id")) + F.col("_start")
    rows = ranged.join(small(facts), ranged["_source"].eqNullSafe(facts["_s"]) & (ranged["_part"] == facts["_p"]))
    rows = rows.withColumn("_rank", rank).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    u = offset(seed, F.col("no"))
    copies = F.least(F.floor(F.col("_rate") * F.col("_rank") + u) - F.floor(F.col("_rate") * (F.col("_rank") - 1) + u), F.lit(most)).cast("int")
    return rows.withColumn("copies", copies).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), *[F.col(f"_k_{c}").alias(c) for c in keep]
    )


def drawn(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it (see mix): 0 to `most` times.

    The mix is made on ids, sources and sizes alone; texts are joined with their copies once, without a shuffle where
    the taken ids are few enough to broadcast. Rows that repeat a doc_id (or have none) are told apart by source, size and
    a number among their likes, which are equal in all that the mix looks at. Column names of df may be any.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(df.columns, names, strict=True)])
    at = {k: names[df.columns.index(c)] for k, c in (("text", text), ("source", source), ("id", doc_id))}
    taken = cut(mix(rows, at["text"], at["source"], at["id"], keep=[at["source"]], **how).select(F.col("doc_id").alias("_i"), F.col(at["source"]).alias("_s"), F.col("size").alias("_z"), "copies"))
    if taken.groupBy("_i").count().where("count > 1 or _i is null").isEmpty():
        both = rows.join(small(taken.where("copies > 0").select("_i", "copies")), F.col(at["id"]) == F.col("_i"))
    else:
        taken = taken.withColumn("_t", F.row_number().over(Window.partitionBy("_i", "_s", "_z").orderBy("copies")))
        sized = rows.withColumn("_size", word_count(F.col(at["text"])))
        sized = sized.withColumn("_tie", F.row_number().over(Window.partitionBy(at["id"], at["source"], "_size").orderBy(F.crc32(F.col(at["text"]).cast("binary")))))
        same = F.col(at["id"]).eqNullSafe(F.col("_i")) & F.col(at["source"]).eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_tie") == F.col("_t"))
        both = sized.join(small(taken.where("copies > 0")), same)
    out = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(x).alias(c) for c, x in zip(df.columns, names, strict=True)])


#: The query's rows, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CAST((no - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, no, CASE WHEN level * weight > cap THEN cap ELSE least(final * weight, cap) END AS target,
      CAST(CAST('0x' || substr(md5('7:' || no), 1, 5) AS BIGINT) AS DOUBLE) / 1048576.0 AS u FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
      row_number() OVER (PARTITION BY t.no ORDER BY d.size, d.doc_id) AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * i + u) - floor(rate * (i - 1) + u), 3) AS BIGINT) * size AS taken FROM r
"""

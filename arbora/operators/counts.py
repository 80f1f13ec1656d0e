"""Counts beyond inner equi-joins: bounded, unequal, outer, semi, anti, range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.messages import BIG, aggregate
from arbora.operators.reducer import tuples
from arbora.plans.ir import Aggregate, JoinGraph, SpecError

_COUNT = [Aggregate("count", "count")]


def count(g: JoinGraph) -> DataFrame:
    """The join's cardinality; an inequality x <> y counts all tuples less those with x = y (null x or y count in neither)."""
    if g.unequal is None:
        return aggregate(g, _COUNT)
    (a, x), (b, y) = g.unequal
    known = {r: df for r, df in g.relations.items()}
    known[a], known[b] = known[a].where(F.col(f"`{x}`").isNotNull()), known[b].where(F.col(f"`{y}`").isNotNull())
    both = aggregate(JoinGraph(known, g.equal), _COUNT)
    same = aggregate(JoinGraph(known, [*g.equal, g.unequal]), _COUNT).select(F.col("count").alias("same"))
    return both.withColumn("one", F.lit(1)).join(same.withColumn("one", F.lit(1)), "one").select((F.col("count") - F.col("same")).alias("count"))


#: A bound up to which the join's first tuples are counted instead of all.
FEW = 1000


def count_at_most(g: JoinGraph, limit: int) -> DataFrame:
    """min(limit, cardinality): nothing is read for 0, the reduced join stops at a small limit, and a larger one takes the count."""
    if limit < 0:
        raise SpecError("a limit can't be negative")
    if limit == 0:
        return next(iter(g.relations.values())).sparkSession.range(1).select(F.lit(0).cast("long").alias("count"))
    if limit <= FEW and g.unequal is None:
        return tuples(g, limit).agg(F.count("*").alias("count"))
    return count(g).select(F.least(F.lit(limit).cast("long"), F.col("count")).alias("count"))


def _by_key(df: DataFrame, on: list[str], name: str) -> DataFrame:
    return df.groupBy(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)]).agg(F.count("*").cast(BIG).alias(name))


def side_count(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str) -> DataFrame:
    """Cardinality of left ⋈ right for how in inner, left, right, full, semi, anti: one row per key meets one row per key.

    An unmatched row of a preserved side counts once; null keys never match.
    """
    l, r = _by_key(left, left_on, "nl"), _by_key(right, right_on, "nr")
    keys = [f"k{i}" for i in range(len(left_on))]
    kind = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}.get(how)
    if kind is None:
        raise SpecError(f"unknown join: {how!r}")
    n = F.col("nl") if how in ("semi", "anti") else F.coalesce("nl", F.lit(1).cast(BIG)) * F.coalesce("nr", F.lit(1).cast(BIG))
    return l.join(r, keys, kind).agg(F.coalesce(F.sum(n.cast(BIG)), F.lit(0)).cast("long").alias("count"))


def outer_count(g: JoinGraph, right: DataFrame, left_key: tuple[str, str], right_on: str, how: str) -> DataFrame:
    """Cardinality of (join of g) outer-joined with `right` last: the inner join is folded per key first."""
    alias, column = left_key
    folded = aggregate(g, [Aggregate("count", "nl")], [left_key]).select(F.col(column).alias("k0"), F.col("nl").cast(BIG).alias("nl"))
    r = _by_key(right, [right_on], "nr")
    n = F.coalesce("nl", F.lit(1).cast(BIG)) * F.coalesce("nr", F.lit(1).cast(BIG))
    return folded.join(r, "k0", how).agg(F.coalesce(F.sum(n.cast(BIG)), F.lit(0)).cast("long").alias("count"))


def range_count(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """How many pairs have left.x < right.y: both sides become one row per value, and a running sum in value order replaces the theta join.

    Ranges of values are summed in parallel (each partition, then the partitions' totals), so nothing passes through one task.
    """
    a = left.where(F.col(f"`{x}`").isNotNull()).groupBy(F.col(f"`{x}`").alias("v")).agg(F.count("*").cast(BIG).alias("n"), F.lit(0).cast(BIG).alias("m"))
    b = right.where(F.col(f"`{y}`").isNotNull()).groupBy(F.col(f"`{y}`").alias("v")).agg(F.lit(0).cast(BIG).alias("n"), F.count("*").cast(BIG).alias("m"))
    both = a.unionByName(b).groupBy("v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    from pyspark.sql import Window

    part = both.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    inside = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("less", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sums = local.groupBy("p").agg(F.sum((F.col("less") * F.col("m")).cast(BIG)).alias("own"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    total = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return total.agg(F.coalesce(F.sum((F.col("own") + F.col("before") * F.col("m")).cast(BIG)), F.lit(0)).cast("long").alias("count"))

"""Statistics of columns: most common values, tails, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_common(df: DataFrame, column: str, k: int = 128) -> DataFrame:
    """(value, freq) of the k most frequent values, approximately, in one mergeable aggregate."""
    top = df.agg(F.expr(f"approx_top_k(`{column}`, {k})").alias("t")).select(F.explode("t").alias("x"))
    return top.select(F.col("x.item").alias("value"), F.col("x.count").alias("freq"))


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct keys, rows, mean and greatest fan-out of the keys."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.avg("n").alias("fanout_mean"), F.max("n").alias("fanout_max"))


def spread_sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows from all over df."""
    n = df.count()
    return df if n <= rows else df.sample(rows / n, seed)

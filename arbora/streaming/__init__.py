"""Join counts over streams: messages are sums, so each batch only adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, key: str, static: DataFrame, static_key: str) -> DataFrame:
    """Per key, the tuples that a stream's rows make with a static relation; run it in `update` or `complete` mode.

    The static side is folded to one row per key first, so each stream row meets at most one row, and the state is a sum per key.
    """
    folded = static.groupBy(F.col(static_key).alias("_k")).agg(F.count("*").alias("_n"))
    return stream.join(folded, F.col(key) == F.col("_k")).groupBy(F.col(key).alias("key")).agg(F.sum("_n").alias("count"))

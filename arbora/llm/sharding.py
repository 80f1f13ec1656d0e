"""Sharding by longest processing time."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Groups of one size up to which the heap deals them out one by one.
ONE_BY_ONE = 4096


def longest_first(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int], list[int]]]:
    """The longest-processing-time schedule of groups given as (size, how many): per size, the shards that take some and the ends of their shares.

    Groups go by falling size, each to the least-loaded shard of a heap (the first on ties). Groups of one size are interchangeable, so
    it is enough to know how many of them each shard takes: of a size's groups in some order, ranks under the first end go to the first shard, and so on.
    """
    heap, out = [(0, s) for s in range(n_shards)], []
    for size, times in sorted(sizes, reverse=True):
        taken: dict[int, int] = {}
        if times > ONE_BY_ONE:
            taken = dealt(dict((s, load) for load, s in heap), size, times)
            heap = [(load + size * taken.get(s, 0), s) for load, s in heap]
            heapq.heapify(heap)
        else:
            for _ in range(times):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                taken[s] = taken.get(s, 0) + 1
        shards = sorted(s for s, n in taken.items() if n)
        ends, end = [], 0
        for s in shards:
            end += taken[s]
            ends.append(end)
        out.append((size, shards, ends))
    return out


def dealt(loads: dict[int, int], size: int, times: int) -> dict[int, int]:
    """How many of `times` equal groups each shard takes from the heap: those whose turns, at loads load + j * size, come first."""
    before = lambda level: {s: max(0, -(-(level - load) // size)) for s, load in loads.items()}  # noqa: E731  turns at a load under level
    low, high = 0, max(loads.values()) + size * times + 1
    while high - low > 1:  # the highest level under which no more than `times` turns lie
        mid = (low + high) // 2
        low, high = (mid, high) if sum(before(mid).values()) <= times else (low, mid)
    taken = before(low)
    left = times - sum(taken.values())
    for s in sorted(loads):
        if left and loads[s] + taken[s] * size == low:
            taken[s], left = taken[s] + 1, left - 1
    return taken


def shard(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_shards: int = 40, cells: int = 256, hot: int = 2560) -> DataFrame:
    """Put every row of df into one of n_shards shards, near equal in bytes; rows of equal text stay together.

    Law `bytes`. A row weighs its text's UTF-8 bytes plus 16. Groups (equal texts, by MD5 and length) are scheduled longest first, every one of them: the
    driver schedules the histogram of their sizes (distinct sizes only, so at most the square root of twice all bytes; see longest_first), and a group finds its shard by
    its rank among those of its size. Ranks and slots are local row numbers plus counts of earlier cells (hashes), so a hot size or
    shard is numbered by `cells` tasks. Groups with 1 / hot of all rows or bytes (at most 2 * hot) are joined with their rows by broadcast,
    so a hot group's rows stay spread.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts weigh 16, have a null crc
    and form one group (apart from empty texts); repeated rows and null doc_ids are rows of their own; an empty table gives
    no rows; other columns are not read.
    """
    spark, body = df.sparkSession, F.col(text)
    base = cut(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.coalesce(F.concat(F.md5(body.cast("binary")), F.lit(":"), F.octet_length(body).cast("string")), F.lit("none")).alias("group_key"),
        )
    )
    cell = F.pmod(F.xxhash64("group_key"), F.lit(cells)).cast("int").alias("cell")
    groups = cut(base.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select("*", cell))
    per_cell = cut(groups.groupBy("bytes", "cell").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")))
    sizes = [(r["bytes"], r["n"]) for r in per_cell.groupBy("bytes").agg(F.sum("n").alias("n")).collect()]
    plan = spark.createDataFrame(longest_first(sizes, n_shards), "bytes long, shards array<int>, ends array<long>")
    all_bytes = sum(b * n for b, n in sizes)
    all_rows = per_cell.agg(F.sum("rows")).first()[0] or 0
    ahead = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most `cells` rows
    starts = per_cell.select("bytes", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")).join(plan, "bytes")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("group_key")) - 1
    ranked = groups.join(starts, ["bytes", "cell"]).withColumn("rank", rank)
    placed = cut(ranked.select("group_key", "bytes", "rows", F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1).alias("shard")))
    is_hot = (F.col("bytes") * hot >= all_bytes) | (F.col("rows") * hot >= all_rows)
    alone = placed.where(is_hot).select("group_key", F.col("shard").alias("alone"))
    others = placed.where(~is_hot).select("group_key", F.col("shard").alias("other"))
    marked = base.join(F.broadcast(alone), "group_key", "left")
    found = marked.where("alone is not null").withColumnRenamed("alone", "shard").unionByName(marked.where("alone is null").drop("alone").join(small(others), "group_key").withColumnRenamed("other", "shard"))
    found = cut(found.select("doc_id", "size", "text_crc32", "group_key", "shard", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(cells)).cast("int").alias("cell")))
    counts = found.groupBy("shard", "cell").count()  # at most n_shards * cells rows
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("shard", "cell", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "group_key"))
    return found.withColumn("at", at).join(F.broadcast(begun), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

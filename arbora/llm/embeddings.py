"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, small_batches
from .components import components


def tables_for(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): bits so that unrelated vectors rarely meet, tables so that a pair at `cosine` is found with probability `recall`."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))) + 2)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) sign hashes of the rows of x; up to 62 bits."""
    planes = np.random.default_rng([11, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    side = (x @ planes > 0).reshape(len(x), tables, bits)
    whole = (side << np.arange(bits)).sum(axis=2)
    return ((whole ^ whole >> 31) & 0x7FFFFFFF).astype(np.int32)  # over 31 bits, folded: buckets may merge, none is split


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have at least that cosine, in double precision; the rows are normalised."""
    return x @ y.T >= cosine


def _cell(table: int, i: int, j: int, rep, n, block, vec, keys, cosine: float):
    """(rep, links, root) of the links first found in this cell: copies linked, and the smallest rep they lead to here."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    hit = linked(vec[left], vec[right], cosine)
    if i == j:
        hit = np.triu(hit, 1)
    a, b = np.nonzero(hit)
    a, b = left[a], right[b]
    if not len(a):
        return None
    first = (keys[a] == keys[b]).argmax(axis=1) == table
    a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
    root = rep.copy()
    while True:  # the least rep along links
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    some = links > 0
    return rep[some], links[some].astype(np.int64), root[some]


def near_vectors(df: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", cosine: float = 0.9, recall: float = 0.97, block: int = 1024) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Equal vectors are one class. A class's vector is hashed in `tables` tables by the signs of `bits` random
    projections, both set from the number of classes (see tables_for). Bucket mates are compared exactly; a pair
    counts in the first table it shares. A bucket of more than `block` vectors is cut into blocks, and each two
    blocks meet in a cell of their own, so no task holds a hot bucket. A cell returns at most one row per vector:
    its copies' links and the least id it leads to, never the pairs.

    Vectors that are null or zero, or hold nulls or non-finite numbers, link with nothing, as do rows of null
    vec_id and vectors of different lengths; their component is their own id. Empty table: no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    classes = cut(rows.where(ok).groupBy("v").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("n")))
    bits, tables = tables_for(classes.count(), cosine, recall)

    def sketch(batches):
        for b in batches:
            v = b.column(0).to_pylist()
            keys: list = [None] * len(v)
            unit: list = [None] * len(v)
            for size in set(map(len, v)):
                at = [i for i, x in enumerate(v) if len(x) == size]
                x = np.array([v[i] for i in at], float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, k, u in zip(at, signs(x, bits, tables).tolist(), x.tolist(), strict=True):
                    keys[i], unit[i] = k, u
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(unit, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int32()))], names=["rep", "n", "unit", "keys"])

    made = cut(classes.select("v", "rep", "n").mapInArrow(sketch, "rep long, n long, unit array<double>, keys array<int>"))
    at = made.select("rep", F.size("unit").alias("dims"), F.posexplode("keys").alias("t", "key"))
    shared = at.groupBy("dims", "t", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    member = at.join(shared, ["dims", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = member.select("dims", "t", "key", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("dims", "t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    cells = cells.join(made, "rep").repartition("dims", "t", "key", "i", "j").sortWithinPartitions("dims", "t", "key", "i", "j")

    def compare(batches):
        def flush(parts):
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            t, i, j = int(cols[0][0]), int(cols[1][0]), int(cols[2][0])
            return _cell(t, i, j, *cols[3:], cosine) if len(cols[3]) > 1 else None

        held: list = []
        name = None
        for b in batches:
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], 1)
            rep, n, blk = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (6, 7, 5))
            ends = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            unit, keys = (b.column(k) for k in (8, 9))
            out = []
            for a, z in zip(np.r_[0, ends], np.r_[ends, len(ids)], strict=True):
                own = tuple(ids[a])
                if own != name and held:
                    out.append(flush(held))
                    held = []
                name = own
                u = unit.slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
                k = keys.slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
                held.append((ids[a:z, 1], ids[a:z, 3], ids[a:z, 4], rep[a:z], n[a:z], blk[a:z], u, k))
            yield from told(out)
        if held:
            yield from told([flush(held)])

    def told(out):
        out = [x for x in out if x is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

    cells = cells.select(*[F.col(c).cast("long").alias(c) for c in ("dims", "t", "key", "i", "j", "block")], "rep", "n", "unit", "keys")
    found = cut(cells.mapInArrow(compare, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found, "rep", "root")
    per = classes.join(small(cut(links)), "rep", "left").join(small(cut(comp)), F.col("rep") == F.col("node"), "left")
    per = per.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.withColumn("ok", ok).join(per, F.col("ok") & (F.col("v") == F.col("_v")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", F.col("vec_id").cast("long")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

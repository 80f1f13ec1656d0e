"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mixed, released, shingles, slices, small, small_batches
from .components import components

_seeds = np.random.default_rng(97).integers(1, 2**63, 4096, dtype=np.uint64)
_EMPTY = np.uint64(2**64 - 1)
#: Documents for each partition of the narrow tables (at most 400,000 rows of a band and two numbers).
DEALT = 20_000
#: Members from which a bucket is met by broadcast, so that its rows stay where they are.
HOT = 1_000


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen, Thorup) of t coordinates, one row per set, none of them empty.

    Round i < t throws every element into one of t bins with a value in [i, i+1); round t + j throws all
    elements into bin j. A coordinate is the least value in its bin; a set whose bins are full needs no
    further round. The values' integer parts are the top bits of a 64-bit number.
    """
    out = np.full((len(sets), t), _EMPTY, np.uint64)
    active = np.arange(len(sets))
    elements = np.concatenate(sets)
    owner = np.repeat(active, [len(s) for s in sets])
    for i in range(2 * t):
        h = mixed(elements ^ _seeds[i])
        place = (h % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out.reshape(-1), owner * t + place, (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9)))
        short = (out == _EMPTY).any(axis=1)
        if not short.any():
            break
        held = short[owner]
        elements, owner = elements[held], owner[held]
    return out


def sketched(df: DataFrame, text: str, doc_id: str, bands: int, rows: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands) per row; h1, h2 identify the shingle set; bands is empty where the set is."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    weights = _seeds[:rows] | np.uint64(1)

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            n, h1, h2, keys = [], [], [], []
            for a, z in slices(texts):
                sets = shingles(texts[a:z], k)
                full = [s for s in sets if len(s)]
                n += [len(s) for s in sets]
                h1 += [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                h2 += [int(mixed(s ^ _seeds[-1]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                made = iter(())
                if full:
                    coords = mixed(sketches(full, bands * rows)).reshape(len(full), bands, rows)
                    made = iter(mixed((coords * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist())
                keys += [next(made) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda batches: released(run(batches)), f"doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>")


def shingle_sets(df: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(rep, elements, bits): the full shingle sets of df's rows, and the parity of each set's elements by hash modulo 512."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            ids = b.column(0)
            for a, z in slices(texts):
                sets = shingles(texts[a:z], k)
                flat = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                ends = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
                odd = [np.packbits(np.bincount((x & np.uint64(511)).astype(np.int64), minlength=512) & 1).view(np.int64).tolist() for x in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.ListArray.from_arrays(ends, flat), pa.array(odd, pa.list_(pa.int64()))], names=["rep", "elements", "bits"])

    return df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).mapInArrow(lambda batches: released(run(batches)), "rep long, elements array<long>, bits array<long>")


def beside(live: DataFrame, one: DataFrame) -> DataFrame:
    """live joined with `one`, a checkpointed row per band with its members: bands of over HOT members by broadcast
    (there are at most 1 / HOT as many as rows; beyond what `small` lets through, AQE splits them), all others by a shuffle."""
    hot = small(one.where(f"members > {HOT}").drop("members"))
    cold = live.join(hot.select("band"), "band", "left_anti").join(one.where(f"members <= {HOT}").drop("members"), "band")
    return live.join(hot, "band").unionByName(cold)


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, e, rank, odd) of each set's rarest n - ceil(percent n / 100) + 1 elements; odd is the share that no other set has."""
    each = sets.select("rep", F.size("elements").alias("m"), F.explode("elements").alias("e"))
    times = each.groupBy("e").agg(F.count("*").alias("times"))
    w = Window.partitionBy("rep")
    ranked = each.join(times, "e").withColumn("rank", F.row_number().over(w.orderBy("times", "e"))).withColumn("odd", F.sum(F.when(F.col("times") == 1, 1).otherwise(0)).over(w) / F.col("m"))
    return ranked.where(f"rank <= m - ceil({percent}D * m / 100D - 1e-9) + 1").select("rep", "e", "rank", "odd")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, bands: int = 20, rows: int = 6, k: int = 5) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Two texts are linked if their sets of distinct k-word shingles (A-Z lowered; a shorter text is one
    shingle) have 100 * intersection >= percent * union. Rows of equal sets form a class; only its smallest
    doc_id goes on. Candidates share a band of a sketch; with 20 bands of 6, a pair at 0.85 is missed with
    probability 1e-4 and at 0.8 with 2e-3. A bucket isn't expanded into pairs: its members are
    compared, on full sets, with its smallest doc_id, then those not yet connected with its most central
    member. What is then still apart in some bucket is joined on rare shingles: sets similar enough must share
    one among each one's rarest few (prefix filter), so no candidate is skipped but those already connected.

    Texts without words (or null) have an empty set and link with nothing; so do rows of null doc_id, which
    are kept. Rows that repeat a doc_id and text carry the same result. An empty table gives no rows. Other columns aren't read.
    """
    made = cut(sketched(df, text, doc_id, bands, rows, k))
    parts = max(1, -(-made.count() // DEALT))  # of tables with a few numbers for each row
    able = made.where("n_shingles > 0 and doc_id is not null")
    reps = cut(able.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").cast("long").alias("rep"), F.any_value("bands").alias("bands")).coalesce(parts))
    keyed = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = cut(keyed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").coalesce(parts))
    bucket = cut(beside(keyed, shared).coalesce(parts))  # only buckets of two and more
    wanted = small(bucket.select(F.col("rep").alias("_rep")).distinct())
    sets = cut(shingle_sets(df.select(doc_id, text).join(wanted, F.col(doc_id) == F.col("_rep"), "left_semi"), text, doc_id, k).dropDuplicates(["rep"]))
    edges, comp, tried = None, None, None

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose full sets are similar enough."""
        left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea"))
        right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb"))
        both = F.size(F.array_intersect("ea", "eb"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ea") + F.size("eb") - both)).select("a", "b")

    def link(pairs: DataFrame) -> None:
        """Verify new candidates (rep, n, comp, rep_b, n_b, comp_b) and extend the components."""
        nonlocal edges, comp, tried
        far = pairs.where(f"comp <> comp_b and n * 100 >= {percent} * n_b and n_b * 100 >= {percent} * n")
        new = far.select(F.greatest("rep", "rep_b").alias("a"), F.least("rep", "rep_b").alias("b")).distinct()
        new = cut((new if tried is None else new.join(tried, ["a", "b"], "left_anti")).coalesce(parts))
        if new.isEmpty():
            return
        hits = cut(verified(new).repartition(parts))
        tried = new if tried is None else tried.unionByName(new)
        edges = hits if edges is None else edges.unionByName(hits)
        comp = cut(components(edges).coalesce(parts))

    def apart() -> DataFrame:
        """(band, rep, n, comp) of the buckets whose members are not all connected."""
        if comp is None:
            return bucket.withColumn("comp", F.col("rep"))
        live = bucket.join(small(comp), bucket["rep"] == comp["node"], "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        still = live.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi")
        return cut(beside(live, cut(still.select("band", "members").coalesce(parts))).coalesce(parts))

    def versus(live: DataFrame, best) -> DataFrame:
        """Each member of a bucket beside the bucket's pivot, the least by `best`."""
        pivot = live.groupBy("band").agg(F.min(F.struct(*best, "rep", "n", "comp")).alias("p"), F.count("*").alias("members"))
        return beside(live, cut(pivot.select("band", F.col("p.rep").alias("rep_b"), F.col("p.n").alias("n_b"), F.col("p.comp").alias("comp_b"), "members").coalesce(parts)))

    link(versus(apart(), []))
    live = apart()
    if not live.isEmpty():
        ranked = cut(rarest(sets.join(live.select("rep").distinct(), "rep"), percent))
        odd = ranked.groupBy("rep").agg(F.first("odd").alias("odd"))
        link(versus(live.join(odd, "rep"), ["odd"]))
        live = apart().select("rep", "n", "comp").distinct()
        prefix = cut(ranked.join(live, "rep").join(sets.select("rep", "bits"), "rep").select("rep", "n", "comp", "e", "rank", "bits"))
        # Of two similar sets, the smaller shares one of its rarest n - ceil(2p/(100+p) n) + 1 shingles. The first one
        # shared leaves enough after it in both, and the sets differ in no more elements than their parities do.
        index = prefix.where(f"rank <= n - ceil({2 * percent}D * n / {100 + percent}D - 1e-9) + 1").select("e", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "comp", "rank", "bits")])
        common = f"ceil({percent}D * (n + n_b) / {100 + percent}D - 1e-9)"
        differ = " + ".join(f"bit_count(bits[{i}] ^ bits_b[{i}])" for i in range(8))
        link(prefix.join(index, "e").where(f"comp <> comp_b and struct(n_b, rep_b) < struct(n, rep) and n_b * 100 >= {percent} * n and 1 + least(n - rank, n_b - rank_b) >= {common} and {differ} <= n + n_b - 2 * {common}").select("rep", "n", "comp", "rep_b", "n_b", "comp_b"))
    if comp is None:
        comp = df.sparkSession.createDataFrame([], "node long, component long")
    ids = reps.join(small(comp), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.col("n_shingles").alias("n_"), F.coalesce("component", "rep").alias("c"))
    keys = (made["h1"] == ids["h1"]) & (made["h2"] == ids["h2"]) & (made["n_shingles"] == ids["n_"]) & made["doc_id"].isNotNull()
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id").cast("long"))
    out = made.join(ids, keys, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

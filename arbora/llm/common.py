"""What several operators share: lineage cuts, size-checked broadcasts, bounded text slices, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Spark and DuckDB regular expressions: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which the planner is told to broadcast a side whose rows are narrow (under 100 bytes each).
BROADCAST_ROWS = 200_000
#: UTF-8 bytes of text that a Python task holds in work arrays at once (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by rows and bytes, as some texts are very long. Both settings are read when a
    query runs, so they stay in the session; they bound memory and change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only local sessions, as in tests, get one of their own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arbora-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Checkpoints made since the innermost `freed` began.
_made: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder, so that a lost executor costs nothing before it."""
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint()
    if _made:
        _made[-1].append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Deletes, at its end, the checkpoints made inside: what was made from them must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast if a count shows at most `rows` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(name: str) -> dict:
    """A dict that lives as long as the Python worker: functions sent by value get new globals for every task."""
    return sys.modules.setdefault(f"_arbora_{name}", types.ModuleType(name)).__dict__


def released(batches, own: tuple = ()):
    """The batches of a task; after each one the worker gives free memory back, as workers live on beside the next stage's.

    At its start, what other operators' tasks held in this worker (see held) but `own` is given up.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for name in [x for x in sys.modules if x.startswith("_arbora_") and x.removeprefix("_arbora_") not in own]:
        del sys.modules[name]
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


def slices(texts: list, most: int = SLICE_BYTES):
    """Split a list of bytes into index ranges (start, end) of about `most` bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BYTE[np.arange(0x41, 0x5B)] = _BYTE[np.arange(0x61, 0x7B)]  # A-Z hash as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) and the index of each one's text, for a slice of texts."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
    powers = np.full(int(max((ends - starts).max(), 1)) + 1, _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = _BYTE[raw] * powers[np.minimum(at, len(powers) - 1)]
    words = mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    return words, np.searchsorted(begin, starts, "right") - 1


def shingles(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle, one without words none."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), int)
    out, first = [], np.r_[0, np.cumsum(counts)]
    n = len(words) - k + 1
    if n > 0:
        whole = np.zeros(n, np.uint64)
        for j in range(k):
            whole += words[j : j + n] * _PLACE[j]
        whole = mixed(whole)
    for i, c in enumerate(counts):
        a = first[i]
        if c >= k:
            out.append(np.unique(whole[a : a + c - k + 1]))
        elif c:
            out.append(mixed(np.array([(words[a : a + c] * _PLACE[:c]).sum() + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

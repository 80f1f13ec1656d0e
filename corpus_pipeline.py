"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, SentencePiece.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. run() applies them in turn, each written as Parquet in the shared
checkpoint folder and read again; a stage's input and checkpoints are deleted once its output is written.

In every stage: null texts count as empty (quality rules reject them), null languages and sources are groups
of their own, rows that repeat a doc_id are rows of their own, ties go by doc_id, an empty table gives an empty table, and
further columns pass, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arbora.llm import mixing, neardup, quality, secrets, spm
from arbora.llm.common import checkpoint_folder, cut, delete, freed, small

#: No SQL expresses the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule and the robust outlier test keep.

    Statistics are computed once, on rows named by doc_id and a hash of what they are judged by (equal rows, equal verdicts);
    texts stay where they are if the rejected rows are few enough to broadcast.
    """
    row = F.xxhash64("doc_id", "text", "lang", "source")
    judged = quality.quality(docs.select("doc_id", "text", "lang", "source", row.alias("row")), keep=["doc_id", "row"])
    out = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    return docs.join(small(out), (row == F.col("_row")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)


def minhash_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates (similarity 0.8 of five-word shingles)."""
    out = cut(neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_out")))
    return docs.join(small(out), docs["doc_id"] == F.col("_out"), "left_anti").select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it (0 to 3 times)."""
    return mixing.drawn(docs)


def encode(spark, docs, sf_dir):
    """The columns of documents, and each text's ids."""
    return spm.encode(docs, memory=50_000)  # its workers share the executors with what the other stages left there


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", minhash_dedup), ("secret scan", secret_scan), ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}-{i}"
        with freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

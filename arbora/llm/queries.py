"""Queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, langid, licenses, mixing, neardup, quality, secrets, sharding, spm, suffixtree
from .common import documents


def op2_secrets(spark, sf_dir):
    return secrets.report(documents(spark, sf_dir))


def op4_sentencepiece(spark, sf_dir):
    """doc_id, n_ids, ids, round_trip (decoding the ids gives the text; null for null)."""
    made = spm.encode(documents(spark, sf_dir).select("doc_id", "text"))
    back = spm.decode(made, out="back")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("back") == F.col("text")).alias("round_trip"))


def op5_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op6_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op8_minhash(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85)


def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op2_secrets, op4_sentencepiece, op5_sharding, op6_quality, op8_minhash, op9_mixing, pipeline)}
SQL = {"op9_mixing": mixing.SQL}


def op1_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    made = langid.identify(docs, docs.where(rest != 2))
    return made.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_embeddings(spark, sf_dir):
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_licenses(spark, sf_dir):
    return licenses.licenses(documents(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (op1_langid, op3_embeddings, op10_licenses)}


def op7_suffixtree(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    made = suffixtree.score(docs, docs.where(rest != 2))
    return made.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op7_suffixtree"] = op7_suffixtree

"""A training-corpus pipeline of five stages; each takes what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again before the next stage. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import bpe, decontam, quality, simhash, substring
from lexigraph.llm.common import fold, write_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores at 0.3 or more.

    Every row is scored by its whole text alone: a null text counts as empty, repeated rows and rows without a
    doc_id stay or go alike. Columns beyond those of ``documents`` are left out here.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold("doc_id", 5) != 0)
    return quality.score(docs.select(*COLUMNS), model, name="_lx_score").where("_lx_score >= 0.3").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id.

    Near copies have fingerprints within 4 bits, or five-word shingles of similarity 0.8 and more. Texts without
    words are copies of each other. Rows that share a doc_id are one document: one of them stays, the least by its
    columns. Rows without a doc_id are grouped by their texts like any others, and give way to rows with one.
    """
    # Rows without an id are named by their text, behind all ids that are likely to occur.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    keyed = docs.select(*COLUMNS, key.alias("_lx_key"))
    groups = simhash.near_duplicates(keyed, shingle=5, similarity=0.8, doc_id="_lx_key")
    kept = F.max(F.col("doc_id") == F.col("component_id"))
    judged = groups.groupBy(F.col("doc_id").alias("_lx_key")).agg(kept.alias("_lx_kept"), (F.count(F.lit(1)) > 1).alias("_lx_again"))
    # What goes is far less than what stays: only that is joined, and rows that share an id are looked at apart.
    gone = spark.read.parquet(write_scratch(judged.where("_lx_again or not _lx_kept"), "gone"))
    again = keyed.join(gone.where("_lx_again and _lx_kept"), "_lx_key", "left_semi")
    single = keyed.join(gone, "_lx_key", "left_anti").select(*COLUMNS)
    return single.unionByName(again.groupBy("_lx_key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 13 words and more that a document with a smaller doc_id also holds.

    Every row stays, with its kept words joined by one space (a null text becomes ''). Rows with the same doc_id, or
    without one, don't judge each other.
    """
    out = substring.substring_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold a benchmark item, whole or edited.

    A null or empty text holds nothing and stays; repeated rows stay or go alike; null and empty items are held nowhere.
    """
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number, and whether decoding them gives the text again.

    Every row stays. A null text counts as empty: no ids, round_trip true.
    """
    out = bpe.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), decoded="_lx_decoded")
    return out.withColumn("round_trip", F.col("_lx_decoded") == F.coalesce("text", F.lit(""))).drop("_lx_decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: The quality model, XXH64 fingerprints and alignment scores have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spark.read.parquet(write_scratch(docs, f"stage{k}"))
    return docs

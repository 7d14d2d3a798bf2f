"""The registered queries of the ten operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, language, license, lm, quality, simhash, substring, tokencount, topk
from .common import fold


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: the best item and its score, how many, and where the best one stands."""
    found = decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.max(F.struct("score", (-F.col("item_id")).alias("i"), "first_word", "end_word"))
    return found.groupBy("doc_id").agg(best.alias("b"), F.countDistinct("item_id").alias("n_items")).select("doc_id", (-F.col("b.i")).alias("item_id"), F.col("b.score").alias("score"), "n_items", F.col("b.first_word").alias("first_word"), F.col("b.end_word").alias("end_word"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("held_out", fold("doc_id", 10) == 0)
    return lm.score(docs, lm.train(docs, ~F.col("held_out")), keep=["held_out"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids=None, ids_text="ids_text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest("ids_text").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id are neither learned from nor held out."""
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang")
    network = language.train(docs, ~fold("doc_id", 4).isin(2, -1))
    return language.identify(docs.select("doc_id", "text"), network).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_decontamination": op1_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_topk": op4_topk,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_license": op7_license,
        "op8_bpe": op8_bpe,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "pipeline": corpus_pipeline.run,
    }


# Words and windows are judged on the input; list positions in DuckDB begin at 1.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f USING (k) WHERE f.d < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, gone, CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(gone, x)), lambda x: ws[x]) END AS kept
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


OP4_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _op7_sql() -> str:
    """Words of lines against templates by plain intersection, without any filter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license.PHRASES.items())
    templates = ", ".join(f"('{t}', '{label}')" for t, label in license.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
ph AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) x(p, label)),
stands AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, label, p, unnest(range(1, len(ws) - len(p) + 2)) AS i FROM w, ph WHERE list_has_all(ws, p)) WHERE ws[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b FROM stands GROUP BY doc_id),
tp AS (SELECT list_distinct(string_split(t, ' ')) AS tokens, label FROM (VALUES {templates}) x(t, label)),
ln AS (SELECT doc_id, number, list_distinct(regexp_extract_all(line, '{word}')) AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS number FROM d)),
m AS (SELECT doc_id, number, label, len(list_intersect(tokens, ws)) / len(tokens) AS share FROM ln, tp),
hit AS (SELECT doc_id, label, share FROM m WHERE share >= 0.8 QUALIFY share = max(share) OVER (PARTITION BY doc_id, number)),
lab AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM stands) GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM stands) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(bl.labels, '') AS base_labels,
       coalesce(lab.labels, '') AS labels, (CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_substring_dedup": OP3_SQL, "op4_topk": OP4_SQL, "op7_license": _op7_sql()}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out

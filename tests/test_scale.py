"""What larger and odder tables showed: results beyond a search's reach, work that is dealt in bounded pieces."""

from collections import Counter
from itertools import product

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigraph import queries as core
from lexigraph.functions import answers, batches
from lexigraph.functions.porter import STEP2, STEP3, STEP4, stem
from lexigraph.operators import fusion, geo, keyword


@pytest.mark.parametrize("n, want", [(9, 8), (10, None)])
def test_path_ends_where_its_sql_does(spark, tmp_path, n, want):
    """A chain of parts from 0 to n - 1: links of more than eight steps have no degree."""
    spark.range(n).selectExpr("id AS p_partkey", "'p' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    to = F.pmod((1 - 6 * F.col("id")) * pow(13, -1, n), F.lit(n))
    spark.range(n - 1).select(F.col("id").alias("l_partkey"), to.alias("l_suppkey"), F.lit(1).alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("part", "lineitem"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = [tuple(r) for r in core.queries()["shortest_path_length"](spark, str(tmp_path)).collect()]
    assert got == duck.sql(core.oracle_sql()["shortest_path_length"]).fetchall() == [(0, n - 1, want)]


#: Rows that share an id, rows without one, texts and titles that are null; padded so that none counts as very short.
ODD = [(1, "src1", "the apache license version two " + "x " * 30), (1, "src2", "license " + "y " * 30), (2, "apache", "version of a license, apache's " + "z " * 30), (3, None, "The Apache LICENSE, version 1: apache_license " + "w " * 30), (4, "src1", None), (None, "src1", "apache license version " + "v " * 30), (5, "", "général license, version apacheé " + "u " * 30), *[(k, "s", "plain words only " + "t " * 30) for k in range(6, 30)]]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """(folder, DuckDB connection) of a documents table of odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(i, t, s, 99) for i, s, t in ODD], "doc_id long, text string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    return d, duck


def against_sql(spark, odd, name):
    df = core.queries()[name](spark, odd[0])
    want = odd[1].sql(f"SELECT {', '.join(df.columns)} FROM ({core.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_keyword_search_of_odd_rows(spark, odd):
    against_sql(spark, odd, "keyword_and")


def test_an_index_for_words_keeps_their_tokens_only(spark):
    docs = spark.createDataFrame([(1, "red car", "a red, red thing"), (2, None, "blue"), (3, "x", None)], "doc long, title string, lead string")
    index = keyword.build_for(docs, ["red", "thing"])
    assert sorted(map(tuple, index.occurrences.collect())) == [("red", 1, 0, 0), ("red", 1, 1, 1), ("red", 1, 1, 2), ("thing", 1, 1, 3)]
    assert sorted(map(tuple, index.sizes.collect())) == [(1, 6), (2, 1), (3, 1)] and index.documents == 3
    assert [tuple(r) for r in index.hits("red thing").collect()] == [(1, 1.0)]


def test_word_counts_of_odd_rows(spark, odd):
    against_sql(spark, odd, "token_df")


def test_texts_become_python_objects_in_bounded_parts(spark):
    """However many rows an Arrow batch has, an encoder gets ``batches.PART`` bytes of text at once, or one row."""
    long = batches.PART // 4
    docs = spark.createDataFrame([(1,), (2,), (3,)], "n long").coalesce(1).selectExpr("explode(sequence(1, 4)) AS doc", f"CASE WHEN n < 3 THEN repeat('ab ', {long}) WHEN doc > 2 THEN 'é b' END AS text")

    def encode(texts):
        return [[len(texts), sum(len(t.encode()) for t in texts)] for _ in texts]

    rows = fusion.embedded(docs, "text", "v", encode).collect()
    assert len(rows) == 12 and all(r.v[0] == 1 or r.v[1] <= batches.PART for r in rows)
    assert sorted(r.doc for r in rows) == sorted([1, 2, 3, 4] * 3) and max(r.v[0] for r in rows) > 1
    plain = fusion.embedded(docs.where("text IS NULL OR length(text) < 9"), "text").collect()
    assert all(r.embedding == pytest.approx(fusion.hashed([r.text])[0].tolist()) for r in plain) and len(plain) == 4


def test_passages_are_cut_in_bounded_parts(spark):
    """Every document's passages in order, with ids beyond 2^53 beside null ones, over more text than one part holds."""
    text = "This is a sentence of seven words. " * 60
    docs = [(2**53 + 1, text), (None, text), (3, None), (4, "too short"), (5, text * (batches.PART // len(text) + 1)), (6, text)]
    got = answers.passages(spark.createDataFrame(docs, "page_id long, text string").coalesce(1)).collect()
    assert [tuple(r) for r in got] == [(k, *p) for k, t in docs for p in answers.split_passages([("", t or "")])]
    texts = pa.array(["a" * 3, None, "b" * 5, "c" * 20, "", "d"])
    assert [(s.start, s.stop) for s in batches.parts(texts, 8)] == [(0, 3), (3, 4), (4, 6)] and not list(batches.parts(texts[:0], 8))


def test_crowded_cells_are_dealt_in_blocks(spark, monkeypatch):
    """All points in one cell: the same pairs, with no task that gets more than a share of them."""
    spots = spark.range(300).selectExpr("id AS page_id", "10 + id / 1000 AS lat", "20 + id / 1000 AS lon")
    centres = spark.range(200).selectExpr("id AS centre", "10.0001 + id / 1000 AS lat", "20D AS lon")
    want = {tuple(r) for r in spots.crossJoin(centres.withColumnsRenamed({"lat": "a", "lon": "b"})).where(geo.haversine_km(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) <= 20).select("centre", "page_id").collect()}
    for name, value in (("BLOCK", 20), ("TASK_PAIRS", 2000)):
        monkeypatch.setattr(geo, name, value, raising=False)
    got = geo.near_many(centres, spots, 20.0).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.centre, r.page_id) for r in got} == want and len(got) == len(want) > 10_000
    assert max(Counter(r.task for r in got).values()) < len(want) / 5


def test_stems_that_are_searched_and_no_others(spark):
    """The same scores as the whole index; words that can't be searched ones are counted, but not stemmed."""
    texts = [(k, f"Title {w}", " ".join([w] * (k % 4 + 1)) + f" running towers tower's number {k} bridges the old café") for k, w in enumerate("alpha licensed bridging alpha licenses works working o'brien version".split())]
    docs = spark.createDataFrame([*texts, (20, None, "license"), (21, "x", None)], "doc long, title string, lead string")
    whole, some = keyword.build(docs), keyword.build_for(docs, ["license", "work", "tower's", "cafe"], stemmed=True)
    assert (some.documents, some.average) == (whole.documents, whole.average)
    assert {tuple(r) for r in some.occurrences.collect()} == {tuple(r) for r in whole.occurrences.where("term IN ('licens', 'work', 'tower', 's', 'cafe')").collect()}
    for words in (["license", "work"], ["tower's", "cafe"]):
        assert {r.doc: r.score for r in some.bm25(words, False).collect()} == pytest.approx({r.doc: r.score for r in whole.bm25(words, False).collect()})
    for w in ["".join(p) for n in (3, 4) for p in product("aeisyd", repeat=n)] + [a + b for a in ("", "a", "be", "tro") for b in (*STEP2, *STEP3, *STEP4, "ed", "ing", "ies", "sses", "eed")]:
        assert stem(w)[:1] == w[:1]

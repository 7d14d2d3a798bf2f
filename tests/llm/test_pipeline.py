"""The pipeline against a brute-force version of its stages, and the registered SQL."""

import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexigraph.llm import common, decontam, quality, queries
from tests.conftest import SF
from tests.llm import plain


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), common.fold("doc_id", 5) != 0)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(i, t) for i, t in rows if model.score((t or "").encode()) >= 0.3]
    root = plain.groups([i for i, _ in rows], [plain.fingerprint(t, 5) for _, t in rows], sets=[plain.shingles(t) for _, t in rows], similarity=0.8)
    rows = [(i, t) for i, t in rows if root[i] == i]
    cut = plain.substring(rows)
    rows = [(i, cut[n][2]) for n, (i, _) in enumerate(rows)]
    items = [decontam.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for i, t in rows:
        w = decontam.words_of(t.encode())
        held = set(w)
        if all(len(held & set(item)) < 5 or plain.alignment(item, w) < min(0.5, 13 / len(item)) for item in items):
            clean.append((i, t))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (t, len(t), library.encode(t, add_special_tokens=False).ids) for i, t in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(want)
    for i, (text, n, ids) in want.items():
        assert (got[i].text, got[i].n_chars, got[i].ids, got[i].n_tokens, got[i].round_trip) == (text, n, ids, len(ids), True)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain_rows = lambda rows: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain_rows(tuple(r) for r in df.select(*columns).collect()) == plain_rows(duck.sql(f"SELECT {picked} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_near_dedup_keeps_one_of_each_group(spark):
    words = [f"word{i} of{i % 7}" for i in range(60)]
    base, edited, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    rows = [(3, base), (3, base), (3, edited), (5, edited), (None, base), (None, edited), (None, other), (None, other), (9, None), (None, None), (8, " \n"), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=repr)
    assert kept == sorted([(3, edited), (8, " \n"), (None, other)], key=repr)


def test_stages_take_odd_rows(spark):
    huge = " ".join(f"w{(i * i) % 9973}" for i in range(40_000)) + " " + "x" * 50_000
    rows = [(1, huge), (2, huge), (None, None), (None, ""), (4, None), (5, "The cat sat."), (5, "The cat sat."), (-6, "The cat sat."), (2**62, "é 漢字 <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, N_TOKENS string").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert len(set(c.lower() for c in out.columns)) == len(out.columns)
        if name not in ("quality classifier", "SimHash near-dedup"):
            assert len(got) == len(rows), name
        else:
            assert len(got) <= len(rows)

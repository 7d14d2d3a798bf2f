"""Each operator against a brute-force version, over whole tables and over rows that are odd in every column."""

import collections
import os
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigraph.llm import bpe, common, components, decontam, language, license, lm, quality, queries, simhash, substring, tokencount, topk
from tests.conftest import SF
from tests.llm import plain

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
COPY = " ".join(f"word{i % 9} and thing{i % 7}" for i in range(40))
LONG = " ".join(f"tok{(i * i) % 977}" for i in range(30_000)) + " " + "x" * 70_000
ODD = [
    (1, COPY, "en"), (2, COPY, "en"), (2, COPY, "en"), (3, None, None), (4, "", "fr"), (5, " \t\n\x0b ", "fr"), (None, COPY, "de"), (None, None, None),
    (6, LONG, "en"), (7, LONG + " end", "en"), (8, "Émile Ünder ß ǅ 漢字 🙂 ́ combining \x85\xa0 x", None), (9, "one", "es"), (10, "<|endoftext|> hi<|startoftext|>\x00!", "es"),
    (11, COPY + " " + " ".join(f"new{i}" for i in range(30)), "fr"), (12, "12 34 -- !!", "de"), (-5, "minus " + COPY, "en"), (13, "a b\x1cc\x1dd e", None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that clash with what operators add."""
    extra = "n_words string, n_tokens string, score string, ids string, fp string, bucket string, decoded string, n_removed string, labels string, lang_pred string, word string"
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *[f"'clash' AS {c.split()[0]}" for c in extra.split(", ")]).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return sorted(map(repr, rows))


# ---------------------------------------------------------------- shared pieces


def test_keys_survive_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (common.unpack_sorted(common.pack_sorted(keys)) == keys).all() and len(common.unpack_sorted(b"")) == 0
    for n in (1, 3, 7, 1000):
        b = common.bucket_bounds(keys, n)
        assert (np.repeat(np.arange(n), np.diff(b)) == common.bucket_of(keys, n)).all() and b[-1] == len(keys)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299), (299, 301), (301, 300), (7, 7), (400, 401), (400, 401)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)} | {299: 299, 300: 299, 301: 299, 400: 400, 401: 400}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_decontamination(spark, odd, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee near the old harbour gate"
    w = item.split()
    edited = " ".join(x for i, x in enumerate(w) if i not in (4, 11)).replace("wizards", "sorcerers")
    long = " ".join(f"long{i}" for i in range(90))
    filler = "lorem ipsum dolor sit amet " * 40
    rows = [(1, filler + item.upper() + " " + filler), (2, filler + edited), (3, filler), (4, " ".join(w[6:11])), (5, None), (6, ""), (None, item), (1, item), (7, "Quick, BROWN; fox -- " + item.replace(" ", "\n") + "!"), (8, " ".join(reversed(w))), (9, filler + " ".join(long.split()[30:44]) + " " + filler), (10, filler + " ".join(long.split()[30:38]) + " " + filler)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(50, item), (51, None), (52, ""), (53, "two words"), (50, item), (54, long)], "item_id long, text string")
    got = decontam.contamination(d, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 50), (1, 50), (1, 50), (2, 50), (7, 50), (9, 54)]
    for r in got:
        best = max(plain.alignment(decontam.words_of({50: item, 54: long}[r.item_id].encode()), decontam.words_of(t.encode())) for i, t in rows if i == r.doc_id)
        assert r.score <= best + 1e-9
    assert [r.score for r in got if r.doc_id == 2][0] == pytest.approx(plain.alignment(w, edited.split()), abs=0.05)
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [3, 4, 5, 6, 8, 10]
    assert decontam.contamination(odd, bench).count() == 0 and decontam.decontaminate(odd, bench).count() == len(ODD)
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(d, bench.limit(0)).count() == 0


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 14)), rng.integers(0, 6, rng.integers(1, 30))
        assert decontam.align(a, b) / (2 * len(a)) == pytest.approx(plain.alignment(a.tolist(), b.tolist()))


def test_every_whole_copy_is_found(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()}
    items = [(i, decontam.words_of(t.encode())) for i, t in ((r.item_id, r.text) for r in bench.collect())]
    texts = {i: b" " + b" ".join(decontam.words_of((t or "").encode())) + b" " for i, t in pairs(docs)}
    assert got >= {(d, i) for d, t in texts.items() for i, w in items if b" " + b" ".join(w) + b" " in t}
    wrong = [(d, i) for d, i in got if plain.alignment(dict(items)[i], texts[d].split()) < min(0.5, 13 / len(dict(items)[i]))]
    assert not wrong


def test_items_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontam, "ITEM_BYTES", 2000)
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.contamination(docs, bench).collect()} == whole


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("shard_bytes", [96 << 20, 3000])
def test_language_model(spark, odd, shard_bytes):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    d = odd.select("doc_id", "text", "n_words").withColumn("held", common.fold("doc_id", 3) == 0)
    model = lm.train(d, ~F.col("held"), bits=40, shard_bytes=shard_bytes, bucket_bytes=20_000)
    assert (len(model.bounds) > 1) == (shard_bytes < 10_000)
    got = lm.score(d, model, mu=16.0, keep=["n_words", "held"]).collect()
    want = plain.lm(rows, [plain.fold(i, 3) != 0 for i, _ in rows], 16.0)
    assert len(got) == len(rows) and {r.n_words for r in got} == {"clash"}
    key = lambda t: (t[0], t[1], t[2], round(t[3], 4), round(t[4], 2))
    assert multiset((r.doc_id, *key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))) for r in got) == multiset((rows[i][0], *key(w)) for i, w in want.items())


def test_language_model_with_its_filter_as_shipped(spark, docs):
    """At 9 bits an event a few levels are too high; documents' scores stay close to those of exact levels."""
    d = docs.select("doc_id", "text").withColumn("held", common.fold("doc_id", 10) == 0).withColumn("SCORE", F.lit("clash"))
    rows = pairs(d)
    want = plain.lm(rows, [plain.fold(i, 10) != 0 for i, _ in rows], 16.0)
    got = {r.doc_id: r for r in lm.score(d, lm.train(d, ~F.col("held")), keep=["held", "SCORE"]).collect()}
    assert all((got[i].n_tokens, got[i].n_known, got[i].train_tokens) == w[:3] and got[i].base_score == pytest.approx(w[3]) for (i, _), w in zip(rows, want.values(), strict=True))
    apart = np.array([abs(got[i].score - w[4]) / w[0] for (i, _), w in zip(rows, want.values(), strict=True)])
    assert 0 < apart.mean() < 0.02 and np.quantile(apart, 0.99) < 0.1


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    levels = rng.integers(1, 9, len(keys)).astype(np.uint8)
    seg = lm.segment(keys, levels, -(-int(levels.sum()) * 9 // 64))
    shard = lm.Shard(1, 0, 1, keys[:0], np.empty(0, np.int64), seg, np.zeros(1, np.int64), np.array([len(seg)], np.uint64))
    got = shard.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.08
    assert (shard.levels(np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))) > 0).mean() < 0.08
    assert lm.quantised(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_language_model_beats_its_base_and_takes_empty_tables(spark, docs, empty):
    d = docs.select("doc_id", "text").withColumn("held", common.fold("doc_id", 10) == 0)
    r = lm.score(d, lm.train(d, ~F.col("held")), keep=["held"]).where("held").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
    model = lm.train(empty, F.lit(True))
    assert (model.tokens, model.words) == (0, 0) and lm.score(empty, model).count() == 0
    assert [(x.n_tokens, x.n_known, x.base_score) for x in lm.score(docs.limit(1).selectExpr("doc_id", "'a b' AS text"), model).collect()] == [(3, 0, 0.0)]


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "bucket_bytes": 5000, "batches": 4}, {"block_bytes": 40_000, "batches": 1}])
def test_substring_dedup(odd, options):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain.substring(rows)
    got = substring.substring_dedup(odd, **options).collect()
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == multiset((rows[n][0], *w) for n, w in want.items())
    assert {r.score for r in got} == {"clash"}


def test_substring_dedup_of_documents(docs, empty):
    rows = pairs(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.substring_dedup(docs, block_bytes=50_000, bucket_bytes=60_000).collect()}
    assert got == {rows[n][0]: w for n, w in plain.substring(rows).items()}
    assert substring.substring_dedup(empty).count() == 0


def test_blocks_beyond_the_ranges_keep_the_order(spark):
    rows = [(i * i, "x" * (10 + i % 7)) for i in range(400)] + [(2**63 - 1, "last")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out, n = substring._blocks(d, "doc_id", "text", 6000, 100, ranges=5)
    got = [r["_lx_block"] for r in out.orderBy("doc_id").collect()]
    assert got == sorted(got) and len(set(got)) > 20 and 0 <= got[0] and got[-1] == max(got) < n


def test_index_stays_between_calls(spark, docs, tmp_path):
    """Batches in separate calls, each on the index opened anew, remove what one call over all removes."""
    rows = pairs(docs)
    want, got = plain.substring(rows), {}
    for k in range(5):
        index = substring.WindowIndex.open(spark, str(tmp_path / "index"), buckets=3, fanout=2)
        part = docs.where(F.floor(F.col("doc_id") / 50) == k)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.substring_dedup(part, block_bytes=40_000, batches=2, index=index).collect()}
        assert index.buckets == 3
    assert got == {rows[n][0]: w for n, w in want.items() if rows[n][0] < 250}
    again = substring.WindowIndex.open(spark, str(tmp_path / "index"), buckets=99)
    assert again.buckets == 3 and len(again.runs) < 5 and max(level for level, _ in again.runs) > 1
    repeated = substring.substring_dedup(docs.limit(20), index=again).collect()
    assert all(r.n_removed == r.n_words for r in repeated if r.n_words >= 13)


def test_windows_whose_keys_collide_stay_apart():
    key = np.array([5, 3, 5, 5, 3, 9], np.uint64)
    check = np.array([1, 1, 2, 1, 1, 0], np.uint16)
    by, lead = substring.ranked(key, check)
    assert by.tolist() == [1, 4, 0, 3, 2, 5] and lead.tolist() == [True, False, True, False, True, True]


def test_rows_without_an_id_are_spread(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(None, text(i)) for i in range(80)] + [(None, text(0))] * 3 + [(1, text(7)), (2, text(200) + " " + text(7))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.substring_dedup(d, block_bytes=2000).collect()
    want = plain.substring(rows)
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == multiset((rows[n][0], *w) for n, w in want.items())


def test_index_is_incremental_and_compacts(spark, docs):
    index = substring.WindowIndex(spark, 3, fanout=2)
    d = docs.select(F.col("doc_id").alias("_lx_id"), "text").withColumn("_lx_block", F.floor(F.col("_lx_id") / 20))
    paths = []
    for k in range(4):
        paths.append(index.add(d.where(F.floor(F.col("_lx_id") / 60) == k), "_lx_id", "text"))
        index.compact()
    assert index.compactions == 3 and [level for level, _ in index.runs] == [2]
    assert substring.replies(spark, paths).select("_lx_block").distinct().count() == d.where("_lx_id < 240").select("_lx_block").distinct().count()
    index.clear()
    assert index.runs == []


# ---------------------------------------------------------------- 4


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(24) * rng.choice([0.02, 1, 30])]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(90)] + [(600, None), (620, [1.0] * 23 + [float("nan")]), (621, [float("inf")] * 24), (640, [0.0] * 24), (641, [1.0] * 3), (660, [2.0] * 3), (680, [])]
    rows += [(661, [1.0, None, 2.0]), (700, [0.25] * 24), (700, [-0.25] * 24)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("options", [{}, {"block": 32, "query_block": 5, "lead": 4}, {"block": 1000, "query_block": 3, "lead": 24}])
def test_topk(spark, options):
    rows, v = vectors(spark)
    whole = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, **options).collect())
    assert got == plain.topk(whole)


def test_topk_keeps_every_finite_vector(spark):
    rng = np.random.default_rng(41)
    rows = [(i, [float(x) for x in rng.standard_normal(12) * rng.choice([1, 3e4, 1e6])]) for i in range(150)]
    rows += [(200, [17000.0] * 12), (201, [17000.0] * 12), (220, [1e7] + [0.0] * 11), (221, [0.0] * 11 + [1e7]), (300, [1e15]), (301, [1.0]), (240, []), (241, []), (260, []), (260, [])]
    whole = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows]
    want = plain.topk(whole)
    assert max(abs(r[3]) for r in want) > 1 << 53
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"block": 16, "query_block": 3, "lead": 4}):
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, **options).collect()) == want
    with pytest.raises(Exception, match="range of a long"):
        topk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")).collect()


def test_topk_of_small_and_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone).count() == 0
    assert topk.top_k(alone.selectExpr("vec_id + 1 AS vec_id", "embedding")).count() == 0


# ---------------------------------------------------------------- 5 and 8


@pytest.mark.parametrize("chunk, overlap", [(tokencount.CHUNK, tokencount.OVERLAP), (64, 8)])
def test_token_counts(odd, docs, empty, chunk, overlap):
    library = Tokenizer.from_file(WORD)
    for d in (odd, docs) if chunk > 1000 else (odd.where("doc_id IS NULL OR doc_id NOT IN (6, 7)"),):
        got = tokencount.token_counts(d, WORD, limit=5, chunk=chunk, overlap=overlap).collect()
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in pairs(d)]
        assert multiset((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == multiset((i, len((t or "").encode()), n, n > 5) for (i, t), n in zip(pairs(d), want, strict=True))
    assert tokencount.token_counts(empty, WORD).count() == 0


def test_overlaps_are_widened_where_nothing_lines_up():
    counter = tokencount.Counter(open(WORD).read(), chunk=50, overlap=4)
    library = Tokenizer.from_file(WORD)
    for text in ("x" * 400, "ab " * 200, "é" * 120 + " " + "b" * 300 + " c d e f", "word, " * 90, " " * 300 + "a"):
        e = library.encode(text, add_special_tokens=False)
        assert counter.tokens(text) == [(i, o[0]) for i, o in zip(e.ids, e.offsets, strict=True)]
    assert counter.widened


def test_bpe(odd, docs, empty):
    library = Tokenizer.from_file(BYTE)
    for d in (odd, docs):
        got = bpe.encode_decode(d, BYTE, ids_text="ids_text").collect()
        want = {}
        for _, t in pairs(d):
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[t] = (ids, library.decode(ids, skip_special_tokens=False))
        assert len(got) == len(pairs(d))
        for r in got:
            assert (r.ids, r.decoded) == want[r.text] and r.n_tokens == len(r.ids) and r.ids_text == ",".join(map(str, r.ids))
    assert bpe.encode_decode(empty, BYTE).count() == 0


def test_bpe_long_words_and_decoding():
    codec, library = bpe.Codec(open(BYTE).read()), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(0)
    for word in ("a" * 5000, "".join(map(chr, rng.integers(97, 123, 4000))), "abab" * 700, "ß" * 900, "".join(map(chr, rng.integers(0x4E00, 0x4E50, 500)))):
        assert codec.encode(word) == library.encode(word, add_special_tokens=False).ids
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 12)).tolist()
        text = codec.decode(ids)
        if "�" not in text:
            assert text == library.decode(ids, skip_special_tokens=False)


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("bands", [None, 1, 2, 3, 6])
def test_simhash(odd, bands):
    rows = pairs(odd)
    fps = [plain.fingerprint(t) for _, t in rows]
    known = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    want = plain.groups([i for i, _ in known], [f for _, f in known])
    got = simhash.near_duplicates(odd, bands=bands).collect()
    assert multiset((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == multiset((i, f, want.get(i)) for (i, _), f in zip(rows, fps, strict=True))


def test_rows_of_one_id_link_what_they_are_like(spark):
    rows = [(1, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (3, "one two three four"), (7, "one two three four"), (8, "else where")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (3, 1), (7, 1), (8, 8)}


def test_simhash_of_documents(docs, empty):
    rows = pairs(docs)
    want = plain.groups([i for i, _ in rows], [plain.fingerprint(t) for _, t in rows])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bands, leaf, block", [(5, 16, 40), (3, 16, 40), (1, 64, 100), (6, 16, 4096), (5, 4, 8)])
def test_links_against_all_pairs(spark, bands, leaf, block):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in list(base[:25]) + [base[0]] * 60:
        y = int(x)
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    fps = sorted(fps)
    points = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.root for r in components.components(simhash.links(points, 4, bands, leaf, block)).collect()}
    want = {i: r for i, r in plain.groups(list(range(len(fps))), fps).items()}
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_edited_copies_of_many_texts(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 300)))) for i in range(300)]
    for i in range(120):
        words = rows[i % 60][1].split()
        for _ in range(max(1, len(words) // 70)):
            words[rng.integers(0, len(words))] = f"edit{rng.integers(0, 10**6)}"
        rows.append((1000 + i, " ".join(words)))
    sets, fps = [plain.shingles(t) for _, t in rows], [plain.fingerprint(t, 5) for _, t in rows]
    want = plain.groups([i for i, _ in rows], fps, sets=sets, similarity=0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert got == want and sum(want[i] != i for i in want) > 100


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"edit{rng.integers(0, 10**9)}"
    return " ".join(words)


def test_hundreds_of_edited_copies_of_one_text_are_one_group(spark):
    rng = np.random.default_rng(21)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(words))] + [(i, edited(rng, words, 6)) for i in range(1, 301)] + [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 200))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}


def test_every_pair_of_the_similarity_is_linked(spark):
    """Pairs just over 0.8, most of them beyond the fingerprints' radius."""
    rng = np.random.default_rng(22)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, 280)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, 6))]
    sets, fps = [plain.shingles(t) for _, t in rows], [plain.fingerprint(t, 5) for _, t in rows]
    want = plain.groups([i for i, _ in rows], fps, sets=sets, similarity=0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert got == want and sum(want[i] != i for i in want) > 200


def test_substring_gives_memory_back_after_each_group(spark, monkeypatch, tmp_path):
    """Workers live on, so each block, bucket and compaction gives back what it took; results stay."""
    marks, release = str(tmp_path), common.released

    def marking(value):
        name = "apply" if "n_removed" in value.column_names else "windows" if value.column("block")[0].as_py() >= 0 and set(value.column("kind").to_pylist()) == {substring.REPLY} else "merge"
        tempfile.NamedTemporaryFile(prefix=f"{name}-", dir=marks, delete=False).close()
        return release(value)

    rows = [(i, " ".join(f"w{i % 5} v{k}" for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring.substring_dedup(docs, block_bytes=2000, bucket_bytes=4000).collect()))
    monkeypatch.setattr(substring, "released", marking)
    got = sorted(map(tuple, substring.substring_dedup(docs, block_bytes=2000, bucket_bytes=4000).collect()))
    made = collections.Counter(f.split("-")[0] for f in os.listdir(marks))
    assert got == want and made["windows"] == made["apply"] > 5 and made["merge"] > 2


def test_shingles_are_counted_in_every_row(spark, monkeypatch):
    """The order of the join's shingles follows from all rows, however many there are."""
    counted, n = [], 140_000

    class Enough(Exception):
        pass

    def counting(texts, *_):
        counted.append(texts.count())
        raise Enough

    monkeypatch.setattr(simhash, "shingle_counts", counting)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    base = spark.read.parquet(common.write_scratch(simhash.fingerprints(docs, 5, sets=True), "fp"))
    points = base.select("fp", F.col("doc_id").alias("rep"))
    with pytest.raises(Enough):
        simhash.similar_links(docs, base, points, spark.createDataFrame([], "a long, b long"), 0.8, 5, 42, "doc_id", "text")
    assert counted == [n]


def test_trees_and_bands_grow_with_the_rows():
    fps = np.random.default_rng(6).integers(0, 1 << 64, 3000, dtype=np.uint64)
    for depth in (3, 14, 20, 28):
        bands = simhash.bands_for(depth, 4)
        mask, radius = simhash.masks(bands, 4)[0]
        assert radius == 0 and bin(mask).count("1") >= depth
        tree = simhash.Tree(mask, 0, depth, fps[:500], 1)
        home = tree.home(fps)
        assert home.min() >= 1 << depth and home.max() < 2 << depth and (home == tree.home(fps ^ ~np.uint64(mask))).all()
    assert len(np.unique(home)) > 2000


def test_common_tokens_are_found_across_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [(int(t),) for t in rng.integers(-(1 << 63), 1 << 63, 500)] * 2 + [(int(t),) for t in rng.integers(-(1 << 63), 1 << 63, 500)]
    for buckets in (1, 7):
        got = {r.token for r in simhash.repeated(spark.createDataFrame(rows, "token long").repartition(5), buckets).collect()}
        assert got == {r[0] for r in rows[:500]}


def test_one_byte_counts_never_fall():
    got = simhash.rising(np.array([0, 1, 127, 128, 129, 200, 10**4, 10**5, 10**6, 10**9]))
    assert (np.diff(got.astype(int)) >= 0).all() and got[2] < got[3] < got[-3] < got[-2]


def test_majority_counts_many_shingles():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 255, 256, 700, 0, 3])
    h = rng.integers(0, 1 << 64, sizes.sum(), dtype=np.uint64)
    got, at = simhash.majority(h, sizes), 0
    for value, n in zip(got, sizes, strict=True):
        own = h[at : at + n]
        at += n
        assert int(value) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)


# ---------------------------------------------------------------- 7


def test_license_scan(spark, odd, empty):
    rows = [
        (1, "Released under the MIT License."), (2, "x\nThis work is licensed under the GNU General\nPublic License, version 3.\ny"), (3, "permission hereby granted free of charge to any person obtaining copy of this software and documentation files associated"),
        (4, "mit license mit license CC BY"), (5, None), (6, "mitlicense apache  LICENSE"), (7, "licensed under CC BY-SA 4.0"), (8, "the license of the work under version"),
    ]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pick = lambda i: (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert pick(1) == (5, 1, 3, 3, "mit", "mit") and got[1].score == 1.0
    assert pick(2)[1:5] == (1, 7, 7, "gpl")
    assert pick(3)[1:] == (0, None, None, "", "mit") and 0.8 <= got[3].score < 1
    assert pick(4) == (6, 3, 0, 4, "cc-by,mit", "cc-by,mit")
    assert pick(5) == (0, 0, None, None, "", "") and got[5].score == 0.0
    assert pick(6)[1:5] == (1, 1, 1, "apache") and pick(8)[5] == ""
    assert pick(7)[5] == "cc-by,cc-by-sa-4.0" and {s.line for s in got[7].spans} == {0}
    out = license.scan(odd).collect()
    assert len(out) == len(ODD) and {r.labels for r in out} == {""} and {r.ids for r in out} == {"clash"}
    assert license.scan(empty).count() == 0


def test_wrapped_notices_are_found(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
        (2, "x y\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:", "bsd"),
        (3, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "isc"),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl-2.0"),
        (5, "licensed under CC BY-SA\n4.0", "cc-by,cc-by-sa-4.0"),
        (6, "licensed under CC BY-SA 4.0\nby", "cc-by,cc-by-sa-4.0"),
        (7, "permission is hereby granted free " + "and so on " * 20 + "\nof charge to any person " + "and so on " * 20 + "\nobtaining a copy of this software documentation files", ""),
    ]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: got[i].labels for i, *_ in rows} == {i: labels for i, _, labels in rows}
    assert all(got[i].score == 1.0 for i in (1, 2, 3, 4)) and got[7].score == 0.0


def test_a_second_edited_notice_in_a_line_keeps_its_label(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without charge is hereby granted"
    rows = [(1, f"{bsd} and so on. {isc}"), (2, "licensed under CC BY-SA 4.0 and so on")]
    got = {r.doc_id: r.labels for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd,isc", 2: "cc-by,cc-by-sa-4.0"}


def test_filters_lose_no_template():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = [(" ".join(rng.choice(vocabulary, rng.integers(1, 9), replace=False)), f"L{i}") for i in range(25)]
    known = license.Templates(templates, 0.8, {w.encode(): int(rng.integers(0, 50)) for w in vocabulary})
    for _ in range(400):
        line = [w.encode() for w in rng.choice(vocabulary + ["zz"], rng.integers(0, 16))]
        want = {(k, share) for k, (t, _) in enumerate(templates) if (share := len(set(line) & set(t.encode().split())) / len(t.split())) >= 0.8 - 1e-12}
        assert set(known.search(line)) == want


# ---------------------------------------------------------------- 9


def test_gradient_of_the_network():
    net = language.Network.new(["a", "b", "c"], hidden=4, embed=3, seed=5)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, n = language.padded([b"abc", b"z", b"\xc3\xa9ab", b"abcdefg"])
    y = np.array([0, 2, 1, 0])
    _, g = net.gradient(x, n, y)
    rng = np.random.default_rng(0)
    for name, grad in g.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in grad.shape) if name != "E" else (int(rng.choice([97, 98, 122])), int(rng.integers(0, 3)))
            keep = net.weights[name][at]
            loss = []
            for step in (1e-3, -1e-3):
                net.weights[name][at] = keep + step
                loss.append(net.gradient(x, n, y)[0])
            net.weights[name][at] = keep
            assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(grad[at], abs=2e-3), name


def test_network_reads_as_byte_by_byte():
    net = language.Network.new(["a", "b", "c"], hidden=5, embed=4, seed=3)
    texts = ["One word", "é 漢字漢字漢字 mixed with Latin, 12 marks!", "x" * 300, "kurz und gut " * 40, "🙂" * 60, "a", "ab 9 cd"]
    for chunk, context in ((language.CHUNK, language.CONTEXT), (7, 3), (10, 0)):
        flat = [language.letters_of(t.encode()) for t in texts]
        buffer, ends = np.frombuffer(b"".join(flat), np.uint8), np.cumsum([len(f) for f in flat])
        doc, *spans = language.chunked(buffer, ends - [len(f) for f in flat], ends, chunk, context)
        sums = np.zeros((len(texts), 3))
        np.add.at(sums, doc, net.chunk_sums(buffer, *spans))
        for t, f, total in zip(texts, flat, sums, strict=True):
            p = np.exp(total / (len(f) - f.count(b" ")))
            assert p / p.sum() == pytest.approx(plain.language(net, t, chunk, context), abs=1e-4), (t, chunk)


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(9)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    rows = [(i, " ".join(word("abcdef") for _ in range(20)), "common") for i in range(2000)] + [(5000 + i, " ".join(word("uvwxyz") for _ in range(20)), "rare") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    net = language.train(d.unionByName(d.limit(50)), F.lit(True), sample=40, steps=60)
    assert net.langs == ["common", "rare"]
    assert [x[0] for x in language.Scorer(net).documents([b"vwxyzu wwxyzz", b"abcdef fedcba"])] == ["rare", "common"]


def test_language_id(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.train(d, ~common.fold("doc_id", 4).isin(2, -1))
    out = language.identify(d, network).where(common.fold("doc_id", 4) == 2).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    got = language.identify(odd, network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    und = {(r.text or "")[:10] for r in got if r.lang_pred == "und"}
    assert und == {"", " \t\n\x0b ", "12 34 -- !"}
    pooled = language.Scorer(network)
    again = {t: pooled.documents([(t or "").encode()])[0] for _, t in pairs(odd)}
    assert all((r.lang_pred, round(r.score, 4)) == (again[r.text][0], round(again[r.text][1], 4)) for r in got)
    assert language.identify(empty, network).count() == 0
    none = language.train(empty, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


# ---------------------------------------------------------------- 10


def test_quality(spark, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels, common.fold("doc_id", 5) != 0)
    out = quality.score(d, model).join(labels, "doc_id").where(common.fold("doc_id", 5) == 0).select("score", "quality").collect()
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.97
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and {r.ids for r in got} == {"clash"}
    assert all(r.score == pytest.approx(model.score((r.text or "").encode())) for r in got)
    assert quality.score(empty, model).count() == 0
    nothing = quality.train(empty, labels.limit(0), F.lit(True))
    assert nothing.score(b"any") == pytest.approx(0.5)
    mixed = labels.select("doc_id", "quality").limit(5).union(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, quality int"))
    assert 0 <= quality.train(d, mixed, F.lit(True)).score(b"text") <= 1


def test_quality_features_as_counted_one_by_one():
    texts = [b"", b"a", b"the cat sat on a mat", b"xqz zzv kqj ww q pfh", "É é 漢字 Ab1 [x] {y} a a a A a\r\n#!".encode(), b"tab\tand  two   blanks " * 30]
    for raw in texts:
        got = quality.features(raw)
        assert len(set(got.tolist())) == len(got) and (np.diff(got)[len(got) and got[:-1] >= quality.FORM] > 0).all()
        assert set(got.tolist()) == plain.quality_features(raw, quality.HASHED, int(quality.PAIR))
    assert set(quality.features(texts[2]).tolist()) != set(quality.features(texts[3]).tolist())


def test_dual_coordinate_descent_as_in_plain_loops():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(50)]
    values = [rng.normal(size=len(x)) for x in rows]
    y, cost = np.where(rng.random(50) < 0.4, 1.0, -1.0), rng.uniform(0.05, 0.5, 50)
    w, b = quality.descend(rows, values, y, cost, 30, epochs=7, seed=2, settled=0.0)
    want, bias = plain.hinge([dict(zip(x.tolist(), v.tolist(), strict=True)) for x, v in zip(rows, values, strict=True)], y.tolist(), cost.tolist(), 30, 7, 2)
    assert w == pytest.approx(np.array(want), abs=1e-9) and b == pytest.approx(bias, abs=1e-9)


def test_words_decide_where_forms_are_alike(spark):
    rng = np.random.default_rng(10)
    good, bad = ["clear", "plain", "exact", "sound"], ["cheap", "crazy", "dirty", "nasty"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 12))) for i in range(400)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.train(d, labels, F.col("doc_id") < 300)
    assert np.mean([(model.score(t.encode()) >= 0.5) == i % 2 for i, t in rows[300:]]) > 0.97


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(6)
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 12), [60 + y]))) for y in (0, 1) for _ in range(60)]
    labels = np.repeat([0, 1], 60)
    model = quality.fit(rows, labels, size=64)
    margin = np.array([model.weights[x].sum() + model.bias for x in rows])
    assert (margin[labels == 1].min() > margin[labels == 0].max()) and model.slope > 0


# ---------------------------------------------------------------- registry


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)

import random
from collections import deque

import numpy as np
import pytest

from lexigraph.operators import graph, ranking, titles
from pyspark.sql import functions as F

TITLES = ["Kevin Bacon", "Footloose", "Film", "Biology", "Cell (biology)", "Mitochondrion", "Isolated article", "Bacon"]
LINKS = [(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (2, 0), (7, 0), (1, 0), (0, 1), (5, 3)]
REDIRECTS = [(900, "Mitochondria", 105), (901, "Bacon, Kevin", 100), (902, "Movie", 102)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, 100 + i, t) for i, t in enumerate(TITLES)], "idx long, page_id long, title string").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(LINKS, "src long, dst long").distinct().cache()


def test_degrees_and_ranks(nodes, edges):
    ranks = {r.idx: (r.degree, r["rank"]) for r in graph.rank_by(graph.degrees(nodes, edges), "degree").collect()}
    assert ranks[0] == (3, 1) and ranks[6] == (0, 7) and ranks[7] == (0, 8)


def test_rank_ties_go_to_the_smaller_idx(spark):
    s = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.1), (3, 0.9)], "idx long, score double")
    assert {r.idx: r["rank"] for r in graph.rank_by(s, "score", single=True).collect()} == {3: 1, 1: 2, 0: 3, 2: 4}


def test_ranked_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(7)
    got = {r.x: r["rank"] for r in ranking.ranked(df, "x").collect()}
    assert got == {x: x + 1 for x in range(1000)}
    sums = {r.x: r.s for r in ranking.running_sum(df, "x", "x", name="s").collect()}
    assert sums == {x: x * (x + 1) // 2 for x in range(1000)}


def plain_path(adjacent, a, b):
    dist, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in adjacent.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist.get(b)


def test_shortest_path(edges):
    p = graph.shortest_path(edges, 0, 5)
    assert [TITLES[i] for i in p.nodes] == ["Kevin Bacon", "Footloose", "Film", "Biology", "Mitochondrion"] and p.degree == 4
    assert graph.shortest_path(edges, 0, 6).nodes is None
    assert graph.shortest_path(edges, 3, 3).degree == 0


def test_shortest_path_against_plain_search(spark):
    rng = random.Random(42)
    n = 30
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(55)}
    pairs = {(a, b) for a, b in pairs if a != b}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long").cache()
    adjacent = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)
    for _ in range(5):
        a, b = rng.randrange(n), rng.randrange(n)
        p = graph.shortest_path(e, a, b)
        assert p.degree == plain_path(adjacent, a, b)
        assert p.nodes is None or all(x in pairs for x in zip(p.nodes, p.nodes[1:], strict=False))


def test_pagerank_against_dense_iteration(spark):
    rng = np.random.default_rng(3)
    n = 40
    m = (rng.random((n, n)) < 0.08) & ~np.eye(n, dtype=bool)
    m[5] = False
    s = np.full(n, 1 / n)
    for _ in range(500):
        out = m.sum(1)
        share = np.where(out > 0, s / np.maximum(out, 1), 0)
        new = 0.15 / n + 0.85 * (share @ m + s[out == 0].sum() / n)
        new /= new.sum()
        done, s = np.abs(new - s).sum() < 1e-7, new
        if done:
            break
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(m), strict=True)], "src long, dst long")
    nodes = spark.range(n).withColumnRenamed("id", "idx")
    got, rounds, residual = graph.pagerank(nodes, edges, tolerance=1e-7)
    assert residual < 1e-7 and 1 < rounds < 200
    assert max(abs(r.score - s[r.idx]) for r in got.collect()) < 1e-6


def test_redirect_chains_cycles_and_limits(spark):
    article = [(1, 0, "Article", False, 10)]
    chain = [(100 + k, 0, f"R{k}", True, 0) for k in range(12)]
    odd = [(200, 0, "C1", True, 0), (201, 0, "C2", True, 0), (202, 0, "Interwiki", True, 0), (203, 0, "Nowhere", True, 0), (204, 4, "Elsewhere", True, 0)]
    pages = spark.createDataFrame(article + chain + odd, "page_id long, ns int, title string, is_redirect boolean, length long")
    rows = [(100, 0, "Article", "")] + [(100 + k, 0, f"R{k - 1}", "") for k in range(1, 12)]
    rows += [(200, 0, "C2", ""), (201, 0, "C1", ""), (202, 0, "Article", "fr"), (203, 0, "Missing", ""), (204, 0, "Article", ""), (1, 0, "R1", "")]
    redirects = spark.createDataFrame(rows, "rd_from long, rd_namespace int, rd_title string, rd_interwiki string")
    articles = graph.articles(pages)
    got = {r.page_id: r.target for r in graph.redirect_targets(pages, redirects, articles).collect()}
    assert got == {100 + k: 1 for k in range(10)}  # R9 takes ten hops, R10 eleven
    red = graph.redirect_targets(pages, redirects, articles)
    targets = spark.createDataFrame([(1, 0, "R3"), (2, 0, "Article"), (3, 0, "Missing"), (4, 1, "Article")], "lt_id long, lt_namespace int, lt_title string")
    known = graph.link_targets(targets, articles, red)
    assert {r.lt_id: r.idx for r in known.collect()} == {1: 0, 2: 0}
    links = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (100, 0, 2)], "pl_from long, pl_from_namespace int, pl_target_id long")
    assert graph.link_edges(links, articles, known).count() == 0  # only links of the article to itself


def test_profile_and_neighbours(nodes, edges):
    ranks = {"indegree": graph.rank_by(graph.degrees(nodes, edges), "degree")}
    p = graph.profile(nodes, ranks, edges, 0, "indegree")
    assert p["title"] == "Kevin Bacon" and p["indegree"]["percentile"] == 100 and (p["in_degree"], p["out_degree"]) == (3, 1)
    assert p["out_neighbours"] == [("Footloose", 3)] or p["out_neighbours"][0][0] == "Footloose"
    assert {t for t, _ in p["in_neighbours"]} == {"Film", "Footloose", "Bacon"}


def test_overlap_share_of_a_sample(spark, edges):
    some = spark.createDataFrame([(2, 0), (4, 5), (1, 0)], "src long, dst long")
    r = graph.overlap_share(some, edges).first()
    assert (r.edges, r.shared) == (3, 2)
    assert graph.overlap_share(some, edges, nodes=1, seed=3).first().edges == 1


@pytest.fixture(scope="module")
def index(spark, nodes, edges):
    red = spark.createDataFrame(REDIRECTS, "page_id long, title string, target long")
    return titles.index(nodes, red, graph.degrees(nodes, edges)).cache()


def test_title_search(index):
    assert titles.exact(index, "KEVIN_BACON").first().title == "Kevin Bacon"
    assert titles.exact(index, "nobody").first() is None
    assert [r.article for r in titles.search(index, "bacon").collect()][:2] == ["Bacon", "Kevin Bacon"]
    assert {r.title for r in titles.contains(index, "olo").collect()} == {"Biology", "Cell (biology)"}
    assert titles.contains(index, "ol").count() == 0 and titles.prefix(index, "ki").count() == 0
    for typo, right in (("Mitocondrion", "Mitochondrion"), ("Kevn Bacon", "Kevin Bacon")):
        assert titles.search(index, typo).first().article == right
    assert titles.search(index, "Movie").first().article == "Film"
    assert titles.search(index, "  ").count() == 0


def test_title_index_order(index):
    rows = index.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 12))
    assert (rows[0].title, rows[1].title) == ("Kevin Bacon", "Bacon, Kevin")
    assert titles.random_article(index, 100, 7).first() == titles.random_article(index, 100, 7).first()

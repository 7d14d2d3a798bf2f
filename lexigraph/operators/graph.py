"""The link graph: building, degrees, PageRank, shortest paths, leaderboards.

Tables: nodes(idx, page_id, title, ...), edges(src, dst) in idx, distinct and without
self-loops.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, settled
from .ranking import percentile, ranked, sample

MAX_HOPS = 10

# ---------------------------------------------------------------- building


def articles(pages: DataFrame) -> DataFrame:
    """Non-redirect pages of namespace 0 with idx, their place by page_id (from 0)."""
    kept = pages.where("ns = 0 AND NOT is_redirect").select("page_id", "title", "length")
    return ranked(kept, "page_id", name="idx", start=0)


def redirect_targets(pages: DataFrame, redirects: DataFrame, articles: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(page_id, title, target): redirect pages and the article that they lead to.

    A redirect counts if its page is a redirect in namespace 0 and its target stands in
    namespace 0 of this wiki. Chains are followed for ``hops`` steps; longer ones, cycles and
    chains to nowhere drop out.
    """
    sources = pages.where("ns = 0 AND is_redirect").select(F.col("page_id").alias("rd_from"), "title")
    named = articles.select("page_id", "title").withColumn("final", F.lit(True)).unionByName(sources.select(F.col("rd_from").alias("page_id"), "title").withColumn("final", F.lit(False)))
    valid = redirects.where("rd_namespace = 0 AND coalesce(rd_interwiki, '') = ''").select("rd_from", "rd_title")
    step = settled(valid.join(sources, "rd_from", "left_semi").join(named, valid.rd_title == named.title).select("rd_from", F.col("page_id").alias("to"), "final"), "redirects")
    rounds = [step.where("final").select("rd_from", "to")]
    hop = step.select(F.col("rd_from").alias("to"), F.col("to").alias("next"), "final")
    open_ = step.where("NOT final").select("rd_from", "to")
    for _ in range(hops - 1):
        if open_.isEmpty():
            break
        following = settled(open_.join(hop, "to").select("rd_from", F.col("next").alias("to"), "final"), "redirects")
        rounds.append(following.where("final").select("rd_from", "to"))
        open_ = following.where("NOT final").select("rd_from", "to")
    out = reduce(DataFrame.unionByName, rounds)
    return out.join(sources, "rd_from").select(F.col("rd_from").alias("page_id"), "title", F.col("to").alias("target"))


def link_targets(linktargets: DataFrame, articles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(lt_id, idx): link targets of namespace 0 as articles, through redirects; red links drop out."""
    ends = articles.select("title", "idx").unionByName(redirects.join(articles.select(F.col("page_id").alias("target"), "idx"), "target").select("title", "idx"))
    return linktargets.where("lt_namespace = 0").join(ends, linktargets.lt_title == ends.title).select("lt_id", "idx")


def link_edges(pagelinks: DataFrame, articles: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (src, dst): links from articles to articles, without links to the page itself."""
    src = pagelinks.where("pl_from_namespace = 0").join(articles.select(F.col("page_id").alias("pl_from"), F.col("idx").alias("src")), "pl_from")
    both = src.join(targets.select(F.col("lt_id").alias("pl_target_id"), F.col("idx").alias("dst")), "pl_target_id")
    return both.where("src <> dst").select("src", "dst").distinct()


def overlap_share(some: DataFrame, all_: DataFrame, nodes: int | None = None, seed: int = 1) -> DataFrame:
    """(edges, shared, share): how many of ``some`` edges are in ``all_``, over a sample of source nodes or all."""
    if nodes is not None:
        some = some.join(sample(some.select("src").distinct(), "src", nodes, seed), "src", "left_semi")
    marked = some.select("src", "dst").join(all_.select("src", "dst").distinct().withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    total = marked.agg(F.count(F.lit(1)).alias("edges"), F.count("hit").alias("shared"))
    return total.withColumn("share", F.when(F.col("edges") > 0, F.col("shared") / F.col("edges")))


# ---------------------------------------------------------------- metrics


def degrees(nodes: DataFrame, edges: DataFrame, side: str = "dst", name: str = "degree") -> DataFrame:
    """(idx, name): edges into (side dst) or out of (side src) every node; 0 without any."""
    counted = edges.groupBy(F.col(side).alias("idx")).agg(F.count(F.lit(1)).alias(name))
    return nodes.select("idx").join(counted, "idx", "left").select("idx", F.coalesce(name, F.lit(0)).alias(name))


def rank_by(scores: DataFrame, score: str, single: bool = False) -> DataFrame:
    """(idx, score, rank): highest first, ties to the smaller idx; ``single`` compares as 32-bit floats."""
    key = F.col(score).cast("float") if single else F.col(score)
    return ranked(scores.select("idx", key.alias(score)), F.desc(score), "idx")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, max_iterations: int = 200) -> tuple[DataFrame, int, float]:
    """((idx, score), iterations, residual): PageRank with the dangling mass spread evenly.

    Starts evenly; each round adds the teleport share, spreads dangling mass, and divides by
    the sum; it ends when the summed change falls below ``tolerance``. Edges and scores are
    tables in the shared folder, so a lost executor costs one round. Only three sums come
    to the driver.
    """
    n = nodes.count()
    if not n:
        return nodes.select("idx", F.lit(0.0).alias("score")), 0, 0.0
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    weighted = settled(edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("out")).alias("w")).repartition("src"), "weighted")
    base = settled(nodes.select("idx").join(out, nodes.idx == out.src, "left").select("idx", F.col("out").isNull().alias("dangling")), "base")
    scores, residual, mass = base.withColumn("score", F.lit(1.0 / n)), float("inf"), base.where("dangling").count() / n
    last = None
    for done in range(1, max_iterations + 1):
        gathered = weighted.join(scores.select(F.col("idx").alias("src"), "score"), "src").groupBy(F.col("dst").alias("idx")).agg(F.sum(F.col("score") * F.col("w")).alias("s"))
        raw = scores.join(gathered, "idx", "left").select("idx", "dangling", F.col("score").alias("old"), (F.lit((1 - damping) / n) + damping * (F.coalesce("s", F.lit(0.0)) + mass / n)).alias("raw"))
        raw = settled(raw, "scores")
        total = raw.agg(F.sum("raw")).first()[0]
        scores = raw.select("idx", "dangling", (F.col("raw") / total).alias("score"), "old")
        residual, mass = scores.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0))).first()
        scores = scores.drop("old")
        if last is not None:
            discard(last)
        last = raw
        if residual < tolerance:
            break
    discard(weighted)
    return scores.select("idx", "score"), done, residual


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def surprises(ranks: DataFrame, first: str, second: str, top: int, n: int, up: bool) -> DataFrame:
    """The n nodes whose place differs most between two rankings, of those among the ``top`` of either.

    ``ranks``: (idx, first, second) with ranks; ratio = ln(second / first): highest first if
    ``up``, lowest first else; its sign isn't judged. Ties to the smaller idx.
    """
    pool = ranks.where((F.col(first) <= top) | (F.col(second) <= top))
    scored = pool.withColumn("ratio", F.log(F.col(second) / F.col(first)))
    return scored.orderBy(F.desc("ratio") if up else F.asc("ratio"), "idx").limit(n)


def top_neighbours(edges: DataFrame, ranks: DataFrame, n: int = 5, side: str = "dst") -> DataFrame:
    """(idx, neighbour, rank, place): each node's n best ranked neighbours, by dst (links out) or src (links in).

    A node's neighbours are cut to n inside every task first (Spark's group limit), so a hub
    doesn't gather in one task.
    """
    other, own = side, "src" if side == "dst" else "dst"
    joined = edges.select(F.col(own).alias("idx"), F.col(other).alias("neighbour")).join(ranks.select(F.col("idx").alias("neighbour"), "rank"), "neighbour")
    place = F.row_number().over(Window.partitionBy("idx").orderBy("rank", "neighbour"))
    return joined.withColumn("place", place).where(F.col("place") <= n).select("idx", "neighbour", "rank", "place")


def default_metric(metrics: DataFrame, nodes: int) -> str:
    """'prose' if it is there for every node, else 'pagerank'. ``metrics``: (idx, metric, score, rank)."""
    return "prose" if metrics.where("metric = 'prose'").count() == nodes else "pagerank"


def leaderboard(metrics: DataFrame, nodes: DataFrame, edges: DataFrame, metric: str, n: int = 50, skip: int = 0) -> DataFrame:
    """Ranks skip+1 to skip+n of a metric: title, score, degrees in ``edges``, and a rank_<metric> for every metric.

    The page's nodes are few, so degrees are counted for them alone.
    """
    page = metrics.where((F.col("metric") == metric) & (F.col("rank") > skip) & (F.col("rank") <= skip + n)).select("idx", "score", "rank")
    names = sorted(r.metric for r in metrics.select("metric").distinct().collect())
    ranks = metrics.join(F.broadcast(page.select("idx")), "idx", "left_semi").groupBy("idx").pivot("metric", names).agg(F.first("rank"))
    out = page.join(nodes.select("idx", "title"), "idx").join(ranks.select("idx", *[F.col(m).alias(f"rank_{m}") for m in names]), "idx")
    for name, side in (("out_degree", "src"), ("in_degree", "dst")):
        own = edges.join(F.broadcast(page.select(F.col("idx").alias(side))), side, "left_semi").groupBy(F.col(side).alias("idx")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(own, "idx", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def profile(nodes: DataFrame, ranks: dict[str, DataFrame], edges: DataFrame, idx: int, best: str, n: int = 5) -> dict:
    """Ranks, percentiles and scores of one node by every metric, its degrees, and its best neighbours both ways.

    ``ranks``: metric to (idx, score, rank); ``best``: the metric that orders neighbours.
    """
    total = nodes.count()
    own = F.col("idx") == idx
    out = {"idx": idx, "title": (nodes.where(own).select("title").first() or [None])[0]}
    for metric, table in ranks.items():
        row = table.where(own).withColumn("percentile", percentile(F.col("rank"), F.lit(total))).first()
        out[metric] = row.asDict() if row else None
    for way, side in (("out", "src"), ("in", "dst")):
        mine = edges.where(F.col(side) == idx)
        out[f"{way}_degree"] = mine.count()
        near = top_neighbours(mine, ranks[best], n, "dst" if side == "src" else "src").join(nodes.select(F.col("idx").alias("neighbour"), "title"), "neighbour")
        out[f"{way}_neighbours"] = [(r.title, r["rank"]) for r in near.orderBy("place").collect()]
    return out


# ---------------------------------------------------------------- paths


SMALL_FRONTIER = 200_000


def _near(front: DataFrame, size: int) -> DataFrame:
    """A frontier of (node): broadcast up to ``SMALL_FRONTIER`` rows that were counted, so that edges stay where they are."""
    return F.broadcast(front) if size <= SMALL_FRONTIER else front


@dataclass
class Path:
    nodes: list[int] | None
    visited: int

    @property
    def degree(self) -> int | None:
        return None if self.nodes is None else len(self.nodes) - 1


def shortest_path(edges: DataFrame, start: int, goal: int, max_levels: int = 20) -> Path:
    """A shortest directed path, by search from both ends.

    Each level expands the side whose frontier has fewer edges (the forward side on equal
    terms). Visited nodes with a parent and a distance are tables in the shared folder;
    the driver sees counts and, at the end, the path.
    """
    spark = edges.sparkSession
    if start == goal:
        return Path([start], 1)
    whole = settled(edges.select("src", "dst"), "edges")

    def expanded(side: dict) -> None:
        """The edges out of the side's frontier, as a table, and how many."""
        met = whole.join(_near(side["front"].select(F.col("node").alias(side["from"])), side["front_size"]), side["from"])
        side["next"] = settled(met.select(F.col(side["to"]).alias("node"), F.col(side["from"]).alias("parent")), "frontier")
        side["size"] = side["next"].count()

    sides = []
    for node, own, to in ((start, "src", "dst"), (goal, "dst", "src")):
        first = spark.createDataFrame([(node, None, 0)], "node long, parent long, dist int")
        sides.append({"seen": first, "front": first, "front_size": 1, "from": own, "to": to, "dist": 0})
        expanded(sides[-1])
    found = Path(None, 0)
    for _ in range(max_levels):
        k = 0 if sides[0]["size"] <= sides[1]["size"] else 1
        side, other = sides[k], sides[1 - k]
        if not side["size"]:
            break
        side["dist"] += 1
        new = side["next"].groupBy("node").agg(F.min("parent").alias("parent")).join(side["seen"], "node", "left_anti").withColumn("dist", F.lit(side["dist"]))
        side["front"] = settled(new, "level")
        side["front_size"] = side["front"].count()
        side["seen"] = side["seen"].unionByName(side["front"])
        met = side["front"].join(other["seen"].select("node", F.col("dist").alias("far")), "node").orderBy("far", "node").first()
        if met:
            found = Path(_walk(sides[0]["seen"], met.node)[::-1] + _walk(sides[1]["seen"], met.node)[1:], 0)
            break
        discard(side["next"])
        expanded(side)
    found.visited = sum(side["seen"].count() for side in sides)
    discard(whole)
    return found


def _walk(seen: DataFrame, node: int) -> list[int]:
    out = [node]
    while (row := seen.where(F.col("node") == out[-1]).first()) and row.parent is not None:
        out.append(row.parent)
    return out


def levels(edges: DataFrame, start: int, max_levels: int = 20) -> DataFrame:
    """(node, level): the distance of every node that is reached from ``start`` within ``max_levels`` links."""
    spark = edges.sparkSession
    whole = settled(edges.select("src", "dst"), "edges")
    front, size = spark.createDataFrame([(start, 0)], "node long, level int"), 1
    seen = front
    for level in range(1, max_levels + 1):
        reached = whole.join(_near(front.select(F.col("node").alias("src")), size), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = settled(reached.withColumn("level", F.lit(level)), "level")
        size = front.count()
        if not size:
            break
        seen = seen.unionByName(front)
    discard(whole)
    return seen

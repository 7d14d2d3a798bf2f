"""The build as stages: dump files to data sets, each with a manifest; finished stages are skipped."""

from __future__ import annotations

import time
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wikitext
from ..operators import fusion, geo, graph, keyword, ranking, titles
from ..sources import multistream, sqldump
from ..store import exists, fingerprint, read_dataset, read_json, remove, write_dataset, write_json


@dataclass(frozen=True)
class Settings:
    """What a build can be told; ``checked`` refuses values that make no sense."""

    damping: float = 0.85
    tolerance: float = 1e-9
    max_iterations: int = 200
    lead_chars: int = 1200
    shard_rows: int = 50_000
    embed_limit: int = 50_000

    def checked(self) -> Settings:
        if not 0 < self.damping < 1:
            raise ValueError("damping must be between 0 and 1")
        for f in fields(self)[1:]:
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be more than 0")
        return self

    @classmethod
    def load(cls, text: str, environment: dict[str, str] | None = None) -> Settings:
        """From a TOML table [build]; variables LEXIGRAPH_<NAME> go before it."""
        known = {f.name: type(f.default) for f in fields(cls)}
        given = {k: v for k, v in tomllib.loads(text).get("build", {}).items() if k in known}
        given |= {n: (environment or {})[f"LEXIGRAPH_{n.upper()}"] for n in known if f"LEXIGRAPH_{n.upper()}" in (environment or {})}
        return replace(cls(), **{k: known[k](v) for k, v in given.items()}).checked()

    def dump(self) -> str:
        return "[build]\n" + "".join(f"{k} = {v}\n" for k, v in asdict(self).items())


@dataclass
class Build:
    spark: SparkSession
    source: str
    target: str
    settings: Settings = field(default_factory=Settings)
    inputs: tuple[str, ...] = ()  # what the stage that runs needs

    def path(self, name: str) -> str:
        return f"{self.target}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return read_dataset(self.spark, self.path(name), settings=fingerprint(asdict(self.settings)))

    def manifest(self, name: str) -> dict | None:
        """The data set's manifest, if it was built with these settings."""
        meta = read_json(self.spark, f"{self.path(name)}.meta.json")
        return meta if meta and meta.get("settings") == fingerprint(asdict(self.settings)) else None

    def built(self, names: tuple[str, ...]) -> dict[str, str | None]:
        return {n: (self.manifest(n) or {}).get("built") for n in names}

    def write(self, name: str, df: DataFrame, sort: list[str] | None = None, **meta: Any) -> None:
        write_dataset(df, self.path(name), {"settings": fingerprint(asdict(self.settings)), "inputs": self.built(self.inputs)} | meta, sort=sort)

    def file(self, name: str) -> str:
        return f"{self.source}/{name}"


def core(b: Build) -> None:
    """Articles, redirects and the link graph; edges once by source and once by target."""
    pages = sqldump.pages(b.spark, b.file("page.sql.gz"))
    articles = graph.articles(pages)
    b.write("articles", articles.repartitionByRange("page_id"), ["page_id"])
    articles = b.read("articles")
    redirects = graph.redirect_targets(pages, sqldump.redirects(b.spark, b.file("redirect.sql.gz")), articles)
    b.write("redirects", redirects)
    targets = graph.link_targets(sqldump.linktargets(b.spark, b.file("linktarget.sql.gz")), articles, b.read("redirects"))
    edges = graph.link_edges(sqldump.pagelinks(b.spark, b.file("pagelinks.sql.gz")), articles, targets)
    b.write("edges", edges.repartitionByRange("src", "dst"), ["src", "dst"])
    b.write("edges_in", b.read("edges").repartitionByRange("dst", "src"), ["dst", "src"])


def title_index(b: Build) -> None:
    degree = graph.degrees(b.read("articles"), b.read("edges"))
    b.write("titles", titles.index(b.read("articles"), b.read("redirects"), degree).repartitionByRange("id"), ["id"])


def text(b: Build) -> None:
    """Leads in order of popularity, from rank 0."""
    articles = b.read("articles")
    rank = ranking.ranked(graph.degrees(articles, b.read("edges")), F.desc("degree"), "idx", name="rank", start=0)
    found = wikitext.lead_rows(multistream.kept(multistream.pages(b.spark, b.file("pages.xml.bz2"))), b.settings.lead_chars)
    leads = found.drop("title").join(articles.select("page_id", "idx", "title"), "page_id").join(rank.select("idx", F.col("rank").alias("raw")), "idx")
    placed = ranking.ranked(leads, "raw", "page_id", name="rank", start=0).drop("raw")
    b.write("leads", placed.repartitionByRange("rank"), ["rank"])


def prose_graph(b: Build) -> None:
    articles = b.read("articles")
    links = wikitext.link_rows(multistream.kept(multistream.pages(b.spark, b.file("pages.xml.bz2"))))
    edges, nodes = wikitext.prose_graph(links, articles, b.read("redirects"))
    b.write("prose_edges", edges.repartitionByRange("src", "ord"), ["src", "ord"])
    b.write("first_links", nodes)


def centrality(b: Build) -> None:
    """(idx, metric, score, rank) of PageRank, reverse PageRank, in-degree and, with a prose graph, prose PageRank."""
    articles, edges, s = b.read("articles"), b.read("edges"), b.settings
    wanted = {"pagerank": edges, "reverse": graph.reverse_edges(edges)}
    if exists(b.spark, f"{b.path('prose_edges')}.meta.json"):
        wanted["prose"] = b.read("prose_edges").select("src", "dst")
    parts = []
    for metric, e in wanted.items():
        scores, _, _ = graph.pagerank(articles, e, s.damping, s.tolerance, s.max_iterations)
        parts.append(graph.rank_by(scores, "score", single=True).select("idx", F.lit(metric).alias("metric"), F.col("score").cast("double").alias("score"), "rank"))
    degree = graph.rank_by(graph.degrees(articles, edges), "degree")
    parts.append(degree.select("idx", F.lit("indegree").alias("metric"), F.col("degree").cast("double").alias("score"), "rank"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    b.write("metrics", every.repartition("metric"), ["rank"], nodes=articles.count())


def places(b: Build) -> None:
    tags = sqldump.geo_tags(b.spark, b.file("geo_tags.sql.gz"))
    articles = b.read("articles")
    built = geo.build_places(tags, articles, sqldump.langlinks(b.spark, b.file("langlinks.sql.gz")), graph.degrees(articles, b.read("edges")))
    counts = geo.audit(tags, articles).first().asDict() | {"secondary_only": geo.secondary_only(tags, articles).count()}
    b.write("places", built.repartitionByRange("lat", "lon"), ["lat", "lon"], counts=counts)


def keyword_index(b: Build) -> None:
    docs = b.read("leads").where("disambig = 0").select(F.col("page_id").alias("doc"), "title", "lead")
    index = keyword.build(docs)
    b.write("occurrences", index.occurrences, ["term"], documents=index.documents, average=index.average)
    b.write("sizes", index.sizes)


def embed(b: Build, encode: Callable = fusion.hashed, model: str = "hashed-64") -> int:
    """Vectors of leads in shards of rank; finished shards of the same model, size and leads stay. Returns how many were built."""
    s, base = b.settings, b.path("vectors")
    leads = b.read("leads")
    signature = fingerprint({"model": model, "shard": s.shard_rows, "leads": (read_json(b.spark, f"{b.path('leads')}.meta.json") or {}).get("built")})
    manifest = f"{base}.shards.json"
    state = read_json(b.spark, manifest) or {}
    if state.get("signature") != signature:
        remove(b.spark, base)
        state = {"signature": signature, "done": []}
    total = min(s.embed_limit, leads.count())
    built = 0
    for shard in range(-(-total // s.shard_rows)):
        first, last = shard * s.shard_rows, min((shard + 1) * s.shard_rows, total)
        if [shard, last] in state["done"]:
            continue
        rows = leads.where((F.col("rank") >= first) & (F.col("rank") < last) & (F.col("disambig") == 0) & (F.col("lead") != ""))
        fusion.embedded(rows.select("page_id", F.concat_ws(": ", "title", "lead").alias("text")), "text", encode=encode).select("page_id", "embedding").write.mode("overwrite").parquet(f"{base}/shard={shard}")
        state["done"] = [d for d in state["done"] if d[0] != shard] + [[shard, last]]
        write_json(b.spark, manifest, state)
        built += 1
    return built


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Build], Any]
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    by_hand: bool = False


STAGES = [
    Stage("core", core, (), ("articles", "redirects", "edges", "edges_in")),
    Stage("titles", title_index, ("articles", "redirects", "edges"), ("titles",)),
    Stage("prose_graph", prose_graph, ("articles", "redirects"), ("prose_edges", "first_links")),
    Stage("centrality", centrality, ("articles", "edges"), ("metrics",)),
    Stage("places", places, ("articles", "edges"), ("places",)),
    Stage("text", text, ("articles", "edges"), ("leads",)),
    Stage("keyword", keyword_index, ("leads",), ("occurrences", "sizes")),
    Stage("embed", embed, ("leads",), ("vectors",), by_hand=True),
]


def done(b: Build, stage: Stage) -> bool:
    """All that the stage makes is there, with these settings, and was built from the inputs that are there now."""
    made = [b.manifest(n) for n in stage.makes]
    return all(made) and all(m.get("inputs", {}) == b.built(stage.needs) for m in made)


def missing(b: Build, stage: Stage) -> list[str]:
    return [n for n in stage.needs if not b.manifest(n)]


#: Runs that the log keeps.
RUNS = 50


def run_all(b: Build, stages: list[Stage] | None = None) -> list[tuple[str, str]]:
    """Runs what isn't done, in order, and stops at the first failure: (stage, done, ran, skipped or failed: why)."""
    out: list[tuple[str, str]] = []
    seconds: dict[str, float] = {}
    for stage in stages or STAGES:
        if stage.by_hand:
            out.append((stage.name, "skipped"))
        elif done(b, stage):
            out.append((stage.name, "done"))
        elif lacking := missing(b, stage):
            out.append((stage.name, f"failed: no {', '.join(lacking)}"))
            break
        else:
            began = time.monotonic()
            b.inputs = stage.needs
            try:
                stage.run(b)
            except Exception as e:  # a stage's failure is reported, and the rest isn't tried
                out.append((stage.name, f"failed: {e}"))
                break
            finally:
                seconds[stage.name] = round(time.monotonic() - began, 3)
                b.inputs = ()
            out.append((stage.name, "ran"))
    log = read_json(b.spark, f"{b.target}/runs.json") or {}
    run = {"ended": datetime.now(UTC).isoformat(timespec="seconds"), "settings": asdict(b.settings), "stages": out, "seconds": seconds}
    write_json(b.spark, f"{b.target}/runs.json", {"runs": [*log.get("runs", []), run][-RUNS:]})
    return out

"""Places: building them from coordinate tags, and what is notable near a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bearing_deg, bounding_boxes, compass, haversine_km, in_boxes
from ..store import settled

SIGNAL_WEIGHT, LANGS_WEIGHT = 0.7, 0.3
UNTYPED = "untyped"
BLOCK, TASK_PAIRS, MOST_TASKS, MANY_CELLS = 2000, 16_000_000, 20_000, 200_000


def split_type(column: Column) -> tuple[Column, Column]:
    """'city(334,000)' to (city, 334000); 'river:us-oh' to (river, null); blank to nulls."""
    kind = F.lower(F.trim(F.regexp_extract(column, r"^([^(:]*)", 1)))
    digits = F.regexp_replace(F.regexp_extract(column, r"\(([\d,]+)", 1), ",", "")
    return F.when(kind != "", kind), F.when(digits != "", digits.try_cast("long"))


def judged_tags(tags: DataFrame) -> DataFrame:
    """The tags with lat, lon as doubles and ``verdict``: ok, other_body, secondary or bad_coordinates."""
    lat, lon = F.expr("try_cast(gt_lat AS DOUBLE)"), F.expr("try_cast(gt_lon AS DOUBLE)")
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    verdict = F.when(F.coalesce(F.col("gt_globe"), F.lit("earth")) != "earth", "other_body").when(F.coalesce(F.col("gt_primary").cast("int"), F.lit(0)) != 1, "secondary").when(F.coalesce(good, F.lit(False)), "ok").otherwise("bad_coordinates")
    return tags.withColumn("verdict", verdict).withColumn("lat", lat).withColumn("lon", lon)


def primary_tags(tags: DataFrame) -> DataFrame:
    """One valid primary tag for each page, the one with the smallest gt_id."""
    kind, pop = split_type(F.col("gt_type"))
    ok = judged_tags(tags).where("verdict = 'ok'").select("gt_page_id", "gt_id", "lat", "lon", kind.alias("type"), pop.alias("pop"))
    first = ok.groupBy("gt_page_id").agg(F.min_by(F.struct("gt_id", "lat", "lon", "type", "pop"), "gt_id").alias("t"))
    return first.select(F.col("gt_page_id").alias("page_id"), "t.*")


def secondary_only(tags: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles that only have secondary tags."""
    judged = judged_tags(tags)
    pages = judged.where("verdict = 'secondary'").select(F.col("gt_page_id").alias("page_id")).distinct()
    primary = judged.where("verdict IN ('ok', 'bad_coordinates')").select(F.col("gt_page_id").alias("page_id")).distinct()
    return pages.join(primary, "page_id", "left_anti").join(articles.select("page_id"), "page_id", "left_semi")


def build_places(tags: DataFrame, articles: DataFrame, langlinks: DataFrame, in_degree: DataFrame) -> DataFrame:
    """(page_id, idx, title, lat, lon, type, pop, langs, links): articles with their first valid primary tag."""
    langs = langlinks.groupBy(F.col("ll_from").alias("page_id")).agg(F.count(F.lit(1)).alias("langs"))
    joined = primary_tags(tags).join(articles.select("page_id", "idx", "title"), "page_id").join(langs, "page_id", "left").join(in_degree, "idx", "left")
    return joined.select("page_id", "idx", "title", "lat", "lon", "type", "pop", F.coalesce("langs", F.lit(0)).alias("langs"), F.coalesce("degree", F.lit(0)).alias("links"))


def audit(tags: DataFrame, articles: DataFrame) -> DataFrame:
    """Counters of one pass over the tags: what was kept and why the rest was not."""
    judged = judged_tags(tags).join(articles.select(F.col("page_id").alias("gt_page_id"), F.lit(True).alias("known")), "gt_page_id", "left")
    ok = F.col("verdict") == "ok"
    return judged.agg(
        F.count(F.lit(1)).alias("tags"),
        F.count_if(F.col("verdict") == "other_body").alias("other_bodies"),
        F.count_if(F.col("verdict") == "secondary").alias("secondary"),
        F.count_if(F.col("verdict") == "bad_coordinates").alias("bad_coordinates"),
        F.count_if(ok & F.col("known").isNull()).alias("not_articles"),
        (F.count_if(ok & F.col("known").isNotNull()) - F.count_distinct(F.when(ok & F.col("known").isNotNull(), F.col("gt_page_id")))).alias("repeated_primary"),
    )


def notability(signal: Column, langs: Column, signal_max: float, langs_max: float) -> Column:
    """0 to 100 on log scales: 0.7 of the signal and 0.3 of the languages; the signal alone if no place has languages."""
    a = F.log1p(signal) / math.log1p(signal_max) if signal_max > 0 else F.lit(0.0)
    whole = a if langs_max <= 0 else SIGNAL_WEIGHT * a + LANGS_WEIGHT * F.log1p(langs) / math.log1p(langs_max)
    return 100.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole))


def in_range(places: DataFrame, lat: float, lon: float, radius: float, exclude: int | None = None) -> DataFrame:
    """Places within ``radius`` km with ``dist``: box predicates first, which reach the scan, then the exact distance."""
    near = places.where(in_boxes(bounding_boxes(lat, lon, radius), F.col("lat"), F.col("lon"))).withColumn("dist", haversine_km(lat, lon, F.col("lat"), F.col("lon"))).where(F.col("dist") <= radius)
    return near if exclude is None else near.where(F.col("page_id") != exclude)


def nearby(places: DataFrame, lat: float, lon: float, radius: float, types: list[str] | None = None, sort: str = "notable", limit: int = 30, exclude: int | None = None, signal: str = "links") -> DataFrame:
    """The most notable (or nearest) places in range: score, dist, bearing and direction, ties to the smaller page_id.

    ``types`` filters by kind ('untyped' for none). Maxima for the score are over all places.
    """
    top = places.agg(F.max(signal), F.max("langs")).first()
    near = in_range(places, lat, lon, radius, exclude)
    if types:
        near = near.where(F.coalesce("type", F.lit(UNTYPED)).isin([t.strip().lower() for t in types]))
    bearing = bearing_deg(lat, lon, F.col("lat"), F.col("lon"))
    scored = near.withColumn("score", notability(F.col(signal), F.col("langs"), top[0] or 0, top[1] or 0)).withColumn("bearing", bearing).withColumn("direction", compass(F.col("bearing"), F.col("dist")))
    order = [F.desc("score"), F.asc("dist")] if sort == "notable" else [F.asc("dist"), F.desc("score")]
    return scored.orderBy(*order, "page_id").limit(limit)


def histogram(places: DataFrame, lat: float, lon: float, radius: float, exclude: int | None = None) -> DataFrame:
    """Kinds of all places in range."""
    return in_range(places, lat, lon, radius, exclude).groupBy(F.coalesce("type", F.lit(UNTYPED)).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def nearest(places: DataFrame, lat: float, lon: float, after: float = 0.0, limit: int = 1) -> DataFrame:
    """The nearest places farther than ``after`` km."""
    far = places.withColumn("dist", haversine_km(lat, lon, F.col("lat"), F.col("lon"))).where(F.col("dist") > after)
    return far.orderBy("dist", "page_id").limit(limit)


def type_options(places: DataFrame, limit: int = 30) -> DataFrame:
    return places.where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(limit)


def near_many(centres: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """(centre, page_id, dist) for many centres (centre, lat, lon): a join on grid cells with the exact distance behind it.

    Cells are ``radius`` high; a centre looks at the three rows of cells around its own and,
    in each, at the cells that its circle can reach, so every pair meets exactly once. What meets
    grows with the square of a cell's points: cells are cut into blocks of about ``BLOCK`` centres by
    as many places, dealt over so many tasks that each has about ``TASK_PAIRS`` pairs.
    """
    step = max(math.degrees(radius / 6371.0088), 1e-6)
    row = lambda lat: F.floor((lat + 90) / step)
    columns = lambda r: F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(r * step - 90), F.abs((r + 1) * step - 90))))) / step))
    cell = lambda lon, n: F.floor((F.pmod(lon + 180, F.lit(360.0))) / 360 * n)
    placed = places.withColumn("_r", row(F.col("lat"))).withColumn("_n", columns(F.col("_r"))).withColumn("_c", cell(F.col("lon"), F.col("_n")))
    # The widest longitude reach of the circle, in degrees, all the way round where it holds a pole.
    s = F.sin(F.lit(min(radius / 6371.0088, math.pi / 2))) / F.cos(F.radians("lat"))
    wide = (F.abs(F.col("lat")) + step >= 90) | (s >= 1)
    reach = F.when(wide, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), s))) + 1e-9)
    around = centres.withColumn("_reach", reach).withColumn("_r", F.explode(F.sequence(row(F.col("lat")) - 1, row(F.col("lat")) + 1))).withColumn("_n", columns(F.col("_r")))
    first, last = F.floor((F.col("lon") - F.col("_reach") + 180) / 360 * F.col("_n")), F.floor((F.col("lon") + F.col("_reach") + 180) / 360 * F.col("_n"))
    last = F.least(last, first + F.col("_n") - 1)
    around = around.withColumn("_c", F.explode(F.sequence(first, last))).withColumn("_c", F.pmod(F.col("_c"), F.col("_n")))
    around = around.select("centre", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_r", "_c")
    met = _in_blocks(around, placed.select("page_id", "lat", "lon", "_r", "_c"), ["_r", "_c"]).withColumn("dist", haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return met.where(F.col("dist") <= radius).select("centre", "page_id", "dist")


def _in_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on ``keys``; every pair of a key's blocks of both sides is a key of its own."""
    # A number for each row, written with it, so that a task that runs again cuts the same blocks.
    left, right = (settled(x.withColumn("_h", F.xxhash64(F.monotonically_increasing_id())), "blocks") for x in (left, right))
    a, b = (x.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "_a"), (right, "_b")))
    cut = settled(a.join(b, keys).withColumn("_m", F.ceil(F.col("_a") / BLOCK)).withColumn("_n", F.ceil(F.col("_b") / BLOCK)), "cut")
    cells, pairs = cut.agg(F.count(F.lit(1)), F.sum(F.col("_a").cast("double") * F.col("_b"))).first()
    sizes = cut.select(*keys, "_m", "_n")
    sizes = F.broadcast(sizes) if cells <= MANY_CELLS else sizes
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, math.ceil((pairs or 0) / TASK_PAIRS)))

    def dealt(x: DataFrame, own: str, k: str, other: str, n: str) -> DataFrame:
        blocks = x.join(sizes, keys).withColumn(own, F.pmod("_h", k)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
        return blocks.drop("_h", "_m", "_n").repartition(tasks, *keys, "_i", "_j")

    return dealt(left, "_i", "_m", "_j", "_n").hint("merge").join(dealt(right, "_j", "_n", "_i", "_m"), [*keys, "_i", "_j"]).drop("_i", "_j")


def top_near_many(centres: DataFrame, places: DataFrame, radius: float, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("centre").orderBy("dist", "page_id"))
    return near_many(centres, places, radius).withColumn("place", place).where(F.col("place") <= n)

"""Registered queries over places and titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import geo, graph, titles
from ..sources import tables

LAT, LON, RADIUS = 40.0, 10.0, 2500.0


def _articles(spark, d):
    """Customers as articles; one key in seven is none."""
    c = tables.table(spark, d, "customer").where("c_custkey % 7 <> 3")
    return c.select(F.col("c_custkey").alias("page_id"), F.col("c_custkey").alias("idx"), F.col("c_name").alias("title"))


def geo_valid_tags(spark, d):
    return geo.judged_tags(tables.geo_tags(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def geo_audit(spark, d):
    return geo.audit(tables.geo_tags(spark, d), _articles(spark, d))


def first_primary_tag(spark, d):
    return geo.primary_tags(tables.geo_tags(spark, d))


def secondary_only(spark, d):
    return geo.secondary_only(tables.geo_tags(spark, d), _articles(spark, d))


def lang_counts(spark, d):
    return tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count(F.lit(1)).alias("langs"))


def places_join(spark, d):
    """Places built from tags, articles, language links (orders) and links in (orders by day of month)."""
    orders = tables.table(spark, d, "orders")
    degree = orders.groupBy(F.col("o_custkey").alias("idx")).agg(F.count_if(F.col("o_orderpriority") == "5-LOW").alias("degree"))
    return geo.build_places(tables.geo_tags(spark, d), _articles(spark, d), orders.select(F.col("o_custkey").alias("ll_from")), degree)


def _shown(df):
    return df.select("page_id", "title", "type", *[F.round(c, 6).alias(c) for c in ("dist", "score", "bearing")], "direction")


def nearby_notable(spark, d):
    return _shown(geo.nearby(tables.places(spark, d), LAT, LON, RADIUS))


def nearby_distance(spark, d):
    return _shown(geo.nearby(tables.places(spark, d), LAT, LON, RADIUS, sort="distance"))


def nearby_untyped(spark, d):
    return _shown(geo.nearby(tables.places(spark, d), LAT, LON, RADIUS, types=["untyped"]))


def nearby_dateline(spark, d):
    """A circle across the antimeridian, nearest first."""
    return _shown(geo.nearby(tables.places(spark, d), -17.0, 179.5, RADIUS, sort="distance"))


def nearby_pole(spark, d):
    return _shown(geo.nearby(tables.places(spark, d), 88.0, 0.0, RADIUS, sort="distance"))


def nearby_histogram(spark, d):
    return geo.histogram(tables.places(spark, d), LAT, LON, RADIUS)


def nearest_place(spark, d):
    return geo.nearest(tables.places(spark, d), LAT, LON).select("page_id", F.round("dist", 6).alias("dist"))


def bearing_compass(spark, d):
    p = tables.places(spark, d).withColumn("dist", geometry.haversine_km(LAT, LON, F.col("lat"), F.col("lon"))).withColumn("bearing", geometry.bearing_deg(LAT, LON, F.col("lat"), F.col("lon")))
    return p.select("page_id", F.round("dist", 6).alias("dist"), F.round("bearing", 6).alias("bearing"), geometry.compass(F.col("bearing"), F.col("dist")).alias("direction"), F.round(geometry.wrap_lon(F.col("lon") + 200.5), 6).alias("wrapped"))


def type_options(spark, d):
    return geo.type_options(tables.places(spark, d), 3)


def near_many(spark, d):
    """Places within 300 km of every supplier, placed by its key."""
    s = F.col("s_suppkey")
    centres = tables.table(spark, d, "supplier").select(s.alias("centre"), (F.pmod(s * 1543, F.lit(18001)) / 100.0 - 90.0).alias("lat"), (F.pmod(s * 7001, F.lit(36000)) / 100.0 - 180.0).alias("lon"))
    return geo.near_many(centres, tables.places(spark, d), 300.0).select("centre", "page_id", F.round("dist", 6).alias("dist"))


def _titles(spark, d):
    """Parts and customers' redirects, by orders of the part and its redirects."""
    pages, redirects = tables.redirects(spark, d)
    articles = tables.nodes(spark, d).select("idx", "page_id", "title")
    return titles.index(articles, graph.redirect_targets(pages, redirects, articles), graph.degrees(articles, tables.edges(spark, d)))


def title_index_order(spark, d):
    return _titles(spark, d)


def title_exact(spark, d):
    return titles.exact(_titles(spark, d), "CUSTOMER#000000001").select("id", "title", "target")


def title_prefix(spark, d):
    return titles.prefix(_titles(spark, d), "red_w").select("id", "title", "target", "links", "redirect")


def title_prefix_short(spark, d):
    """A prefix of two characters: the most linked of all titles with it."""
    return titles.prefix(_titles(spark, d), "re").select("id", "title", "target", "links", "redirect")


def title_contains(spark, d):
    return titles.contains(_titles(spark, d), "WIDGET 1").select("id", "title", "target", "links", "redirect")


def title_search_ranked(spark, d):
    return titles.search(_titles(spark, d), "customer#0000001").select("target", "title", "links", "redirect", "how", "place", "article")


def title_similar(spark, d):
    return titles.similar(_titles(spark, d), "custmer#000000001").select("id", "title", F.round("ratio", 6).alias("ratio"), "links")


def title_resolve(spark, d):
    """Every redirect with its article's title, first letters in capitals, underscores as blanks."""
    t = _titles(spark, d)
    return titles.with_article(t.where("redirect = 1"), t).select("title", "target", "article", titles.capital_first(titles.title_text(F.lower("title"))).alias("shown"))


TAGS = """
tags AS (SELECT o_orderkey AS gt_id, o_custkey AS gt_page_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'moon' ELSE 'earth' END AS globe,
                CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS prim, o_orderkey * 37 % 19000 / 100.0 - 95.0 AS lat, o_orderkey * 9173 % 36000 / 100.0 - 180.0 AS lon,
                CASE o_orderpriority WHEN '1-URGENT' THEN 'city' WHEN '2-HIGH' THEN 'river' WHEN '3-MEDIUM' THEN 'landmark' END AS type,
                CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey * 10 END AS pop FROM orders),
judged AS (SELECT *, CASE WHEN globe <> 'earth' THEN 'other_body' WHEN prim <> 1 THEN 'secondary' WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) THEN 'ok' ELSE 'bad_coordinates' END AS verdict FROM tags),
arts AS (SELECT c_custkey AS page_id, c_name AS title FROM customer WHERE c_custkey % 7 <> 3),
prime AS (SELECT gt_page_id AS page_id, gt_id, lat::DOUBLE AS lat, lon::DOUBLE AS lon, type, pop FROM judged WHERE verdict = 'ok' QUALIFY row_number() OVER (PARTITION BY gt_page_id ORDER BY gt_id) = 1)
"""
PLACES = """
cnt AS (SELECT o_custkey AS k, count(*) AS links, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS langs FROM orders GROUP BY 1),
places AS (SELECT c_custkey AS page_id, c_name AS title, (c_custkey * 7919 % 17000 / 100.0 - 85.0)::DOUBLE AS lat, (c_custkey * 104729 % 36000 / 100.0 - 180.0)::DOUBLE AS lon,
                  CASE WHEN c_nationkey % 5 > 0 THEN c_mktsegment END AS type, coalesce(langs, 0) AS langs, coalesce(links, 0) AS links FROM customer LEFT JOIN cnt ON k = c_custkey)
"""


def _dist(lat: str, lon: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - ({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - ({lon})) / 2), 2))))"


def _bearing(lat: str, lon: str) -> str:
    y = f"sin(radians(lon - ({lon}))) * cos(radians(lat))"
    x = f"cos(radians({lat})) * sin(radians(lat)) - sin(radians({lat})) * cos(radians(lat)) * cos(radians(lon - ({lon})))"
    return f"((degrees(atan2({y}, {x})) + 360) - 360 * floor((degrees(atan2({y}, {x})) + 360) / 360))"


def _near_sql(lat: str, lon: str, order: str, where: str = "true") -> str:
    direction = "CASE WHEN dist < 0.001 THEN '' ELSE (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((bearing + 22.5) / 45)::INTEGER % 8) + 1] END"
    return f"""WITH {PLACES}, near AS (SELECT *, {_dist(lat, lon)} AS dist, {_bearing(lat, lon)} AS bearing,
 100.0 * greatest(0.0, least(1.0, 0.7 * ln(1 + links) / ln(1 + (SELECT max(links) FROM places)) + 0.3 * ln(1 + langs) / ln(1 + (SELECT max(langs) FROM places)))) AS score FROM places)
SELECT page_id, title, type, round(dist, 6) AS dist, round(score, 6) AS score, round(bearing, 6) AS bearing, {direction} AS direction FROM near WHERE dist <= {RADIUS} AND {where} ORDER BY {order}, page_id LIMIT 30"""


def _titles_sql() -> str:
    from .graph_queries import EDGES, PAGES

    return f"""WITH RECURSIVE {PAGES}, {EDGES}, deg AS (SELECT idx, count(dst) AS links FROM art LEFT JOIN edges ON dst = idx GROUP BY idx),
every AS (SELECT art.page_id AS own, title, art.page_id AS target, links, 0 AS redirect FROM art JOIN deg USING (idx) UNION ALL SELECT page_id, title, target, links, 1 FROM red JOIN deg USING (idx)),
titles AS (SELECT row_number() OVER (ORDER BY links DESC, redirect, length(title), own)::BIGINT AS id, title, target, links::BIGINT AS links, redirect::INTEGER AS redirect FROM every)"""


_T = _titles_sql()
_LOW = "translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COLS = "id, title, target, links, redirect"
QUERIES = {f.__name__: f for f in (geo_valid_tags, geo_audit, first_primary_tag, secondary_only, lang_counts, places_join, nearby_notable, nearby_distance, nearby_untyped, nearby_dateline, nearby_pole, nearby_histogram, nearest_place, bearing_compass, type_options, near_many, title_index_order, title_exact, title_prefix, title_prefix_short, title_contains, title_search_ranked, title_similar, title_resolve)}
_LATS, _LONS = str(LAT), str(LON)
SQL = {
    "geo_valid_tags": f"WITH {TAGS} SELECT verdict, count(*)::BIGINT AS n FROM judged GROUP BY verdict",
    "geo_audit": f"""WITH {TAGS}, j AS (SELECT judged.*, page_id AS known FROM judged LEFT JOIN arts ON page_id = gt_page_id)
SELECT count(*)::BIGINT AS tags, count(*) FILTER (verdict = 'other_body')::BIGINT AS other_bodies, count(*) FILTER (verdict = 'secondary')::BIGINT AS secondary, count(*) FILTER (verdict = 'bad_coordinates')::BIGINT AS bad_coordinates,
 count(*) FILTER (verdict = 'ok' AND known IS NULL)::BIGINT AS not_articles, (count(*) FILTER (verdict = 'ok' AND known IS NOT NULL) - count(DISTINCT gt_page_id) FILTER (verdict = 'ok' AND known IS NOT NULL))::BIGINT AS repeated_primary FROM j""",
    "first_primary_tag": f"WITH {TAGS} SELECT page_id, gt_id, lat, lon, type, pop::BIGINT AS pop FROM prime",
    "secondary_only": f"WITH {TAGS} SELECT DISTINCT gt_page_id AS page_id FROM judged WHERE verdict = 'secondary' AND gt_page_id NOT IN (SELECT gt_page_id FROM judged WHERE verdict IN ('ok', 'bad_coordinates')) AND gt_page_id IN (SELECT page_id FROM arts)",
    "lang_counts": "SELECT o_custkey AS page_id, count(*)::BIGINT AS langs FROM orders GROUP BY 1",
    "places_join": f"""WITH {TAGS}, l AS (SELECT o_custkey AS page_id, count(*) AS langs, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS links FROM orders GROUP BY 1)
SELECT page_id, page_id AS idx, title, lat, lon, type, pop::BIGINT AS pop, coalesce(langs, 0)::BIGINT AS langs, coalesce(links, 0)::BIGINT AS links FROM prime JOIN arts USING (page_id) LEFT JOIN l USING (page_id)""",
    "nearby_notable": _near_sql(_LATS, _LONS, "score DESC, dist"),
    "nearby_distance": _near_sql(_LATS, _LONS, "dist, score DESC"),
    "nearby_untyped": _near_sql(_LATS, _LONS, "score DESC, dist", "type IS NULL"),
    "nearby_dateline": _near_sql("-17.0", "179.5", "dist, score DESC"),
    "nearby_pole": _near_sql("88.0", "0.0", "dist, score DESC"),
    "nearby_histogram": f"WITH {PLACES} SELECT coalesce(type, 'untyped') AS type, count(*)::BIGINT AS n FROM places WHERE {_dist(_LATS, _LONS)} <= {RADIUS} GROUP BY 1",
    "nearest_place": f"WITH {PLACES}, x AS (SELECT page_id, {_dist(_LATS, _LONS)} AS dist FROM places) SELECT page_id, round(dist, 6) AS dist FROM x ORDER BY x.dist, page_id LIMIT 1",
    "bearing_compass": f"""WITH {PLACES}, x AS (SELECT page_id, lon, {_dist(_LATS, _LONS)} AS dist, {_bearing(_LATS, _LONS)} AS bearing FROM places)
SELECT page_id, round(dist, 6) AS dist, round(bearing, 6) AS bearing, CASE WHEN dist < 0.001 THEN '' ELSE (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((bearing + 22.5) / 45)::INTEGER % 8) + 1] END AS direction,
 round(lon + 380.5 - 360 * floor((lon + 380.5) / 360) - 180, 6) AS wrapped FROM x""",
    "type_options": f"WITH {PLACES} SELECT type, count(*)::BIGINT AS n FROM places WHERE type IS NOT NULL GROUP BY type ORDER BY n DESC, type LIMIT 3",
    "near_many": f"WITH {PLACES}, c AS (SELECT s_suppkey AS centre, s_suppkey * 1543 % 18001 / 100.0 - 90.0 AS clat, s_suppkey * 7001 % 36000 / 100.0 - 180.0 AS clon FROM supplier), x AS (SELECT centre, page_id, {_dist('clat', 'clon')} AS dist FROM places, c) SELECT centre, page_id, round(dist, 6) AS dist FROM x WHERE dist <= 300",
    "title_index_order": f"{_T} SELECT {_COLS} FROM titles",
    "title_exact": f"{_T} SELECT id, title, target FROM titles WHERE {_LOW} = 'customer#000000001' ORDER BY title = 'CUSTOMER#000000001' DESC, id LIMIT 1",
    "title_prefix": f"{_T} SELECT {_COLS} FROM titles WHERE starts_with({_LOW}, 'red w') ORDER BY id LIMIT 60",
    "title_prefix_short": f"{_T} SELECT {_COLS} FROM titles WHERE starts_with({_LOW}, 're') ORDER BY id LIMIT 60",
    "title_contains": f"{_T} SELECT {_COLS} FROM titles WHERE contains({_LOW}, 'widget 1') ORDER BY id LIMIT 60",
    "title_search_ranked": f"""{_T}, m AS (SELECT *, CASE WHEN starts_with({_LOW}, 'customer#0000001') THEN 1 ELSE 2 END AS stage FROM titles WHERE contains({_LOW}, 'customer#0000001')),
p AS (SELECT * FROM m WHERE stage = 1 ORDER BY id LIMIT 60), one AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY stage, id) AS k FROM p), r AS (SELECT *, row_number() OVER (ORDER BY stage, id)::INTEGER AS place FROM one WHERE k = 1)
SELECT r.target, r.title, r.links, r.redirect, 'prefix' AS how, place, a.title AS article FROM r JOIN titles a ON a.target = r.target AND a.redirect = 0 WHERE place <= 10""",
    "title_resolve": f"{_T} SELECT r.title, r.target, a.title AS article, upper(substr(lower(r.title), 1, 1)) || substr(replace(lower(r.title), '_', ' '), 2) AS shown FROM titles r JOIN titles a ON a.target = r.target AND a.redirect = 0 WHERE r.redirect = 1",
}

"""Scans and sources: registry checks, catalogue features, vector features, areas, grids of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import ITEMS_SQL, items, query, table
from tilewright import vocab as V
from tilewright.functions import geodesy as G, polygons as P, scalars as S
from tilewright.operators import overlay as O, windows as D
from tilewright.plans import layers as L
from tilewright.session import write_stage
from tilewright.sources import catalogue as C, registry as R, vectors as X
from tilewright.sources.registry_rows import RULES, SOURCES

_Q = lambda s: "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


# ---- registry ------------------------------------------------------------------------------------------------------

def _parts_as_sources(spark, sf_dir):
    """A registry of one source per part; some rows break a rule."""
    themes = F.element_at(F.lit(list(V.THEMES)), (F.col("p_partkey") % 21 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("src-"), F.when(F.col("p_partkey") % 97 == 0, F.lit("same")).otherwise(F.col("p_partkey").cast("string"))).alias("id"),
        F.when(F.col("p_partkey") % 31 != 0, F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 13 == 0, F.array(themes, F.lit("astrology"))).otherwise(F.array(themes)).alias("themes"),
        F.when(F.col("p_partkey") % 17 == 0, "tensor").otherwise("raster").alias("kind"),
        F.element_at(F.lit(["layer", "series", "query", "events"]), (F.col("p_size") % 4 + 1).cast("int")).alias("shape"),
        F.lit("CC BY 4.0").alias("license"), F.col("p_type").alias("description"),
        F.when(F.col("p_partkey") % 19 == 0, "ftp").otherwise("stac").alias("driver"),
        F.when(F.col("p_partkey") % 23 == 0, "magic").when(F.col("p_partkey") % 2 == 0, "optical").alias("explicit_planner"))


@query("s1_registry_violations", """WITH p AS (SELECT 'src-' || CASE WHEN p_partkey % 97 = 0 THEN 'same' ELSE CAST(p_partkey AS VARCHAR) END AS id, p_partkey AS k FROM part)
SELECT id, 'missing name' AS problem FROM p WHERE k % 31 = 0 UNION ALL SELECT id, 'unknown theme' FROM p WHERE k % 13 = 0
UNION ALL SELECT id, 'bad kind' FROM p WHERE k % 17 = 0 UNION ALL SELECT id, 'bad driver' FROM p WHERE k % 19 = 0
UNION ALL SELECT id, 'unknown planner' FROM p WHERE k % 23 = 0
UNION ALL SELECT id, 'duplicate id' FROM p GROUP BY id HAVING count(*) > 1""")
def registry_violations(spark, sf_dir):
    return R.source_violations(_parts_as_sources(spark, sf_dir))


@query("s2_rule_need_violations", """WITH n AS (SELECT o_orderkey AS k FROM orders)
SELECT 'rule-' || CAST(k % 14 AS VARCHAR) AS rule, CASE WHEN k % 11 = 0 THEN 'astrology' ELSE 'water' END AS theme, 'unknown theme' AS problem FROM n WHERE k % 11 = 0
UNION ALL SELECT 'rule-' || CAST(k % 14 AS VARCHAR), CASE WHEN k % 11 = 0 THEN 'astrology' ELSE 'water' END, 'unknown temporal mode' FROM n WHERE k % 7 = 0
UNION ALL SELECT 'rule-' || CAST(k % 14 AS VARCHAR), CASE WHEN k % 11 = 0 THEN 'astrology' ELSE 'water' END, 'unknown priority' FROM n WHERE k % 5 = 0""")
def need_violations(spark, sf_dir):
    n = table(spark, sf_dir, "orders").selectExpr(
        "concat('rule-', o_orderkey % 14) AS rule", "IF(o_orderkey % 11 = 0, 'astrology', 'water') AS theme",
        "IF(o_orderkey % 7 = 0, 'hourly', 'series') AS temporal", "IF(o_orderkey % 5 = 0, NULL, 'required') AS priority")
    return R.need_violations(n)


@query("f11_sources_by_theme", """SELECT 'src-' || CASE WHEN p_partkey % 97 = 0 THEN 'same' ELSE CAST(p_partkey AS VARCHAR) END AS id, 'water' AS theme
FROM part WHERE p_partkey % 21 = 3""")
def sources_by_theme(spark, sf_dir):
    return R.by_theme(_parts_as_sources(spark, sf_dir), "water").select("id", F.lit("water").alias("theme"))


@query("e8_declared_assets_missing", """WITH s AS (SELECT s_suppkey AS k FROM supplier),
f AS (SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS fi FROM lineitem GROUP BY 1)
SELECT 'src-' || CAST(k AS VARCHAR) AS id, CAST((SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.k) AS BIGINT) AS n_items,
 CASE WHEN fi IS NULL THEN 'red,nir,scl' WHEN fi % 10 % 2 = 0 THEN 'scl' ELSE 'nir,scl' END AS missing FROM s LEFT JOIN f ON f.l_suppkey = s.k""")
def declared_missing(spark, sf_dir):
    src = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.create_map(*[x for k in ("red", "nir", "scl") for x in (F.lit(k), F.array(F.lit(k)))]).alias("assets"))
    it = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src-"), F.col("l_suppkey").cast("string")).alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("red"), F.lit("a"), F.lit("nir"), F.lit("b")))
        .otherwise(F.create_map(F.lit("red"), F.lit("a"))).alias("assets"))
    return R.declared_assets_missing(src, it).select("id", "n_items", F.array_join("missing", ",").alias("missing"))


@query("a24_check_totals", "SELECT CAST(count(*) FILTER (s_acctbal > 0) AS BIGINT) AS reachable, CAST(count(*) AS BIGINT) AS total FROM supplier")
def check_totals(spark, sf_dir):
    return R.check_totals(table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("ok")))


# ---- catalogue features --------------------------------------------------------------------------------------------

_FEATURE_SOURCES = ("sentinel-2-l2a", "landsat-c2-l2", "hls-l30", "opera-dswx-hls")


def _feature_json(spark, sf_dir):
    """Catalogue features as JSON text, with the differences between providers that normalisation absorbs."""
    e = (table(spark, sf_dir, "events"))
    k = F.col("event_id")
    src = F.element_at(F.lit(list(_FEATURE_SOURCES)), (k % 4 + 1).cast("int"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    props = F.create_map(
        F.lit("datetime"), F.when(k % 7 != 0, iso(F.col("ts"))),
        F.lit("start_datetime"), F.when(k % 7 <= 1, iso(F.col("ts"))), F.lit("end_datetime"), F.when(k % 7 == 0, iso(F.col("ts") + F.expr("interval 9 days 1 second"))),
        F.lit("eo:cloud_cover"), F.when(k % 29 != 0, ((k * 37) % 101).cast("string")),
        F.lit("grid:code"), F.when(k % 11 != 0, F.concat(F.lit("MGRS-"), (F.col("user_id") % 16).cast("string"))),
        F.lit("landsat:wrs_path"), (k % 200).cast("string"), F.lit("landsat:wrs_row"), F.when(k % 3 != 0, (k % 90).cast("string")),
        F.lit("proj:epsg"), F.when(k % 3 == 0, F.lit("32643")), F.lit("proj:code"), F.when(k % 3 == 1, F.lit("epsg:32644")).when(k % 6 == 2, F.lit("OGC:CRS84")),
        F.lit("proj:bbox"), F.when(k % 5 == 0, F.concat(F.lit("["), k.cast("string"), F.lit(",0,"), (k + 10).cast("string"), F.lit(",20]"))),
        F.lit("proj:transform"), F.when(k % 5 == 1, F.concat(F.lit("[10,0,"), k.cast("string"), F.lit(",0,-10,500,0,0,1]"))),
        F.lit("proj:shape"), F.when(k % 5 == 1, F.lit("[30,40]")))
    x, y = (k % 300 - 150).cast("double"), (k % 120 - 60).cast("double")
    ring = F.array(*[F.array(a, b) for a, b in ((x, y), (x + 1, y), (x + 1, y + 2), (x, y + 2), (x, y))])
    href = lambda n: F.struct(F.concat(F.lit("https://x/"), k.cast("string"), F.lit(f"_{n}.tif")).alias("href"), F.lit("image/tiff").alias("type"), (k * 1000).alias("size"))
    names = ["red", "nir08", "B05", "B04"]
    assets = F.map_from_entries(F.filter(F.array(
        *[F.struct(F.lit(n).alias("key"), href(n).alias("value")) for n in names],
        F.struct(F.when(k % 8 == 3, "1_B01_WTR").otherwise("0_B01_WTR").alias("key"), href("wtr").alias("value"))), lambda p: p["key"].isNotNull()))
    item = F.concat(F.lit("OPERA_HLS.T"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("._T"), F.lpad((k % 77777).cast("string"), 5, "0"), F.lit("_"), k.cast("string"))
    part = F.array(*[F.array(a, b) for a, b in ((x + 2, y + 2), (x + 3, y + 2), (x + 3, y + 3), (x + 2, y + 2))])
    feature = lambda kind, shape: F.to_json(F.struct(item.alias("id"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"),
                                                     F.map_filter(props, lambda _, v: v.isNotNull()).alias("properties"), assets.alias("assets")))
    js = F.when(k % 9 == 0, feature("MultiPolygon", F.array(F.array(ring), F.array(part)))).otherwise(feature("Polygon", F.array(ring)))
    return e.select(src.alias("source_id"), js.alias("js"))


def _normalised(spark, sf_dir):
    return C.normalise(C.parse_features(_feature_json(spark, sf_dir), "js"), R.load_sources(spark))


_NORM_SQL = """k AS (SELECT event_id AS k, user_id AS u, date_trunc('second', ts) AS ts FROM events),
norm AS (SELECT 'OPERA_HLS.T' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || '._T' || lpad(CAST(k % 77777 AS VARCHAR), 5, '0') || '_' || CAST(k AS VARCHAR) AS item_id,
 CASE k % 4 WHEN 0 THEN 'sentinel-2-l2a' WHEN 1 THEN 'landsat-c2-l2' WHEN 2 THEN 'hls-l30' ELSE 'opera-dswx-hls' END AS source_id,
 CASE WHEN k % 7 = 0 THEN ts + INTERVAL 4 DAY + INTERVAL 12 HOUR + INTERVAL 500 MILLISECOND ELSE ts END AS dt,
 CASE WHEN k % 29 <> 0 THEN CAST((k * 37) % 101 AS DOUBLE) END AS cloud_cover,
 CASE k % 4 WHEN 0 THEN CASE WHEN k % 11 <> 0 THEN 'MGRS-' || CAST(u % 16 AS VARCHAR) END
  WHEN 1 THEN CASE WHEN k % 3 <> 0 THEN CAST(k % 200 AS VARCHAR) || '/' || CAST(k % 90 AS VARCHAR) END
  WHEN 2 THEN lpad(CAST(k % 100000 AS VARCHAR), 5, '0') ELSE lpad(CAST(k % 77777 AS VARCHAR), 5, '0') END AS "group",
 CASE k % 3 WHEN 0 THEN 32643 WHEN 1 THEN 32644 END::INT AS epsg,
 CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k END::DOUBLE AS tb_minx, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 200 END::DOUBLE AS tb_miny,
 CASE k % 5 WHEN 0 THEN k + 10 WHEN 1 THEN k + 400 END::DOUBLE AS tb_maxx, CASE k % 5 WHEN 0 THEN 20 WHEN 1 THEN 500 END::DOUBLE AS tb_maxy,
 CASE k % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'nir,red' WHEN 2 THEN 'nir,red' ELSE 'water' END AS assets,
 'https://x/' || CAST(k AS VARCHAR) || CASE k % 4 WHEN 0 THEN '_red' WHEN 1 THEN '_nir08' WHEN 2 THEN '_B05' ELSE '_wtr' END || '.tif' AS first_href,
 CAST(k % 300 - 150 AS DOUBLE) AS minx, CAST(k % 120 - 60 AS DOUBLE) AS miny,
 CAST(k % 300 - 150 + CASE WHEN k % 9 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS maxx, CAST(k % 120 - 60 + CASE WHEN k % 9 = 0 THEN 3 ELSE 2 END AS DOUBLE) AS maxy,
 CAST(CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END AS INT) AS n_rings, k FROM k)"""


@query("s3_p1_to_p6_normalised_items", f"WITH {_NORM_SQL} SELECT * EXCLUDE (k) FROM norm")
def normalised_items(spark, sf_dir):
    n = _normalised(spark, sf_dir)
    names = F.sort_array(F.map_keys("assets"))
    return n.select("item_id", "source_id", "dt", "cloud_cover", "group", "epsg", *[F.col(f"tile_bbox.{c}").alias(f"tb_{c}") for c in ("minx", "miny", "maxx", "maxy")],
                    F.array_join(names, ",").alias("assets"), F.try_element_at("assets", F.get(names, F.lit(0)))["href"].alias("first_href"),
                    *[F.col(f"footprint.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.size("rings").alias("n_rings"))


@query("s4_s5_filtered_search", f"""WITH {_NORM_SQL} SELECT item_id, source_id, dt, 'red' AS assets FROM norm WHERE source_id = 'landsat-c2-l2'
 AND minx <= 60 AND maxx >= -20 AND miny <= 30 AND maxy >= -40 AND CAST(dt AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND k % 200 = 77""")
def filtered_search(spark, sf_dir):
    hits = C.search(_normalised(spark, sf_dir), "landsat-c2-l2", (-20.0, -40.0, 60.0, 30.0), "2024-01-03", "2024-01-20",
                    equals={"landsat:wrs_path": 77}, assets=["red"])
    return hits.select("item_id", "source_id", "dt", F.array_join(F.map_keys("assets"), ",").alias("assets"))


_SEARCH_REQ = """req AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'sentinel-2-l2a' WHEN 1 THEN 'landsat-c2-l2' WHEN 2 THEN 'hls-l30' ELSE 'opera-dswx-hls' END AS source_id,
 CAST(c_custkey % 260 - 130 AS DOUBLE) AS rx, CAST(c_custkey % 100 - 50 AS DOUBLE) AS ry, CASE WHEN c_custkey % 13 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 20 AS INT) END AS s, DATE '2024-01-01' + CAST(c_custkey % 20 + 10 AS INT) AS e FROM customer),
hits AS (SELECT r.request_id, n.item_id FROM req r JOIN norm n ON n.source_id = r.source_id AND n.minx <= r.rx + 20 AND n.maxx >= r.rx AND n.miny <= r.ry + 20 AND n.maxy >= r.ry
 AND (r.s IS NULL OR CAST(n.dt AS DATE) BETWEEN r.s AND r.e))"""


def _search_requests(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 260 - 130).cast("double"), (k % 100 - 50).cast("double")
    day = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.element_at(F.lit(list(_FEATURE_SOURCES)), (k % 4 + 1).cast("int")).alias("source_id"),
        F.struct(x.alias("minx"), y.alias("miny"), (x + 20).alias("maxx"), (y + 20).alias("maxy")).alias("box"),
        F.when(k % 13 != 0, F.date_add(day, (k % 20).cast("int"))).alias("start"), F.date_add(day, (k % 20 + 10).cast("int")).alias("end"))


@query("s4_many_searches", f"WITH {_NORM_SQL}, {_SEARCH_REQ} SELECT request_id, item_id FROM hits")
def many_searches(spark, sf_dir):
    placed = write_stage(_normalised(spark, sf_dir).select("item_id", "source_id", "footprint", "d"), "items")  # parsed once
    return C.search_all(placed, _search_requests(spark, sf_dir)).select("request_id", "item_id")


@query("s6_size_guard", f"WITH {_NORM_SQL}, {_SEARCH_REQ} SELECT request_id, CAST(count(*) AS BIGINT) AS n_items, count(*) >= 5 AS refused FROM hits GROUP BY 1")
def size_guard(spark, sf_dir):
    counts = C.count_all(_normalised(spark, sf_dir), _search_requests(spark, sf_dir))
    return C.size_guard(counts, 5).select("request_id", "n_items", "refused")


@query("s7_search_reuse", """WITH q AS (SELECT o_orderkey AS k, substr(sha256('{"source_id":' || CAST(o_custkey % 50 AS VARCHAR) || ',"start":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"}'), 1, 16) AS query_key FROM orders)
SELECT k AS request_id, query_key FROM q WHERE query_key NOT IN (SELECT query_key FROM q WHERE k % 3 = 0)""")
def search_reuse(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), C.query_key(
        (F.col("o_custkey") % 50).alias("source_id"), F.col("o_orderdate").cast("date").alias("start")).alias("query_key"))
    return C.cache_misses(q, q.where("request_id % 3 = 0"))


@query("s12_j5_asset_sizes", """WITH a AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'red' ELSE 'nir' END AS asset FROM orders),
s AS (SELECT l_orderkey AS item_id, CASE WHEN l_orderkey % 2 = 0 THEN 'red' ELSE 'nir' END AS asset, max(CAST(l_quantity AS BIGINT)) % 7 AS size FROM lineitem GROUP BY 1, 2)
SELECT a.item_id, a.asset, CAST(nullif(s.size, 0) AS BIGINT) AS size FROM a LEFT JOIN s USING (item_id, asset)""")
def asset_sizes(spark, sf_dir):
    pair = lambda k: F.when(F.col(k) % 2 == 0, "red").otherwise("nir").alias("asset")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), pair("o_orderkey"))
    s = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), pair("l_orderkey"))
         .agg((F.max(F.col("l_quantity").cast("bigint")) % 7).alias("size")))
    return C.asset_sizes(a, s)


# ---- files on grids and in series ----------------------------------------------------------------------------------

def _customer_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 340 - 170) + 0.25, (k % 140 - 70) + 0.75
    return table(spark, sf_dir, "customer").select(k.alias("area_id"), F.struct(
        x.cast("double").alias("minx"), y.cast("double").alias("miny"), (x + k % 23).cast("double").alias("maxx"), (y + k % 17).cast("double").alias("maxy")).alias("box"))


@query("s14_tile_grid", """WITH a AS (SELECT c_custkey AS area_id, (c_custkey % 340 - 170) + 0.25::DOUBLE AS x0, (c_custkey % 140 - 70) + 0.75::DOUBLE AS y0, c_custkey % 23 AS w, c_custkey % 17 AS h FROM customer),
t AS (SELECT area_id, CAST(top AS INT) AS top, CAST(lft AS INT) AS lft FROM a, range(-80, 100, 10) r(top), range(-180, 200, 10) s(lft)
 WHERE lft <= x0 + w AND lft + 10 >= x0 AND top - 10 <= y0 + h AND top >= y0)
SELECT area_id, lpad(CAST(abs(top) AS VARCHAR), 2, '0') || CASE WHEN top >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(CAST(abs(lft) AS VARCHAR), 3, '0') || CASE WHEN lft >= 0 THEN 'E' ELSE 'W' END AS tile FROM t""")
def tile_grid(spark, sf_dir):
    return L.tile_grid(_customer_boxes(spark, sf_dir), F.lit(10)).select("area_id", "tile")


@query("s13_file_series", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) AS e FROM orders),
m AS (SELECT k, greatest(CAST(m AS DATE), s) AS w_start, strftime(m, '%Y-%m') AS label FROM (SELECT *, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM o))
SELECT k AS request_id, 'chirps-monthly-' || label AS item_id, 'https://data.chc.ucsb.edu/products/CHIRPS-2.0/global_monthly/tifs/chirps-v2.0.' || substr(label, 1, 4) || '.' || substr(label, 6, 2) || '.tif.gz' AS href,
 CASE WHEN label > '2001-06' THEN 'incomplete' ELSE 'feasible-single' END AS verdict FROM m""")
def file_series(spark, sf_dir):
    url = next(s["access"]["url"] for s in SOURCES if s["id"] == "chirps-monthly")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("s"),
                                             F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 200).cast("int")).alias("e"))
    w = D.expand(o, D.monthly_array(F.col("s"), F.col("e")), "request_id").withColumn("source_id", F.lit("chirps-monthly")).withColumn("url", F.lit(url))
    sized = L.file_series(w).withColumn("size", F.when(F.col("label") <= "2001-06", F.lit(10)))
    return L.file_series_verdicts(sized).select("request_id", "item_id", "href", "verdict")


@query("f9_vector_query_cap", """WITH r AS (SELECT c_custkey AS request_id, c_acctbal * 10 AS area_km2, CASE c_custkey % 3 WHEN 0 THEN 2000.0 WHEN 1 THEN 50000.0 END AS cap FROM customer)
SELECT request_id, CASE WHEN area_km2 > cap THEN 'incomplete' ELSE 'feasible-single' END AS verdict, CASE WHEN area_km2 > cap THEN 0 ELSE 1 END::INT AS n_assets FROM r""")
def vector_cap(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id", "c_acctbal * 10 AS area_km2", "CASE c_custkey % 3 WHEN 0 THEN 2000.0D WHEN 1 THEN 50000.0D END AS max_area_km2", "'overpass' AS driver")
    return L.vector_verdicts(r).select("request_id", "verdict", "n_assets")


@query("r6_read_strategy", """SELECT p_partkey AS item_id, p_partkey % 5 = 0 AS whole_file, round(CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_size / 100.0 END::DOUBLE, 6) AS fraction,
 CAST(floor(p_retailprice * 1000 * CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE ELSE p_size / 100.0::DOUBLE END) + 2000000 AS BIGINT) AS windowed_bytes FROM part""")
def read_strategy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_retailprice", L.read_strategy(F.col("p_partkey") % 5 != 0, F.col("p_size") / 100).alias("s"))
    return p.select("item_id", "s.whole_file", F.round("s.fraction", 6).alias("fraction"), S.windowed_bytes(F.col("p_retailprice") * 1000, F.col("s.fraction")).alias("windowed_bytes"))


# ---- vector features -----------------------------------------------------------------------------------------------

def _elements(spark, sf_dir):
    """Map elements from line items: nodes, ways with two to five vertices, closed or open, some with a centre only."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    at = lambda i: F.struct(((k * 3 + i * 7) % 90).cast("double").alias("lat"), ((k * 5 + i * 11) % 170).cast("double").alias("lon"))
    n = (F.col("l_partkey") % 5 + 1).cast("int")
    path = F.transform(F.sequence(F.lit(1), n), at)
    closed = F.concat(path, F.slice(path, 1, 1))
    way = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        F.when(way, "way").otherwise("node").alias("type"), k.alias("id"),
        F.when(~way & (k % 3 != 0), at(0)["lat"]).alias("lat"), F.when(~way & (k % 3 != 0), at(0)["lon"]).alias("lon"), F.when(k % 3 == 0, at(0)).alias("center"),
        F.create_map(F.lit("name"), F.col("l_shipdate").cast("date").cast("string"), F.lit("source"), F.lit("survey")).alias("tags"),
        F.when(way & (k % 7 != 0), F.when(F.col("l_suppkey") % 2 == 0, closed).otherwise(path)).alias("geometry"))


_ELEMENT_SQL = """el AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_linestatus = 'O' AS way, CAST(l_partkey % 5 + 1 AS INT) AS n, l_suppkey % 2 = 0 AS closed, CAST(l_shipdate AS DATE) AS nm FROM lineitem)"""


@query("s9_map_points", f"""WITH {_ELEMENT_SQL} SELECT CASE WHEN way THEN 'way/' ELSE 'node/' END || CAST(k AS VARCHAR) AS osm_id, CAST(nm AS VARCHAR) AS name,
 CAST((k * 5) % 170 AS DOUBLE) AS x, CAST((k * 3) % 90 AS DOUBLE) AS y FROM el WHERE (NOT way AND k % 3 <> 0) OR k % 3 = 0""")
def map_points(spark, sf_dir):
    return X.map_elements(_elements(spark, sf_dir), "point").select("osm_id", F.try_element_at("tags", F.lit("name")).alias("name"), "x", "y")


@query("s9_map_lines_and_polygons", f"""WITH {_ELEMENT_SQL}, w AS (SELECT *, n + CASE WHEN closed THEN 1 ELSE 0 END AS v FROM el WHERE way AND k % 7 <> 0)
SELECT 'line' AS geometry, CAST(k AS VARCHAR) AS osm_id, CAST(v AS INT) AS vertices FROM w WHERE v >= 2
UNION ALL SELECT 'polygon', CAST(k AS VARCHAR), CAST(v AS INT) FROM w WHERE v >= 4 AND closed""")
def map_ways(spark, sf_dir):
    e = _elements(spark, sf_dir)
    part = lambda g: X.map_elements(e, g).select(F.lit(g).alias("geometry"), "osm_id", F.size("line").alias("vertices"))
    return part("line").unionByName(part("polygon"))


def _rings(spark, sf_dir):
    """Hexagon-like closed rings, one per customer."""
    k = F.col("c_custkey")
    cx, cy, r = (k % 160 - 80).cast("double"), (k % 100 - 50).cast("double"), (k % 9 + 2).cast("double")
    steps = ((1, 0), (0.5, 1), (-0.5, 1), (-1, 0), (-0.5, -1), (0.5, -1), (1, 0))
    return (table(spark, sf_dir, "customer")).select(k.alias("area_id"), F.array(*[F.struct((cx + r * a).alias("x"), (cy + r * b).alias("y")) for a, b in steps]).alias("ring"))


_WAY = 10 ** 15


@query("g8_points_in_polygons", f"""WITH {_ELEMENT_SQL}, pt AS (SELECT DISTINCT CASE WHEN way THEN 'way/' ELSE 'node/' END || CAST(k AS VARCHAR) AS osm_id, CAST((k * 5) % 170 AS DOUBLE) + 0.37 - 80 AS x, CAST((k * 3) % 90 AS DOUBLE) + 0.4 - 50 AS y FROM el WHERE (NOT way AND k % 3 <> 0) OR k % 3 = 0),
pg AS (SELECT c_custkey AS area_id, CAST(c_custkey % 160 - 80 AS DOUBLE) AS cx, CAST(c_custkey % 100 - 50 AS DOUBLE) AS cy, CAST(c_custkey % 9 + 2 AS DOUBLE) AS r FROM customer),
hit AS (SELECT area_id, osm_id FROM pg JOIN pt ON abs(x - cx) <= r AND abs(y - cy) <= r WHERE abs(x - cx) <= r - 0.5 * abs(y - cy))
SELECT area_id, CAST(count(*) AS BIGINT) AS n, arg_min(osm_id, CAST(split_part(osm_id, '/', 2) AS BIGINT) + CASE WHEN osm_id LIKE 'way/%' THEN {_WAY} ELSE 0 END) AS first_id FROM hit GROUP BY 1""")
def points_in_polygons(spark, sf_dir):
    way = F.col("osm_id").startswith("way/")
    key = F.substring_index("osm_id", "/", -1).cast("bigint") + F.when(way, F.lit(_WAY)).otherwise(F.lit(0))  # ways after nodes
    p = X.map_elements(_elements(spark, sf_dir), "point").select(key.alias("key"), (F.col("x") + 0.37 - 80).alias("x"), (F.col("y") + 0.4 - 50).alias("y")).distinct()
    first = F.concat(F.when(F.col("first_key") >= _WAY, "way/").otherwise("node/"), (F.col("first_key") % _WAY).cast("string"))
    return X.count_points(p, _rings(spark, sf_dir), 1.0).select("area_id", "n", first.alias("first_id"))


@query("s8_g9_g11_polygons_clipped", """WITH pg AS (SELECT c_custkey AS area_id, CAST(c_custkey % 160 - 80 AS DOUBLE) AS cx, CAST(c_custkey % 100 - 50 AS DOUBLE) AS cy, CAST(c_custkey % 9 + 2 AS DOUBLE) AS r FROM customer),
c AS (SELECT area_id, r, greatest(-30 - cx, -r) AS a, least(40 - cx, r) AS b, greatest(-20 - cy, -r) AS lo, least(35 - cy, r) AS hi FROM pg),
-- the hexagon is r - |y|/2 wide to each side of its centre: integrate the clipped width over y, split at y = 0 and where the clip starts to act
ok AS (SELECT * FROM c WHERE lo < hi AND a < b),
ys AS (SELECT area_id, r, a, b, y0, y1 FROM (SELECT area_id, r, a, b, list_sort(list_distinct(list_filter([lo, hi, 0, 2 * (r - abs(b)), -2 * (r - abs(b)), 2 * (r - abs(a)), -2 * (r - abs(a))], lambda y: y >= lo AND y <= hi))) AS l FROM ok),
 LATERAL (SELECT unnest(l[1:-2]) AS y0, unnest(l[2:]) AS y1)),
ar AS (SELECT area_id, sum((y1 - y0) * greatest(0, least(b, r - abs((y0 + y1) / 2) / 2) - greatest(a, -(r - abs((y0 + y1) / 2) / 2)))) AS area FROM ys GROUP BY 1)
SELECT area_id, round(area, 4) AS area FROM ar WHERE area > 0""")
def polygons_clipped(spark, sf_dir):
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((-30.0, "minx"), (-20.0, "miny"), (40.0, "maxx"), (35.0, "maxy"))])
    cut = X.clip_polygons(_rings(spark, sf_dir), box)
    return cut.select("area_id", F.round(G.ring_area(F.col("ring")), 4).alias("area"))


@query("g9_lines_clipped", """WITH k AS (SELECT o_orderkey AS id, CAST(o_orderkey % 60 - 30 AS DOUBLE) AS ax, CAST(o_custkey % 60 - 30 AS DOUBLE) AS ay, CAST((o_orderkey * 7) % 60 - 30 AS DOUBLE) AS bx, CAST((o_custkey * 11) % 60 - 30 AS DOUBLE) AS by_ FROM orders),
t AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM k),
u AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (-10 - ax) / dx WHEN dx < 0 THEN (15 - ax) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (-12 - ay) / dy WHEN dy < 0 THEN (9 - ay) / dy ELSE 0 END) AS t0,
 least(1, CASE WHEN dx > 0 THEN (15 - ax) / dx WHEN dx < 0 THEN (-10 - ax) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (9 - ay) / dy WHEN dy < 0 THEN (-12 - ay) / dy ELSE 1 END) AS t1,
 (dx <> 0 OR ax BETWEEN -10 AND 15) AND (dy <> 0 OR ay BETWEEN -12 AND 9) AS ok FROM t)
SELECT id, round((t1 - t0) * sqrt(dx * dx + dy * dy), 4) AS length FROM u WHERE ok AND t0 < t1""")
def lines_clipped(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lines = table(spark, sf_dir, "orders").select(o.alias("id"), F.array(pt(o % 60 - 30, c % 60 - 30), pt((o * 7) % 60 - 30, (c * 11) % 60 - 30)).alias("line"))
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((-10.0, "minx"), (-12.0, "miny"), (15.0, "maxx"), (9.0, "maxy"))])
    return X.clip_lines(lines, box).select("id", F.round(P.line_length(F.col("pieces")), 4).alias("length"))


# diamonds with a diamond of half the size cut out, one per supplier
_DIAMOND_SQL = "d AS (SELECT s_suppkey AS area_id, CAST((s_suppkey * 37) % 150 - 75 AS DOUBLE) AS cx, CAST((s_suppkey * 23) % 90 - 45 AS DOUBLE) AS cy, CAST(s_suppkey % 9 + 2 AS DOUBLE) AS r FROM supplier)"


def _diamonds(spark, sf_dir):
    k = F.col("s_suppkey")
    at = lambda f, a, b: F.struct(((k * 37) % 150 - 75 + (k % 9 + 2) * f * a).cast("double").alias("x"), ((k * 23) % 90 - 45 + (k % 9 + 2) * f * b).cast("double").alias("y"))
    ring = lambda f: F.array(*[at(f, a, b) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])
    return table(spark, sf_dir, "supplier").select(k.alias("area_id"), F.array(F.array(ring(1.0), ring(0.5))).alias("parts"))


@query("s8_g9_lines_in_areas", f"""WITH {_DIAMOND_SQL},
k AS (SELECT o_orderkey AS id, CAST(o_orderkey % 160 - 80 AS DOUBLE) + 0.37 AS ax, CAST(o_custkey % 100 - 50 AS DOUBLE) + 0.45 AS ay, CAST((o_orderkey * 7) % 17 - 8 AS DOUBLE) AS dx, CAST((o_custkey * 11) % 13 - 6 AS DOUBLE) AS dy FROM orders),
-- a diamond is a box in x + y and x - y; the hole's stretch is taken from the whole one's
s AS (SELECT area_id, id, f, sqrt(dx * dx + dy * dy) AS len, ax + ay - cx - cy AS u, ax - ay - cx + cy AS v, dx + dy AS du, dx - dy AS dv, r * abs(f) AS q FROM k
 JOIN d ON abs(ax + dx / 2 - cx) <= r + abs(dx) / 2 AND abs(ay + dy / 2 - cy) <= r + abs(dy) / 2 CROSS JOIN (VALUES (1.0::DOUBLE), (-0.5::DOUBLE)) h(f)),
t AS (SELECT *, greatest(0, CASE WHEN du <> 0 THEN least((-q - u) / du, (q - u) / du) ELSE 0 END, CASE WHEN dv <> 0 THEN least((-q - v) / dv, (q - v) / dv) ELSE 0 END) AS t0,
 least(1, CASE WHEN du <> 0 THEN greatest((-q - u) / du, (q - u) / du) ELSE 1 END, CASE WHEN dv <> 0 THEN greatest((-q - v) / dv, (q - v) / dv) ELSE 1 END) AS t1,
 (du <> 0 OR abs(u) <= q) AND (dv <> 0 OR abs(v) <= q) AS ok FROM s),
n AS (SELECT area_id, id, sum(CASE WHEN ok AND t0 < t1 THEN sign(f) * (t1 - t0) * len ELSE 0 END) AS l FROM t GROUP BY 1, 2)
SELECT area_id, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l), 3) AS length FROM n WHERE l > 1e-9 GROUP BY 1""")
def lines_in_areas(spark, sf_dir):
    """Lines cut to areas with holes: number of lines and length inside each."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pt = lambda x, y: F.struct((x + 0.37).alias("x"), (y + 0.45).alias("y"))
    x, y = (o % 160 - 80).cast("double"), (c % 100 - 50).cast("double")
    lines = table(spark, sf_dir, "orders").select(o.alias("feature_id"), F.array(pt(x, y), pt(x + (o * 7) % 17 - 8, y + (c * 11) % 13 - 6)).alias("line"))
    pieces = O.clip_lines(lines, _diamonds(spark, sf_dir), 2.0)
    own = pieces.groupBy("area_id", "feature_id").agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("l"))
    return own.groupBy("area_id").agg(F.count("*").alias("n_lines"), F.round(F.sum("l"), 3).alias("length"))


@query("s8_g8_g11_polygons_in_areas", f"""WITH {_DIAMOND_SQL},
b AS (SELECT c_custkey AS feature_id, CAST((c_custkey * 13) % 160 - 80 AS DOUBLE) + 0.3 AS x0, CAST((c_custkey * 7) % 100 - 50 AS DOUBLE) + 0.4 AS y0, CAST(1 + c_custkey % 5 AS DOUBLE) AS w, CAST(1 + c_custkey % 4 AS DOUBLE) AS h FROM customer),
p AS (SELECT feature_id, area_id, x0 - cx AS x0, x0 + w - cx AS x1, y0 - cy AS y0, y0 + h - cy AS y1, r * abs(f) AS r, sign(f) AS f FROM b
 JOIN d ON x0 < cx + r AND x0 + w > cx - r AND y0 < cy + r AND y0 + h > cy - r CROSS JOIN (VALUES (1.0::DOUBLE), (-0.5::DOUBLE)) g(f)),
-- the shared height is linear in x between these places
m AS (SELECT *, list_sort(list_distinct(list_filter([x0, x1, 0, r, -r, r - y1, y1 - r, r + y1, -r - y1, r - y0, y0 - r, r + y0, -r - y0], lambda x: x >= x0 AND x <= x1))) AS l FROM p),
z AS (SELECT feature_id, area_id, r, f, y0, y1, unnest(l[1:-2]) AS a, unnest(l[2:]) AS b FROM m),
e AS (SELECT feature_id, area_id, f * (b - a) * greatest(0, least(y1, r - abs((a + b) / 2)) - greatest(y0, abs((a + b) / 2) - r)) AS s FROM z)
SELECT feature_id, area_id, round(sum(s), 4) AS shared FROM e GROUP BY 1, 2 HAVING sum(s) > 1e-6""")
def polygons_in_areas(spark, sf_dir):
    """Polygons cut to areas with holes: what each pair shares."""
    k = F.col("c_custkey")
    x, y, w, h = ((k * 13) % 160 - 80).cast("double") + 0.3, ((k * 7) % 100 - 50).cast("double") + 0.4, (k % 5 + 1).cast("double"), (k % 4 + 1).cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(pt(x, y), pt(x, y + h), pt(x + w, y + h), pt(x + w, y), pt(x, y))
    boxes = table(spark, sf_dir, "customer").select(k.alias("feature_id"), F.array(F.array(ring)).alias("parts"))
    shared = O.shared_areas(O.clip_polygons(boxes, _diamonds(spark, sf_dir), 2.0))
    return shared.select("feature_id", "area_id", F.round("shared", 4).alias("shared"))


_EA = "6378137.0 * (cos(radians(30)) / sqrt(1 - power(0.0818191908426215 * sin(radians(30)), 2)))"


def _eay(lat):
    e = "0.0818191908426215"
    s = f"sin(radians({lat}))"
    return (f"(6378137.0 / (2 * (cos(radians(30)) / sqrt(1 - power({e} * sin(radians(30)), 2))))) * (1 - {e} * {e}) * ({s} / (1 - power({e} * {s}, 2)) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e}))")


@query("s11_area_frames", f"""WITH r AS (SELECT DISTINCT s_suppkey AS k FROM supplier),
b AS (SELECT k AS area_id, CAST(k % 100 - 50 AS DOUBLE) AS x0, CAST(k % 80 - 40 AS DOUBLE) AS y0, 1.0 + k % 5 AS w, 1.0 + k % 3 AS h FROM r)
SELECT area_id, CAST(2 AS BIGINT) AS n_parts, round(x0, 6) AS minx, round(y0, 6) AS miny, round(x0 + w, 6) AS maxx, round(y0 + h, 6) AS maxy,
 round({_EA} * radians(x0), 3) AS ox, round({_eay('y0')}, 3) AS oy FROM b""")
def area_frames(spark, sf_dir):
    """Two overlapping boxes per area, dissolved on the area's frame."""
    k = F.col("s_suppkey")
    x, y, w, h = (k % 100 - 50).cast("double"), (k % 80 - 40).cast("double"), (k % 5 + 1).cast("double"), (k % 3 + 1).cast("double")
    ring = lambda a, b, c, d: F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ((a, b), (c, b), (c, d), (a, d), (a, b))])
    s = table(spark, sf_dir, "supplier").select(k.alias("area_id"), F.explode(F.array(ring(x, y, x + w * 0.75, y + h), ring(x + w * 0.25, y, x + w, y + h))).alias("ring"))
    f = X.area_frames(s)
    return f.select("area_id", "n_parts", *[F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.round("ox", 3).alias("ox"), F.round("oy", 3).alias("oy"))


@query("p8_box_areas", f"""WITH b AS (SELECT c_custkey AS area_id, CAST(c_custkey % 340 - 170 AS DOUBLE) AS x0, CAST(c_custkey % 140 - 70 AS DOUBLE) AS y0, CAST(1 + c_custkey % 5 AS DOUBLE) AS w, CAST(1 + c_custkey % 3 AS DOUBLE) AS h FROM customer)
SELECT area_id, round({_EA} * radians(w) * ({_eay('(y0 + h)')} - {_eay('y0')}) / 1e6, 4) AS area_km2 FROM b""")
def box_areas(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 340 - 170).cast("double"), (k % 140 - 70).cast("double")
    return table(spark, sf_dir, "customer").select(k.alias("area_id"), F.round(G.box_km2(x, y, x + (k % 5 + 1), y + (k % 3 + 1)), 4).alias("area_km2"))


@query("f7_f8_area_guard", """SELECT c_custkey AS area_id, c_acctbal * 15 > 50000 AS needs_confirmation, c_acctbal * 15 > 100000 AS no_scenes FROM customer""")
def area_guard(spark, sf_dir):
    return X.area_guard(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("area_id"), (F.col("c_acctbal") * 15).alias("area_km2"))).drop("area_km2")


@query("p7_g13_zone_of_centroid", """WITH pg AS (SELECT c_custkey AS area_id, CAST(c_custkey % 160 - 80 AS DOUBLE) AS cx, CAST(c_custkey % 100 - 50 AS DOUBLE) AS cy FROM customer)
SELECT area_id, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, CAST(CASE WHEN cy + 0.001 >= 0 THEN 32600 ELSE 32700 END + floor((cx + 0.001 + 180) / 6) + 1 AS INT) AS epsg FROM pg""")
def zone_of_centroid(spark, sf_dir):
    c = G.centroid(F.col("ring"))
    r = _rings(spark, sf_dir).select("area_id", c.alias("c"))
    return r.select("area_id", (F.round("c.x", 6) + 0.0).alias("cx"), (F.round("c.y", 6) + 0.0).alias("cy"), G.utm_epsg(F.col("c.x") + 0.001, F.col("c.y") + 0.001).alias("epsg"))


@query("g12_project_to_zone")
def project_to_zone(spark, sf_dir):
    """Krueger series per vertex; compared with published control points in the tests."""
    r = _rings(spark, sf_dir)
    c = G.centroid(F.col("ring"))
    z = r.withColumn("epsg", G.utm_epsg(c["x"], c["y"]))
    return z.select("area_id", "epsg", F.posexplode(X.to_project_crs(F.col("ring"), F.col("epsg"))).alias("vertex", "p")).select(
        "area_id", "epsg", "vertex", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("s10_hazard_feed", """SELECT CAST(o_orderkey AS VARCHAR) AS hazard_id, 'flood' AS hazard_name, CAST(o_orderdate AS DATE) AS hazard_start,
 CAST(o_orderkey % 360 - 180 AS DOUBLE) AS lon, CAST(o_custkey % 180 - 90 AS DOUBLE) AS lat FROM orders WHERE o_orderkey % 4 <> 0""")
def hazard_feed(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, "Polygon").otherwise("Point").alias("geometry_type"),
        F.array((F.col("o_orderkey") % 360 - 180).cast("double"), (F.col("o_custkey") % 180 - 90).cast("double")).alias("coordinates"),
        F.create_map(F.lit("eventid"), F.col("o_orderkey").cast("string"), F.lit("name"), F.lit("flood"),
                     F.lit("fromdate"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("props"))
    return X.hazards(f).select("hazard_id", "hazard_name", "hazard_start", "lon", "lat")

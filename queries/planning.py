"""Scene planning: windows, coverage algebra, optical, radar and product plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import CELLS_SQL, ITEMS_SQL, OPTICAL_SQL, SIDE, WINDOWS_SQL, areas, footprints, items, months, query, table
from queries.sources import _NORM_SQL, _normalised
from tilewright.functions import bitgrid as B
from tilewright.operators import windows as D
from tilewright.plans import optical, products, sar, scenes as scene_plans
from tilewright.session import write_stage


def _plan(spark, sf_dir):
    f = write_stage(footprints(spark, sf_dir).select("aoi_id", "item_id", "tile", "d", "cloud_cover", "words"), "footprints")
    return optical.plan_optical(f, areas(spark, sf_dir, f), months(spark, sf_dir, f), SIDE)


@query("w1_w2_t8_best_scene_per_tile_and_month", f"""WITH {OPTICAL_SQL}
SELECT source_id, label, tile, item_id, d, CAST(n_candidates AS BIGINT) AS n_candidates, round(cloud, 6) AS cloud,
 round(coverage, 6) AS coverage, round(clear, 6) AS clear FROM best""")
def best_scene(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return p.selections.where(F.col("item_id").isNotNull()).select(
        F.col("aoi_id").alias("source_id"), "label", "tile", "item_id", "d", "n_candidates", F.round("cloud", 6).alias("cloud"),
        F.round("coverage", 6).alias("coverage"), F.round("clear", 6).alias("clear"))


@query("g3_g4_g5_tile_claims", f"""WITH {OPTICAL_SQL}
SELECT g.source_id, g.tile, CAST(g.tc AS INT) AS tile_cells, CAST(g.excl AS INT) AS exclusive_cells, g.kept, CAST(g.rk - 1 AS INT) AS tile_rank,
 round(q.q, 6) AS quality FROM greedy g JOIN quality q USING (source_id, tile)""")
def tile_claims(spark, sf_dir):
    area = areas(spark, sf_dir)
    scenes = optical.in_area(footprints(spark, sf_dir), area)
    return optical.claim(optical.tile_extents(scenes, SIDE), area).select(
        F.col("aoi_id").alias("source_id"), "tile", "tile_cells", "exclusive_cells", "kept", "tile_rank", F.round("quality", 6).alias("quality"))


@query("w3_composite_scenes", f"""WITH {OPTICAL_SQL}
SELECT source_id, label, tile, item_id, round(clear, 6) AS clear FROM comp""")
def composite_scenes(spark, sf_dir):
    return _plan(spark, sf_dir).composites.select(F.col("aoi_id").alias("source_id"), "label", "tile", "item_id", F.round("clear", 6).alias("clear"))


_REPORT_SQL = OPTICAL_SQL + """,
sel_cells AS (SELECT b.source_id, b.label, count(DISTINCT c.cell) AS seen FROM best b JOIN cells c USING (item_id) GROUP BY 1, 2),
naive AS (SELECT p.source_id, p.label, count(DISTINCT p.item_id) AS naive_scenes, count(DISTINCT c.cell) AS naive_cells
 FROM pos p JOIN cells c USING (item_id) WHERE p.cloud_cover <= 20 GROUP BY 1, 2),
grid AS (SELECT w.source_id, w.label, k.tile, k.excl FROM windows w JOIN kept k USING (source_id)),
rep AS (SELECT g.source_id, g.label, sum(coalesce(b.n_candidates, 0)) AS n_scenes, count(*) FILTER (b.item_id IS NULL) AS tiles_missing,
  count(b.item_id) AS single_scenes, count(*) AS n_tiles, count(*) FILTER (b.cloud > 20) AS over_threshold,
  coalesce(sum(g.excl * b.clear), 0) / 400 AS single_clear, coalesce(sum(g.excl * ct.composite_clear), 0) / 400 AS composite_clear,
  coalesce(sum(ct.n_composite), 0) AS composite_scenes
 FROM grid g LEFT JOIN best b USING (source_id, label, tile) LEFT JOIN comp_tile ct USING (source_id, label, tile) GROUP BY 1, 2),
full_rep AS (SELECT r.*, coalesce(s.seen, 0) / 400.0::DOUBLE AS observed, coalesce(n.naive_scenes, 0) AS naive_scenes,
  coalesce(n.naive_cells, 0) / 400.0::DOUBLE AS naive_observed
 FROM rep r LEFT JOIN sel_cells s USING (source_id, label) LEFT JOIN naive n USING (source_id, label)),
verdicts AS (SELECT *, CASE WHEN observed < 0.9 THEN 'incomplete' WHEN single_clear >= 0.8 THEN 'feasible-single'
  WHEN composite_clear >= 0.8 THEN 'feasible-composite' ELSE 'infeasible' END AS verdict FROM full_rep)"""


@query("a2_a3_a4_e4_e7_window_reports", f"""WITH {_REPORT_SQL}
SELECT source_id, label, CAST(n_scenes AS BIGINT) AS n_scenes, CAST(tiles_missing AS BIGINT) AS tiles_missing, CAST(single_scenes AS BIGINT) AS single_scenes,
 CAST(over_threshold AS BIGINT) AS over_threshold, CAST(composite_scenes AS BIGINT) AS composite_scenes, CAST(naive_scenes AS BIGINT) AS naive_scenes,
 round(observed, 6) AS observed, round(single_clear, 6) AS single_clear, round(composite_clear, 6) AS composite_clear,
 round(naive_observed, 6) AS naive_observed, verdict FROM verdicts""")
def window_reports(spark, sf_dir):
    return _plan(spark, sf_dir).reports.select(
        F.col("aoi_id").alias("source_id"), "label", "n_scenes", "tiles_missing", "single_scenes", "over_threshold", "composite_scenes", "naive_scenes",
        *[F.round(c, 6).alias(c) for c in ("observed", "single_clear", "composite_clear", "naive_observed")], "verdict")


def _rings(x0, y0, x1, y1):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


# ---- which normalised items meet which areas, by rings; areas are boxes of 7 x 5 degrees around the globe ---------------------------------

@query("s3_w1_items_meeting_areas", f"""WITH {_NORM_SQL}, boxes AS (SELECT CAST(i AS INT) AS i, i * 10 - 150.5::DOUBLE AS a, i * 10 - 143.5::DOUBLE AS b, (i % 5) * 20 - 50.5::DOUBLE AS c, (i % 5) * 20 - 45.5::DOUBLE AS d FROM range(30) t(i))
SELECT 'area_' || CAST(i AS VARCHAR) AS area_id, item_id, source_id, "group" AS tile FROM norm, boxes WHERE "group" IS NOT NULL AND (
 (minx <= b AND minx + 1 >= a AND miny <= d AND miny + 2 >= c) OR
 (n_rings = 2 AND minx + 2 <= b AND minx + 3 >= a AND greatest(0, c - miny - 2) <= least(least(1, b - minx - 2), d - miny - 2)))""")
def items_meeting_areas(spark, sf_dir):
    found = scene_plans.catalogue_scenes(_normalised(spark, sf_dir)).where("tile IS NOT NULL")
    a, c = F.col("i") * 10 - 150.5, F.col("i") % 5 * 20 - 50.5
    one = spark.range(30).withColumnRenamed("id", "i").select(F.concat(F.lit("area_"), F.col("i").cast("string")).alias("aoi_id"), _rings(a, c, a + 7, c + 5).alias("rings"))
    placed = [scene_plans.placed(rows, plane=True) for rows in (found, one)]
    return scene_plans.members(*placed, square=scene_plans.SQUARE).join(found, "item_id").select(F.col("aoi_id").alias("area_id"), "item_id", "source_id", "tile")


# ---- the same planning from rings, over blocks of 8 x 8 cells; every 31st footprint is a strip without a cell centre, some beside the area ---------------

def _block_plan(spark, sf_dir):
    i = write_stage(items(spark, sf_dir), "items")
    thin = F.col("item_id") % 31 == 0
    x0, y0, x1 = F.col("x0") + F.when(thin, 0.6).otherwise(0.0), F.col("y0"), F.when(thin, F.col("x0") + 0.9).otherwise(F.col("x0") + 7.0)
    scenes = i.select("source_id", "item_id", F.col("tile").cast("string").alias("tile"), "d", "cloud_cover", _rings(x0, y0, x1, y0 + 7).alias("rings"))
    one = i.select("source_id", "aoi_id").distinct()
    area = one.select("source_id", "aoi_id", _rings(F.lit(0), F.lit(0), F.lit(SIDE), F.lit(SIDE)).alias("rings"))
    return scene_plans.plan_scenes(scenes, area, months(spark, sf_dir, i), 1.0, side=8, on=("source_id",), plane=True)


_STRIPS = {"ON y.c BETWEEN i.y0 AND i.y0 + 6)": "ON y.c BETWEEN i.y0 AND i.y0 + 6 WHERE i.item_id % 31 <> 0)",
           "n_item AS (SELECT item_id, count(*) AS n FROM cells GROUP BY 1)": "n_item AS (SELECT i.item_id, count(c.cell) AS n FROM items i LEFT JOIN cells c USING (item_id) WHERE i.item_id % 31 <> 0 OR i.x0 >= 0 GROUP BY 1)",
           "ORDER BY q DESC, t.tile)": "ORDER BY q DESC, CAST(t.tile AS VARCHAR))"}


def _with_strips(sql: str) -> str:
    for old, new in _STRIPS.items():
        assert old in sql
        sql = sql.replace(old, new)
    return sql


_STRIP_REPORT_SQL = _with_strips(_REPORT_SQL).replace("FROM pos p JOIN cells c USING (item_id) WHERE", "FROM pos p LEFT JOIN cells c USING (item_id) WHERE")


@query("g1_w1_block_window_reports", f"""WITH {_STRIP_REPORT_SQL}
SELECT source_id, label, CAST(n_scenes AS BIGINT) AS n_scenes, CAST(tiles_missing AS BIGINT) AS tiles_missing, CAST(single_scenes AS BIGINT) AS single_scenes,
 CAST(over_threshold AS BIGINT) AS over_threshold, CAST(composite_scenes AS BIGINT) AS composite_scenes, CAST(naive_scenes AS BIGINT) AS naive_scenes,
 round(observed, 6) AS observed, round(single_clear, 6) AS single_clear, round(composite_clear, 6) AS composite_clear,
 round(naive_observed, 6) AS naive_observed, verdict FROM verdicts""")
def block_reports(spark, sf_dir):
    return _block_plan(spark, sf_dir).reports.select(
        F.col("aoi_id").alias("source_id"), "label", "n_scenes", "tiles_missing", "single_scenes", "over_threshold", "composite_scenes", "naive_scenes",
        *[F.round(c, 6).alias(c) for c in ("observed", "single_clear", "composite_clear", "naive_observed")], "verdict")


@query("w1_block_candidates", f"""WITH {_with_strips(OPTICAL_SQL)}
SELECT source_id, label, CAST(tile AS VARCHAR) AS tile, item_id, round(coverage, 6) AS coverage, round(clear, 6) AS clear FROM cand""")
def block_candidates(spark, sf_dir):
    return _block_plan(spark, sf_dir).candidates.select(F.col("aoi_id").alias("source_id"), "label", "tile", "item_id", F.round("coverage", 6).alias("coverage"), F.round("clear", 6).alias("clear"))


_PCT = "CAST(CAST(round_even({0} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


@query("e5_selection_reasons", f"""WITH {OPTICAL_SQL}
SELECT source_id, label, tile, 'highest clear fraction ' || {_PCT.format('clear')} || ' of ' || CAST(n_candidates AS VARCHAR) || ' candidates'
 || CASE WHEN cloud > 20 THEN '; best available exceeds cloud threshold (' || CAST(CAST(round_even(cloud, 0) AS BIGINT) AS VARCHAR) || '% > 20%)' ELSE '' END
 || CASE WHEN coverage < 0.9 THEN '; footprint covers only ' || {_PCT.format('coverage')} || ' of tile∩AOI (swath edge)' ELSE '' END AS reasons FROM best""")
def selection_reasons(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return p.selections.where(F.col("item_id").isNotNull()).select(F.col("aoi_id").alias("source_id"), "label", "tile", F.array_join("reasons", "; ").alias("reasons"))


@query("e4_verdict_texts", f"""WITH {_REPORT_SQL}
SELECT source_id, label, verdict, CASE verdict WHEN 'incomplete' THEN 'scenes in this window image only ' || {_PCT.format('observed')} || ' of the AOI' || CASE WHEN tiles_missing > 0 THEN ' (' || CAST(tiles_missing AS VARCHAR) || ' of ' || CAST(n_tiles AS VARCHAR) || ' tiles had no acquisition)' ELSE '' END
 WHEN 'feasible-single' THEN 'one scene per tile reaches ' || {_PCT.format('single_clear')} || ' expected clear coverage'
 WHEN 'feasible-composite' THEN 'single scenes give ' || {_PCT.format('single_clear')} || ' clear; a ' || CAST(CAST(composite_scenes AS BIGINT) AS VARCHAR) || '-scene composite reaches ' || {_PCT.format('composite_clear')}
 ELSE 'all ' || CAST(CAST(n_scenes AS BIGINT) AS VARCHAR) || ' scenes combined reach only ' || CAST(CAST(floor(composite_clear * 100) AS BIGINT) AS VARCHAR) || '% expected clear (target 80%); consider SAR, a longer window, or coarser daily optical' END AS verdict_text FROM verdicts""")
def verdict_texts(spark, sf_dir):
    return _plan(spark, sf_dir).reports.select(F.col("aoi_id").alias("source_id"), "label", "verdict", "verdict_text")


@query("f6_naive_cloud_filter", f"""WITH {_REPORT_SQL}
SELECT source_id, label, CAST(naive_scenes AS BIGINT) AS naive_scenes, CAST(naive_cells AS INT) AS naive_cells FROM naive""")
def naive_filter(spark, sf_dir):
    return optical.naive_coverage(_plan(spark, sf_dir).candidates, SIDE).select(F.col("aoi_id").alias("source_id"), "label", "naive_scenes", "naive_cells")


@query("u3_t10_acquisitions", f"""WITH {OPTICAL_SQL}
SELECT DISTINCT 'single' AS mode, source_id, label, item_id FROM best UNION ALL SELECT DISTINCT 'composite', source_id, label, item_id FROM comp
ORDER BY mode, source_id, label, item_id""")
def acquisitions(spark, sf_dir):
    p = _plan(spark, sf_dir)
    both = (optical.acquisitions(p).withColumn("mode", F.lit("single"))
            .unionByName(optical.acquisitions(p, "composite").withColumn("mode", F.lit("composite"))))
    return both.select("mode", F.col("aoi_id").alias("source_id"), "label", "item_id").orderBy("mode", "source_id", "label", "item_id")


@query("g1_footprint_cells", f"""WITH {CELLS_SQL}
SELECT item_id, tile, CAST(cell // 100 AS INT) AS cx, CAST(cell % 100 AS INT) AS cy FROM cells""")
def footprint_cells(spark, sf_dir):
    return B.to_cells(footprints(spark, sf_dir).select("item_id", "tile", "words"), "words", SIDE).select("item_id", "tile", "cx", "cy")


@query("g2_dissolve_per_source_and_month", f"""WITH {CELLS_SQL}
SELECT source_id, strftime(d, '%Y-%m') AS label, CAST(count(DISTINCT cell) AS INT) AS n_cells, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items
FROM cells GROUP BY 1, 2""")
def dissolve(spark, sf_dir):
    f = footprints(spark, sf_dir).where(B.cells(F.col("words")) > 0).withColumn("label", F.date_format("d", "yyyy-MM"))
    return B.dissolve(f, ["source_id", "label"], "words", SIDE, F.count("*").alias("n_items")).select(
        "source_id", "label", B.cells(F.col("words")).alias("n_cells"), "n_items")


@query("j3_f5_items_over_area", f"""WITH {CELLS_SQL}
SELECT i.item_id, i.source_id, CAST(n.n AS INT) AS n_cells, round(n.n / 400.0::DOUBLE, 6) AS share FROM items i JOIN n_item n USING (item_id)""")
def items_over_area(spark, sf_dir):
    s = optical.in_area(footprints(spark, sf_dir), areas(spark, sf_dir))
    return s.select("item_id", "source_id", "n_cells", F.round(F.col("n_cells") / (SIDE * SIDE), 6).alias("share"))


@query("g6_g7_footprint_fraction", f"""WITH {CELLS_SQL}
SELECT i.item_id, round(least(1.0::DOUBLE, coalesce(n.n, 0) / 49.0::DOUBLE), 6) AS fraction FROM items i LEFT JOIN n_item n USING (item_id)""")
def footprint_fraction(spark, sf_dir):
    """Share of a 7 x 7 footprint that lies in the area, in closed form from the two boxes."""
    from tilewright.functions import polygons as P
    box = lambda a, b, c, d: F.struct(a.cast("double").alias("minx"), b.cast("double").alias("miny"), c.cast("double").alias("maxx"), d.cast("double").alias("maxy"))
    fp = box(F.col("x0"), F.col("y0"), F.col("x0") + 7, F.col("y0") + 7)
    area = box(F.lit(0), F.lit(0), F.lit(SIDE), F.lit(SIDE))
    return items(spark, sf_dir).select("item_id", F.round(F.least(F.lit(1.0), P.box_overlap(fp, area) / P.box_area(fp)), 6).alias("fraction"))


# ---- radar ---------------------------------------------------------------------------------------------------------

def _pairs(spark, sf_dir):
    """Before/after windows around the middle of each source's record."""
    ev = items(spark, sf_dir).groupBy("aoi_id").agg(D.reference_date(F.min("d"), F.max("d")).alias("event"))
    w = ev.select("aoi_id", "event", F.inline(D.pair_array(F.col("event"), F.lit(30), F.lit(30))))
    return w.withColumn("ref_date", F.col("event")).drop("event")


def _radar(spark, sf_dir):
    f = footprints(spark, sf_dir).withColumnRenamed("rel_orbit", "orbit").withColumnRenamed("orbit_state", "state")
    return sar.plan_sar(f, areas(spark, sf_dir), _pairs(spark, sf_dir), SIDE)


_RADAR_SQL = CELLS_SQL + """,
passes AS (SELECT i.source_id, i.rel_orbit AS orbit, i.orbit_state AS state, i.d, count(DISTINCT i.item_id) AS frames, count(DISTINCT c.cell) / 400.0::DOUBLE AS coverage
 FROM items i JOIN cells c USING (item_id) GROUP BY 1, 2, 3, 4),
ev AS (SELECT source_id, min(d) + CAST(floor((max(d) - min(d)) / 2) AS INT) AS event FROM items GROUP BY 1),
windows AS (SELECT source_id, 'pre' AS label, event - 30 AS w_start, event AS w_end, event FROM ev UNION ALL SELECT source_id, 'post', event, event + 30, event FROM ev),
pw AS (SELECT w.label, w.event, p.* FROM windows w JOIN passes p ON p.source_id = w.source_id AND p.d BETWEEN w.w_start AND w.w_end),
per_orbit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, label, orbit, state ORDER BY coverage DESC, abs(d - event), d) AS rn FROM pw) WHERE rn = 1),
scored AS (SELECT source_id, orbit, state, round_even(min(coverage), 3) AS worst FROM per_orbit GROUP BY 1, 2, 3 HAVING count(*) = 2),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY worst DESC, orbit DESC, state DESC) AS rn FROM scored) WHERE rn = 1),
free AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, label ORDER BY coverage DESC, d, orbit, state DESC) AS rn FROM pw) WHERE rn = 1),
picks AS (SELECT p.source_id, p.label, p.orbit, p.state, p.d, p.coverage, p.frames FROM per_orbit p JOIN kept k USING (source_id, orbit, state)
 UNION ALL SELECT source_id, label, orbit, state, d, coverage, frames FROM free WHERE source_id NOT IN (SELECT source_id FROM kept))"""


@query("a5_radar_passes", f"""WITH {_RADAR_SQL} SELECT source_id, orbit, state, d, CAST(frames AS BIGINT) AS frames, round(coverage, 6) AS coverage FROM passes""")
def radar_passes(spark, sf_dir):
    return _radar(spark, sf_dir).passes.select(F.col("aoi_id").alias("source_id"), "orbit", "state", "d", "frames", F.round("coverage", 6).alias("coverage"))


@query("a6_radar_orbit_scores", f"""WITH {_RADAR_SQL} SELECT source_id, orbit, state, round(worst, 6) AS worst FROM scored""")
def radar_orbits(spark, sf_dir):
    return _radar(spark, sf_dir).orbits.select(F.col("aoi_id").alias("source_id"), "orbit", "state", F.round("worst", 6).alias("worst"))


@query("t1_t3_d3_d7_radar_pair_plan", f"""WITH {_RADAR_SQL}
SELECT w.source_id, w.label, p.orbit, p.state, p.d, CAST(p.frames AS BIGINT) AS frames, round(coalesce(p.coverage, 0), 6) AS observed,
 CAST((SELECT count(*) FROM pw WHERE pw.source_id = w.source_id AND pw.label = w.label) AS BIGINT) AS n_available,
 CASE WHEN p.coverage >= 0.9 THEN 'feasible-single' ELSE 'incomplete' END AS verdict FROM windows w LEFT JOIN picks p USING (source_id, label)""")
def radar_plan(spark, sf_dir):
    return _radar(spark, sf_dir).reports.select(F.col("aoi_id").alias("source_id"), "label", "orbit", "state", "d", "frames",
                                                F.round("observed", 6).alias("observed"), "n_available", "verdict")


@query("t3_best_pass_any_orbit", f"""WITH {_RADAR_SQL} SELECT source_id, label, orbit, state, d, round(coverage, 6) AS coverage FROM free""")
def radar_any_orbit(spark, sf_dir):
    f = footprints(spark, sf_dir).withColumnRenamed("rel_orbit", "orbit").withColumnRenamed("orbit_state", "state")
    p = sar.plan_sar(f, areas(spark, sf_dir), _pairs(spark, sf_dir), SIDE, same_orbit=False)
    return p.picks.select(F.col("aoi_id").alias("source_id"), "label", "orbit", "state", "d", F.round("coverage", 6).alias("coverage"))


# ---- products ------------------------------------------------------------------------------------------------------

_PRODUCT_SQL = CELLS_SQL + ", " + WINDOWS_SQL + """,
inside AS (SELECT w.source_id, w.label, w.w_start, w.w_end, i.tile, i.item_id, i.d, i.cloud_cover FROM windows w JOIN items i ON i.source_id = w.source_id
 AND i.d BETWEEN w.w_start AND w.w_end),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, label, tile ORDER BY coalesce(cloud_cover, 0),
  abs(d - (w_start + CAST(floor((w_end - w_start) / 2) AS INT))), d, item_id) AS rn FROM inside) WHERE rn = 1)"""


@query("t2_one_product_per_window", f"""WITH {_PRODUCT_SQL} SELECT source_id, label, CAST(tile AS VARCHAR) AS tile, item_id, d FROM one""")
def one_product(spark, sf_dir):
    p = products.plan_products(footprints(spark, sf_dir), areas(spark, sf_dir), months(spark, sf_dir), SIDE, one_per_window=True)
    return p.selections.select(F.col("aoi_id").alias("source_id"), "label", "tile", "item_id", "d")


@query("a7_product_coverage", f"""WITH {_PRODUCT_SQL},
g AS (SELECT DISTINCT source_id, tile FROM items),
miss AS (SELECT w.source_id, w.label, count(*) AS m FROM windows w JOIN g USING (source_id) LEFT JOIN (SELECT DISTINCT source_id, label, tile FROM inside) f
 USING (source_id, label, tile) WHERE f.tile IS NULL AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.source_id = w.source_id AND x.label = w.label AND x.tile = g.tile) GROUP BY 1, 2),
cov AS (SELECT i.source_id, i.label, count(DISTINCT i.item_id) AS n_products, count(DISTINCT c.cell) / 400.0::DOUBLE AS observed FROM inside i JOIN cells c USING (item_id) GROUP BY 1, 2)
SELECT w.source_id, w.label, CAST(coalesce(n_products, 0) AS BIGINT) AS n_products, CAST(coalesce(m, 0) AS BIGINT) AS tiles_missing,
 round(coalesce(observed, 0), 6) AS observed, CASE WHEN observed >= 0.9 THEN 'feasible-single' ELSE 'incomplete' END AS verdict
FROM windows w LEFT JOIN cov USING (source_id, label) LEFT JOIN miss USING (source_id, label)""")
def product_coverage(spark, sf_dir):
    p = products.plan_products(footprints(spark, sf_dir), areas(spark, sf_dir), months(spark, sf_dir), SIDE)
    return p.reports.select(F.col("aoi_id").alias("source_id"), "label", "n_products", "tiles_missing", F.round("observed", 6).alias("observed"), "verdict")


# ---- windows -------------------------------------------------------------------------------------------------------

def _requests(spark, sf_dir):
    """Dated questions from orders: period, event and temporal mode vary with the key."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "CAST(o_orderdate AS DATE) AS start", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 900 AS INT)) AS end",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'pair' ELSE 'series' END AS temporal", "date_add(CAST(o_orderdate AS DATE), 10) AS event",
        "CAST(30 AS INT) AS pre_days", "CAST(20 AS INT) AS post_days", "o_orderkey % 5 = 0 AS source_yearly")


_REQ_SQL = """req AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS e,
 o_orderkey % 3 = 0 AS pair, CAST(o_orderdate AS DATE) + 10 AS ev, o_orderkey % 5 = 0 AS yearly FROM orders),
monthly AS (SELECT request_id, strftime(m, '%Y-%m') AS label, greatest(CAST(m AS DATE), s) AS w_start, least(last_day(CAST(m AS DATE)), e) AS w_end
 FROM (SELECT *, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM req)),
yearly AS (SELECT request_id, CAST(y AS VARCHAR) AS label, greatest(make_date(y, 1, 1), s) AS w_start, least(make_date(y, 12, 31), e) AS w_end
 FROM (SELECT *, unnest(generate_series(year(s), year(e))) AS y FROM req)),
pairs AS (SELECT request_id, 'pre' AS label, ev - 30 AS w_start, ev AS w_end FROM req UNION ALL SELECT request_id, 'post', ev, ev + 20 FROM req),
steps AS (SELECT request_id, CASE WHEN pair THEN 'pair' WHEN yearly OR e - s > 548 THEN 'yearly' ELSE 'monthly' END AS step FROM req)"""


@query("d1_monthly_windows", f"WITH {_REQ_SQL} SELECT request_id, label, w_start, w_end FROM monthly")
def monthly_windows(spark, sf_dir):
    return D.expand(_requests(spark, sf_dir), D.monthly_array(F.col("start"), F.col("end")), "request_id")


@query("d2_yearly_windows", f"WITH {_REQ_SQL} SELECT request_id, label, w_start, w_end FROM yearly")
def yearly_windows(spark, sf_dir):
    return D.expand(_requests(spark, sf_dir), D.yearly_array(F.col("start"), F.col("end")), "request_id")


@query("d3_pre_post_windows", f"""WITH {_REQ_SQL} SELECT request_id, 'pre' AS label, ev - 32 AS w_start, ev - 2 AS w_end FROM req
UNION ALL SELECT request_id, 'post', ev + 2, ev + 22 FROM req""")
def pre_post_windows(spark, sf_dir):
    return D.expand(_requests(spark, sf_dir), D.pair_array(F.col("event"), F.lit(30), F.lit(20), F.lit(2)), "request_id")


@query("d4_p21_window_choice", f"""WITH {_REQ_SQL} SELECT request_id, step, label, w_start, w_end FROM steps JOIN monthly USING (request_id) WHERE step = 'monthly'
UNION ALL SELECT request_id, step, label, w_start, w_end FROM steps JOIN yearly USING (request_id) WHERE step = 'yearly'
UNION ALL SELECT request_id, step, label, w_start, w_end FROM steps JOIN pairs USING (request_id) WHERE step = 'pair'""")
def window_choice(spark, sf_dir):
    return D.windows_for(_requests(spark, sf_dir), "request_id")


@query("j2_items_in_overlapping_windows", f"""WITH {ITEMS_SQL},
win AS (SELECT source_id, min(d) + CAST(k * 20 AS INT) AS w_start, min(d) + CAST(k * 20 + 44 AS INT) AS w_end, k FROM items, range(0, 17) t(k) GROUP BY source_id, k)
SELECT i.source_id, CAST(k AS INT) AS k, CAST(count(*) AS BIGINT) AS n, min(i.item_id) AS first_item FROM items i JOIN win w
 ON w.source_id = i.source_id AND i.d BETWEEN w.w_start AND w.w_end GROUP BY 1, 2""")
def overlapping_windows(spark, sf_dir):
    i = items(spark, sf_dir)
    win = (i.groupBy("source_id").agg(F.min("d").alias("s")).select("source_id", "s", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("k"))
           .select("source_id", "k", F.date_add("s", F.col("k") * 20).alias("w_start"), F.date_add("s", F.col("k") * 20 + 44).alias("w_end")))
    return D.join_windows(i, win, ["source_id"]).groupBy("source_id", "k").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


@query("d6_f16_request_period", """WITH r AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders),
c AS (SELECT request_id, CASE WHEN k % 7 = 0 THEN d END AS fs, CASE WHEN k % 7 IN (0, 1) THEN d + 90 END AS fe, CASE WHEN k % 5 < 2 THEN d - 40 END AS ps,
 CASE WHEN k % 5 < 2 THEN d + 40 END AS pe, CASE WHEN k % 11 = 0 THEN d - 100 END AS js, CASE WHEN k % 11 = 0 THEN d + 100 END AS je,
 CASE WHEN k % 4 = 0 THEN d END AS ev, CASE WHEN k % 6 = 0 THEN 10 END AS dy, DATE '2026-09-26' AS today FROM r),
p AS (SELECT *, fs IS NOT NULL OR fe IS NOT NULL AS flagged, ps IS NULL AND ev IS NOT NULL AND NOT (fs IS NOT NULL OR fe IS NOT NULL) AND js IS NULL AS centred FROM c),
q AS (SELECT *, ps IS NULL AND NOT centred AND dy IS NOT NULL AND NOT flagged AND js IS NULL AS spanned FROM p),
z AS (SELECT *, CASE WHEN centred THEN ev - 30 WHEN spanned THEN make_date(year(today) - dy, 1, 1) ELSE ps END AS s2,
 CASE WHEN centred THEN least(ev + 20, today) WHEN spanned THEN today ELSE pe END AS e2 FROM q)
SELECT request_id, CASE WHEN flagged THEN coalesce(fs, s2, today - 365) ELSE coalesce(s2, js, today - 365) END AS "start",
 CASE WHEN flagged THEN coalesce(fe, e2, today) WHEN s2 IS NOT NULL THEN e2 ELSE coalesce(je, today) END AS "end",
 CASE WHEN flagged THEN 'flags' WHEN centred THEN 'event' WHEN spanned THEN 'default years' WHEN ps IS NOT NULL THEN 'text' WHEN js IS NOT NULL THEN 'project'
 ELSE 'last 12 months' END AS period_source FROM z""")
def request_period(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "o_orderkey AS k", "CAST(o_orderdate AS DATE) AS d").selectExpr(
        "request_id", "IF(k % 7 = 0, d, NULL) AS flag_start", "IF(k % 7 IN (0, 1), date_add(d, 90), NULL) AS flag_end",
        "IF(k % 5 < 2, date_sub(d, 40), NULL) AS parsed_start", "IF(k % 5 < 2, date_add(d, 40), NULL) AS parsed_end",
        "IF(k % 11 = 0, date_sub(d, 100), NULL) AS project_start", "IF(k % 11 = 0, date_add(d, 100), NULL) AS project_end",
        "IF(k % 4 = 0, d, NULL) AS event", "30 AS pre_days", "20 AS post_days", "IF(k % 6 = 0, 10, NULL) AS default_years")
    return D.request_period(r, F.lit("2026-09-26").cast("date")).select("request_id", "start", "end", "period_source")


_HAZARD_SQL = """areas AS (SELECT c_custkey AS area_id, (c_custkey * 7 % 360) - 180 + 0.5 AS cx, (c_custkey * 13 % 170) - 85 + 0.25 AS cy,
  CASE WHEN c_custkey % 2 = 0 THEN 'FL' ELSE 'TC' END AS code, DATE '1996-01-01' AS s, DATE '1998-12-31' AS e FROM customer),
haz AS (SELECT o_orderkey AS hazard_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FL' ELSE 'TC' END AS code, 'event ' || CAST(o_orderkey AS VARCHAR) AS hazard_name,
  CAST(o_orderdate AS DATE) AS hs, (o_orderkey * 11 % 3600) / 10.0::DOUBLE - 180 AS lon, (o_orderkey * 17 % 1700) / 10.0::DOUBLE - 85 AS lat FROM orders),
near AS (SELECT a.area_id, h.hazard_id, h.hazard_name, h.hs, round_even(sqrt(power(h.lon - a.cx, 2) + power(h.lat - a.cy, 2)), 2) AS dist FROM areas a JOIN haz h
  ON a.code = h.code AND h.hs BETWEEN a.s AND a.e AND sqrt(power(h.lon - a.cx, 2) + power(h.lat - a.cy, 2)) <= 3.0)"""


def _areas_and_hazards(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS area_id", "CAST((c_custkey * 7 % 360) - 180 + 0.5D AS DOUBLE) AS cx", "CAST((c_custkey * 13 % 170) - 85 + 0.25D AS DOUBLE) AS cy",
        "CASE WHEN c_custkey % 2 = 0 THEN 'FL' ELSE 'TC' END AS code", "DATE '1996-01-01' AS start", "DATE '1998-12-31' AS end")
    h = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS hazard_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'FL' ELSE 'TC' END AS code", "concat('event ', o_orderkey) AS hazard_name",
        "CAST(o_orderdate AS DATE) AS hazard_start", "(o_orderkey * 11 % 3600) / 10.0D - 180 AS lon", "(o_orderkey * 17 % 1700) / 10.0D - 85 AS lat")
    return a, h


@query("t5_s10_nearest_hazard", f"""WITH {_HAZARD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY dist, hazard_id) AS rn,
 count(*) OVER (PARTITION BY area_id) AS n_near FROM near)
SELECT area_id, hazard_id, hazard_name, hs AS hazard_start, dist AS distance_deg, CAST(n_near AS BIGINT) AS n_near FROM r WHERE rn = 1""")
def nearest_hazard(spark, sf_dir):
    a, h = _areas_and_hazards(spark, sf_dir)
    return D.nearest_hazard(a, h).select("area_id", "hazard_id", "hazard_name", "hazard_start", "distance_deg", "n_near")


@query("d5_event_ladder", f"""WITH {_HAZARD_SQL}, r AS (SELECT area_id, hs, row_number() OVER (PARTITION BY area_id ORDER BY dist, hazard_id) AS rn FROM near),
q AS (SELECT a.area_id, a.s, a.e, CASE WHEN a.area_id % 10 = 0 THEN DATE '1997-05-01' END AS g, CASE WHEN a.area_id % 10 = 1 THEN DATE '1997-06-01' END AS t, r.hs
 FROM areas a LEFT JOIN r ON r.area_id = a.area_id AND r.rn = 1)
SELECT area_id, coalesce(g, t, hs, s) AS event_date, CASE WHEN coalesce(g, t, hs) IS NOT NULL THEN 30 ELSE greatest(30, greatest(e - s, 1)) END::INT AS event_pre,
 CASE WHEN coalesce(g, t, hs) IS NOT NULL THEN 20 ELSE greatest(e - s, 1) END::INT AS event_post,
 CASE WHEN g IS NOT NULL THEN 'given' WHEN t IS NOT NULL THEN 'text' WHEN hs IS NOT NULL THEN 'hazard' ELSE 'period' END AS provenance FROM q""")
def event_ladder(spark, sf_dir):
    a, h = _areas_and_hazards(spark, sf_dir)
    r = (a.join(D.nearest_hazard(a, h).select("area_id", "hazard_start"), "area_id", "left")
         .selectExpr("*", "IF(area_id % 10 = 0, DATE '1997-05-01', NULL) AS given_event", "IF(area_id % 10 = 1, DATE '1997-06-01', NULL) AS text_event",
                     "30 AS pre_days", "20 AS post_days"))
    return D.event_ladder(r).select("area_id", "event_date", "event_pre", "event_post", "provenance")

"""Registration, table access and the derived catalogue views shared by the query modules."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright.functions import bitgrid as B
from tilewright.operators import windows as D
from tilewright.session import SMALL_READS, configure

QUERIES: dict = {}
ORACLES: dict = {}
SIDE = 20  # the area is a square of 20 x 20 cells


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark, SMALL_READS), sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df


# ---- catalogue items derived from events -------------------------------------------------------------------------

def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")).selectExpr(
        "event_id AS item_id", "concat('src_', event_type) AS source_id", "concat('src_', event_type) AS aoi_id", "ts",
        "date_add(CAST(ts AS DATE), CAST(event_id % 12 AS INT) * 30) AS d", "CAST(user_id % 16 AS INT) AS tile",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS cloud_cover",
        "CAST(event_id % 5 AS INT) AS rel_orbit",
        "CASE WHEN event_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state",
        "CAST((user_id % 16) % 4 * 5 - event_id % 3 AS INT) AS x0",
        "CAST(floor((user_id % 16) / 4) * 5 - event_id % 2 AS INT) AS y0")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their 7 x 7-cell footprints as grid words."""
    i = items(spark, sf_dir)
    return i.withColumn("words", B.box_words(F.col("x0"), F.col("y0"), F.col("x0") + 6, F.col("y0") + 6, SIDE, SIDE))


def areas(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One plan per source, each over the whole square."""
    src = (items(spark, sf_dir) if rows is None else rows).select("aoi_id").distinct()
    return src.withColumn("words", B.box_words(F.lit(0), F.lit(0), F.lit(SIDE - 1), F.lit(SIDE - 1), SIDE, SIDE))


def months(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Monthly windows over the dates present, per source."""
    span = (items(spark, sf_dir) if rows is None else rows).groupBy("aoi_id").agg(F.min("d").alias("s"), F.max("d").alias("e"))
    return span.select("aoi_id", F.inline(D.monthly_array(F.col("s"), F.col("e"))))


ITEMS_SQL = """items AS (
 SELECT event_id AS item_id, 'src_' || event_type AS source_id, ts,
  CAST(ts AS DATE) + CAST((event_id % 12) * 30 AS INT) AS d, CAST(user_id % 16 AS INT) AS tile,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS cloud_cover,
  CAST(event_id % 5 AS INT) AS rel_orbit, CASE WHEN event_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
  CAST((user_id % 16) % 4 * 5 - event_id % 3 AS INT) AS x0, CAST(floor((user_id % 16) / 4) * 5 - event_id % 2 AS INT) AS y0
 FROM events)"""
CELLS_SQL = ITEMS_SQL + """,
axis AS (SELECT CAST(range AS INT) AS c FROM range(20)),
cells AS (SELECT i.item_id, i.source_id, i.tile, i.d, i.cloud_cover, x.c * 100 + y.c AS cell FROM items i
 JOIN axis x ON x.c BETWEEN i.x0 AND i.x0 + 6 JOIN axis y ON y.c BETWEEN i.y0 AND i.y0 + 6),
n_item AS (SELECT item_id, count(*) AS n FROM cells GROUP BY 1)"""
WINDOWS_SQL = """spans AS (SELECT source_id, min(d) AS s, max(d) AS e FROM items GROUP BY 1),
windows AS (SELECT source_id, strftime(m, '%Y-%m') AS label, greatest(CAST(m AS DATE), s) AS w_start,
  least(last_day(CAST(m AS DATE)), e) AS w_end
 FROM (SELECT source_id, s, e, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM spans))"""
OPTICAL_SQL = "RECURSIVE " + CELLS_SQL + ", " + WINDOWS_SQL + """,
tile_cells AS (SELECT source_id, tile, count(DISTINCT cell) AS tc, list(DISTINCT cell) AS cl FROM cells GROUP BY 1, 2),
quality AS (SELECT i.source_id, i.tile, avg(n) AS q FROM items i JOIN n_item USING (item_id) GROUP BY 1, 2),
ranked AS (SELECT t.source_id, t.tile, t.tc, t.cl, row_number() OVER (PARTITION BY t.source_id ORDER BY q DESC, t.tile) AS rk
 FROM tile_cells t JOIN quality USING (source_id, tile)),
greedy AS (
 SELECT source_id, tile, tc, rk, cl AS covered, len(cl) AS excl, len(cl) >= 4 AS kept FROM ranked WHERE rk = 1
 UNION ALL
 SELECT r.source_id, r.tile, r.tc, r.rk,
  CASE WHEN len(list_filter(r.cl, lambda x: NOT list_contains(g.covered, x))) >= 4
   THEN list_distinct(list_concat(CASE WHEN g.kept OR g.rk > 1 THEN g.covered ELSE [] END, r.cl)) ELSE g.covered END,
  len(list_filter(r.cl, lambda x: NOT list_contains(g.covered, x))),
  len(list_filter(r.cl, lambda x: NOT list_contains(g.covered, x))) >= 4
 FROM greedy g JOIN ranked r ON r.source_id = g.source_id AND r.rk = g.rk + 1),
kept AS (SELECT source_id, tile, tc, excl FROM greedy WHERE kept),
cand AS (SELECT i.source_id, w.label, i.tile, i.item_id, i.d, i.cloud_cover, coalesce(i.cloud_cover, 100) AS cloud, k.excl,
  n.n * 1.0::DOUBLE / k.tc AS coverage, (n.n * 1.0::DOUBLE / k.tc) * (1 - coalesce(i.cloud_cover, 100) / 100) AS clear
 FROM items i JOIN n_item n USING (item_id) JOIN kept k USING (source_id, tile)
 JOIN windows w ON w.source_id = i.source_id AND i.d BETWEEN w.w_start AND w.w_end),
pos AS (SELECT *, row_number() OVER (PARTITION BY source_id, label, tile ORDER BY round_even(clear, 3) DESC, cloud, d, item_id) AS rn,
  count(*) OVER (PARTITION BY source_id, label, tile) AS n_candidates FROM cand),
best AS (SELECT * FROM pos WHERE rn = 1),
seq AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, coalesce(list(1 - clear) OVER (PARTITION BY source_id, label, tile ORDER BY rn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])), lambda a, b: a * b) AS remaining FROM pos),
comp AS (SELECT * FROM seq WHERE remaining > 1 - 0.8::DOUBLE),
comp_tile AS (SELECT source_id, label, tile, count(*) AS n_composite, 1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - clear ORDER BY rn)), lambda a, b: a * b) AS composite_clear
 FROM comp GROUP BY 1, 2, 3)"""

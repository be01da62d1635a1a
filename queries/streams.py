"""Streams over the event table, read as a file source until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import ITEMS_SQL, query, table
from tilewright.session import shared_folder
from tilewright.streaming import feeds

ITEM_EXPR = ("event_id AS item_id", "concat('src_', event_type) AS source_id", "ts AS dt", "date_add(CAST(ts AS DATE), CAST(event_id % 12 AS INT) * 30) AS d", "CAST(user_id % 16 AS INT) AS tile",
             "CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS cloud_cover")


def _events(spark, sf_dir):
    return feeds.read_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


@query("i1_new_items_deduplicated", f"WITH {ITEMS_SQL} SELECT DISTINCT source_id, item_id % 1500 AS item_id FROM items")
def new_items(spark, sf_dir):
    s = _events(spark, sf_dir).selectExpr(*ITEM_EXPR).withColumn("item_id", F.col("item_id") % 1500)
    out = shared_folder(spark, "new-items")
    return feeds.keep_new_items(s.select("source_id", "item_id", "dt"), f"{out}/data", f"{out}/checkpoint").select("source_id", "item_id")


@query("i2_best_scene_per_month_stream", f"""WITH {ITEMS_SQL}, r AS (SELECT *, strftime(d, '%Y-%m') AS label, coalesce(cloud_cover, 100) AS cloud, row_number() OVER (PARTITION BY source_id, tile, strftime(d, '%Y-%m') ORDER BY coalesce(cloud_cover, 100), d, item_id) AS rn,
 count(*) OVER (PARTITION BY source_id, tile, strftime(d, '%Y-%m')) AS n FROM items) SELECT source_id, tile, label, CAST(n AS BIGINT) AS n, round(cloud, 6) AS cloud, d, item_id FROM r WHERE rn = 1""")
def best_scenes(spark, sf_dir):
    out = shared_folder(spark, "best-scenes")
    return feeds.keep_best_scenes(_events(spark, sf_dir).selectExpr(*ITEM_EXPR), f"{out}/data", f"{out}/checkpoint").select(
        "source_id", "tile", "label", "n", F.round("cloud", 6).alias("cloud"), "d", "item_id")


@query("i3_library_from_log_stream", """WITH t AS (SELECT event_id AS seq, 'f/' || CAST(event_id % 997 AS VARCHAR) AS path, value FROM events WHERE event_type <> 'error')
SELECT path, seq, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM t) WHERE rn = 1""")
def library_log(spark, sf_dir):
    out = shared_folder(spark, "library")
    log = _events(spark, sf_dir).selectExpr("event_id AS seq", "concat('f/', event_id % 997) AS path", "IF(event_type = 'error', 'failed', 'ok') AS status", "value")
    return feeds.keep_library(log, f"{out}/data", f"{out}/checkpoint").select("path", "seq", F.round("value", 6).alias("value"))


@query("i4_refresh_finds_only_new", f"""WITH {ITEMS_SQL} SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM items WHERE d < DATE '2024-07-01')""")
def refresh(spark, sf_dir):
    """Two runs of one stream: items of July and later are published between them; the gap join keeps what the second run added."""
    from tilewright.operators import ledger
    out = shared_folder(spark, "refresh")
    all_items = table(spark, sf_dir, "events").selectExpr(*ITEM_EXPR).select(F.col("item_id").alias("item"), F.lit("red").alias("asset"), "d")
    publish = lambda some, mode: some.write.mode(mode).parquet(f"{out}/feed")
    publish(all_items.where("d < DATE '2024-07-01'"), "error")
    stream = feeds.read_stream(spark, f"{out}/feed", all_items.schema)
    feeds.run_available(stream, f"{out}/data", f"{out}/checkpoint")
    before = spark.read.parquet(f"{out}/data")
    had = before.select("item", "asset").withColumn("run", F.lit(1))
    had.write.parquet(f"{out}/before")
    publish(all_items.where("d >= DATE '2024-07-01'"), "append")
    feeds.run_available(stream, f"{out}/data", f"{out}/checkpoint")
    return ledger.gaps(spark.read.parquet(f"{out}/data"), spark.read.parquet(f"{out}/before")).select(F.col("item").alias("item_id"))

"""Dated products that the provider already composited: every product of a window, or the best one per tile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say
from tilewright.functions import bitgrid as B, verdicts as E
from tilewright.operators.windows import join_windows
from tilewright.plans.optical import in_area


@dataclass
class ProductPlan:
    selections: DataFrame  # aoi_id, label, tile, item_id, d
    missing: DataFrame     # (aoi, window, tile) without a product
    reports: DataFrame


def plan_products(items: DataFrame, area: DataFrame, windows: DataFrame, ny: int, one_per_window: bool = False,
                  min_coverage: float = V.MIN_COVERAGE) -> ProductPlan:
    """items: aoi_id, item_id, tile, d, cloud_cover, words.  Products without a tile share the group 'all'."""
    dated = in_area(items.withColumn("tile", F.coalesce(F.col("tile").cast("string"), F.lit("all"))), area)
    inside = join_windows(dated, windows, ["aoi_id"])
    if one_per_window:
        # the middle of the window, half days towards the start
        middle = F.date_add("w_start", F.floor(F.datediff("w_end", "w_start") / 2).cast("int"))
        key = F.struct(F.coalesce("cloud_cover", F.lit(0.0)).alias("c"), F.abs(F.datediff("d", middle)).alias("a"), "d", "item_id")
        inside = inside.groupBy("aoi_id", "label", "tile").agg(F.min_by(F.struct("item_id", "d", "cloud_cover", "words", "n_cells"), key).alias("p")).select(
            "aoi_id", "label", "tile", "p.*")
    n_area = area.select("aoi_id", B.cells(F.col("words")).alias("area_cells"))
    labels = windows.select("aoi_id", "label").distinct()
    groups = dated.select("aoi_id", "tile").distinct()
    found = inside.select("aoi_id", "label", "tile").distinct()
    missing = labels.join(groups, "aoi_id").join(found, ["aoi_id", "label", "tile"], "left_anti")
    n_missing = missing.groupBy("aoi_id", "label").agg(F.count("*").alias("tiles_missing"))
    cover = B.dissolve(inside, ["aoi_id", "label"], "words", ny, F.count("*").alias("n_products")).select(
        "aoi_id", "label", "n_products", B.cells(F.col("words")).alias("_cells"))
    reports = (labels.join(n_area, "aoi_id").join(cover, ["aoi_id", "label"], "left").join(n_missing, ["aoi_id", "label"], "left")
               .withColumn("n_products", F.coalesce("n_products", F.lit(0))).withColumn("tiles_missing", F.coalesce("tiles_missing", F.lit(0)))
               .withColumn("observed", F.coalesce(F.col("_cells") / F.col("area_cells"), F.lit(0.0)))
               .withColumn("verdict", F.when(F.col("observed") >= min_coverage, "feasible-single").otherwise("incomplete"))
               .withColumn("verdict_text", F.when(F.col("n_products") == 0, say("no product")).otherwise(
                   say("products", F.col("n_products"), E.percent(F.col("observed")))))
               .drop("area_cells", "_cells"))
    return ProductPlan(inside.select("aoi_id", "label", "tile", "item_id", "d"), missing, reports)

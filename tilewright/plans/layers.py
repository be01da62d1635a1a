"""Plans for static layers, one-file-per-month series and vector queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions import polygons as P, scalars as S
from tilewright.functions.bind import say


def fill_template(url: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        url = F.replace(url, F.lit("{" + name + "}"), value)
    return url


def country_url(url: Column, iso3: Column) -> Column:
    return fill_template(url, iso3=iso3, iso3_lower=F.lower(iso3))


def file_series(windows: DataFrame) -> DataFrame:
    """One file per monthly window.  windows: source_id, url, label, w_start, plus the caller's keys."""
    return windows.select("*", F.concat_ws("-", "source_id", "label").alias("item_id"), fill_template(
        F.col("url"), yyyy=F.date_format("w_start", "yyyy"), mm=F.date_format("w_start", "MM")).alias("href"))


def file_series_verdicts(files: DataFrame) -> DataFrame:
    """A month whose file has no size is not published yet.  files: keys…, label, size."""
    unpublished = F.col("size").isNull() | (F.col("size") == 0)
    return files.withColumn("verdict", F.when(unpublished, "incomplete").otherwise("feasible-single")).withColumn(
        "verdict_text", F.when(unpublished, say("file unpublished")).otherwise(say("one file")))


def tile_name(top: Column, left: Column) -> Column:
    """Name by the top-left corner, such as 20N_070E."""
    return F.format_string("%02d%s_%03d%s", F.abs(top), F.when(top >= 0, "N").otherwise("S"), F.abs(left), F.when(left >= 0, "E").otherwise("W"))


def tile_grid(areas: DataFrame, step: Column) -> DataFrame:
    """Tiles of a fixed longitude/latitude grid that meet an area's box.  areas: area_id, box; adds tile, tile_box, and fraction, the
    share of the tile that the area's box takes."""
    b = F.col("box")
    top, left = (F.ceil(b["maxy"] / step) * step).cast("int"), (F.floor(b["minx"] / step) * step).cast("int")
    # a box without height or width may lie on a grid line; it then has the tile below or to the right of it
    tops = F.sequence(top, F.least(top, (F.floor(b["miny"] / step) * step + step).cast("int")), -step)
    lefts = F.sequence(left, F.greatest(left, (F.ceil(b["maxx"] / step) * step - step).cast("int")), step)
    t = (areas.withColumn("step_deg", step).withColumn("top", F.explode(tops)).withColumn("left", F.explode(lefts)))
    box = F.struct(F.col("left").cast("double").alias("minx"), (F.col("top") - F.col("step_deg")).cast("double").alias("miny"),
                   (F.col("left") + F.col("step_deg")).cast("double").alias("maxx"), F.col("top").cast("double").alias("maxy"))
    return (t.withColumn("tile_box", box).where(P.boxes_touch(F.col("tile_box"), F.col("box")))
            .withColumn("fraction", P.box_overlap(F.col("tile_box"), b) / P.box_area(F.col("tile_box")))
            .withColumn("tile", tile_name(F.col("top"), F.col("left"))))


def read_strategy(ranged: Column, fraction: Column) -> Column:
    """Whole-file download where the server has no range reads, which makes the fraction one."""
    return F.struct((~ranged).alias("whole_file"), F.when(ranged, fraction).otherwise(F.lit(1.0)).alias("fraction"))


def vector_verdicts(requests: DataFrame) -> DataFrame:
    """Area cap of live queries.  requests: area_km2, max_area_km2, driver."""
    too_big = F.coalesce((F.col("max_area_km2") > 0) & (F.col("area_km2") > F.col("max_area_km2")), F.lit(False))
    text = (F.when(too_big, say("area over limit", F.format_string("%,.0f", F.col("area_km2")), F.format_string("%,d", F.col("max_area_km2").cast("bigint"))))
            .when(F.col("driver") == "overpass", say("live map query")).otherwise(say("downloaded")))
    return (requests.withColumn("verdict", F.when(too_big, "incomplete").otherwise("feasible-single")).withColumn("verdict_text", text)
            .withColumn("n_assets", F.when(too_big, 0).otherwise(1)))


def layer_verdict(n_files: Column) -> Column:
    return F.struct(F.when(n_files > 0, "feasible-single").otherwise("incomplete").alias("verdict"), F.when(n_files > 0, say("files meet", n_files)).otherwise(
        say("no tile meets")).alias("verdict_text"))


def estimate(acquire: DataFrame, *keys: str) -> DataFrame:
    """Files, full and windowed bytes and unknown sizes per plan.  acquire: keys…, size (null = unknown), fraction."""
    return acquire.groupBy(*keys).agg(
        F.count("*").alias("n_assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("full_bytes"),
        F.coalesce(F.sum(S.windowed_bytes(F.col("size"), F.coalesce("fraction", F.lit(1.0)))), F.lit(0)).alias("windowed_bytes"),
        F.count_if(F.col("size").isNull()).alias("unknown"))


def rescale_kept(before: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Estimate of a plan of which only some windows are kept: windowed bytes scale with the full bytes kept."""
    k = kept.groupBy(*keys).agg(F.count("*").alias("n_assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("kept_bytes"),
                                F.count_if(F.col("size").isNull()).alias("unknown"))
    full = F.coalesce(F.nullif("full_bytes", F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    return k.join(before.select(*keys, "full_bytes", "windowed_bytes"), [*keys]).select(
        *keys, "n_assets", F.col("kept_bytes").alias("full_bytes"),
        S.share_of(F.col("windowed_bytes"), F.col("kept_bytes"), full).alias("windowed_bytes"), "unknown")

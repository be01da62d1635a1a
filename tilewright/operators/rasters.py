"""Rasters as rows: windows and blocks, masking, nearest-neighbour regridding, mosaics and valid shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pixel_window(left: Column, top: Column, res: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, width: Column, height: Column) -> Column:
    """Pixel window of bounds, offsets and lengths rounded, cut to the raster; null when they do not meet."""
    off_c, off_r = F.floor((minx - left) / res), F.floor((top - maxy) / res)
    n_c, n_r = F.ceil((maxx - minx) / res), F.ceil((maxy - miny) / res)
    c0, r0 = F.greatest(off_c, F.lit(0)), F.greatest(off_r, F.lit(0))
    c1, r1 = F.least(off_c + n_c, width), F.least(off_r + n_r, height)
    return F.when((c1 > c0) & (r1 > r0), F.struct(c0.cast("int").alias("c0"), r0.cast("int").alias("r0"), c1.cast("int").alias("c1"), r1.cast("int").alias("r1")))


def blocks(windows: DataFrame, block: int) -> DataFrame:
    """Block-aligned reads of a pixel window; blocks at the edge are cut to the raster.  windows: raster_id, win, width, height."""
    w = F.col("win")
    first = lambda v: (F.floor(v / block) * block).cast("int")
    rows = F.sequence(first(w["r0"]), first(w["r1"] - 1), F.lit(block))
    cols = F.sequence(first(w["c0"]), first(w["c1"] - 1), F.lit(block))
    return (windows.where(w.isNotNull()).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
            .select("raster_id", "row", "col", F.least(F.lit(block), F.col("width") - F.col("col")).alias("w"), F.least(F.lit(block), F.col("height") - F.col("row")).alias("h")))


def mask_outside(pixels: DataFrame, inside: Column, nodata: Column) -> DataFrame:
    """Pixels outside the area become no-data; zeros inside survive."""
    return pixels.withColumn("value", F.when(inside, F.col("value")).otherwise(nodata))


def regrid_nearest(grid: DataFrame, pixels: DataFrame, nodata: Column) -> DataFrame:
    """Output pixels take the source pixel their centre falls in, so every value exists in the source.

    grid: raster_id, orow, ocol, sx, sy (source pixel coordinates of the centre); an equi-join on (raster, row, col).
    """
    at = grid.withColumn("row", F.floor("sy").cast("int")).withColumn("col", F.floor("sx").cast("int")).drop("sx", "sy")
    return at.join(pixels, ["raster_id", "row", "col"], "left").select("raster_id", "orow", "ocol", F.coalesce("value", nodata).alias("value"))


def mosaic(pixels: DataFrame, nodata: Column) -> DataFrame:
    """One value per cell: the last source in order that has data there.  pixels: mosaic_id, cy, cx, source_pos, value."""
    seen = F.when(F.col("value") != nodata, F.col("source_pos"))
    best = F.max(F.struct(seen.alias("p"), F.when(F.col("value") != nodata, F.col("value")).alias("v")))
    return pixels.groupBy("mosaic_id", "cy", "cx").agg(best.alias("b")).select("mosaic_id", "cy", "cx", F.coalesce("b.v", nodata).alias("value"))


def mosaic_extent(files: DataFrame, *keys: str) -> DataFrame:
    """Extent and size of a mosaic on the average pixel size of its files.  files: keys…, left, bottom, right, top, xres, yres."""
    e = files.groupBy(*keys).agg(F.avg("xres").alias("xres"), F.avg("yres").alias("yres"), F.min("left").alias("left"), F.max("right").alias("right"),
                                 F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.count("*").alias("n_files"))
    return e.withColumn("width", F.bround((F.col("right") - F.col("left")) / F.col("xres"), 0).cast("int")).withColumn(
        "height", F.bround((F.col("top") - F.col("bottom")) / F.col("yres"), 0).cast("int"))


def valid_fraction(pixels: DataFrame, *keys: str) -> DataFrame:
    """Share of pixels with a real value inside the area; of all pixels where none lies inside.  pixels: keys…, valid, inside."""
    v = F.col("valid").cast("int")
    inner = F.avg(F.when(F.col("inside"), v))
    return pixels.groupBy(*keys).agg(F.bround(F.coalesce(inner, F.avg(v)), 4).alias("valid_fraction"), F.count("*").alias("pixels"))


def empty_rasters(fractions: DataFrame) -> DataFrame:
    return fractions.where("valid_fraction = 0")

"""Rasters as pixel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table
from tilewright.operators import rasters as R


def _pixels(spark, sf_dir):
    """Pixels of one raster per supplier; 255 marks no data."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("raster_id"), (F.col("l_orderkey") % 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col")).agg(
        (F.max("l_orderkey") % 256).cast("int").alias("value"), F.max("l_linenumber").alias("source_pos"))


_PIX = """px AS (SELECT l_suppkey AS raster_id, CAST(l_orderkey % 40 AS INT) AS "row", CAST(l_partkey % 40 AS INT) AS col, CAST(max(l_orderkey) % 256 AS INT) AS value, max(l_linenumber) AS source_pos FROM lineitem GROUP BY 1, 2, 3)"""


@query("r2_masked_pixels", f"""WITH {_PIX} SELECT raster_id, "row", col, CASE WHEN "row" BETWEEN 5 AND 30 AND col BETWEEN 10 AND 35 THEN value ELSE 255 END AS value FROM px""")
def masked(spark, sf_dir):
    inside = F.col("row").between(5, 30) & F.col("col").between(10, 35)
    return R.mask_outside(_pixels(spark, sf_dir), inside, F.lit(255)).select("raster_id", "row", "col", "value")


@query("r3_nearest_regrid", f"""WITH {_PIX}, g AS (SELECT DISTINCT l_suppkey AS raster_id, CAST(l_orderkey % 60 AS INT) AS orow, CAST(l_partkey % 60 AS INT) AS ocol FROM lineitem)
SELECT g.raster_id, orow, ocol, coalesce(px.value, 255) AS value FROM g LEFT JOIN px ON px.raster_id = g.raster_id AND px."row" = CAST(floor((orow + 0.5) / 1.5) AS INT) AND px.col = CAST(floor((ocol + 0.5) / 1.5) AS INT)""")
def regrid(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("raster_id"), (F.col("l_orderkey") % 60).cast("int").alias("orow"), (F.col("l_partkey") % 60).cast("int").alias("ocol")).distinct()
    at = g.withColumn("sy", (F.col("orow") + 0.5) / 1.5).withColumn("sx", (F.col("ocol") + 0.5) / 1.5)
    return R.regrid_nearest(at, _pixels(spark, sf_dir).select("raster_id", "row", "col", "value"), F.lit(255))


@query("r4_mosaic", """WITH p AS (SELECT l_suppkey % 20 AS mosaic_id, CAST(l_orderkey % 50 AS INT) AS cy, CAST(l_partkey % 50 AS INT) AS cx, l_orderkey * 8 + l_linenumber AS source_pos, CAST(l_orderkey % 5 * 51 AS INT) AS value, l_suppkey FROM lineitem),
b AS (SELECT mosaic_id, cy, cx, max(source_pos) FILTER (value <> 204) AS best FROM p GROUP BY 1, 2, 3)
SELECT b.mosaic_id, b.cy, b.cx, coalesce((SELECT max(p.value) FROM p WHERE p.mosaic_id = b.mosaic_id AND p.cy = b.cy AND p.cx = b.cx AND p.source_pos = b.best AND p.value <> 204), 204) AS value FROM b""")
def mosaic(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("mosaic_id"), (F.col("l_orderkey") % 50).cast("int").alias("cy"), (F.col("l_partkey") % 50).cast("int").alias("cx"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_pos"), (F.col("l_orderkey") % 5 * 51).cast("int").alias("value"))
    return R.mosaic(p, F.lit(204))


_VALID = _PIX + """, vf AS (SELECT raster_id, count(*) AS pixels, count(*) FILTER ("row" < 20 AND raster_id % 10 <> 0) AS ni, count(*) FILTER (value <> 255 AND value % 2 = 0 AND raster_id % 7 <> 0 AND "row" < 20 AND raster_id % 10 <> 0) AS vi,
 count(*) FILTER (value <> 255 AND value % 2 = 0 AND raster_id % 7 <> 0) AS va FROM px GROUP BY 1), fr AS (SELECT raster_id, CAST(pixels AS BIGINT) AS pixels, round_even(CASE WHEN ni > 0 THEN vi / ni::DOUBLE ELSE va / pixels::DOUBLE END, 4) AS valid_fraction FROM vf)"""


def _fractions(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("valid", (F.col("value") != 255) & (F.col("value") % 2 == 0) & (F.col("raster_id") % 7 != 0)).withColumn("inside", (F.col("row") < 20) & (F.col("raster_id") % 10 != 0))
    return R.valid_fraction(p, "raster_id")


@query("a21_r5_valid_fraction", f"WITH {_VALID} SELECT raster_id, pixels, round(valid_fraction, 6) AS valid_fraction FROM fr")
def valid_fraction(spark, sf_dir):
    return _fractions(spark, sf_dir).select("raster_id", "pixels", F.round("valid_fraction", 6).alias("valid_fraction"))


@query("r5_empty_rasters", f"WITH {_VALID} SELECT raster_id FROM fr WHERE valid_fraction = 0")
def empty_rasters(spark, sf_dir):
    return R.empty_rasters(_fractions(spark, sf_dir)).select("raster_id")


@query("a20_mosaic_extents", """WITH f AS (SELECT l_suppkey % 50 AS grp, CAST(l_linenumber AS INT) AS band, CAST(l_partkey % 100 AS DOUBLE) * 10 AS l, CAST(l_orderkey % 100 AS DOUBLE) * 10 AS b FROM lineitem)
SELECT grp, band, round(avg(10.0 + (l / 10) % 2), 6) AS xres, min(l) AS "left", max(l) + 400 AS "right", min(b) AS bottom, max(b) + 300 AS top, CAST(count(*) AS BIGINT) AS n_files,
 CAST(round_even((max(l) + 400 - min(l)) / avg(10.0::DOUBLE + (l / 10) % 2), 0) AS INT) AS width, CAST(round_even((max(b) + 300 - min(b)) / 10.0::DOUBLE, 0) AS INT) AS height FROM f GROUP BY 1, 2""")
def mosaic_extents(spark, sf_dir):
    l, b = (F.col("l_partkey") % 100).cast("double") * 10, (F.col("l_orderkey") % 100).cast("double") * 10
    f = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_linenumber").alias("band"), l.alias("left"), b.alias("bottom"), (l + 400).alias("right"), (b + 300).alias("top"),
                                               (10.0 + (l / 10) % 2).alias("xres"), F.lit(10.0).alias("yres"))
    return R.mosaic_extent(f, "grp", "band").drop("yres").withColumn("xres", F.round("xres", 6))


@query("r1_blocks_of_pixel_windows", """WITH a AS (SELECT c_custkey AS raster_id, CAST(c_custkey % 300 AS DOUBLE) * 10 + 3 AS x0, CAST(c_custkey % 250 AS DOUBLE) * 10 + 7 AS y0, CAST(c_custkey % 40 AS DOUBLE) * 50 + 5 AS w, CAST(c_custkey % 30 AS DOUBLE) * 50 + 5 AS h FROM customer),
o AS (SELECT raster_id, floor((x0 - 500) / 10) AS oc, floor((2600 - (y0 + h)) / 10) AS orow, ceil(w / 10) AS nc, ceil(h / 10) AS nr FROM a),
z AS (SELECT raster_id, CAST(greatest(oc, 0) AS INT) AS c0, CAST(greatest(orow, 0) AS INT) AS r0, CAST(least(oc + nc, 210) AS INT) AS c1, CAST(least(orow + nr, 190) AS INT) AS r1 FROM o)
SELECT raster_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(least(64, 210 - c) AS INT) AS w, CAST(least(64, 190 - r) AS INT) AS h FROM z, range(0, 210, 64) t(c), range(0, 190, 64) u(r) WHERE c1 > c0 AND r1 > r0 AND c + 64 > c0 AND c < c1 AND r + 64 > r0 AND r < r1""")
def blocks(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 300).cast("double") * 10 + 3, (k % 250).cast("double") * 10 + 7
    win = R.pixel_window(F.lit(500.0), F.lit(2600.0), F.lit(10.0), x, y, x + (k % 40) * 50 + 5, y + (k % 30) * 50 + 5, F.lit(210), F.lit(190))
    w = table(spark, sf_dir, "customer").select(k.alias("raster_id"), win.alias("win"), F.lit(210).alias("width"), F.lit(190).alias("height"))
    return R.blocks(w, 64)

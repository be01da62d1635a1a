"""Registry checks, resolution cases, reuse rules, sinks, streams, rasters and geometry on small tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geodesy as G, scalars as S
from tilewright.operators import library as L, rasters as Ra, resolve as R
from tilewright.sources import registry as Reg, sinks as K
from tilewright.streaming import feeds


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


BOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def test_shipped_registry_is_valid(spark):
    s, r = Reg.load_sources(spark), Reg.load_rules(spark)
    assert s.count() == 27 and r.count() == 14 and Reg.source_violations(s).count() == 0 and Reg.need_violations(Reg.rule_needs(r)).count() == 0
    assert Reg.check_keywords(r).where("compiles").count() == sum(len(x.keywords) for x in r.collect())


def resolve(spark, theme, temporal, start="2026-06-01", end="2026-09-15", b=(76, 13.5, 77, 15), iso3="IND", area=None, prefer=False, override=None):
    n = spark.createDataFrame([("q", theme, temporal, start, end, box(*b), iso3, area, prefer, override)],
                              f"request_id string, theme string, temporal string, start string, end string, box {BOX}, iso3 string, area_km2 double, prefer_cloud_independent boolean, override string")
    return R.resolve(n, Reg.load_sources(spark)).collect()[0]


def test_resolution_cases(spark):
    assert resolve(spark, "sar", "pair", prefer=True).chosen == "sentinel-1-rtc"
    assert resolve(spark, "vegetation", "series", override="sentinel-1-rtc").chosen == "sentinel-1-rtc"
    assert resolve(spark, "vegetation", "series", override="nothing").chosen == "sentinel-2-l2a"
    assert resolve(spark, "soil_moisture", "series").unmet == "none"
    assert resolve(spark, "vegetation", "series", "2025-01-01", "2025-12-31", (-60, -15, -50, -5), None, 8e6).chosen == "modis-ndvi-16day"
    assert resolve(spark, "surface_water", "series").unmet == "login"
    assert resolve(spark, "precipitation", "series", b=(10, 60, 20, 70)).unmet == "none"
    assert resolve(spark, "fire", "series", "2026-01-01", "2026-03-01").unmet == "outside period"
    # periods compare as text: a record that ends "2023" does not reach May 2023
    assert resolve(spark, "landcover", "series", "2023-05-01", "2023-06-01").chosen is None


def test_reuse_rules(spark, tmp_path):
    cols = f"path string, project string, source string, item string, asset string, epsg int, native_grid boolean, cover {BOX}, bytes bigint"
    lib = spark.createDataFrame([("f", "A", "s", "scene-7", "swir", 32643, True, box(0, 0, 10, 10), 100), ("g", "B", "s", "scene-8", "swir", 32643, False, box(0, 0, 10, 10), 100)], cols)
    inv = spark.createDataFrame([("f", 100), ("g", 100)], "path string, size bigint")
    need = lambda i, item="scene-7", asset="swir", b=(1, 3, 6, 7), epsg=32643, project="C": (i, "s", item, asset, box(*b), epsg, project)
    rows = [need("ok"), need("outside", b=(6, 1, 11, 4)), need("crs", epsg=32644), need("band", asset="blue"), need("own", project="A"), need("resampled", item="scene-8"), need("edge", b=(0, 0, 10, 10 + 1e-10))]
    n = spark.createDataFrame(rows, f"need_id string, source string, item string, asset string, box {BOX}, epsg int, project string")
    assert {r.need_id for r in L.reusable(n, lib, inv).collect()} == {"ok", "edge"}
    assert L.reusable(n, lib, inv.withColumn("size", F.lit(5).cast("bigint"))).count() == 0


def test_merge_keeps_earlier_assets(spark):
    schema = "item string, props map<string,string>, assets map<string,string>"
    old = spark.createDataFrame([("i", {"p": "1"}, {"a": "old", "b": "old"}), ("k", {}, {"a": "old"})], schema)
    new = spark.createDataFrame([("i", {"p": "2"}, {"b": "new", "c": "new"}), ("n", {}, {"z": "new"})], schema)
    got = {r.item: (r.props, r.assets) for r in K.merge_items(old, new).collect()}
    assert got == {"i": ({"p": "2"}, {"a": "old", "b": "new", "c": "new"}), "k": ({}, {"a": "old"}), "n": ({}, {"z": "new"})}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", "x"), ("r2", "y")], "request_id string, v string")
    K.save_documents(df, str(tmp_path / "req"), "request_id")
    K.save_documents(df.where("request_id = 'r1'").withColumn("v", F.lit("z")), str(tmp_path / "req"), "request_id")
    assert {(r.request_id, r.v) for r in spark.read.json(str(tmp_path / "req")).collect()} == {("r1", "z"), ("r2", "y")}
    K.append_log(df, str(tmp_path / "log")); K.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    K.upsert_partitions(df, str(tmp_path / "cat"), "request_id")
    K.upsert_partitions(df.where("request_id = 'r2'").withColumn("v", F.lit("w")), str(tmp_path / "cat"), "request_id")
    assert {r.v for r in spark.read.parquet(str(tmp_path / "cat")).collect()} == {"x", "w"}
    lines = spark.createDataFrame([("p", "1", i, f"line {i}") for i in range(20)], "report_id string, section string, line_no int, line string")
    K.write_lines(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted(text) == sorted(f"line {i}" for i in range(20))


def test_stream_equals_batch_over_several_files_and_replays(spark, tmp_path):
    rows = [(i, f"f{i % 7}", "failed" if i % 5 == 0 else "ok", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq int, path string, status string, v double")
    src = str(tmp_path / "in")
    df.where("seq < 30").coalesce(1).write.parquet(src)
    df.where("seq >= 30").coalesce(1).write.mode("append").parquet(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = lambda: feeds.read_stream(spark, src, df.schema, max_files=1)
    got = {r.path: r.seq for r in feeds.keep_library(stream(), out, cp).collect()}
    want = {}
    for s, p, st, _ in rows:
        if st == "ok":
            want[p] = max(want.get(p, -1), s)
    assert got == want
    # a second run has nothing new, and a replay with a fresh checkpoint overwrites the same batches
    assert {r.path: r.seq for r in feeds.keep_library(stream(), out, cp).collect()} == want
    assert {r.path: r.seq for r in feeds.keep_library(stream(), out, str(tmp_path / "cp2")).collect()} == want
    assert feeds.compact(spark, out, str(tmp_path / "compact")).count() == len(want)


def test_equal_area_and_zone_projection(spark):
    r = spark.range(1).select(G.equal_area_x(F.lit(180.0)).alias("x"), G.box_km2(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(20.0)).alias("a"),
                              G.utm_xy(F.lit(75.0), F.lit(0.0), F.lit(32643)).alias("o"), G.utm_xy(F.lit(78.0), F.lit(0.0), F.lit(32643)).alias("e"),
                              G.utm_xy(F.lit(77.0), F.lit(-33.0), F.lit(32743)).alias("s")).collect()[0]
    assert abs(r.x - 17367530.4452) < 1e-3
    e2, a = 0.0066943799901413165, 6378137.0
    strip = lambda lat: math.cos(lat) / (1 - e2 * math.sin(lat) ** 2) ** 2
    n = 20000
    lats = [math.radians(10 + 10 * (i + 0.5) / n) for i in range(n)]
    exact = a * a * (1 - e2) * math.radians(10) * math.radians(10) / n * sum(strip(x) for x in lats) / 1e6
    assert abs(r.a - exact) / exact < 1e-6
    assert abs(r.o.x - 500000) < 1e-6 and abs(r.o.y) < 1e-6 and abs(r.e.x - 833978.5569) < 1e-3
    # northing of a southern point: false northing less the scaled meridian arc, slightly more away from the axis
    assert 6_000_000 < r.s.y < 6_400_000 and 680_000 < r.s.x < 690_000


def test_raster_rules(spark):
    p = spark.createDataFrame([("m", 0, c, 1, 7 if c < 2 else 255) for c in range(4)] + [("m", 0, c, 2, 9 if c >= 1 and c != 3 else 255) for c in range(4)], "mosaic_id string, cy int, cx int, source_pos int, value int")
    assert [r.value for r in Ra.mosaic(p, F.lit(255)).orderBy("cx").collect()] == [7, 9, 9, 255]
    v = spark.createDataFrame([("a", i < 50, i < 50) for i in range(100)] + [("b", i < 50, False) for i in range(100)], "r string, valid boolean, inside boolean")
    assert {x.r: x.valid_fraction for x in Ra.valid_fraction(v, "r").collect()} == {"a": 1.0, "b": 0.5}
    z = spark.createDataFrame([(0, True), (0, False)], "value int, inside boolean")
    assert [r.value for r in Ra.mask_outside(z, F.col("inside"), F.lit(255)).collect()] == [0, 255]


def test_scalar_rules(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(S.safe_name(F.lit('tile<7>|north*.tif?v:2'))) == "tile_7__north_.tif_v_2"
    assert one(S.partial_date(F.lit("2019-02-03T11:05:00+02:00"))) == dt.date(2019, 2, 3) and one(S.partial_date(F.lit("ongoing"))) is None
    assert one(S.partial_date(F.lit("1998"))) == dt.date(1998, 1, 1)
    assert one(S.redact(F.lit("read of http://store/b/7.nc?key=abc&n=3 broke off"))) == "read of http://store/b/7.nc?… broke off"
    assert one(S.nodata_value(F.lit("uint8"), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 255.0
    assert one(S.nodata_value(F.lit("int16"), F.lit(0.0), F.lit(200.0))) == 0.0
    assert one(S.year_runs(F.lit([1996, 1990, 1995, 1991, 2001, 1997]))) == "1990–1991, 1995–1997, 2001"


@pytest.mark.parametrize("declared,code,want", [(25832, "EPSG:3035", 25832), (None, "EPSG:3035", 3035), (0, "epsg:3857", 3857), (0, "IAU:30100", None), (None, None, None)])
def test_epsg(spark, declared, code, want):
    r = spark.createDataFrame([(declared, code)], "n int, c string").select(S.epsg_code(F.col("n"), F.col("c"))).collect()[0][0]
    assert r == want


def test_items_published_late_are_kept(spark, tmp_path):
    """Three batches; the last brings an item dated months before, a repeat and a repeat within itself."""
    rows = [[("s", "a", "2024-05-01"), ("s", "b", "2024-05-02")], [("s", "c", "2024-06-20"), ("t", "a", "2024-06-21")], [("s", "late", "2024-01-03"), ("s", "a", "2024-05-01"), ("s", "d", "2024-06-22"), ("s", "d", "2024-06-22")]]
    src = str(tmp_path / "feed")
    schema = "source_id string, item_id string, dt string"
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        got = feeds.keep_new_items(feeds.read_stream(spark, src, spark.createDataFrame([], schema).schema, max_files=1), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted(map(tuple, got)) == sorted({r for b in rows for r in b})


def test_points_counted_in_areas_are_those_clipped(spark):
    from tilewright.sources import vectors as X
    ring = lambda *p: [dict(x=float(a), y=float(b)) for a, b in (*p, p[0])]
    areas = spark.createDataFrame([("l", ring((0, 0), (9, 0), (9, 3), (3, 3), (3, 8), (0, 8))), ("t", ring((-4.5, -1), (6, 2.5), (1, 7.2)))], "area_id string, ring array<struct<x:double,y:double>>")
    points = spark.range(4000).selectExpr("id AS key", "CAST((id * 7) % 163 AS DOUBLE) / 10 - 5 AS x", "CAST((id * 11) % 113 AS DOUBLE) / 10 - 2 AS y")
    pairs = X.clip_points(points, areas, 1.0).groupBy("area_id").agg(F.count("*").alias("n"), F.min("key").alias("k")).collect()
    assert sorted(map(tuple, X.count_points(points, areas, 1.0).collect())) == sorted(map(tuple, pairs)) and len(pairs) == 2


def test_item_table_prunes_and_moves_items(spark, tmp_path):
    from tilewright.sources import catalogue as C
    path = str(tmp_path / "items")
    rows = [("s/1", f"i{k}", dt.date(2024, 1 + k % 3, 5), 10.0, box(k, 0, k + 1, 1)) for k in range(9)] + [("t", "u", None, None, box(0, 0, 1, 1))]
    make = lambda r: spark.createDataFrame(r, f"source_id string, item_id string, d date, cloud_cover double, footprint {BOX}")
    K.write_items(make(rows), path)
    read = lambda: {(r.source_id, r.item_id): (r.month, r.cloud_cover) for r in K.read_items(spark, path).collect()}
    assert read()[("t", "u")] == ("undated", None) and len(read()) == 10
    # the only item of a month moves away, others change, one is new and comes twice
    gone = [("s/1", f"i{k}", dt.date(2025, 7, 1), 1.0, box(k, 0, k + 1, 1)) for k in (0, 3, 6)]
    K.upsert_items(make(gone + [("s/1", "new", dt.date(2024, 2, 1), 2.0, box(0, 0, 1, 1)), ("s/1", "new", dt.date(2024, 2, 2), 3.0, box(0, 0, 1, 1))]), path)
    now = read()
    assert len(now) == 11 and {now[("s/1", f"i{k}")] for k in (0, 3, 6)} == {("2025-07", 1.0)} and now[("s/1", "new")] == ("2024-02", 3.0)
    assert now[("s/1", "i1")] == ("2024-02", 10.0) and "2024-01" not in {m for m, _ in now.values()}
    K.upsert_items(make([]), path)
    assert read() == now
    hit = C.search_table(K.read_items(spark, path), "s/1", (4.0, 0.0, 9.0, 1.0), "2024-02-01", "2024-03-31")
    plan = hit._jdf.queryExecution().toString()
    assert sorted(r.item_id for r in hit.collect()) == ["i4", "i5", "i7", "i8"]
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "month" in filters.split("PushedFilters")[0] and "source_id" in filters.split("PushedFilters")[0] and "footprint.minx" in filters.split("PushedFilters")[1]

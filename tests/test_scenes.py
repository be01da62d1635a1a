"""Scene plans over blocks: against the single frame, against brute force over cell centres, and membership of thin footprints."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import polygons as P
from tilewright.plans import optical, scenes

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan(spark, items, areas, cell, side, **more):
    windows = frame(spark, [(a, "2024", "2024-01-01", "2024-12-31") for a in {a for a, _ in areas}], "aoi_id string, label string, s string, e string").select(
        "aoi_id", "label", F.col("s").cast("date").alias("w_start"), F.col("e").cast("date").alias("w_end"))
    i = frame(spark, items, f"item_id string, tile string, cloud_cover double, rings {RINGS}").withColumn("d", F.lit("2024-05-01").cast("date"))
    return scenes.plan_scenes(i, frame(spark, areas, f"aoi_id string, rings {RINGS}"), windows, cell, side, plane=True, **more)


@pytest.mark.parametrize("side", [5, 60])
def test_against_cell_centres(spark, side):
    """Polygons with holes and parts on both sides of the origin, areas of many blocks."""
    rng = random.Random(side)

    def shape(size):
        x, y, n = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randint(3, 7)
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(x + size * math.cos(t) * rng.uniform(0.5, 1), y + size * math.sin(t) * rng.uniform(0.5, 1)) for t in at]
        return ring + ring[:1]

    areas = [("a", [box(-25, -25, 25, 25), box(-5, -5, 5, 5)]), ("b", [shape(18)])]
    items = [(f"i{k}", f"t{k % 4}", float(k % 3) * 20, [shape(14)] + ([shape(4)] if k % 5 == 0 else [])) for k in range(24)]
    items.append(("thin", "t0", 10.0, [box(-20.0, 9.6, 20.0, 9.9)]))
    items.append(("hole", "t1", 10.0, [box(-4, -4, 4, 4)]))
    got = plan(spark, items, areas, 1.0, side)
    centres = [(x + 0.5, y + 0.5) for x in range(-60, 60) for y in range(-60, 60)]
    for aoi, rings in areas:
        own = {c for c in centres if inside(*c, rings)}
        cells = {i: {c for c in own if inside(*c, r)} for i, _, _, r in items}
        cand = {r.item_id: (r.tile, r.coverage) for r in got.candidates.where(F.col("aoi_id") == aoi).collect()}
        kept = {r.tile: (r.tile_cells, r.area_cells) for r in got.tiles.where(F.col("aoi_id") == aoi).collect()}
        assert {a for _, a in kept.values()} == {len(own)}
        for i, tile, _, _ in items:
            if tile in kept and cells[i]:
                assert cand[i] == (tile, pytest.approx(len(cells[i]) / kept[tile][0]))
        for tile, (n, _) in kept.items():
            assert n == len(set().union(*(cells[i] for i, t, _, _ in items if t == tile)))
        report = got.reports.where(F.col("aoi_id") == aoi).first()
        chosen = [r.item_id for r in got.selections.where((F.col("aoi_id") == aoi) & F.col("item_id").isNotNull()).collect()]
        assert report.observed == pytest.approx(len(set().union(*(cells[i] for i in chosen))) / len(own))
        if aoi == "a":
            assert cand["thin"][1] == 0 and "hole" not in cand


def test_same_as_one_frame(spark):
    rng = random.Random(7)
    boxes = [(rng.randint(-3, 16), rng.randint(-3, 16)) for _ in range(40)]
    items = [(f"i{k}", f"t{k % 5}", float(rng.randint(0, 100)), [box(x, y, x + 6, y + 6)]) for k, (x, y) in enumerate(boxes)]
    many = plan(spark, items, [("a", [box(0, 0, 20, 20)])], 1.0, 7)
    one = plan(spark, items, [("a", [box(0, 0, 20, 20)])], 1.0, 20)
    for name in ("reports", "candidates", "composites"):
        rows = [sorted(map(str, getattr(p, name).drop("words").collect())) for p in (many, one)]
        assert rows[0] == rows[1] and rows[0]


def test_longitudes_nulls_and_empty_tables(spark):
    items = [("a", "t", None, [box(76, 13, 77, 14)]), ("b", None, 1.0, [box(76, 13, 77, 14)]), ("c", "t", 1.0, None), ("d", "t", 5.0, [box(100, 1, 101, 2)])]
    i = frame(spark, items, f"item_id string, tile string, cloud_cover double, rings {RINGS}").withColumn("d", F.lit("2024-05-01").cast("date"))
    a = frame(spark, [("x", [box(76.2, 13.2, 78, 14.8)]), ("y", None)], f"aoi_id string, rings {RINGS}")
    w = spark.sql("SELECT 'x' AS aoi_id, 'm' AS label, DATE'2024-05-01' AS w_start, DATE'2024-05-31' AS w_end")
    got = scenes.plan_scenes(i, a, w, 1000.0)
    row = got.candidates.first()
    assert (row.item_id, row.cloud, got.candidates.count()) == ("a", 100.0, 1)
    share = got.reports.first().observed
    sin = lambda d: math.sin(math.radians(d))
    assert share == pytest.approx(0.8 * (sin(14) - sin(13.2)) / (1.8 * (sin(14.8) - sin(13.2))), rel=0.01)
    assert scenes.plan_scenes(i.limit(0), a, w, 1000.0).candidates.count() == 0
    with pytest.raises(ValueError):
        scenes.plan_scenes(i, a, w, 1000.0, side=64)


def test_plan_from_catalogue_features(spark):
    """From feature JSON to a plan: sources apart, parts and holes of multipolygons, items without group left out."""
    from tilewright.sources import catalogue, registry
    def feature(k, group, geometry):
        return json.dumps({"id": f"S{k}", "geometry": geometry, "assets": {}, "properties": {"datetime": f"2024-05-{k + 1:02d}T10:00:00Z", "eo:cloud_cover": str(10 * k), **({"grid:code": group} if group else {})}})
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    rows = [("sentinel-2-l2a", feature(0, "MGRS-1", {"type": "Polygon", "coordinates": [square(76.0, 13.0, 1.0)]})),
            ("sentinel-2-l2a", feature(1, "MGRS-1", {"type": "MultiPolygon", "coordinates": [[square(76.0, 13.0, 0.2)], [square(90.0, 1.0, 1.0)]]})),
            ("sentinel-2-l2a", feature(2, None, {"type": "Polygon", "coordinates": [square(76.0, 13.0, 1.0)]})),
            ("sentinel-2-l2a", feature(3, "MGRS-1", {"type": "Polygon", "coordinates": [square(75.0, 12.0, 3.0), square(75.9, 12.9, 1.3)]})),
            ("landsat-c2-l2", feature(4, "MGRS-1", {"type": "Polygon", "coordinates": [square(76.0, 13.0, 1.0)]}))]
    items = catalogue.normalise(catalogue.parse_features(frame(spark, rows, "source_id string, js string"), "js"), registry.load_sources(spark))
    areas = frame(spark, [("sentinel-2-l2a", "x", [box(76, 13, 77, 14)])], f"source_id string, aoi_id string, rings {RINGS}")
    windows = spark.sql("SELECT 'x' AS aoi_id, '2024-05' AS label, DATE'2024-05-01' AS w_start, DATE'2024-05-31' AS w_end")
    got = scenes.plan_catalogue(items, areas, windows, 500.0)
    cand = {r.item_id: r for r in got.candidates.collect()}
    assert sorted(cand) == ["S0", "S1"] and cand["S0"].coverage == 1 and cand["S1"].coverage == pytest.approx(0.04, rel=0.05)
    assert got.selections.first().item_id == "S0" and got.reports.first().verdict == "feasible-single"


def test_rings_meet(spark):
    cases = [([box(0, 0, 2, 2)], [box(1, 1, 3, 3)], True), ([box(0, 0, 2, 2)], [box(2, 0, 3, 1)], True), ([box(0, 0, 2, 2)], [box(2.01, 0, 3, 1)], False),
             ([box(0, 0, 9, 9)], [box(4, 4, 5, 5)], True), ([box(0, 0, 9, 9), box(3, 3, 6, 6)], [box(4, 4, 5, 5)], False),
             ([box(0, 0, 9, 9), box(3, 3, 6, 6)], [box(4, 4, 7, 5)], True), ([box(0, 4, 9, 5)], [box(4, 0, 5, 9)], True),
             ([[(0.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]], [[(2.0, 0.0), (4.0, 0.0), (4.0, 1.9), (2.0, 0.0)]], False)]
    df = frame(spark, [(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {RINGS}, b {RINGS}")
    for x, y in (("a", "b"), ("b", "a")):
        assert [r.m for r in df.select("k", P.rings_meet(F.col(x), F.col(y)).alias("m")).orderBy("k").collect()] == [m for _, _, m in cases]


def test_full_clear_border_block_takes_one_scene(spark):
    """Any number of full-clear scenes: the composite orders no more of them than there are slices."""
    rows = [("a", "w", "t", f"i{k:04d}", 0.0, 0.0, 1.0, 1.0, 1000, False) for k in range(3000)]
    cand = frame(spark, rows, "aoi_id string, label string, tile string, item_id string, cloud_cover double, cloud double, coverage double, clear double, bucket int, held boolean").withColumn(
        "d", F.lit("2024-05-01").cast("date")).withColumn("words", F.array(F.lit(1).cast("bigint")))
    assert [r.item_id for r in optical.composites(cand).collect()] == ["i0000"]

"""Lines and polygons cut to areas, against scan lines over every strip between vertices and crossings."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import overlay as O
from tilewright.sources import vectors as X

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def star(rng, x, y, r, n):
    """A closed ring around (x, y), in either direction."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + s * math.cos(t), y + s * math.sin(t)) for t in turns for s in [r * rng.uniform(0.4, 1)]]
    ring = ring if rng.random() < 0.5 else ring[::-1]
    return [*ring, ring[0]]


def shape(rng, x, y, r):
    """Two parts, the first with a hole; rings of one shape do not cross."""
    outer = [(x + r * math.cos(k * math.pi / 6) * (1 if k % 2 else 0.9), y + r * math.sin(k * math.pi / 6)) for k in range(12)]
    return [[[*outer, outer[0]], star(rng, x, y, 0.7 * r, 7)], [star(rng, x + 3.5 * r, y, r, 9)]]


def edges(parts):
    return [(a, b) for part in parts for ring in part for a, b in zip(ring, ring[1:])]


def inside(parts, y):
    """Stretches of the line at height y inside the shape."""
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges(parts) if (a[1] > y) != (b[1] > y))
    return list(zip(xs[::2], xs[1::2]))


def crossing(e, f):
    (a, b), (c, d) = e, f
    turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if turn == 0:
        return None
    t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / turn
    u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / turn
    return t if 0 <= t <= 1 and 0 <= u <= 1 else None


def shared(a, b):
    ys = {p[1] for e in edges(a) + edges(b) for p in e}
    ys |= {e[0][1] + t * (e[1][1] - e[0][1]) for e, f in itertools.product(edges(a), edges(b)) if (t := crossing(e, f)) is not None}
    ys = sorted(ys)
    total = 0.0
    for lo, hi in zip(ys, ys[1:]):
        m = (lo + hi) / 2
        total += (hi - lo) * sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in inside(a, m) for q in inside(b, m))
    return total


def length_in(line, parts):
    total = 0.0
    for e in zip(line, line[1:]):
        ts = sorted({0.0, 1.0, *(t for f in edges(parts) if (t := crossing(e, f)) is not None)})
        for lo, hi in zip(ts, ts[1:]):
            m = (lo + hi) / 2
            x, y = (e[0][i] + m * (e[1][i] - e[0][i]) for i in (0, 1))
            if any(p <= x < q for p, q in inside(parts, y)):
                total += (hi - lo) * math.dist(*e)
    return total


def frame(spark, key, shapes):
    return spark.createDataFrame(list(shapes.items()), f"{key} long, parts {PARTS}")


@pytest.mark.parametrize("cell", [0.8, 30.0])
def test_against_scan_lines(spark, cell):
    rng = random.Random(11)
    features = {i: shape(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.3, 3)) for i in range(12)}
    areas = {i: shape(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(1, 4)) for i in range(5)}
    borders = O.clip_polygons(frame(spark, "feature_id", features), frame(spark, "area_id", areas), cell).cache()
    got = {(r.feature_id, r.area_id): r.shared for r in O.shared_areas(borders).collect()}
    want = {(i, j): s for i, f in features.items() for j, a in areas.items() if (s := shared(f, a)) > 1e-7}
    assert {k for k, v in got.items() if v > 1e-7} == set(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    # rings of the results hold the same surface
    sums = {}
    for r in O.clipped_rings(borders).collect():
        assert r.points[0] == r.points[-1]
        sums[r.feature_id, r.area_id] = sums.get((r.feature_id, r.area_id), 0) + sum(p.x * q.y - q.x * p.y for p, q in zip(r.points, r.points[1:])) / 2
    assert all(abs(sums[k] - v) < 1e-5 for k, v in want.items())
    lines = {i: [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(6)] for i in range(9)}
    df = spark.createDataFrame(list(lines.items()), "feature_id long, line array<struct<x:double,y:double>>")
    pieces = O.clip_lines(df, frame(spark, "area_id", areas), cell)
    lengths = {(r.feature_id, r.area_id): r.n for r in pieces.groupBy("feature_id", "area_id").agg(F.sum(F.hypot(F.expr("bx - ax"), F.expr("by - ay"))).alias("n")).collect()}
    known = {(i, j): s for i, f in lines.items() for j, a in areas.items() if (s := length_in(f, a)) > 1e-7}
    assert {k for k, v in lengths.items() if v > 1e-7} == set(known) and all(abs(lengths[k] - v) < 1e-6 for k, v in known.items())
    # stretches go on across squares: as many as without squares
    assert pieces.count() == O.clip_lines(df, frame(spark, "area_id", areas), 100.0).count()


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def test_shared_borders(spark):
    whole, hole = [[box(0, 0, 4, 4)]], [[box(0, 0, 4, 4), box(1, 1, 3, 3)]]
    features = frame(spark, "feature_id", {1: whole, 2: hole, 3: [[box(1, 1, 3, 3)]], 4: [[box(4, 0, 6, 4)]], 5: [[box(0, 0, 4, 2)], [box(4, 2, 5, 3)]]})
    got = {(r.feature_id, r.area_id): r.shared for r in O.shared_areas(O.clip_polygons(features, frame(spark, "area_id", {1: whole, 2: hole}), 1.0)).collect()}
    want = {(1, 1): 16, (1, 2): 12, (2, 1): 12, (2, 2): 12, (3, 1): 4, (3, 2): 0, (4, 1): 0, (4, 2): 0, (5, 1): 8, (5, 2): 6}
    assert set(got) <= set(want) and all(abs(got.get(k, 0) - v) < 1e-6 for k, v in want.items())


def test_no_geometry_and_empty_tables(spark):
    features = frame(spark, "feature_id", {1: None, 2: [], 3: [[]], 4: [[box(0, 0, 2, 2)]], 5: [[[(1.0, 1.0)]]]})
    areas = frame(spark, "area_id", {1: None, 2: [], 3: [[box(1, 1, 3, 3)]], 4: [[[]]]})
    got = {(r.feature_id, r.area_id): round(r.shared, 6) for r in O.shared_areas(O.clip_polygons(features, areas, 1.0)).collect()}
    assert got == {(4, 3): 1.0}
    lines = spark.createDataFrame([(1, None), (2, []), (3, [(1.5, 1.5)]), (4, [(1.5, 0.0), (1.5, 0.0), (1.5, 5.0)])], "feature_id long, line array<struct<x:double,y:double>>")
    assert [(r.feature_id, r.segment, r.ay, r.by) for r in O.clip_lines(lines, areas, 1.0).collect()] == [(4, 1, 1.0, 3.0)]
    assert O.clip_lines(lines.limit(0), areas, 1.0).count() == O.clip_polygons(features, areas.limit(0), 1.0).count() == 0


def test_collections_keep_parts_and_points_know_holes(spark, tmp_path):
    parts = [[box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(6, 0, 7, 1)]]
    doc = {"features": [{"properties": {"n": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": parts}},
                        {"properties": {"n": "b"}, "geometry": {"type": "Polygon", "coordinates": parts[0]}},
                        {"properties": {"n": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = {r.properties["n"]: r for r in X.read_collection(spark, str(tmp_path)).collect()}
    assert [[[tuple(p) for p in ring] for ring in part] for part in got["a"].parts] == parts
    assert len(got["b"].parts) == 1 and len(got["b"].parts[0]) == 2 and got["c"].parts is None
    areas = frame(spark, "area_id", {1: parts}).select("area_id", F.flatten("parts").alias("rings"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 6.5, 0.5), (4, 5.0, 0.5)], "key long, x double, y double")
    assert sorted(r.key for r in X.clip_points(points, areas, 1.0).collect()) == [1, 3]
    assert [(r.n, r.first_key) for r in X.count_points(points, areas, 1.0).collect()] == [(2, 1)]


def test_long_borders_repeated_ids_and_skew(spark):
    """Shapes of many edges, ids that come twice or are null, and a crowd in one square: whole, and no join puts out a row per pair."""
    from test_scale import joined_rows
    from tilewright.operators import blocks as K
    rng = random.Random(5)
    round_ = lambda x, y, r, n: [[[(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in [*range(n), 0]]]]
    crowd = [(k, [[box(x, y, x + 1.5, y + 1)]]) for k in range(300) for x, y in [(rng.uniform(0, 5), rng.uniform(0, 5))]]
    features = [*crowd, (0, [[box(1, 1, 2, 2)]]), (None, [[box(2, 2, 3, 3.5)]]), (900, round_(2, 2, 1.7, K.LONG + 9))]
    framed = lambda x, y: [[box(x, y, x + 2, y + 2), box(x + 0.5, y + 0.5, x + 1.5, y + 1.7)], [box(x + 3, y, x + 4, y + 1)]]
    areas = [*((k, framed(rng.uniform(-2, 4), rng.uniform(-1, 4))) for k in range(40)), (7, [[box(0, 0, 3, 3)]]), (800, round_(3, 2, 1.9, K.LONG + 1))]
    want = {}
    for i, f in features:
        for j, a in areas:
            if max(len(r) for s in (f, a) for part in s for r in part) < 100 and (s := shared(f, a)) > 1e-7:
                want[i, j] = want.get((i, j), 0) + s
    table = lambda key, rows: spark.createDataFrame(rows, f"{key} long, parts {PARTS}")
    out = O.shared_areas(O.clip_polygons(table("feature_id", features), table("area_id", areas), 1.0))
    rows = out.collect()
    got = {(r.feature_id, r.area_id): r.shared for r in rows if r.shared > 1e-7}
    assert len({(r.feature_id, r.area_id) for r in rows}) == len(rows)
    few = {k: v for k, v in got.items() if k[0] != 900 and k[1] != 800}
    assert set(few) == set(want) and all(abs(few[k] - v) < 1e-6 for k, v in want.items())
    # two near circles share a lens; a box wholly inside one shares all of itself
    d, r, q = 1.0, 1.7, 1.9
    lens = r * r * math.acos((d * d + r * r - q * q) / (2 * d * r)) + q * q * math.acos((d * d + q * q - r * r) / (2 * d * q)) - math.sqrt((r + q - d) * (d + r - q) * (d - r + q) * (d + r + q)) / 2
    assert abs(got[900, 800] - lens) < 1e-3 and abs(got[None, 800] - shared(features[301][1], round_(3, 2, 1.9, K.LONG + 1))) < 1e-6
    # the same polygon, area or line twice is one
    twice = O.shared_areas(O.clip_polygons(table("feature_id", [crowd[0], *crowd]), table("area_id", [*areas[:3], areas[1]]), 1.0))
    once = {k: v for k, v in want.items() if k[0] not in (0, None) and k[1] < 3} | {(0, k): s for k in range(3) if (s := shared(crowd[0][1], areas[k][1])) > 1e-7}
    held = {(r.feature_id, r.area_id): r.shared for r in twice.collect() if r.shared > 1e-7}
    assert set(held) == set(once) and all(abs(held[k] - v) < 1e-6 for k, v in once.items())
    line = spark.createDataFrame([(1, [(-9.0, 1.1), (9.0, 1.1)])] * 2, "feature_id long, line array<struct<x:double,y:double>>")
    cuts = [{r.area_id: round(r.n, 6) for r in O.clip_lines(line, table("area_id", a), 1.0).groupBy("area_id").agg(F.sum(F.expr("bx - ax")).alias("n")).collect()}
            for a in (areas[:20], areas[:20] * 2)]
    assert cuts[0] == cuts[1] and cuts[0]
    plain = O.shared_areas(O.clip_polygons(table("feature_id", crowd), table("area_id", areas[:40]), 1.0))
    assert plain.count() > 1000 and joined_rows(plain) < 100
    lines = spark.createDataFrame([(k, [(float(x), 0.0), (float(x), 5.0)]) for k, x in enumerate([rng.uniform(0, 5) for _ in range(300)])], "feature_id long, line array<struct<x:double,y:double>>")
    pieces = O.clip_lines(lines, table("area_id", areas[:40]), 1.0)
    assert pieces.count() > 1000 and joined_rows(pieces) < 100


def test_points_meet_areas_in_blocks(spark):
    """Crowded and lone places, points without a key, areas that come twice and one with a long border: all counted, and no join puts out a row per pair."""
    from test_scale import joined_rows
    from tilewright.operators import blocks as K
    rng = random.Random(3)
    points = [(k if k % 9 else None, rng.randint(0, 90) / 10 + 0.03, rng.randint(0, 90) / 10 + 0.07) for k in range(6000)]
    points += [(k, rng.uniform(20, 60), rng.uniform(20, 60)) for k in range(400)] + [(None, 80.5, 80.5), (5, None, 1.0)]
    holed = lambda x, y, r: [[(x - r, y - r), (x + r, y - 0.5 * r), (x + r, y + r), (x, y + 0.2), (x - r, y + r), (x - r, y - r)], box(x - 0.4 * r, y - 0.3 * r, x, y)]
    areas = [(k, holed(rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0.2, 5))) for k in range(60)] + [(100 + k, holed(rng.uniform(20, 60), rng.uniform(20, 60), rng.uniform(1, 9))) for k in range(40)]
    areas += [(3, [box(1, 1, 2, 2)]), (None, [box(80, 80, 81, 81)]), (500, None),
              (501, [[(4 + 3 * math.cos(2 * math.pi * k / 600), 4 + 3 * math.sin(2 * math.pi * k / 600)) for k in [*range(600), 0]]])]
    p = spark.createDataFrame(points, "key long, x double, y double")
    a = spark.createDataFrame(areas, "area_id long, rings array<array<struct<x:double,y:double>>>")
    want = {}
    for k, rings in areas:
        own = [[*zip(r, r[1:])] for r in rings or []]
        for key, x, y in points:
            if x is not None and sum((u[1] > y) != (v[1] > y) and x < (v[0] - u[0]) * (y - u[1]) / (v[1] - u[1]) + u[0] for r in own for u, v in r) % 2:
                n, least = want.get(k, (0, None))
                want[k] = n + 1, min((v for v in (key, least) if v is not None), default=None)
    out = X.count_points(p, a, 1.0)
    assert {r.area_id: (r.n, r.first_key) for r in out.collect()} == want and 501 in want and want[None] == (1, None)
    assert joined_rows(X.count_points(p, a.where("size(rings[0]) < 99"), 1.0)) < K.LONG

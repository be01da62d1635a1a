"""Steps that must not make a row per pair of inputs: their results on repeated rows, and the rows that their joins put out."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from tilewright import session
from tilewright.functions import scalars as S
from tilewright.operators import library as B, overlay as O, windows as D
from tilewright.plans import optical, scenes
from tilewright.sources import catalogue as C, registry as R, vectors as X

DAY = dt.date(2024, 1, 1)


def joined_rows(df):
    """Most rows that one join of the plan puts out, after the query ran."""
    df.collect()
    out, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name.endswith("JoinExec"):
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return max(out)


def box(x, y, w, h):
    return (float(x), float(y), float(x + w), float(y + h))


BOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def touching(a, b):
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


def test_totals_over_areas(spark):
    files = [(f"p{i}", i % 3 or None, "s", box(i % 5 * 4, i % 4 * 3, 4, 4), DAY + dt.timedelta(i % 9), i if i % 7 else None) for i in range(200)]
    files.append(("none", 1, "s", None, DAY, 5))
    # areas 1 and 2 have the same box, 3 has two, 4 has one twice, 5 and the nameless one none that meets a file
    areas = [(1, box(3, 3, 2, 2)), (2, box(3, 3, 2, 2)), (3, box(0, 0, 1, 1)), (3, box(9, 9, 1, 1)), (4, box(7, 2, 9, 1)), (4, box(7, 2, 9, 1)), (5, box(90, 90, 1, 1)), (6, None), (None, box(3, 3, 2, 2))]
    f = spark.createDataFrame(files, f"path string, project int, source string, cover {BOX}, d date, bytes long")
    a = spark.createDataFrame(areas, f"area_id int, box {BOX}")
    met = [(k, p) for k, b in areas for p in files if b and p[3] and touching(b, p[3])]
    total = lambda rows: sum(r[5] for r in rows if r[5] is not None)
    want = {}
    for k, p in met:
        want.setdefault(k, []).append(p)
    got = B.totals_over(f, a, 8.0, ["files", "bytes", "first_path"]).collect()
    assert {r.area_id: (r.files, r.bytes, r.first_path) for r in got} == {k: (len(v), total(v), min(p[0] for p in v)) for k, v in want.items()}
    assert len(got) == len(want)
    by = {}
    for k, p in met:
        if p[1] is not None and p[1] != 2:
            by.setdefault((k, p[2], p[1]), []).append(p)
    there = B.here(f, a, 8.0, F.lit(2)).collect()
    assert {(r.area_id, r.source, r.project): (r.files, r.bytes, r.first_date, r.last_date) for r in there} == {
        k: (len(v), total(v), min(p[4] for p in v), max(p[4] for p in v)) for k, v in by.items()}
    assert len(there) == len(by)


def test_totals_over_areas_make_no_pairs(spark):
    f = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("path"), (F.col("id") % 2).alias("project"), F.lit("s").alias("source"), F.lit(DAY).alias("d"), F.col("id").alias("bytes"),
                                 F.struct(*[F.lit(v).alias(n) for v, n in zip(box(0, 0, 4, 4), ("minx", "miny", "maxx", "maxy"))]).alias("cover"))
    a = spark.range(1000).select(F.col("id").alias("area_id"), F.struct(*[F.lit(v).alias(n) for v, n in zip(box(1, 1, 1, 1), ("minx", "miny", "maxx", "maxy"))]).alias("box"))
    assert joined_rows(B.totals_over(f, a, 8.0, ["files", "bytes", "first_path"])) <= 2000
    assert joined_rows(B.here(f, a, 8.0, F.lit(1))) <= 2000


def test_nearest_hazard_of_repeated_places(spark):
    hazards = [(c, i, f"h{i}", DAY + dt.timedelta(i % 4), i % 6 * 0.7, i % 5 * 0.9) for i, c in zip(range(240), itertools.cycle(("FL", "TC", None)))]
    areas = [(i % 9, i % 4 * 1.1, i % 3 * 1.3, "FL" if i % 2 else "TC", DAY, DAY + dt.timedelta(2)) for i in range(20)] + [(99, 50.0, 50.0, "FL", DAY, DAY)]
    h = spark.createDataFrame(hazards, "code string, hazard_id long, hazard_name string, hazard_start date, lon double, lat double")
    a = spark.createDataFrame(areas, "area_id int, cx double, cy double, code string, start date, end date")
    want = {}
    for k, x, y, c, s, e in areas:
        for hc, i, name, day, lon, lat in hazards:
            dist = ((lon - x) ** 2 + (lat - y) ** 2) ** 0.5
            if hc == c and s <= day <= e and dist <= 3.0:
                want.setdefault(k, []).append((round(dist, 2), i, name, day))
    got = D.nearest_hazard(a, h)
    assert {r[0]: (tuple(r[1:5]), r[5]) for r in got.collect()} == {k: (min(v), len(v)) for k, v in want.items()}
    many = spark.range(1500).selectExpr("'FL' AS code", "id AS hazard_id", "concat('h', id) AS hazard_name", "DATE '2024-01-01' AS hazard_start", "1.0D AS lon", "1.0D AS lat")
    asked = spark.range(1500).selectExpr("id AS area_id", "0.5D AS cx", "0.5D AS cy", "'FL' AS code", "DATE '2024-01-01' AS start", "DATE '2024-01-02' AS end")
    assert joined_rows(D.nearest_hazard(asked, many)) <= 1500


def test_counted_hits_of_repeated_searches(spark):
    items = [(f"i{i}", "a" if i % 3 else "b", box(i % 7 * 5, i % 4 * 6, 3, 3), DAY + dt.timedelta(i % 40) if i % 11 else None) for i in range(150)]
    asked = [(i % 17, "a" if i % 2 else "b", box(i % 3 * 9, i % 5 * 4, 11, 8), DAY + dt.timedelta(i % 9) if i % 4 else None, DAY + dt.timedelta(33) if i % 6 else None) for i in range(30)]
    asked.append((77, "a", box(500, 500, 1, 1), None, None))
    i = spark.createDataFrame(items, f"item_id string, source_id string, footprint {BOX}, d date")
    r = spark.createDataFrame(asked, f"request_id int, source_id string, box {BOX}, start date, end date")
    want = {}
    for k, s, b, start, end in asked:
        n = sum(x[1] == s and touching(x[2], b) and (start is None or end is None or (x[3] is not None and start <= x[3] <= end)) for x in items)
        if n:
            want[k] = want.get(k, 0) + n
    assert {x.request_id: x.n_items for x in C.count_all(i, r).collect()} == want
    assert C.search_all(i, r).count() == sum(want.values())
    same = spark.range(1500).selectExpr("id AS request_id", "'a' AS source_id", "named_struct('minx', 0D, 'miny', 0D, 'maxx', 5D, 'maxy', 5D) AS box", "DATE '2024-01-01' AS start", "CAST(NULL AS DATE) AS end")
    alike = spark.range(1500).selectExpr("id AS item_id", "'a' AS source_id", "named_struct('minx', 1D, 'miny', 1D, 'maxx', 2D, 'maxy', 2D) AS footprint", "DATE '2024-01-01' AS d")
    assert joined_rows(C.size_guard(C.count_all(alike, same), 5)) <= 1500


def test_squares_of_areas_are_not_broadcast(spark):
    p = spark.range(400).selectExpr("id AS key", "id % 20 + 0.5D AS x", "id div 20 + 0.5D AS y")
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    a = spark.createDataFrame([(k, [(x + k, y) for x, y in ring]) for k in range(5)], "area_id int, ring array<struct<x:double,y:double>>")
    got = X.count_points(p, a, 1.0)
    assert {(r.area_id, r.n, r.first_key) for r in got.collect()} == {(k, 100, k) for k in range(5)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_squares_of_cut_areas_are_not_broadcast(spark):
    square = [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)]]
    areas = spark.createDataFrame([(k, [square]) for k in range(3)], "area_id long, parts array<array<array<struct<x:double,y:double>>>>")
    lines = spark.createDataFrame([(k, [(-1.0, k + 0.5), (3.0, k + 0.5)]) for k in range(9)], "feature_id long, line array<struct<x:double,y:double>>")
    got = O.clip_lines(lines, areas, 2.0)
    assert {(r.feature_id, r.area_id, r.ax, r.bx) for r in got.collect()} == {(k, a, 0.0, 3.0) for k in range(6) for a in range(3)}
    boxes = areas.withColumnRenamed("area_id", "feature_id")
    for cut in (got, O.clip_polygons(boxes, areas, 2.0)):
        assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString()


def test_sources_meet_requests_without_a_shuffle(spark):
    met = spark.range(100).selectExpr("id", "IF(id % 4 = 0, 'sentinel-1-rtc', 'sentinel-2-l2a') AS source").join(R.load_sources(spark).withColumnRenamed("id", "source"), "source")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 100 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_best_scene_orders_only_leading_scenes(spark):
    clouds = [0.0, 100.0, 12.5, 12.500001, 12.5000011, 33.3, -4.0, 250.0]
    # tile 0 has every kind of cloud, tile 1 none below 100, tile 2 values between two steps, tile 3 clear fractions beyond any footprint's
    rows = [("a", "m", t, f"i{k * 7 % 900:03}", DAY + dt.timedelta(k * 5 % 40), clouds[k % 8] if t == 0 else 100.0 if t == 1 else 12.5 + (k * 3 % 50) * 1e-6, 0.5, 0.4,
             k % 3 * 500 if t < 2 else 400 if t == 2 else 3000 - k % 7 * 999, k % 4 == 0, [k]) for t in range(4) for k in range(900)]
    names = ["aoi_id", "label", "tile", "item_id", "d", "cloud", "coverage", "clear", "bucket", "held", "words"]
    cand = spark.createDataFrame(rows, "aoi_id string, label string, tile int, item_id string, d date, cloud double, coverage double, clear double, bucket int, held boolean, words array<bigint>")
    best = optical.best_per_tile(cand)
    got = {r.tile: (r.item_id, r.d, r.cloud, r.words, r.n_candidates) for r in best.collect()}
    for t in range(4):
        own = [dict(zip(names, r)) for r in rows if r[2] == t]
        b = min(own, key=lambda r: (-r["bucket"], not r["held"], r["cloud"], r["d"], r["item_id"]))
        assert got[t] == (b["item_id"], b["d"], b["cloud"], b["words"], 900)
    assert 0 < joined_rows(optical.best_per_tile(cand.where("tile < 2"))) < 100


def test_words_of_blocks_are_worked_out_once(spark):
    rows = spark.range(4).selectExpr("id AS item_id", "array(array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ((0, 0), (9, 0), (9, 9), (0, 9), (0, 0))) + ")) AS rings")
    cut = scenes.blocks(scenes.placed(rows, plane=True), 1.0, 8)
    assert {(r.item_id, r.bx, r.by, r.words[0]) for r in cut.collect()} == {(i, x, y, 255 if x == 0 else 1) for i in range(4) for x in (0, 1) for y in (0, 1)}
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" :+-").startswith("Filter") and "bit_count" in line for line in plan.splitlines())


def test_tasks_after_a_shuffle_read_little(spark):
    session.configure(spark, session.SMALL_READS)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_slug_patterns_are_short(spark):
    texts = ["Straße ½ Maß", "ﬁne Œuvre Ĳssel", "ÉCOLE naïve — “quoted”", "plain words", "日本 ㎏ 𝐀𝐁", "", None, "--"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.slug(F.col("t"))).collect()]
    import re
    import unicodedata
    fold = lambda t: re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("-") or "project"
    assert got == [fold(t) if t is not None else "project" for t in texts]
    assert len(S._EXPANDED) < 16 * len(S._EXPAND) / 2


def test_totals_carry_numbered_questions(spark):
    f = spark.range(300).selectExpr("id % 7 AS project", "'s' AS source", "named_struct('minx', CAST(id % 9 AS DOUBLE), 'miny', 0D, 'maxx', id % 9 + 1D, 'maxy', 1D) AS cover", "DATE '2024-01-01' AS d", "id AS bytes")
    a = spark.range(40).selectExpr("id AS area_id", "named_struct('minx', id % 4 + 0.5D, 'miny', 0D, 'maxx', id % 4 + 0.6D, 'maxy', 1D) AS box")
    out = B.here(f, a, 8.0, F.lit(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in line and "boxes" in line for line in plan.splitlines())
    got = {(r.area_id, r.project): (r.files, r.bytes) for r in out.collect()}
    for k in range(40):
        for p in (0, 1, 2, 4, 5, 6):
            own = [i for i in range(300) if i % 7 == p and i % 9 == k % 4]
            assert got[k, p] == (len(own), sum(own))
    assert len(got) == 240


def test_items_are_dealt_before_they_meet_searches(spark):
    i = spark.range(900).coalesce(1).selectExpr("id AS item_id", "'a' AS source_id", "named_struct('minx', 1D, 'miny', 1D, 'maxx', 2D, 'maxy', 2D) AS footprint", "DATE '2024-01-01' AS d")
    r = spark.range(20).selectExpr("id AS request_id", "'a' AS source_id", "named_struct('minx', 0D, 'miny', 0D, 'maxx', 5D, 'maxy', 5D) AS box", "IF(id % 2 = 0, DATE '2024-01-01', NULL) AS start", "DATE '2024-01-02' AS end")
    found = C.search_all(i, r.hint("broadcast"))
    assert found.count() == 18000
    # one file of items, but more than one task makes the hits
    assert C.search_all(i, r).select(F.spark_partition_id()).distinct().count() > 1

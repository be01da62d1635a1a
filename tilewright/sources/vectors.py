"""Vector features: GeoJSON collections, map elements, hazard feeds and areas of interest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright import vocab as V
from tilewright.functions import bitgrid as B, geodesy as G, polygons as P
from tilewright.operators import blocks as K

SQUARES = 8  # squares of the grid to a side of those in which places and whole areas meet
RING = "array<struct<x:double,y:double>>"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and MultiPolygon features of GeoJSON collections, one row per feature, attributes as a map; `rings` holds all
    rings, `ring` the first, `parts` the rings of each part."""
    schema = """features ARRAY<STRUCT<properties:MAP<STRING,STRING>,geometry:STRUCT<type:STRING,coordinates:STRING>>>"""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    rings = P.rings_of(F.col("geometry_type"), F.col("c"))
    parts = P.parts_of(F.col("geometry_type"), F.col("c"))
    return f.select("properties", "geometry_type", rings.alias("rings"), parts.alias("parts")).withColumn("ring", F.get("rings", F.lit(0)))


def to_ring(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))


def map_elements(elements: DataFrame, geometry: str) -> DataFrame:
    """Map elements -> features of one geometry type, with the kept tags.

    elements: type, id, lat, lon, center STRUCT<lat,lon>, tags MAP, geometry ARRAY<STRUCT<lat,lon>>.
    Points take the element's own position or its centre; lines need two vertices; polygons four and closure.
    """
    tags = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*V.OSM_TAGS)).alias("tags")
    if geometry == "point":
        own = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))
        at = F.coalesce(own, F.col("center"))
        return elements.withColumn("_at", at).where(F.col("_at").isNotNull()).select(
            F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), tags, F.col("_at.lon").alias("x"), F.col("_at.lat").alias("y"))
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    ways = elements.where((F.col("type") == "way") & F.col("geometry").isNotNull() & (F.size("geometry") >= 2))
    if geometry == "polygon":
        ways = ways.where((F.size("geometry") >= 4) & (F.get("geometry", F.lit(0)) == F.element_at("geometry", -1)))
    return ways.select(F.col("id").cast("string").alias("osm_id"), tags, line.alias("line"))


def area_squares(areas: DataFrame, cell: float) -> DataFrame:
    """Grid squares that an area touches: area_id, gx, gy, and `edges` of its border where the square is not wholly inside.

    areas: area_id, and rings (parts and holes) or ring.  A square that no edge crosses is wholly inside or outside by its
    centre; outside ones are left out, and areas without points have none.
    """
    if "rings" not in areas.columns:
        areas = areas.withColumn("rings", F.array("ring"))
    points = F.flatten("rings")
    areas = areas.where(F.size(points) > 0)
    xs, ys = F.transform(points, lambda c: c["x"]), F.transform(points, lambda c: c["y"])
    g = lambda v: F.floor(v / cell).cast("int")
    spread = (areas.withColumn("gx", F.explode(F.sequence(g(F.array_min(xs)), g(F.array_max(xs)))))
              .withColumn("gy", F.explode(F.sequence(g(F.array_min(ys)), g(F.array_max(ys))))))
    lo_x, lo_y = F.col("gx") * F.lit(cell) - P.TOLERANCE, F.col("gy") * F.lit(cell) - P.TOLERANCE
    hi_x, hi_y = lo_x + (cell + 2 * P.TOLERANCE), lo_y + (cell + 2 * P.TOLERANCE)
    with_edges = spread.select("area_id", "gx", "gy", P.rings_edges(F.col("rings")).alias("edges"), lo_x.alias("lo_x"), lo_y.alias("lo_y"), hi_x.alias("hi_x"), hi_y.alias("hi_y"))
    crossed = F.exists("edges", lambda e: P.edge_meets_box(e, F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y")))
    marked = with_edges.withColumn("crossed", crossed).withColumn(
        "inside", P.point_in_edges((F.col("gx") + 0.5) * cell, (F.col("gy") + 0.5) * cell, F.col("edges")))
    # a ray to the right from inside the square meets only edges at its height that do not lie wholly to its left
    near = F.filter("edges", lambda e: (F.greatest(e["ay"], e["by"]) >= F.col("lo_y")) & (F.least(e["ay"], e["by"]) <= F.col("hi_y")) & (F.greatest(e["ax"], e["bx"]) >= F.col("lo_x")))
    return marked.where("crossed OR inside").select("area_id", "gx", "gy", F.when(F.col("crossed"), near).alias("edges"))


def clip_points(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Points inside areas, by an equi-join on grid squares; only squares on an area's edge need the ring test.

    areas: area_id, and ring or rings (parts and holes).
    """
    g = lambda v: F.floor(F.col(v) / cell).cast("int")
    placed = points.withColumn("gx", g("x")).withColumn("gy", g("y"))
    inside = F.col("edges").isNull() | P.point_in_edges(F.col("x"), F.col("y"), F.col("edges"))
    return placed.join(area_squares(areas, cell), ["gx", "gy"]).where(inside).drop("gx", "gy", "edges")


def _counted(held: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Sums of places (x, y, n, key) by area, square by square, for areas of any size."""
    g = lambda v: F.floor(F.col(v) / cell).cast("int")
    places = held.select("x", "y", "n", "key").withColumn("gx", g("x")).withColumn("gy", g("y"))
    sums = places.groupBy("gx", "gy").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    none = F.lit(None).cast("double")
    both = sums.select("gx", "gy", F.lit(True).alias("whole"), none.alias("x"), none.alias("y"), "n", "key").unionByName(places.withColumn("whole", F.lit(False)))
    # areas of few rows have many squares, of which Spark knows nothing beforehand: merged, they never go through the driver
    squares = area_squares(areas, cell).withColumn("whole", F.col("edges").isNull()).hint("merge")
    met = both.join(squares, ["gx", "gy", "whole"]).where(F.col("whole") | P.point_in_edges(F.col("x"), F.col("y"), F.col("edges")))
    return met.select("area_id", "n", "key")


def count_points(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Number of points and smallest key inside each area.  points: key, x, y; areas: area_id, and ring or rings.

    Points of one place are added up before they meet an area.  Places and areas of few edges meet in pairs of blocks, where squares
    wholly inside an area take their places' sums (`blocks.sums_inside`), so only places in squares on an area's edge are tested one
    by one; areas with long borders and those over many squares are laid over the grid instead.
    """
    if "rings" not in areas.columns:
        areas = areas.withColumn("rings", F.array("ring"))
    side = SQUARES * cell
    held = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    _, shapes, large = K.units(areas.select("area_id", "rings"), ["area_id"], P.rings_edges(F.col("rings")), side, twice=True)
    spots = held.select("n", "key", F.array("x", "y", "x", "y").alias("edges"), F.lit(1).alias("_n"), *[F.col(a).alias(f"{e}{a}") for e in ("min", "max") for a in ("x", "y")])

    def work(a: K.Block, b: K.Block, gx: int, gy: int):
        at, n, first = K.sums_inside(a, b, gx, gy, side, cell)
        if len(at):
            yield pa.RecordBatch.from_arrays([b.key("area_id", at), pa.array(n), a.table.column("key").take(first)], ["area_id", "n", "key"])
    schema = f"area_id {dict(shapes.dtypes)['area_id']}, n long, key {dict(held.dtypes)['key']}"
    found = K.pairs(spots, ["n", "key"], shapes, ["area_id"], side, schema, work)
    if large is not None:
        found = found.unionByName(_counted(held, large.select("area_id", "rings"), cell))
    return found.groupBy("area_id").agg(F.sum("n").alias("n"), F.min("key").alias("first_key"))


def clip_polygons(features: DataFrame, box: Column, ring: str = "ring") -> DataFrame:
    """Polygon features cut by a box; features left without area are dropped."""
    cut = features.withColumn(ring, P.clip_ring(F.col(ring), box))
    return cut.where((F.size(ring) >= 4) & (G.ring_area(F.col(ring)) > 0))


def clip_lines(features: DataFrame, box: Column, line: str = "line") -> DataFrame:
    """Line features cut by a box, as segment pieces; features entirely outside are dropped."""
    return features.withColumn("pieces", P.clip_line(F.col(line), box)).where(F.size("pieces") > 0)


def to_project_crs(ring: Column, epsg: Column) -> Column:
    """Every vertex in the project's zone."""
    return F.transform(ring, lambda p: G.utm_xy(p["x"], p["y"], epsg))


def hazards(features: DataFrame) -> DataFrame:
    """Hazard feed rows: points only, dates cut to ten characters.

    features: geometry_type, coordinates ARRAY<DOUBLE>, props MAP.
    """
    p = lambda k: F.try_element_at("props", F.lit(k))
    return features.where(F.col("geometry_type") == "Point").select(
        p("eventid").alias("hazard_id"), F.coalesce(p("name"), F.lit("")).alias("hazard_name"),
        F.try_to_date(F.substring(p("fromdate"), 1, 10), "yyyy-MM-dd").alias("hazard_start"),
        F.try_to_date(F.substring(p("todate"), 1, 10), "yyyy-MM-dd").alias("hazard_end"), p("alertlevel").alias("alert"),
        F.get("coordinates", F.lit(0)).alias("lon"), F.get("coordinates", F.lit(1)).alias("lat"))


def area_frames(polygons: DataFrame, side: int = B.MAX_SIDE) -> DataFrame:
    """Areas of interest: polygons of one area dissolved on an equal-area frame of `side` x `side` cells.

    polygons: area_id, and ring or rings (longitude/latitude; holes and parts in `rings`).  Returns the frame origin, cell size,
    words, km² and bounds.
    """
    if "rings" not in polygons.columns:
        polygons = polygons.withColumn("rings", F.array("ring"))
    pts = polygons.select("area_id", F.explode(F.flatten("rings")).alias("p"))
    bounds = pts.groupBy("area_id").agg(*[fn(F.col(f"p.{a}")).alias(n) for fn, a, n in (
        (F.min, "x", "minx"), (F.min, "y", "miny"), (F.max, "x", "maxx"), (F.max, "y", "maxy"))])
    ox, oy = G.equal_area_x(F.col("minx")), G.equal_area_y(F.col("miny"))
    cell = F.greatest(G.equal_area_x(F.col("maxx")) - ox, G.equal_area_y(F.col("maxy")) - oy) / side
    frames = bounds.withColumn("ox", ox).withColumn("oy", oy).withColumn("cell", cell)
    laid = polygons.join(frames, "area_id").withColumn(
        "words", B.rings_words(F.transform("rings", G.project_ring), F.col("ox"), F.col("oy"), F.col("cell"), side, side))
    merged = B.dissolve(laid, ["area_id"], "words", side, F.count("*").alias("n_parts"))
    return merged.join(frames, "area_id").withColumn("area_km2", B.cells(F.col("words")) * F.col("cell") * F.col("cell") / 1e6)


def area_violations(polygons: DataFrame) -> DataFrame:
    """Areas without geometry or without a coordinate system."""
    problem = F.when(F.col("crs").isNull(), "no CRS").when(F.size("ring") < 4, "no geometry")
    return polygons.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("area_id", "problem")


def area_guard(areas: DataFrame, large: float = V.LARGE_AREA_KM2, scene_limit: float = V.SCENE_AREA_LIMIT_KM2) -> DataFrame:
    """Flags areas that need confirmation and areas too large for scene-by-scene planning."""
    return areas.withColumn("needs_confirmation", F.col("area_km2") > large).withColumn("no_scenes", F.col("area_km2") > scene_limit)

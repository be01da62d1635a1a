"""Predicates and clipping for boxes, rings and lines held as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tilewright.functions.bind import let

_RING = "array<struct<x:double,y:double>>"
TOLERANCE = 1e-9


def boxes_touch(a: Column, b: Column) -> Column:
    """Closed overlap of two boxes (structs minx, miny, maxx, maxy)."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def box_covers(outer: Column, inner: Column, tolerance: float = TOLERANCE) -> Column:
    return ((outer["minx"] - tolerance <= inner["minx"]) & (outer["miny"] - tolerance <= inner["miny"])
            & (outer["maxx"] + tolerance >= inner["maxx"]) & (outer["maxy"] + tolerance >= inner["maxy"]))


def box_overlap(a: Column, b: Column) -> Column:
    """Area shared by two boxes in their own units."""
    return (F.greatest(F.lit(0.0), F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"]))
            * F.greatest(F.lit(0.0), F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])))


def box_area(a: Column) -> Column:
    return (a["maxx"] - a["minx"]) * (a["maxy"] - a["miny"])


def rings_of(kind: Column, coordinates: Column) -> Column:
    """All rings of a Polygon or MultiPolygon from the JSON text of its coordinates, as points; null for other geometries."""
    one = F.when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.when(kind == "MultiPolygon", F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))
    return F.transform(F.coalesce(one, many), lambda ring: F.transform(ring, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))))


def parts_of(kind: Column, coordinates: Column) -> Column:
    """Parts of a Polygon or MultiPolygon from the JSON text of its coordinates, each an array of rings, the outer one first."""
    one = F.when(kind == "Polygon", F.array(F.from_json(coordinates, "array<array<array<double>>>")))
    many = F.when(kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>"))
    return F.transform(F.coalesce(one, many), lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))))


def turning(ring: Column) -> Column:
    """Twice the signed surface of a closed ring: above 0 if it runs to the left."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + e["ax"] * e["by"] - e["bx"] * e["ay"])


def oriented_edges(parts: Column) -> Column:
    """Edges of all rings with the inside on their left: outer rings run to the left, holes to the right."""
    def edges(ring, i):
        return ring_edges(F.when((turning(ring) > 0) == (i == 0), ring).otherwise(F.reverse(ring)))
    return F.flatten(F.transform(parts, lambda part: F.flatten(F.transform(part, edges))))


def rings_edges(rings: Column) -> Column:
    """Edges of all rings of an area."""
    return F.flatten(F.transform(rings, ring_edges))


def ring_edges(ring: Column) -> Column:
    """Edges between neighbouring points; none for fewer than two points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n),
                      lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def edge_meets_box(e: Column, lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column) -> Column:
    """Boxes overlap and the corners do not all lie on one side of the edge's line."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    turn = lambda x, y: dx * (y - e["ay"]) - dy * (x - e["ax"])
    corners = [turn(lo_x, lo_y), turn(hi_x, lo_y), turn(hi_x, hi_y), turn(lo_x, hi_y)]
    return ((F.least(e["ax"], e["bx"]) <= hi_x) & (F.greatest(e["ax"], e["bx"]) >= lo_x) & (F.least(e["ay"], e["by"]) <= hi_y)
            & (F.greatest(e["ay"], e["by"]) >= lo_y) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))


def point_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule by counting the edges crossed by a ray to the right."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses(e))


def edges_cross(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common, ends included: their boxes overlap and each lies on both sides of the other's line."""
    def turn(g, x, y):
        return (g["bx"] - g["ax"]) * (y - g["ay"]) - (g["by"] - g["ay"]) * (x - g["ax"])

    def apart(a):
        return (F.greatest(e[f"a{a}"], e[f"b{a}"]) < F.least(f[f"a{a}"], f[f"b{a}"])) | (F.greatest(f[f"a{a}"], f[f"b{a}"]) < F.least(e[f"a{a}"], e[f"b{a}"]))

    def both_sides(g, h):
        return F.signum(turn(g, h["ax"], h["ay"])) * F.signum(turn(g, h["bx"], h["by"])) <= 0
    return ~apart("x") & ~apart("y") & both_sides(e, f) & both_sides(f, e)


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two areas of several rings (parts and holes) have a point in common: borders meet, or one holds a vertex of the other."""
    def holds(rings, edges):
        return F.exists(rings, lambda r: point_in_edges(F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"], edges))

    def test(s):
        return F.exists(s["a"], lambda e: F.exists(s["b"], lambda f: edges_cross(e, f))) | holds(a, s["b"]) | holds(b, s["a"])
    return let(F.struct(rings_edges(a).alias("a"), rings_edges(b).alias("b")), test)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    return point_in_edges(x, y, ring_edges(ring))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def clip_ring(ring: Column, box: Column) -> Column:
    """Sutherland-Hodgman: the closed ring cut by a box, folded over its four half-planes; empty when nothing is left."""

    def plane(bound: Column, is_x: bool, above: bool) -> Column:
        return F.struct(bound.cast("double").alias("bound"), F.lit(is_x).alias("is_x"), F.lit(above).alias("above"))

    def along(p, h):
        return F.when(h["is_x"], p["x"]).otherwise(p["y"])

    def inside(p, h):
        return F.when(h["above"], along(p, h) >= h["bound"]).otherwise(along(p, h) <= h["bound"])

    def cut(a, b, h):
        t = (h["bound"] - along(a, h)) / (along(b, h) - along(a, h))
        return let(t, lambda k: _point(F.when(h["is_x"], h["bound"]).otherwise(a["x"] + (b["x"] - a["x"]) * k),
                                       F.when(h["is_x"], a["y"] + (b["y"] - a["y"]) * k).otherwise(h["bound"])))

    def step(r, h):
        pairs = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        kept = F.flatten(F.transform(pairs, lambda e: F.when(
            inside(e["b"], h) & ~inside(e["a"], h), F.array(cut(e["a"], e["b"], h), e["b"])).when(
            inside(e["b"], h), F.array(e["b"])).when(
            inside(e["a"], h), F.array(cut(e["a"], e["b"], h))).otherwise(F.array().cast(_RING))))
        closed = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.slice(k, -1, 1), k)).otherwise(k))
        return F.when(F.size(r) > 1, closed).otherwise(r)

    planes = F.array(plane(box["minx"], True, True), plane(box["maxx"], True, False), plane(box["miny"], False, True), plane(box["maxy"], False, False))
    return F.aggregate(planes, ring.cast(_RING), step)


def clip_line(line: Column, box: Column) -> Column:
    """Liang-Barsky per segment: array of (ax, ay, bx, by) pieces of the line inside the box."""
    segs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1),
                      lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def limits(s):
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        side = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
        sides = F.array(side(-dx, s["ax"] - box["minx"]), side(dx, box["maxx"] - s["ax"]), side(-dy, s["ay"] - box["miny"]), side(dy, box["maxy"] - s["ay"]))
        enter = F.aggregate(sides, F.lit(0.0), lambda t, e: F.when(e["p"] < 0, F.greatest(t, e["q"] / e["p"])).otherwise(t))
        leave = F.aggregate(sides, F.lit(1.0), lambda t, e: F.when(e["p"] > 0, F.least(t, e["q"] / e["p"])).otherwise(t))
        outside = F.exists(sides, lambda e: (e["p"] == 0) & (e["q"] < 0))
        return let(F.struct(enter.alias("t0"), leave.alias("t1")), lambda t: F.struct(
            (s["ax"] + t["t0"] * dx).alias("ax"), (s["ay"] + t["t0"] * dy).alias("ay"), (s["ax"] + t["t1"] * dx).alias("bx"),
            (s["ay"] + t["t1"] * dy).alias("by"), (~outside & (t["t0"] < t["t1"])).alias("keep")))

    return F.filter(F.transform(segs, limits), lambda s: s["keep"])


def line_length(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0.0), lambda acc, s: acc + F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]))

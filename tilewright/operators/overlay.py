"""Vector features cut to areas of any shape: points, lines and polygons against areas with parts and holes.

Shapes of few edges meet whole, in pairs of blocks (`blocks`): a pair is decided in one place and needs no shuffle of its own.  Shapes
with long borders, those over many squares and those whose ids come more than once are laid over grid squares (`vectors.area_squares`), edges are split where they cross the
grid's lines, and the two meet in an equi-join on squares.  A piece in a square wholly inside an area is kept as it is; only pieces in
squares on an area's border are cut at the edges that matter there.  So neither long borders nor areas with a third of all features
meet in one task.

Coordinates are planar, in whatever system the caller gives.  A polygon or area is an array of parts; a part is an array of closed
rings, the outer one first, holes after it (`polygons.parts_of`).  Null and empty geometries have no edges and no result rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions import polygons as P
from tilewright.functions.bind import let
from tilewright.operators import blocks as K
from tilewright.sources.vectors import area_squares

#: Features move by so much before polygons meet, so that borders shared with an area are decided once and alike for both.
SHIFT = (1e-9, 0.7e-9)
#: Squares of the grid to a side of those in which whole shapes meet.
SQUARES = 4
RINGS = "feature_id long, area_id long, ring int, points array<struct<x:double,y:double>>"


def _squares(shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """Squares of areas with all their rings: key, gx, gy, and the edges to test where a square is not wholly inside."""
    return area_squares(shapes.select(F.col(key).alias("area_id"), F.flatten("parts").alias("rings")), cell).withColumnRenamed("area_id", key)


def _split(edges: DataFrame, cell: float) -> DataFrame:
    """Edges (ax, ay, bx, by and keys) cut at the grid's lines: t0, t1 and the square of each piece."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def crossed(a: str, b: str, d: Column):
        lo, hi = F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)
        at = F.transform(F.sequence(lo + 1, hi), lambda k: (k * cell - F.col(a)) / F.nullif(d, F.lit(0.0)))
        return F.when((hi > lo) & (d != 0), at).otherwise(F.array().cast("array<double>"))
    cuts = _cuts(F.lit(0.0), F.lit(1.0), F.concat(crossed("ax", "bx", dx), crossed("ay", "by", dy)))
    pieces = edges.withColumn("piece", F.explode(cuts)).select("*", "piece.t0", "piece.t1").drop("piece")
    middle = (F.col("t0") + F.col("t1")) / 2
    return pieces.withColumn("gx", F.floor((F.col("ax") + middle * dx) / cell).cast("int")).withColumn("gy", F.floor((F.col("ay") + middle * dy) / cell).cast("int"))


def _cuts(t0: Column, t1: Column, between: Column) -> Column:
    """The stretches (t0, t1) that the given places leave of a longer one."""
    inner = F.filter(between, lambda t: (t > t0) & (t < t1))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(t0, t1), inner)))
    return let(ends, lambda e: F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1"))))


def _place(e, f) -> Column:
    """Where along edge e the line of f crosses it, if it does within f; else null."""
    ex, ey, fx, fy = e["bx"] - e["ax"], e["by"] - e["ay"], f["bx"] - f["ax"], f["by"] - f["ay"]
    turn, ox, oy = ex * fy - ey * fx, f["ax"] - e["ax"], f["ay"] - e["ay"]
    along = (ox * ey - oy * ex) / F.nullif(turn, F.lit(0.0))
    return F.when((along >= 0) & (along <= 1), (ox * fy - oy * fx) / F.nullif(turn, F.lit(0.0)))


def _by_squares(edges: DataFrame, shapes: DataFrame, key: str, cell: float, keys: list[str]) -> DataFrame:
    """`edges_inside` square by square, for shapes and edges of any size."""
    # dealt evenly before one row becomes many; shapes of few rows have many squares, of which Spark knows nothing beforehand: merged, they
    # never go through the driver; few bytes of pieces make many pairs, so their tasks are not merged by size
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = _split(edges.repartition(tasks, *keys), cell).repartition(tasks, "gx", "gy")
    met = pieces.join(_squares(shapes, key, cell).hint("merge"), ["gx", "gy"])
    own = {n: F.col(n) for n in ("ax", "ay", "bx", "by")}
    places = F.transform("edges", lambda f: _place(own, f))

    def inside(s):
        m = (s["t0"] + s["t1"]) / 2
        return P.point_in_edges(own["ax"] + m * (own["bx"] - own["ax"]), own["ay"] + m * (own["by"] - own["ay"]), F.col("edges"))
    kept = F.when(F.col("edges").isNull(), F.array(F.struct("t0", "t1"))).otherwise(F.filter(_cuts(F.col("t0"), F.col("t1"), places), inside))
    found = met.select(*keys, key, *own, F.explode(kept).alias("s")).select(*keys, key, *own, "s.t0", "s.t1")
    # neighbouring squares give the same end to the stretches on both sides
    by = W.partitionBy(*keys, key).orderBy("t0")
    runs = found.withColumn("run", F.sum(F.when(F.lag("t1").over(by) == F.col("t0"), 0).otherwise(1)).over(by))
    ends = runs.groupBy(*keys, key, *own, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    point = lambda a, b, t: F.when(F.col(t) == 1, F.col(b)).otherwise(F.col(a) + F.col(t) * (F.col(b) - F.col(a)))
    return ends.select(*keys, key, point("ax", "bx", "t0").alias("ax"), point("ay", "by", "t0").alias("ay"), point("ax", "bx", "t1").alias("bx"), point("ay", "by", "t1").alias("by"))


def edges_inside(edges: DataFrame, shapes: DataFrame, key: str, cell: float, keys: list[str]) -> DataFrame:
    """Stretches of edges inside shapes.  edges: `keys` (they name one edge), ax, ay, bx, by; shapes: `key`, parts.

    Returns keys, key, and the ends ax, ay, bx, by of each stretch, as long as it goes on.
    """
    side = SQUARES * cell
    ends = ["ax", "ay", "bx", "by"]
    _, own, long_own = K.units(edges.select(*keys, *ends), keys, F.array(F.struct(*ends)), side)
    all_, other, long_other = K.units(shapes.select(key, "parts"), [key], P.rings_edges(F.flatten("parts")), side)

    def work(a: K.Block, b: K.Block, gx: int, gy: int):
        for i, j in K.met(a, b, gx, gy, side):
            pair, _, *at = K.stretches(a, b, i, j, *K.crossings(a, b, i, j))
            yield pa.RecordBatch.from_arrays([*(a.key(k, i[pair]) for k in keys), b.key(key, j[pair]), *map(pa.array, at)], [*keys, key, *ends])
    schema = ", ".join([*(f"`{k}` {t}" for d, names in ((own, keys), (other, [key])) for k in names for t in [dict(d.dtypes)[k]]), *(f"{e} double" for e in ends)])
    found = [K.pairs(own, keys, other, [key], side, schema, work)]
    if long_own is not None:
        found.append(_by_squares(long_own.select(*keys, *ends), all_, key, cell, keys))
    if long_other is not None:
        found.append(_by_squares(own.select(*keys, *ends), long_other, key, cell, keys))
    return reduce(DataFrame.unionByName, found)


def clip_lines(lines: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Lines (feature_id, line: array of points) cut to areas (area_id, parts).

    Returns feature_id, area_id, segment (from 0) and the ends of every stretch inside; equal ids are taken for the same line.
    """
    segments = lines.select("feature_id", F.posexplode(P.ring_edges(F.col("line"))).alias("segment", "e")).select("feature_id", "segment", "e.*")
    segments = segments.where("ax <> bx OR ay <> by").distinct()
    return edges_inside(segments, areas, "area_id", cell, ["feature_id", "segment"])


def _borders(shapes: DataFrame, key: str) -> DataFrame:
    edges = shapes.select(key, F.posexplode(P.oriented_edges(F.col("parts"))).alias("edge", "e")).select(key, "edge", "e.*")
    return edges.where("ax <> bx OR ay <> by")


def _clipped(features: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """`clip_polygons` square by square, for polygons of any size."""
    own = _by_squares(_borders(features, "feature_id"), areas, "area_id", cell, ["feature_id", "edge"]).drop("edge")
    other = _by_squares(_borders(areas, "area_id"), features, "feature_id", cell, ["area_id", "edge"]).drop("edge")
    edge = F.array("ax", "ay", "bx", "by")
    return own.unionByName(other).groupBy("feature_id", "area_id").agg(
        F.flatten(F.collect_list(edge)).alias("border"), F.sum((F.col("ax") + F.col("bx")) / 2 * (F.col("by") - F.col("ay"))).alias("shared"))


def clip_polygons(features: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Polygons (feature_id, parts) cut to areas (area_id, parts): one row of feature_id, area_id, `border` and `shared` per pair that shares something.

    The border of what both share is the part of either border inside the other: ax, ay, bx, by of each stretch in turn, with the inside
    on its left.  Its surface is the integral of x dy along it.
    """
    side = SQUARES * cell
    moved = features.select("feature_id", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.struct((p["x"] + SHIFT[0]).alias("x"), (p["y"] + SHIFT[1]).alias("y"))))).alias("parts"))
    _, own, long_own = K.units(moved, ["feature_id"], P.oriented_edges(F.col("parts")), side)
    all_, other, long_other = K.units(areas.select("area_id", "parts"), ["area_id"], P.oriented_edges(F.col("parts")), side)

    def work(a: K.Block, b: K.Block, gx: int, gy: int):
        for i, j in K.met(a, b, gx, gy, side):
            on, along = K.crossings(a, b, i, j)
            of_a, of_b = K.stretches(a, b, i, j, on, along), K.stretches(b, a, j, i, along.swapaxes(0, 1), on.swapaxes(0, 1))
            pair, _, ax, ay, bx, by = (np.concatenate(v) for v in zip(of_a, of_b))
            if not len(pair):
                continue
            n = np.bincount(pair, minlength=len(i))
            some = n > 0
            shared = np.bincount(pair, (ax + bx) / 2 * (by - ay), minlength=len(i))[some]
            border = np.stack([ax, ay, bx, by], axis=1)[np.argsort(pair.astype(np.uint16), kind="stable")].ravel()  # met gives no more pairs at once
            ends = np.concatenate([[0], np.cumsum(4 * n[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([a.key("feature_id", i[some]), b.key("area_id", j[some]), pa.ListArray.from_arrays(ends, border), pa.array(shared)],
                                             ["feature_id", "area_id", "border", "shared"])
    schema = f"feature_id {dict(own.dtypes)['feature_id']}, area_id {dict(other.dtypes)['area_id']}, border array<double>, shared double"
    found = [K.pairs(own, ["feature_id"], other, ["area_id"], side, schema, work)]
    if long_own is not None:
        found.append(_clipped(long_own, all_, cell))
    if long_other is not None:
        found.append(_clipped(own, long_other, cell))
    return reduce(DataFrame.unionByName, found)


def shared_areas(borders: DataFrame) -> DataFrame:
    """(feature_id, area_id, shared): surface that a feature and an area share, from `clip_polygons`."""
    return borders.select("feature_id", "area_id", "shared")


def _chained(edges: pd.DataFrame) -> pd.DataFrame:
    """Closed rings of the edges of one clipped feature; an edge is followed by one that starts where it ends, to seven decimals."""
    follow: dict = {}
    for e in edges.sort_values(["ax", "ay", "bx", "by"]).itertuples():
        follow.setdefault((round(e.ax, 7), round(e.ay, 7)), []).append(e)
    rings = []
    for start in list(follow):
        while follow.get(start):
            at, points = start, []
            while follow.get(at):
                e = follow[at].pop()
                points.append({"x": e.ax, "y": e.ay})
                at = (round(e.bx, 7), round(e.by, 7))
                if at == start:
                    break
            if at == start and len(points) >= 3:
                rings.append([*points, points[0]])
    return pd.DataFrame({"feature_id": edges["feature_id"].iloc[0], "area_id": edges["area_id"].iloc[0], "ring": range(len(rings)), "points": rings})


def clipped_rings(borders: DataFrame) -> DataFrame:
    """Rings (feature_id, area_id, ring, points) of clipped polygons, outer ones to the left, holes to the right; one task holds one result."""
    at = lambda k, n: F.get("border", k * 4 + n)
    edges = F.transform(F.sequence(F.lit(0), (F.size("border") / 4).cast("int") - 1), lambda k: F.struct(*[at(k, n).alias(c) for n, c in enumerate(("ax", "ay", "bx", "by"))]))
    long = borders.select(F.col("feature_id").cast("long"), F.col("area_id").cast("long"), F.explode(edges).alias("e")).select("feature_id", "area_id", "e.*")
    return long.groupBy("feature_id", "area_id").applyInPandas(_chained, RINGS)

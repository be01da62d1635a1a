"""Coverage algebra on an equal-area grid, one 64-bit word per grid row.

An area of interest is laid over a frame of at most 60 x 60 cells.  A footprint is an array of `ny` BIGINTs in which
bit `c` of word `r` says that the centre of cell (c, r) lies inside.  Union is `bit_or`, which Spark combines on the map
side, so a tile or window that holds a third of all scenes still shuffles a bounded number of words; intersection and
difference are `&` and `& ~`; area is `bit_count`.  The cell size of the frame is the approximation knob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions.bind import let
from tilewright.functions.polygons import ring_edges, rings_edges

MAX_SIDE = 60


def _long(v) -> Column:
    return F.lit(v).cast("bigint")


def span(lo: Column, hi: Column) -> Column:
    """Word with bits lo..hi set (both inclusive); zero when the span is empty."""
    width = F.call_function("shiftleft", _long(1), (hi - lo + 1).cast("int")) - _long(1)
    return F.when(hi < lo, _long(0)).otherwise(F.call_function("shiftleft", width, lo.cast("int")))


def box_words(x0: Column, y0: Column, x1: Column, y1: Column, nx: int, ny: int) -> Column:
    """Words of a rectangle given by its first and last cell on each axis; parts outside the frame are clipped."""
    bits = span(F.greatest(x0, F.lit(0)), F.least(x1, F.lit(nx - 1)))
    row = lambda r, b: F.when((y0 <= r) & (y1 >= r), b).otherwise(_long(0))
    return let(bits, lambda b: F.array(*[row(F.lit(r), b) for r in range(ny)]))


def ring_words(ring: Column, ox: Column, oy: Column, cell: Column, nx: int, ny: int) -> Column:
    """Words of a closed ring `ARRAY<STRUCT<x,y>>` in frame coordinates: even-odd rule at every cell centre.

    Per grid row the crossings of the centre line are sorted, and consecutive pairs become bit spans.
    """
    return edge_words(let(ring, ring_edges), ox, oy, cell, nx, ny)


def rings_words(rings: Column, ox: Column, oy: Column, cell: Column, nx: int, ny: int) -> Column:
    """Words of an area of several rings, parts and holes alike: a centre lies inside if an odd number of rings hold it."""
    return edge_words(rings_edges(rings), ox, oy, cell, nx, ny)


def edge_words(edges: Column, ox: Column, oy: Column, cell: Column, nx: int, ny: int) -> Column:
    """Words of the area whose border is the given edges (ax, ay, bx, by)."""
    def spans(starts):
        pairs = F.transform(F.sequence(F.lit(1), (F.size(starts) / 2).cast("int")), lambda k: span(
            F.greatest(F.element_at(starts, (2 * k - 1).cast("int")), F.lit(0)),
            F.least(F.element_at(starts, (2 * k).cast("int")) - 1, F.lit(nx - 1))))
        return F.when(F.size(starts) < 2, _long(0)).otherwise(F.aggregate(pairs, _long(0), lambda a, b: a.bitwiseOR(b)))

    def row(r, es):
        yc = oy + (r + 0.5) * cell
        hits = F.filter(es, lambda e: (e["ay"] <= yc) != (e["by"] <= yc))
        # first cell whose centre lies at or right of each crossing
        starts = F.sort_array(F.transform(hits, lambda e: F.ceil(
            (e["ax"] + (yc - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"]) - ox) / cell - 0.5).cast("int")))
        return let(starts, spans)

    return let(edges, lambda es: F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda r: row(r, es)))


def cells(words: Column) -> Column:
    """Area in cells."""
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def overlap(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def union_aggregate(words: str, ny: int) -> Column:
    """Aggregate expression: union of all footprints of a group, as words (map-side combinable)."""
    return F.array(*[F.coalesce(F.bit_or(F.get(F.col(words), F.lit(i))), _long(0)) for i in range(ny)])


def dissolve(df: DataFrame, keys: list[str], words: str, ny: int, *more: Column) -> DataFrame:
    """Union of footprints per key, with further aggregates in the same shuffle."""
    return df.groupBy(*keys).agg(union_aggregate(words, ny).alias(words), *more)


def to_cells(df: DataFrame, words: str, nx: int) -> DataFrame:
    """Relational form `(…, cx, cy)`, one row per covered cell."""
    rows = df.select("*", F.posexplode(words).alias("cy", "_word")).drop(words)
    cols = F.filter(F.sequence(F.lit(0), F.lit(nx - 1)), lambda c: F.call_function("getbit", F.col("_word"), c) == 1)
    return rows.select("*", F.explode(cols).alias("cx")).drop("_word")

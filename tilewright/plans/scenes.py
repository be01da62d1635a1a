"""Scene plans from polygons: areas and footprints of any extent, at any cell size.

The plane is cut into blocks of `side` x `side` cells.  An area is one row per block that it has cells in, and so is a footprint, each
with one 64-bit word per grid row of the block; nothing is limited to a frame of one block.  Which scenes belong to an area is
decided by their rings before the grid is used, so a footprint that holds no cell's centre still is a candidate, of no coverage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions import bitgrid as B, geodesy as G, polygons as P
from tilewright.plans import optical
from tilewright.session import write_stage

SQUARE = 1.0  # degrees: the squares in which items and areas meet
_BOX = ("minx", "miny", "maxx", "maxy")


def placed(rows: DataFrame, plane: bool = False) -> DataFrame:
    """Rings in equal-area metres (`plane`: they are given so) with their bounds."""
    rings = F.col("rings") if plane else F.transform("rings", G.project_ring)
    axis = lambda a: F.transform(F.flatten("rings"), lambda p: p[a])
    bounds = [f(axis(a)).alias(n) for f, a, n in zip((F.array_min, F.array_min, F.array_max, F.array_max), "xyxy", _BOX)]
    return rows.withColumn("rings", rings).select("*", *bounds).where("minx IS NOT NULL AND miny IS NOT NULL")


def _squares(lo: str, hi: str, size: float) -> Column:
    floor = lambda c: F.floor(F.col(c) / size).cast("int")
    return F.explode(F.sequence(floor(lo), floor(hi)))


def blocks(rows: DataFrame, cell: float, side: int = B.MAX_SIDE) -> DataFrame:
    """One row per block (bx, by) that holds cells of the rings, with their words.  rows: as `placed` gives them."""
    size = cell * side
    spread = rows.withColumn("bx", _squares("minx", "maxx", size)).withColumn("by", _squares("miny", "maxy", size))
    low, high = F.col("by") * F.lit(size), (F.col("by") + 1) * F.lit(size)
    # only edges at the block's height matter to its rows
    edges = F.filter(P.rings_edges(F.col("rings")), lambda e: (F.greatest(e["ay"], e["by"]) >= low) & (F.least(e["ay"], e["by"]) <= high))
    words = B.edge_words(edges, F.col("bx") * F.lit(size), low, F.lit(float(cell)), side, side)
    # exploded rather than filtered: a filter would work out the words of every block a second time
    held = F.explode(F.filter(F.array(words), lambda w: B.cells(w) > 0)).alias("words")
    return spread.select(*[c for c in spread.columns if c not in ("rings", *_BOX)], held)


def members(items: DataFrame, areas: DataFrame, square: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(aoi_id, item_id) of items whose area or border meets the area's; rows as `placed` gives them, equal in columns `on`.

    Both sides are spread over squares of the plane, so the join is an equi-join; a pair is tested only in the square that holds the lower
    left corner of the overlap of their bounds.
    """
    def spread(rows, key, tag):
        named = rows.select(*on, key, *[F.col(c).alias(f"{tag}_{c}") for c in ("rings", *_BOX)])
        return named.withColumn("_gx", _squares(f"{tag}_minx", f"{tag}_maxx", square)).withColumn("_gy", _squares(f"{tag}_miny", f"{tag}_maxy", square))

    corner = [F.floor(F.greatest(f"i_{c}", f"a_{c}") / square) == F.col(g) for c, g in (("minx", "_gx"), ("miny", "_gy"))]
    near = [F.col(f"i_{lo}") <= F.col(f"a_{hi}") for lo, hi in (("minx", "maxx"), ("miny", "maxy"))]
    near += [F.col(f"a_{lo}") <= F.col(f"i_{hi}") for lo, hi in (("minx", "maxx"), ("miny", "maxy"))]
    met = spread(items, "item_id", "i").join(spread(areas, "aoi_id", "a"), [*on, "_gx", "_gy"])
    for test in (*near, *corner):
        met = met.where(test)
    return met.where(P.rings_meet(F.col("i_rings"), F.col("a_rings"))).select("aoi_id", "item_id").distinct()


def plan_scenes(items: DataFrame, areas: DataFrame, windows: DataFrame, cell: float, side: int = B.MAX_SIDE, on: tuple[str, ...] = (),
                plane: bool = False, held: DataFrame | None = None, cloud_max: float = V.CLOUD_MAX, min_coverage: float = V.MIN_COVERAGE,
                target: float = V.CLEAR_TARGET) -> optical.OpticalPlan:
    """The optical plan of every area from the rings of items and areas.

    items: item_id, tile, d, cloud_cover, rings; areas: aoi_id, rings, one row per part; windows: aoi_id, label, w_start, w_end.
    rings are ARRAY<ARRAY<STRUCT<x, y>>> of longitudes and latitudes, or of metres in an equal-area plane with `plane`.  `on` names columns of
    both sides that have to be equal, such as a source.  `cell` is the side of a cell in metres.
    Items without tile or rings take no part.  Words of the plan's tiles are those of the area's blocks in order.
    """
    if not 1 <= side <= 62:
        raise ValueError("a grid row is one 64-bit word: side must lie between 1 and 62")
    area = write_stage(blocks(placed(areas.select("aoi_id", "rings"), plane), cell, side).groupBy("aoi_id", "bx", "by").agg(B.union_aggregate("words", side).alias("words")), "areas")
    # what meets an area is decided on the given coordinates, whose edges are straight there
    # stages of few bytes are read by few tasks, and one footprint becomes many blocks: items are dealt first, and their blocks never broadcast
    dealt = items.where("tile IS NOT NULL").select(*on, "item_id", "rings").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    own = [placed(r.select(*on, k, "rings"), plane=True) for r, k in ((dealt, "item_id"), (areas, "aoi_id"))]
    pairs = write_stage(members(*own, cell * side if plane else SQUARE, on), "members")
    cut = (blocks(placed(dealt.select("item_id", "rings"), plane), cell, side).hint("merge").join(pairs, "item_id")
           .join(area.withColumnRenamed("words", "_area"), ["aoi_id", "bx", "by"]).withColumn("words", B.overlap(F.col("words"), F.col("_area"))).drop("_area")
           .withColumn("cells", B.cells(F.col("words"))).where("cells > 0"))
    pieces = write_stage(cut, "pieces")
    sizes = pieces.groupBy("aoi_id", "item_id").agg(F.sum("cells").cast("int").alias("n_cells"))
    scenes = (items.select("item_id", "tile", "d", "cloud_cover").join(pairs, "item_id").join(sizes, ["aoi_id", "item_id"], "left")
              .withColumn("n_cells", F.coalesce("n_cells", F.lit(0))))
    scenes = write_stage(optical.marked_held(scenes, held), "scenes")
    claimed = write_stage(optical.claim(_tiles(scenes, pieces, area, side), _flat(area)), "tiles")
    return optical.planned(scenes, claimed, windows, side, cloud_max, min_coverage, target, pieces)


def catalogue_scenes(items: DataFrame) -> DataFrame:
    """Normalised catalogue items as scenes: their group is the tile."""
    return items.select("source_id", "item_id", F.col("group").alias("tile"), "d", "cloud_cover", "rings")


def plan_catalogue(items: DataFrame, areas: DataFrame, windows: DataFrame, cell: float, **more) -> optical.OpticalPlan:
    """Scene plans straight from normalised catalogue items (see `sources.catalogue`).  areas: source_id, aoi_id, rings; an area is planned
    from the items of its source.  Further arguments are those of `plan_scenes`."""
    return plan_scenes(catalogue_scenes(items), areas, windows, cell, on=("source_id",), **more)


def _flat(area: DataFrame) -> DataFrame:
    """Areas as one array of words each, block after block.  Scene planning stops at 100,000 km², which bounds their number."""
    parts = F.sort_array(F.collect_list(F.struct("bx", "by", "words")))
    return area.groupBy("aoi_id").agg(parts.alias("p")).select(
        "aoi_id", F.transform("p", lambda b: F.struct(b["bx"].alias("bx"), b["by"].alias("by"))).alias("blocks"), F.flatten(F.transform("p", lambda b: b["words"])).alias("words"))


def _tiles(scenes: DataFrame, pieces: DataFrame, area: DataFrame, side: int) -> DataFrame:
    """Extent of every tile inside its area, as one array of words in the order of the area's blocks, and its quality."""
    counted = scenes.groupBy("aoi_id", "tile").agg(F.count("*").alias("n_items"), F.avg("n_cells").alias("quality"))
    named = pieces.join(scenes.select("aoi_id", "item_id", "tile"), ["aoi_id", "item_id"])
    seen = B.dissolve(named, ["aoi_id", "tile", "bx", "by"], "words", side)
    held = seen.groupBy("aoi_id", "tile").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("bx", "by"), "words"))).alias("m"))
    none = F.array_repeat(F.lit(0).cast("bigint"), side)
    whole = (counted.join(held, ["aoi_id", "tile"], "left").join(_flat(area).select("aoi_id", "blocks"), "aoi_id")
             .withColumn("words", F.flatten(F.transform("blocks", lambda b: F.coalesce(F.try_element_at("m", b), none)))))
    return whole.drop("m", "blocks").withColumn("tile_cells", B.cells(F.col("words")))

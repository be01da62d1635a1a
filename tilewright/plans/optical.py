"""Cloud-aware scene choice per tile and time window, for many areas at once.

Input footprints are grid words (see `functions.bitgrid`) already cut to the area.  All grouping is by keys that Spark
can combine on the map side, so one tile, window or area holding a large share of all scenes does not end in one task:

* tiles: union of footprints is `bit_or`, quality is an average;
* ranking: the best scene is a `min` over a struct, not a sort of the group;
* composites: scenes are first summed per thousandth of clear fraction; only the scenes that can still matter are then
  ordered row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say
from tilewright.functions import bitgrid as B, verdicts as E
from tilewright.operators.windows import join_windows
from tilewright.session import write_stage

_SALTS = 32
_EPS = 1e-9  # guard band around the stop threshold: block products may differ from the running product in the last digits


@dataclass
class OpticalPlan:
    tiles: DataFrame        # aoi_id, tile, tile_cells, exclusive_cells, words, n_items, quality, tile_rank
    dropped: DataFrame      # aoi_id, tile
    candidates: DataFrame   # one row per (aoi, window, tile, item)
    selections: DataFrame   # best scene per (aoi, window, tile); item_id null where no scene
    composites: DataFrame   # scenes of the composite, best first
    reports: DataFrame      # one row per (aoi, window)


def in_area(items: DataFrame, area: DataFrame) -> DataFrame:
    """Scenes cut to their area and those that miss it dropped; `words` becomes footprint ∩ area."""
    joined = items.join(area.select("aoi_id", F.col("words").alias("_area")), "aoi_id")
    return (joined.withColumn("words", B.overlap(F.col("words"), F.col("_area"))).drop("_area")
            .withColumn("n_cells", B.cells(F.col("words"))).where("n_cells > 0"))


def tile_extents(items: DataFrame, ny: int) -> DataFrame:
    """Data extent of every tile inside the area and its quality, the mean footprint over its scenes."""
    return (B.dissolve(items, ["aoi_id", "tile"], "words", ny, F.count("*").alias("n_items"), F.avg("n_cells").alias("quality"))
            .withColumn("tile_cells", B.cells(F.col("words"))))


def claim(tiles: DataFrame, area: DataFrame, share: float = V.REDUNDANT_TILE_SHARE) -> DataFrame:
    """Greedy exclusive claim: tiles in quality order take the cells no better tile has; a tile adding less than `share`
    of the area is dropped and does not count as covered.

    Folds over one area's tiles.  Scene planning stops at 100,000 km², so an area meets a bounded number of tiles, each
    of them one row of at most 60 words.
    """
    ordered = F.sort_array(F.collect_list(F.struct(
        (-F.col("quality")).alias("nq"), "tile", "words", "tile_cells", "n_items", "quality")))
    per_area = (tiles.groupBy("aoi_id").agg(ordered.alias("ts"))
                .join(area.select("aoi_id", F.col("words").alias("aw"), B.cells(F.col("words")).alias("area_cells")), "aoi_id"))
    empty = F.transform(F.col("aw"), lambda w: F.lit(0).cast("bigint"))
    start = F.struct(empty.alias("covered"), F.array().cast("array<struct<tile:string,exclusive:int,kept:boolean>>").alias("out"))

    def step(acc, t):
        gain = B.cells(B.minus(t["words"], acc["covered"]))
        kept = gain >= F.col("area_cells") * share
        return F.struct(F.when(kept, B.union(acc["covered"], t["words"])).otherwise(acc["covered"]).alias("covered"),
                        F.concat(acc["out"], F.array(F.struct(t["tile"].cast("string").alias("tile"), gain.cast("int").alias("exclusive"), kept.alias("kept")))).alias("out"))

    folded = per_area.select("aoi_id", "area_cells", "ts", F.aggregate("ts", start, step)["out"].alias("o"))
    both = folded.select("aoi_id", "area_cells", F.posexplode(F.arrays_zip("ts", "o")).alias("tile_rank", "z"))
    return both.select("aoi_id", "area_cells", "tile_rank", "z.ts.tile", "z.ts.words", "z.ts.tile_cells", "z.ts.n_items", "z.ts.quality",
                       F.col("z.o.exclusive").alias("exclusive_cells"), F.col("z.o.kept").alias("kept"))


def candidates(items: DataFrame, kept: DataFrame, windows: DataFrame) -> DataFrame:
    """Scenes of kept tiles per window with coverage and clear fraction (missing cloud counts as 100)."""
    joined = items.join(kept.select("aoi_id", "tile", "tile_cells", "exclusive_cells"), ["aoi_id", "tile"])
    cloud = F.coalesce("cloud_cover", F.lit(100.0))
    coverage = F.col("n_cells") / F.col("tile_cells")
    scored = joined.withColumn("cloud", cloud).withColumn("coverage", coverage).withColumn("clear", F.col("coverage") * (1 - F.col("cloud") / 100))
    return join_windows(scored, windows, ["aoi_id"]).withColumn("bucket", F.bround(F.bround("clear", 3) * 1000, 0).cast("int"))


def _rank_key() -> list[Column]:
    return [(-F.col("bucket")).alias("o1"), F.when(F.col("held"), 0).otherwise(1).alias("o2"), F.col("cloud").alias("o3"),
            F.col("d").alias("o4"), F.col("item_id").alias("o5")]


def _coarse_rank() -> Column:
    """The rank key up to the day as one long that never orders two scenes the other way round.

    From the top: clear fraction (11 bits), held (1), cloud in 65,536ths (24) and the day (21).  A part counts only where those before it
    are exact: the lowest bit of cloud marks values between two steps, which stay tied whatever their day.
    """
    whole = lambda c: c.cast("bigint")
    bucket = F.least(F.greatest(whole(1024 - F.col("bucket")), F.lit(0)), F.lit(2047))
    step = F.col("cloud") * 65536
    fits = step.between(0, 8_388_606)
    cloud = F.when(fits, 2 * F.floor(F.when(fits, step)) + F.when(F.floor(F.when(fits, step)) == step, 0).otherwise(1)).when(step < 0, 0).otherwise(2**24 - 1)
    day = F.coalesce(F.least(F.greatest(F.unix_date("d") + 2**20, F.lit(1)), F.lit(2**21 - 1)), F.lit(0))
    exact = fits & (F.floor(F.when(fits, step)) == step)
    lower = F.when(F.col("held"), 0).otherwise(1) * F.lit(2**45) + whole(cloud) * F.lit(2**21) + F.when(exact, whole(day)).otherwise(F.lit(0))
    return F.coalesce(bucket * F.lit(2**46) + F.when(bucket.between(1, 2046), lower).otherwise(F.lit(0)), F.lit(-1).cast("bigint"))


def best_per_tile(cand: DataFrame) -> DataFrame:
    """Best scene and candidate count per (area, window, tile).

    The smallest coarse rank is a hash aggregate of longs; only scenes that share it are ordered as rows.
    """
    keys = ["aoi_id", "label", "tile"]
    ranked = cand.withColumn("_rank", _coarse_rank())
    lead = ranked.groupBy(*keys).agg(F.min("_rank").alias("_lead"), F.count("*").alias("n_candidates"))
    tied = ranked.join(lead, keys).where("_rank = _lead")
    best = F.min(F.struct(*_rank_key(), "item_id", "d", "cloud", "coverage", "clear", "words"))
    return tied.groupBy(*keys, "n_candidates").agg(best.alias("b")).select(
        *keys, "n_candidates", "b.item_id", "b.d", "b.cloud", "b.coverage", "b.clear", "b.words")


def composites(cand: DataFrame, target: float = V.CLEAR_TARGET) -> DataFrame:
    """Scenes added best-first while the share still unseen, the product of (1 - clear) so far, exceeds 1 - target.

    Scenes are summed per block: a thousandth of clear fraction, and below half a thousandth a tenth of a percent of cloud,
    which is the order of ranking there.  The product over blocks says which scenes are surely in, surely out, or in the
    block at the border.  The border block is cut to the scenes that can still be needed, in slices, before it is ordered;
    what one task orders is thus bounded by the target, however many scenes a tile and window hold.
    """
    stop = 1 - target
    keys = ["aoi_id", "label", "tile"]
    block = [*keys, "bucket", "sub"]
    sub = F.when(F.col("bucket") > 0, 0).otherwise(F.when(F.col("held"), 0).otherwise(100_000) + F.floor(F.col("cloud") * 10).cast("int"))
    cand = cand.withColumn("sub", sub)
    order = W.partitionBy(*keys).orderBy(F.col("bucket").desc(), "sub")
    blocks = (cand.groupBy(*block).agg(F.count("*").alias("n"), F.product(1 - F.col("clear")).alias("factor"), F.min("clear").alias("least"))
              .withColumn("before", F.coalesce(F.product("factor").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)))
              .where(F.col("before") > stop - _EPS)
              .withColumn("border", F.col("before") * F.col("factor") <= stop + _EPS))
    # one full-clear scene leaves nothing unseen; a hopeless one has no logarithm to bound by, and its block is taken whole
    bounded = F.col("border") & (F.col("least") > 0) & (F.col("least") < 1) & F.lit(stop > _EPS)
    need = (F.when(F.col("border") & (F.col("least") >= 1), F.lit(1))
            .when(bounded, F.ceil(F.log(F.lit(max(stop - _EPS, _EPS)) / F.col("before")) / F.log(1 - F.col("least"))) + 2).otherwise(F.col("n")))
    live = cand.join(blocks.select(*block, "border", F.greatest(need, F.lit(1)).alias("need"), "before"), block)

    slice_order = W.partitionBy(*block, "_salt").orderBy(*_rank_key())
    border = (live.where("border").withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.lit(_SALTS)))
              .withColumn("_rn", F.row_number().over(slice_order)).where("_rn <= need").drop("_salt", "_rn"))
    tail = live.where("NOT border AND bucket = 0").withColumn("remaining", F.col("before"))

    def running(rows: DataFrame, partition: list[str], start) -> DataFrame:
        seen = F.product(1 - F.col("clear")).over(W.partitionBy(*partition).orderBy(*_rank_key()).rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn("remaining", start * F.coalesce(seen, F.lit(1.0))).where(F.col("remaining") > stop)

    # down to half a thousandth the product runs scene by scene from the first; below, it starts from the blocks before
    upper = running(live.where("NOT border AND bucket > 0").unionByName(border.where("bucket > 0")), keys, F.lit(1.0))
    lower = running(border.where("bucket = 0"), block, F.col("before"))
    return upper.unionByName(lower).unionByName(tail).drop("sub", "border", "need", "before")


def plan_optical(items: DataFrame, area: DataFrame, windows: DataFrame, ny: int, held: DataFrame | None = None,
                 cloud_max: float = V.CLOUD_MAX, min_coverage: float = V.MIN_COVERAGE, target: float = V.CLEAR_TARGET) -> OpticalPlan:
    """items: aoi_id, item_id, tile, d, cloud_cover, words; area: aoi_id, words; windows: aoi_id, label, w_start, w_end.

    held: item_id of scenes already in the library, used only between equally clear scenes.
    Tiles and candidates feed several results each, so both are written once to the shared folder and read back.
    """
    scenes = marked_held(in_area(items.where(F.col("tile").isNotNull()), area), held)
    claimed = write_stage(claim(tile_extents(scenes, ny), area), "tiles")
    return planned(scenes, claimed, windows, ny, cloud_max, min_coverage, target)


def marked_held(scenes: DataFrame, held: DataFrame | None) -> DataFrame:
    """Scenes with `held`: whether the library has them."""
    if held is None:
        return scenes.withColumn("held", F.lit(False))
    marks = held.select("item_id").distinct().withColumn("_held", F.lit(True))
    return scenes.join(marks, "item_id", "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")


def planned(scenes: DataFrame, claimed: DataFrame, windows: DataFrame, ny: int, cloud_max: float, min_coverage: float, target: float,
            pieces: DataFrame | None = None) -> OpticalPlan:
    """The plan of scenes (with n_cells and held) and claimed tiles.  Footprints are the scenes' `words`, or rows of `pieces`:
    aoi_id, item_id, bx, by, words."""
    tiles = claimed.where("kept")
    fields = ["aoi_id", "label", "tile", "item_id", "d", "cloud_cover", "cloud", "coverage", "clear", "bucket", "held"]
    cand = candidates(scenes, tiles, windows)
    cand = write_stage(cand.select(*fields, "words") if pieces is None else cand.select(*fields, F.lit(None).cast("array<bigint>").alias("words")), "candidates")
    best = best_per_tile(cand)
    comp = composites(cand, target)
    grid = windows.select("aoi_id", "label").distinct().join(tiles.select("aoi_id", "tile", "exclusive_cells", "area_cells"), "aoi_id")
    comp_sum = comp.groupBy("aoi_id", "label", "tile").agg(
        F.count("*").alias("n_composite"), (1 - F.product(1 - F.col("clear"))).alias("composite_clear"))
    sel = (grid.join(best, ["aoi_id", "label", "tile"], "left").join(comp_sum, ["aoi_id", "label", "tile"], "left")
           .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
           .withColumn("meets_threshold", F.coalesce((F.col("cloud") <= cloud_max) & (F.col("coverage") >= min_coverage), F.lit(False)))
           .withColumn("reasons", F.when(F.col("item_id").isNull(), F.array(say("no scene")))
                       .otherwise(E.selection_reasons(F.col("clear"), F.col("n_candidates"), F.col("cloud"), F.col("coverage"), cloud_max, min_coverage))))
    return OpticalPlan(tiles, claimed.where("NOT kept").select("aoi_id", "tile"), cand, sel, comp,
                       window_reports(sel, cand, ny, cloud_max, min_coverage, target, pieces))


def imaged(chosen: DataFrame, ny: int, pieces: DataFrame | None = None) -> DataFrame:
    """(aoi_id, label, seen): cells that the chosen scenes of every window image together."""
    keys = ["aoi_id", "label"]
    if pieces is None:
        return B.dissolve(chosen, keys, "words", ny).select(*keys, B.cells(F.col("words")).alias("seen"))
    rows = chosen.select(*keys, "item_id").distinct().join(pieces, ["aoi_id", "item_id"])
    return B.dissolve(rows, [*keys, "bx", "by"], "words", ny).groupBy(*keys).agg(F.sum(B.cells(F.col("words"))).cast("int").alias("seen"))


def naive_coverage(cand: DataFrame, ny: int, cloud_max: float = V.CLOUD_MAX, pieces: DataFrame | None = None) -> DataFrame:
    """What a plain cloud filter would have returned per window: scenes and the cells they image."""
    plain = cand.where(F.col("cloud_cover") <= cloud_max)
    if pieces is None:
        return B.dissolve(plain, ["aoi_id", "label"], "words", ny, F.count("*").alias("naive_scenes")).select(
            "aoi_id", "label", "naive_scenes", B.cells(F.col("words")).alias("naive_cells"))
    counts = plain.groupBy("aoi_id", "label").agg(F.count("*").alias("naive_scenes"))
    return counts.join(imaged(plain, ny, pieces).withColumnRenamed("seen", "naive_cells"), ["aoi_id", "label"], "left")


def window_reports(sel: DataFrame, cand: DataFrame, ny: int, cloud_max: float, min_coverage: float, target: float,
                   pieces: DataFrame | None = None) -> DataFrame:
    """Counts, observed and expected-clear coverage and the verdict of every (area, window)."""
    chosen = F.col("item_id").isNotNull()
    base = sel.groupBy("aoi_id", "label").agg(
        F.sum("n_candidates").alias("n_scenes"), F.count_if(~chosen).alias("tiles_missing"), F.count_if(chosen).alias("single_scenes"),
        F.count("*").alias("n_tiles"), F.first("area_cells").alias("area_cells"),
        F.count_if(F.col("cloud") > cloud_max).alias("over_threshold"),
        F.coalesce(F.sum(F.col("exclusive_cells") * F.col("clear")), F.lit(0.0)).alias("_single"),
        F.coalesce(F.sum(F.col("exclusive_cells") * F.col("composite_clear")), F.lit(0.0)).alias("_comp"),
        F.coalesce(F.sum("n_composite"), F.lit(0)).alias("composite_scenes"),
        *([B.cells(B.union_aggregate("words", ny)).alias("_seen")] if pieces is None else []))
    if pieces is not None:
        base = base.join(imaged(sel.where(chosen), ny, pieces).withColumnRenamed("seen", "_seen"), ["aoi_id", "label"], "left").fillna(0, ["_seen"])
    full = (base.join(naive_coverage(cand, ny, cloud_max, pieces), ["aoi_id", "label"], "left")
            .withColumn("observed", F.col("_seen") / F.col("area_cells"))
            # rounded, as the last digits of a sum hang on the order in which tasks end
            .withColumn("single_clear", F.round(F.col("_single") / F.col("area_cells"), 12))
            .withColumn("composite_clear", F.round(F.col("_comp") / F.col("area_cells"), 12))
            .withColumn("naive_scenes", F.coalesce("naive_scenes", F.lit(0)))
            .withColumn("naive_observed", F.coalesce(F.col("naive_cells") / F.col("area_cells"), F.lit(0.0))))
    verdict = E.optical_verdict(F.col("observed"), F.col("single_clear"), F.col("composite_clear"), min_coverage, target)
    text = E.optical_verdict_text(F.col("verdict"), F.col("observed"), F.col("single_clear"), F.col("composite_clear"),
                                  F.col("composite_scenes"), F.col("n_scenes"), F.col("tiles_missing"), F.col("n_tiles"), target)
    return (full.withColumn("verdict", verdict).withColumn("verdict_text", text)
            .drop("_single", "_comp", "_seen", "naive_cells", "area_cells"))


def acquisitions(plan: OpticalPlan, mode: str = "single") -> DataFrame:
    """Distinct (area, window, item) to fetch."""
    src = plan.composites if mode == "composite" else plan.selections.where(F.col("item_id").isNotNull())
    return src.select("aoi_id", "label", "item_id").distinct()


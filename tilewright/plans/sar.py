"""Radar passes: frames of one orbit on one date, the same orbit kept before and after an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say
from tilewright.functions import bitgrid as B, verdicts as E
from tilewright.operators.windows import join_windows, reference_date
from tilewright.plans.optical import in_area


@dataclass
class RadarPlan:
    passes: DataFrame      # aoi_id, orbit, state, d, coverage, frames, held
    orbits: DataFrame      # per orbit that serves every window: worst coverage, held frames
    picks: DataFrame       # pass per (aoi, window)
    selections: DataFrame  # frames of the picked passes
    reports: DataFrame


def passes(items: DataFrame, area: DataFrame, ny: int) -> DataFrame:
    """One row per (area, orbit, direction, date) with the union coverage of its frames."""
    n_area = area.select("aoi_id", B.cells(F.col("words")).alias("area_cells"))
    grouped = B.dissolve(items, ["aoi_id", "orbit", "state", "d"], "words", ny, F.count("*").alias("frames"), F.count_if("held").alias("held"))
    return grouped.join(n_area, "aoi_id").select(
        "aoi_id", "orbit", "state", "d", "frames", "held", (B.cells(F.col("words")) / F.col("area_cells")).alias("coverage"))


def plan_sar(items: DataFrame, area: DataFrame, windows: DataFrame, ny: int, same_orbit: bool = True,
             min_coverage: float = V.MIN_COVERAGE, held: DataFrame | None = None) -> RadarPlan:
    """items: aoi_id, item_id, orbit, state, d, words; windows: aoi_id, label, w_start, w_end, optional ref_date.

    Equal passes go to the earlier date, equal orbits to the larger (orbit, direction).
    """
    frames = in_area(items.where(F.col("orbit").isNotNull()).withColumn("state", F.coalesce("state", F.lit("?"))), area)
    if held is None:
        frames = frames.withColumn("held", F.lit(False))
    else:
        marks = held.select("item_id").distinct().withColumn("_held", F.lit(True))
        frames = frames.join(marks, "item_id", "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")
    ps = passes(frames, area, ny)
    dated = windows if "ref_date" in windows.columns else windows.withColumn("ref_date", reference_date(F.col("w_start"), F.col("w_end")))
    pw = join_windows(ps, dated, ["aoi_id"])
    away = F.abs(F.datediff("d", "ref_date"))
    # the earlier date wins a tie, so the date enters the maximum as days counted backwards
    early = -F.datediff("d", F.lit("1970-01-01").cast("date"))
    chosen = F.struct("orbit", "state", "d", "coverage", "frames", "held")
    per_orbit = pw.groupBy("aoi_id", "label", "orbit", "state").agg(
        F.max_by(chosen, F.struct("coverage", (-away).alias("a"), early.alias("e"))).alias("p"))
    n_windows = windows.groupBy("aoi_id").agg(F.count_distinct("label").alias("n_windows"))
    orbits = (per_orbit.groupBy("aoi_id", "orbit", "state").agg(
        F.count("*").alias("served"), F.bround(F.min("p.coverage"), 3).alias("worst"), F.sum("p.held").alias("held"))
        .join(n_windows, "aoi_id").where("served = n_windows").drop("served", "n_windows"))
    free = pw.groupBy("aoi_id", "label").agg(F.max_by(chosen, F.struct("coverage", early.alias("e"), (-F.col("orbit")).alias("o"), "state")).alias("p"))
    if same_orbit:
        kept = orbits.groupBy("aoi_id").agg(F.max(F.struct("worst", "held", "orbit", "state")).alias("k")).select("aoi_id", "k.orbit", "k.state")
        tied = per_orbit.join(kept, ["aoi_id", "orbit", "state"]).select("aoi_id", "label", "p")
        picks = tied.unionByName(free.join(kept.select("aoi_id"), "aoi_id", "left_anti"))
    else:
        picks = free
    picks = picks.select("aoi_id", "label", "p.*")
    available = pw.groupBy("aoi_id", "label").agg(F.count("*").alias("n_available"))
    reports = (windows.select("aoi_id", "label").distinct().join(available, ["aoi_id", "label"], "left").join(picks, ["aoi_id", "label"], "left")
               .withColumn("n_available", F.coalesce("n_available", F.lit(0)))
               .withColumn("observed", F.coalesce("coverage", F.lit(0.0)))
               .withColumn("verdict", F.when(F.col("coverage") >= min_coverage, "feasible-single").otherwise("incomplete"))
               .withColumn("verdict_text", F.when(F.col("orbit").isNull(), say("no pass")).otherwise(F.concat(
                   say("pass", F.col("orbit"), F.col("state"), F.col("d"), E.percent(F.col("coverage"))),
                   F.when(F.col("coverage") >= min_coverage, "").otherwise(say("pass in part"))))))
    sel = frames.join(picks.select("aoi_id", "label", "orbit", "state", "d", "coverage"), ["aoi_id", "orbit", "state", "d"]).select(
        "aoi_id", "label", "item_id", "orbit", "state", "d", "coverage")
    return RadarPlan(ps, orbits, picks, sel, reports)

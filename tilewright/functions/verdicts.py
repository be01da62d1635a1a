"""Feasibility verdicts and the sentences that explain them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say


def whole(x: Column) -> Column:
    """Nearest whole number as text, halves to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def percent(x: Column) -> Column:
    return F.concat(whole(x * 100), F.lit("%"))


def optical_verdict(observed: Column, single: Column, composite: Column, min_coverage: float, target: float) -> Column:
    return (F.when(observed < min_coverage, "incomplete").when(single >= target, "feasible-single")
            .when(composite >= target, "feasible-composite").otherwise("infeasible"))


def optical_verdict_text(verdict: Column, observed: Column, single: Column, composite: Column, n_composite: Column,
                         n_scenes: Column, missing: Column, n_tiles: Column, target: float) -> Column:
    return (F.when(verdict == "incomplete", F.concat(
                say("part imaged", percent(observed)), F.when(missing > 0, say("tiles missing", missing, n_tiles)).otherwise("")))
            .when(verdict == "feasible-single", say("single is enough", percent(single)))
            .when(verdict == "feasible-composite", say("composite is needed", percent(single), n_composite, percent(composite)))
            .otherwise(say("cloudy", n_scenes, F.floor(composite * 100).cast("bigint"), F.lit(f"{100 * target:.0f}"))))


def selection_reasons(clear: Column, n: Column, cloud: Column, coverage: Column, cloud_max: float, min_coverage: float) -> Column:
    return F.array_compact(F.array(
        say("clearest", percent(clear), n), F.when(cloud > cloud_max, say("too cloudy", whole(cloud), F.lit(f"{cloud_max:.0f}"))),
        F.when(coverage < min_coverage, say("swath edge", percent(coverage)))))


def out_of_range(n_available: Column, start: Column, end: Column, rec_from: Column, rec_to: Column) -> Column:
    """A window without scenes outside the source's record, compared at the record's own precision."""
    frm = F.coalesce(rec_from, F.lit("0000"))
    s, e = start.cast("string"), end.cast("string")
    before = F.substring(e, F.lit(1), F.length(frm)) < frm
    after = F.coalesce(F.substring(s, F.lit(1), F.length(rec_to)) > rec_to, F.lit(False))
    return (n_available == 0) & (before | after)


def severity(verdict: Column) -> Column:
    return (F.when(verdict == "infeasible", 3).when(verdict.isin("incomplete", "out-of-range"), 2)
            .when(verdict == "feasible-composite", 1).otherwise(0))


def severity_name(level: Column) -> Column:
    return F.element_at(F.lit(["ok", "composite", "incomplete", "infeasible"]), level + 1)


VERDICT_ORDER = V.VERDICTS

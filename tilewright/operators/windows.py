"""Time windows: monthly, yearly, before/after an event, their choice, and the ladders that fix a period or an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions import scalars as S


def _window(label: Column, start: Column, end: Column) -> Column:
    return F.struct(label.alias("label"), start.alias("w_start"), end.alias("w_end"))


def monthly_array(start: Column, end: Column) -> Column:
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(months, lambda m: _window(
        F.date_format(m, "yyyy-MM"), F.greatest(m, start), F.least(F.last_day(m), end))))


def yearly_array(start: Column, end: Column) -> Column:
    years = F.sequence(F.year(start), F.year(end))
    return F.when(F.year(start) <= F.year(end), F.transform(years, lambda y: _window(
        y.cast("string"), F.greatest(F.make_date(y, F.lit(1), F.lit(1)), start), F.least(F.make_date(y, F.lit(12), F.lit(31)), end))))


def pair_array(event: Column, pre_days: Column, post_days: Column, gap_days: Column | None = None) -> Column:
    gap = F.lit(0) if gap_days is None else gap_days
    pre_end, post_start = F.date_sub(event, gap), F.date_add(event, gap)
    return F.array(_window(F.lit("pre"), F.date_sub(pre_end, pre_days), pre_end),
                   _window(F.lit("post"), post_start, F.date_add(post_start, post_days)))


def expand(df: DataFrame, windows: Column, *keep: str) -> DataFrame:
    """One row per window, with the caller's columns."""
    return df.select(*(keep or ["*"]), F.inline(windows))


def windows_for(requests: DataFrame, *keep: str) -> DataFrame:
    """Windows of every request by its temporal mode, period and source cadence.

    Needs `temporal`, `start`, `end`, `event`, `pre_days`, `post_days`, `source_yearly`; adds `step`.
    """
    step = S.window_step(F.col("temporal"), F.col("source_yearly"), F.col("start"), F.col("end"))
    chosen = (F.when(step == "pair", pair_array(F.col("event"), F.col("pre_days"), F.col("post_days")))
              .when(step == "yearly", yearly_array(F.col("start"), F.col("end")))
              .otherwise(monthly_array(F.col("start"), F.col("end"))))
    return requests.withColumn("step", step).select(*keep, "step", F.inline(chosen))


def reference_date(start: Column, end: Column, event: Column | None = None) -> Column:
    """The event when there is one, else the middle day (half days round towards the start)."""
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return middle if event is None else F.coalesce(event, middle)


def join_windows(items: DataFrame, windows: DataFrame, keys: list[str], date: str = "d") -> DataFrame:
    """Interval join `w_start <= date <= w_end`, inclusive, windows may overlap.

    Windows are spread over the months they touch, so that the join is an equi-join on (keys, month) with the two
    comparisons left as a residual; an item meets only the windows of its own month.
    """
    spread = windows.withColumn("_month", F.explode(F.sequence(F.trunc("w_start", "MM"), F.trunc("w_end", "MM"), F.expr("interval 1 month"))))
    dated = items.withColumn("_month", F.trunc(date, "MM"))
    return dated.join(spread, [*keys, "_month"]).where(F.col(date).between(F.col("w_start"), F.col("w_end"))).drop("_month")


def request_period(requests: DataFrame, today: Column) -> DataFrame:
    """Period of a request: given dates, else the period in its text, else the project's, else the last 365 days.

    A change question without dates takes its rule's own number of years; an event without a period is its centre.
    Columns: flag_start, flag_end, parsed_start, parsed_end, project_start, project_end, event, pre_days, post_days, default_years.
    """
    flagged = F.col("flag_start").isNotNull() | F.col("flag_end").isNotNull()
    existing = F.col("project_start").isNotNull()
    no_text = F.col("parsed_start").isNull()
    centred = no_text & F.col("event").isNotNull() & ~flagged & ~existing
    spanned = no_text & ~centred & F.col("default_years").isNotNull() & ~flagged & ~existing
    parsed_s = (F.when(centred, F.date_sub("event", F.col("pre_days")))
                .when(spanned, F.make_date(F.year(today) - F.col("default_years"), F.lit(1), F.lit(1))).otherwise(F.col("parsed_start")))
    parsed_e = (F.when(centred, F.least(F.date_add("event", F.col("post_days")), today)).when(spanned, today).otherwise(F.col("parsed_end")))
    last = F.date_sub(today, 365)
    start = F.when(flagged, F.coalesce("flag_start", parsed_s, last)).otherwise(F.coalesce(parsed_s, F.col("project_start"), last))
    end = F.when(flagged, F.coalesce("flag_end", parsed_e, today)).otherwise(
        F.when(parsed_s.isNotNull(), parsed_e).otherwise(F.coalesce(F.col("project_end"), today)))
    source = (F.when(flagged, "flags").when(centred, "event").when(spanned, "default years").when(~no_text, "text")
              .when(existing, "project").otherwise("last 12 months"))
    return requests.select("*", start.alias("start"), end.alias("end"), source.alias("period_source"))


def event_ladder(requests: DataFrame) -> DataFrame:
    """Event of a before/after request: given, from the text, nearest recorded hazard, else the period as 'after'.

    Columns: given_event, text_event, hazard_start, start, end, pre_days, post_days.
    """
    given, text, hazard = F.col("given_event"), F.col("text_event"), F.col("hazard_start")
    span = F.greatest(F.datediff("end", "start"), F.lit(1))
    known = F.coalesce(given, text, hazard)
    return requests.select(
        "*", F.coalesce(known, F.col("start")).alias("event_date"),
        F.when(known.isNotNull(), F.col("pre_days")).otherwise(F.greatest("pre_days", span)).alias("event_pre"),
        F.when(known.isNotNull(), F.col("post_days")).otherwise(span).alias("event_post"),
        F.when(given.isNotNull(), "given").when(text.isNotNull(), "text").when(hazard.isNotNull(), "hazard").otherwise("period").alias("provenance"))


def nearest_hazard(areas: DataFrame, hazards: DataFrame, radius: float = V.HAZARD_RADIUS_DEG) -> DataFrame:
    """Nearest hazard of the wanted code within `radius` planar degrees of an area's centre, dated inside its period.

    Both sides are put on a grid of `radius`-degree squares; an area looks at the nine squares around its centre, so the
    join is an equi-join on (code, square).  Distances are compared after rounding to two decimals, as they are reported.
    Hazards of one place and day are added up first, and areas of one centre and period are asked once.
    """
    cell = lambda c: F.floor(c / radius).cast("int")
    question = ["code", "cx", "cy", "start", "end"]
    seen = (areas.select(*question).distinct().withColumn("_gx", F.explode(F.array(*[cell(F.col("cx")) + k for k in (-1, 0, 1)])))
            .withColumn("_gy", F.explode(F.array(*[cell(F.col("cy")) + k for k in (-1, 0, 1)]))))
    placed = (hazards.groupBy("code", "lon", "lat", "hazard_start").agg(F.min(F.struct("hazard_id", "hazard_name")).alias("h"), F.count("*").alias("n"))
              .withColumns({"_gx": cell(F.col("lon")), "_gy": cell(F.col("lat"))}))
    dist = F.sqrt(F.pow(F.col("lon") - F.col("cx"), 2) + F.pow(F.col("lat") - F.col("cy"), 2))
    near = (seen.join(placed, ["code", "_gx", "_gy"]).withColumn("_dist", dist)
            .where((F.col("_dist") <= radius) & F.col("hazard_start").between(F.col("start"), F.col("end"))))
    best = F.min(F.struct(F.bround("_dist", 2).alias("distance_deg"), "h.hazard_id", "h.hazard_name", "hazard_start"))
    answers = near.groupBy(*question).agg(best.alias("b"), F.sum("n").alias("n"))
    # an area of several rows takes the best of all
    return areas.select("area_id", *question).join(answers, question).groupBy("area_id").agg(
        F.min("b").alias("b"), F.sum("n").alias("n_near")).select("area_id", "b.*", "n_near")


def refreshed(requests: DataFrame, today: Column) -> DataFrame:
    """Requests whose end lies before today, extended to today; the ledger's gap join then finds only what is new."""
    return requests.where(F.col("end") < today).withColumn("old_end", F.col("end")).withColumn("end", today)

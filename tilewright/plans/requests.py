"""What happens to the plans of a request as a whole: fallbacks, complements, verdict summaries and attention lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say
from tilewright.functions import scalars as S, verdicts as E
from tilewright.operators.resolve import covers_some

_PICK = "array<struct<plan_pos:int,source_id:string,need_key:string,alternative:string>>"


def _assign(steps: DataFrame, planned: DataFrame, one_per_plan: bool) -> DataFrame:
    """Sequential choice per request: each step takes its first candidate that no plan uses yet, and adds it.

    steps: request_id, plan_pos, need_pos, source_id, need_key, options (candidate ids in rank order);
    planned: request_id, planned (ids).  A request has at most one step per (theme, mode), so the fold is short.
    """
    fields = ("plan_pos", "need_pos", "source_id", "need_key", "options")
    per = (steps.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("steps")).join(planned, "request_id"))
    start = F.struct(F.col("planned").alias("planned"), F.array().cast(_PICK).alias("out"))

    def step(acc, s):
        free = F.filter(s["options"], lambda o: ~F.array_contains(acc["planned"], o))
        done = F.exists(acc["out"], lambda o: o["plan_pos"] == s["plan_pos"]) if one_per_plan else F.lit(False)
        take = (F.size(free) > 0) & ~done
        pick = F.struct(s["plan_pos"].cast("int").alias("plan_pos"), s["source_id"].alias("source_id"), s["need_key"].alias("need_key"), F.get(free, F.lit(0)).alias("alternative"))
        return F.struct(F.when(take, F.array_append(acc["planned"], F.get(free, F.lit(0)))).otherwise(acc["planned"]).alias("planned"),
                        F.when(take, F.array_append(acc["out"], pick)).otherwise(acc["out"]).alias("out"))

    folded = per.select("request_id", F.aggregate("steps", start, step).alias("r"))
    return folded.select("request_id", F.posexplode("r.out").alias("added_pos", "p")).select("request_id", "added_pos", "p.*")


def planned_sources(plans: DataFrame) -> DataFrame:
    """Ids already planned per request (bounded by the registry)."""
    return plans.groupBy("request_id").agg(F.collect_set("source_id").alias("planned"))


def fallbacks(plans: DataFrame, windows: DataFrame, needs: DataFrame, planned: DataFrame) -> DataFrame:
    """Cloud-independent alternative for every need of an optical plan with infeasible windows.

    plans: request_id, plan_pos, source_id, planner; windows: request_id, plan_pos, label, verdict;
    needs: request_id, plan_pos, need_pos, need_key, candidates (array of structs id, cloud_dependent, series, stac).
    """
    bad = windows.where("verdict = 'infeasible'").groupBy("request_id", "plan_pos").agg(F.array_sort(F.collect_list("label")).alias("bad"))
    hit = plans.where("planner = 'optical'").join(bad, ["request_id", "plan_pos"])
    steps = hit.join(needs, ["request_id", "plan_pos"]).withColumn("options", F.transform(F.filter(
        "candidates", lambda c: ~c["cloud_dependent"] & c["series"] & c["stac"]), lambda c: c["id"]))
    return _assign(steps, planned, one_per_plan=False).join(bad, ["request_id", "plan_pos"])


def gap_spans(windows: DataFrame) -> DataFrame:
    """First and last day of the windows outside a source's record, with their labels."""
    return windows.where("verdict = 'out-of-range'").groupBy("request_id", "plan_pos").agg(
        F.min("w_start").alias("g_start"), F.max("w_end").alias("g_end"), F.array_sort(F.collect_list("label")).alias("gap"))


def complements(plans: DataFrame, windows: DataFrame, needs: DataFrame, planned: DataFrame, sources: DataFrame) -> DataFrame:
    """Next candidate that covers the gap of a plan; one per plan, for the first need that has one."""
    gaps = gap_spans(windows)
    steps = plans.join(gaps, ["request_id", "plan_pos"]).join(needs, ["request_id", "plan_pos"])
    one = steps.select("request_id", "plan_pos", "need_pos", "source_id", "need_key", "g_start", "g_end", F.posexplode("candidates").alias("rank", "c")).where("c.series AND c.stac")
    fits = one.join(sources.select(F.col("id").alias("_id"), F.col("temporal").alias("_t")), F.col("c.id") == F.col("_id")).where(
        covers_some(F.col("_t"), F.col("g_start").cast("string"), F.col("g_end").cast("string")))
    opts = fits.groupBy("request_id", "plan_pos", "need_pos", "source_id", "need_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("c.id").alias("id")))), lambda x: x["id"]).alias("options"))
    return _assign(opts, planned, one_per_plan=True).join(gaps, ["request_id", "plan_pos"])


def keep_gap_windows(complement_windows: DataFrame, gap_windows: DataFrame) -> DataFrame:
    """Only the windows the primary plan cannot serve."""
    return complement_windows.join(gap_windows.where("verdict = 'out-of-range'").select("request_id", "plan_pos", "label"), ["request_id", "plan_pos", "label"], "left_semi")


def _first_windows(bad: DataFrame, entry: Column, first: int) -> DataFrame:
    """First windows by date and their number.  A plan has one window per month or year of its period."""
    return bad.groupBy("plan_id", "source_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, first).alias("top"), F.count("*").alias("n"))


def attention(windows: DataFrame, filled: DataFrame, needs: DataFrame | None = None, complements: DataFrame | None = None, first: int = 3) -> DataFrame:
    """What a user should look at per plan: its first bad windows, how many more there are, and what stays uncovered.

    windows: plan_id, source_id, label, w_start, verdict, verdict_text; filled: plan_id, label of gap windows that a complement serves.
    needs: plan_id, theme, temporal, named before what stays uncovered; complements: plan_id of plans that fill another's gaps, which are
    reported with that one.
    """
    if complements is not None:
        windows = windows.join(complements.select("plan_id").distinct(), "plan_id", "left_anti")
    bad = windows.where(F.col("verdict").isin("infeasible", "incomplete", "feasible-composite"))
    entry = F.struct("w_start", "label", "verdict", "verdict_text")
    top = _first_windows(bad, entry, first)
    shown = top.select("plan_id", "source_id", F.explode("top").alias("t")).select(
        "plan_id", "source_id", F.replace("t.verdict", F.lit("feasible-"), F.lit("")).alias("level"), F.concat_ws(": ", "t.label", "t.verdict_text").alias("text"))
    more = top.where(F.col("n") > first).select("plan_id", "source_id", F.lit("incomplete").alias("level"), say(
        "more windows", F.col("n") - first).alias("text"))
    open_ = windows.where("verdict = 'out-of-range'").join(filled.select("plan_id", "label"), ["plan_id", "label"], "left_anti")
    uncovered = open_.groupBy("plan_id", "source_id").agg(F.collect_set(F.substring("label", 1, 4).cast("int")).alias("ys")).select(
        "plan_id", "source_id", F.lit("uncovered").alias("level"), say("uncovered", S.year_runs(F.col("ys"))).alias("text"))
    if needs is not None:
        # the needs of a plan are bounded by the vocabulary
        named = needs.groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("theme", F.lit("/"), "temporal"))), ", ").alias("for"))
        uncovered = uncovered.join(named, "plan_id", "left").select(
            "plan_id", "source_id", "level", F.when(F.col("for").isNull(), F.col("text")).otherwise(F.concat("for", F.lit(": "), "text")).alias("text"))
    return shown.unionByName(more).unionByName(uncovered)


def verdict_histogram(windows: DataFrame, *keys: str) -> DataFrame:
    """Counts per verdict and a summary: up to four windows each by name, more as counts in fixed order and the span of labels."""
    counts = windows.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in V.VERDICTS], F.count("*").alias("_n"),
                                        F.min(F.struct("w_start", "label"))["label"].alias("_first"), F.max(F.struct("w_start", "label"))["label"].alias("_last"))
    parts = [F.when(F.col(f"`{v}`") > 0, F.concat(F.lit(v.replace("feasible-", "") + "×"), F.col(f"`{v}`").cast("string"))) for v in V.VERDICTS]
    span = F.concat(F.concat_ws(" ", *parts), F.lit("  ("), "_first", F.lit("…"), "_last", F.lit(")"))
    few = windows.join(counts.where("_n <= 4").select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "w_start", "label", F.replace("verdict", F.lit("feasible-")).alias("v")))).alias("_few"))
    named = F.array_join(F.transform("_few", lambda w: F.concat(w["label"], F.lit("="), w["v"])), ", ")
    return counts.join(few, list(keys), "left").withColumn("summary", F.when(F.col("_n") > 4, span).otherwise(named)).drop("_n", "_first", "_last", "_few")


def worst_verdict(windows: DataFrame, *keys: str) -> DataFrame:
    return windows.groupBy(*keys).agg(E.severity_name(F.max(E.severity(F.col("verdict")))).alias("worst"))


def year_runs(windows: DataFrame, *keys: str) -> DataFrame:
    """Runs of consecutive years as text, by the gaps-and-islands method.  windows: keys…, label (starts with the year)."""
    years = windows.select(*keys, F.substring("label", 1, 4).cast("int").alias("y")).distinct()
    # distinct years per key are few, whatever the number of windows
    return years.groupBy(*keys).agg(F.collect_list("y").alias("ys")).select(*keys, S.year_runs(F.col("ys")).alias("runs"))


def why_lines(plans: DataFrame, needs: DataFrame) -> DataFrame:
    """One sentence per need of a plan, and one per plan that was added automatically.

    plans: plan_id, source_id, fallback_for, fallback_windows ARRAY, complement_for, gap, filled; needs: plan_id, theme, temporal, priority, why.
    """
    a = needs.join(plans.select("plan_id", "source_id"), "plan_id").select("plan_id", F.concat(
        F.col("theme"), F.lit("/"), F.col("temporal"), F.lit(" ("), F.col("priority"), F.lit(") ← "), F.col("source_id"), F.lit(": "), F.col("why")).alias("line"))
    w = F.col("fallback_windows")
    b = plans.where(F.col("fallback_for").isNotNull()).select("plan_id", F.concat(
        say("fallback", F.col("fallback_for"), F.array_join(F.slice(w, 1, 4), ", ")), F.when(F.size(w) > 4, say("and more", F.size(w) - 4)).otherwise("")).alias("line"))
    c = plans.where(F.col("complement_for").isNotNull()).select("plan_id", say(
        "complement", F.col("complement_for"), F.col("gap"), F.coalesce(F.nullif("filled", F.lit("")), F.lit("none of them"))).alias("line"))
    return a.unionByName(b).unionByName(c)


def all_plans(primary: DataFrame, *added: DataFrame) -> DataFrame:
    for a in added:
        primary = primary.unionByName(a, allowMissingColumns=True)
    return primary


def softened(unmet: DataFrame, plans_needs: DataFrame) -> DataFrame:
    """Unmet needs whose theme another plan of the request supplies in another form say so."""
    met = plans_needs.groupBy("request_id").agg(F.collect_set("theme").alias("_themes"))
    j = unmet.join(met, "request_id", "left")
    soft = say("other form", F.col("temporal"), F.col("theme"))
    return j.withColumn("text", F.when(F.coalesce(F.array_contains("_themes", F.col("theme")), F.lit(False)), soft).otherwise(F.col("why"))).drop("_themes")


def estimate_label(n_assets: Column, present: Column, from_library: Column, known: Column, unknown: Column, to_fetch: Column) -> Column:
    """The size column of a request table: have, library, unknown, live or the bytes."""
    return (F.when((n_assets > 0) & (present == n_assets), "have").when((n_assets > 0) & (present + from_library == n_assets), "library")
            .when(known & (unknown > 0) & (to_fetch == 0), "unknown").when(known, F.concat(F.when(unknown > 0, "≥").otherwise(""), S.size_text(to_fetch))).otherwise("live"))

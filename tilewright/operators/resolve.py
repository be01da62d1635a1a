"""Matching needs to ranked sources, with the reasons and the explanation of unmet needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import say


def covers_box(s_global: Column, s_box: Column, s_iso3: Column, box: Column, iso3: Column) -> Column:
    """Global, box overlap (closed), or country list; an unknown country passes a country list."""
    by_box = (box["maxx"] >= s_box["minx"]) & (box["minx"] <= s_box["maxx"]) & (box["maxy"] >= s_box["miny"]) & (box["miny"] <= s_box["maxy"])
    by_country = iso3.isNull() | F.array_contains(s_iso3, iso3)
    return F.when(s_global, True).when(s_box.isNotNull(), by_box).when(s_iso3.isNotNull(), by_country).otherwise(False)


def covers_some(temporal: Column, start: Column, end: Column) -> Column:
    """Any overlap, by comparing text up to the month; an open end means ongoing."""
    frm = F.coalesce(temporal["from"], F.lit("0000"))
    inside = (frm <= F.substring(end, 1, 7)) & (temporal["to"].isNull() | (temporal["to"] >= F.substring(start, 1, 7)))
    return (temporal["type"] == "static") | inside


def covers_all(temporal: Column, start: Column, end: Column) -> Column:
    frm = F.coalesce(temporal["from"], F.lit("0000"))
    inside = (frm <= F.substring(start, 1, 7)) & (temporal["to"].isNull() | (temporal["to"] >= F.substring(end, 1, 7)))
    return (temporal["type"] == "static") | inside


def shape_fits(need_temporal: Column, shape: Column) -> Column:
    return F.when(need_temporal == "static", shape.isin("layer", "query")).otherwise(shape == "series")


def pairs(needs: DataFrame, sources: DataFrame) -> DataFrame:
    """Needs with the sources of their theme that fit by shape, place and kind; needs without any are kept with null source.

    An equi-join on the exploded theme; the registry is a curated list (tens of rows), so a need meets a handful of rows.
    needs: request_id, theme, temporal, start, end (text), box, iso3, area_km2, prefer_cloud_independent.
    """
    s = sources.withColumn("s_theme", F.explode("themes")).select("s_theme", F.struct(
        F.col("registry_pos").alias("pos"), "id", "name", "kind", "shape", "temporal", "resolution_m", "analysis_ready", "cloud_dependent", "license",
        "needs_login", "planner", "driver", "cov_global", "cov_box" if "cov_box" in sources.columns else F.col("cov_bbox").alias("cov_box"), "cov_iso3").alias("s"))
    fits = ((F.col("theme") == F.col("s_theme")) & shape_fits(F.col("temporal"), F.col("s.shape")) & (F.col("s.kind") != "event")
            & covers_box(F.col("s.cov_global"), F.col("s.cov_box"), F.col("s.cov_iso3"), F.col("box"), F.col("iso3")))
    return needs.join(s, fits, "left").drop("s_theme")


def candidates(needs: DataFrame, sources: DataFrame, logged_in: bool = False) -> DataFrame:
    """One row per need with its candidates in rank order and the sources that only miss the period.

    Rank: downloadable first, whole period, analysis-ready, cloud preference, raster, resolution, registry order.
    A need has at most as many candidates as the registry has rows.
    """
    static = F.col("temporal") == "static"
    some = static | covers_some(F.col("s.temporal"), F.col("start"), F.col("end"))
    full = static | covers_all(F.col("s.temporal"), F.col("start"), F.col("end"))
    flag = lambda c: F.when(c, 0).otherwise(1)
    prefers = F.coalesce("prefer_cloud_independent", F.lit(False))
    login_ok = F.lit(True) if logged_in else ~F.col("s.needs_login")
    reasons = F.array_compact(F.array(
        say("theme", F.col("theme"), F.col("s.shape")),
        F.when(~full, say("part of period", F.coalesce("s.temporal.from", F.lit("")), F.coalesce("s.temporal.to", F.lit("now")))),
        F.when(F.col("s.analysis_ready"), F.lit("analysis-ready")),
        F.when(prefers & ~F.col("s.cloud_dependent"), say("cloud-independent")),
        F.when(F.col("s.resolution_m") > 0, F.concat(F.regexp_replace(F.col("s.resolution_m").cast("string"), r"\.0$", ""), F.lit(" m"))),
        F.concat(F.lit("licence: "), F.col("s.license")),
        F.when(F.col("s.needs_login"), say("has login" if logged_in else "needs login"))))
    cand = F.when(F.col("s").isNotNull() & some, F.struct(
        flag(login_ok).alias("r1"), flag(full).alias("r2"), flag(F.col("s.analysis_ready")).alias("r3"), flag(~(prefers & F.col("s.cloud_dependent"))).alias("r4"),
        flag(F.col("s.kind") == "raster").alias("r5"), F.coalesce("s.resolution_m", F.lit(1e9)).alias("r6"), F.col("s.pos").alias("pos"), F.col("s.id").alias("id"),
        F.col("s.name").alias("name"), F.col("s.cloud_dependent").alias("cloud_dependent"),
        (F.col("s.shape") == "series").alias("series"), (F.col("s.driver") == "stac").alias("stac"),
        ((F.col("s.shape") == "series") & F.coalesce(F.col("s.planner").isin("optical", "sar"), F.lit(False))).alias("scene"), login_ok.alias("login_ok"), reasons.alias("reasons")))
    out = F.when(F.col("s").isNotNull() & ~some, F.struct(F.col("s.pos").alias("pos"), F.col("s.name").alias("name"), F.col("s.temporal.from").alias("from"), F.col("s.temporal.to").alias("to")))
    keys = ["request_id", "theme", "temporal"]
    keep = [F.first(c).alias(c) for c in needs.columns if c not in keys]
    return pairs(needs, sources).groupBy(*keys).agg(
        *keep, F.sort_array(F.collect_list(cand)).alias("candidates"), F.min(out).alias("outside"))


def ranked_sources(needs: DataFrame, sources: DataFrame, logged_in: bool = False) -> DataFrame:
    """(need, rank, source) rows, ranks from 1: the alternatives of every need."""
    c = candidates(needs, sources, logged_in)
    return c.select("request_id", "theme", "temporal", F.posexplode("candidates").alias("_r", "c")).select(
        "request_id", "theme", "temporal", (F.col("_r") + 1).alias("rank"), F.col("c.id").alias("source_id"), F.array_join("c.reasons", "; ").alias("reasons"))


def resolve(needs: DataFrame, sources: DataFrame, logged_in: bool = False, scene_limit: float = V.SCENE_AREA_LIMIT_KM2) -> DataFrame:
    """Chosen source, candidates and unmet class of every need.

    An `override` column, where present, names a source that is taken without the candidate checks; an unknown name is ignored.
    """
    c = candidates(needs, sources, logged_in).withColumn("too_big", F.coalesce(F.col("area_km2") > scene_limit, F.lit(False)))
    usable = F.filter("candidates", lambda x: x["login_ok"] & ~(F.col("too_big") & x["scene"]))
    c = c.withColumn("first_usable", F.get(usable, F.lit(0))["id"])
    if "override" in needs.columns:
        known = sources.select(F.col("id").alias("override"), F.lit(True).alias("_known"))
        c = c.join(known, "override", "left").withColumn("chosen", F.when(F.col("_known"), F.col("override")).otherwise(F.col("first_usable"))).drop("_known")
    else:
        c = c.withColumn("chosen", F.col("first_usable"))
    n = F.size("candidates")
    all_scenes = F.forall("candidates", lambda x: x["scene"])
    unmet = (F.when(F.col("chosen").isNotNull(), F.lit(None).cast("string"))
             .when((n > 0) & F.col("too_big") & all_scenes, "too large").when(n > 0, "login").when(F.col("outside").isNotNull(), "outside period").otherwise("none"))
    first_name = F.get("candidates", F.lit(0))["name"]
    span = F.concat(F.coalesce("outside.from", F.lit("")), F.lit(" to "), F.coalesce("outside.to", F.lit("now")))
    text = (F.when(F.col("unmet") == "too large", say("too large", first_name, F.lit(f"{scene_limit:,.0f}")))
            .when(F.col("unmet") == "login", say("login", first_name))
            .when(F.col("unmet") == "outside period", say("outside period", F.col("outside.name"), span, F.substring("start", 1, 7), F.substring("end", 1, 7), span))
            .when(F.col("unmet") == "none", say("no source", F.col("theme"), F.col("temporal"))))
    return (c.withColumn("unmet", unmet).withColumn("unmet_text", text)
            .withColumn("alternatives", F.transform("candidates", lambda x: x["id"])).drop("first_usable", "outside", "too_big"))


def plan_groups(resolved: DataFrame, has_event: Column, sources: DataFrame, scene_limit: float = V.SCENE_AREA_LIMIT_KM2) -> tuple[DataFrame, DataFrame]:
    """Needs grouped into plans by (source, temporal class), and the needs left unmet with the sentence that says why.

    Scene-by-scene sources make no plan for an area above the limit, also where an override names one.
    """
    scenes = sources.where((F.col("shape") == "series") & F.col("planner").isin("optical", "sar")).select(F.col("id").alias("chosen"), F.col("name").alias("_scene"))
    r = resolved.join(scenes, "chosen", "left")
    no_date = (F.col("temporal") == "pair") & ~has_event
    too_large = F.col("_scene").isNotNull() & F.coalesce(F.col("area_km2") > scene_limit, F.lit(False))
    met = r.where(F.col("chosen").isNotNull() & ~no_date & ~too_large)
    plans = met.groupBy("request_id", F.col("chosen").alias("source_id"), "temporal").agg(
        F.array_sort(F.collect_list("theme")).alias("themes"), F.count("*").alias("n_needs"))
    why = (F.when(F.col("chosen").isNull(), F.col("unmet_text")).when(no_date, "needs event date")
           .otherwise(say("scenes too large", F.col("_scene"), F.format_string("%,d", F.bround("area_km2", 0).cast("bigint")), F.lit(f"{scene_limit:,.0f}"))))
    unmet = r.where(F.col("chosen").isNull() | no_date | too_large).select("request_id", "theme", "temporal", why.alias("why"))
    return plans, unmet

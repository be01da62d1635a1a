"""Registry of sources and question rules as DataFrames, with their validation as violation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright import vocab as V
from tilewright.functions import scalars as S
from tilewright.sources.registry_rows import RULES, SOURCES

SOURCE_SCHEMA = """registry_pos INT, id STRING, name STRING, themes ARRAY<STRING>, kind STRING, shape STRING, resolution_m DOUBLE,
 temporal STRUCT<type:STRING,`from`:STRING,`to`:STRING,revisit_days:INT>, cov_global BOOLEAN, cov_iso3 ARRAY<STRING>,
 cov_bbox STRUCT<minx:DOUBLE,miny:DOUBLE,maxx:DOUBLE,maxy:DOUBLE>, license STRING, analysis_ready BOOLEAN, cloud_dependent BOOLEAN,
 description STRING, driver STRING, provider STRING, collection STRING, mode STRING, url STRING, urls MAP<STRING,STRING>, auth STRING,
 explicit_planner STRING, group_by ARRAY<STRING>, group_from_id STRING, assets MAP<STRING,ARRAY<STRING>>, default_assets ARRAY<STRING>,
 theme_assets MAP<STRING,ARRAY<STRING>>, query MAP<STRING,STRING>, geometry STRING, max_area_km2 DOUBLE, tile_deg INT, nodata DOUBLE,
 event_codes MAP<STRING,STRING>"""

RULE_SCHEMA = """rule_pos INT, id STRING, title STRING, keywords ARRAY<STRING>, event_type STRING, default_years INT, examples ARRAY<STRING>,
 needs ARRAY<STRUCT<theme:STRING,temporal:STRING,priority:STRING,why:STRING,prefer_cloud_independent:BOOLEAN>>"""


def source_row(pos: int, s: dict) -> tuple:
    """One registry entry with its polymorphic coverage split into three typed columns."""
    a, c = s["access"], s["coverage"]
    is_box = isinstance(c, (list, tuple)) and len(c) == 4 and all(isinstance(v, (int, float)) for v in c)
    t = s["temporal"]
    return (pos, s["id"], s["name"], s["themes"], s["kind"], s["shape"], s["resolution_m"],
            (t["type"], t["from"], t["to"], t["revisit_days"]), c == "global",
            list(c) if isinstance(c, (list, tuple)) and not is_box else None, tuple(float(v) for v in c) if is_box else None,
            s["license"], bool(s["analysis_ready"]), bool(s["cloud_dependent"]), s["description"], a["driver"], a.get("provider"),
            a.get("collection"), a.get("mode"), a.get("url"), a.get("urls"), a.get("auth"), a.get("planner"), a.get("group_by"),
            a.get("group_from_id"), a.get("assets"), a.get("default_assets"), a.get("theme_assets"), a.get("query"), a.get("geometry"),
            a.get("max_area_km2"), a.get("tile_deg"), a.get("nodata"), a.get("types"))


def with_derived(sources: DataFrame) -> DataFrame:
    """Planner, yearly flag and login flag of every source."""
    return (sources
            .withColumn("planner", S.planner(F.col("shape"), F.col("driver"), F.col("explicit_planner"), F.col("cloud_dependent"),
                                             F.col("themes"), F.col("group_by")))
            .withColumn("yearly", S.yearly(F.col("temporal.revisit_days")))
            .withColumn("needs_login", F.coalesce(F.col("auth") == "earthdata", F.lit(False))))


def load_sources(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """Sources with their derived columns.  The rows came from the driver, so joins send them back to the tasks; a shuffle by source
    would deal all requests to as many tasks as there are sources."""
    rows = SOURCES if rows is None else rows
    return with_derived(spark.createDataFrame([source_row(i, s) for i, s in enumerate(rows)], SOURCE_SCHEMA)).hint("broadcast")


def load_rules(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    rows = RULES if rows is None else rows
    need = ("theme", "temporal", "priority", "why", "prefer_cloud_independent")
    return spark.createDataFrame(
        [(i, r["id"], r["title"], r["keywords"], r["event_type"], r["default_years"], r["examples"],
          [tuple(n[k] for k in need) for n in r["needs"]]) for i, r in enumerate(rows)], RULE_SCHEMA)


def rule_needs(rules: DataFrame) -> DataFrame:
    """One row per need of a rule, in rule order."""
    return rules.select("rule_pos", F.col("id").alias("rule"), F.posexplode("needs").alias("need_pos", "n")).select(
        "rule_pos", "rule", "need_pos", "n.theme", "n.temporal", "n.priority", "n.why", "n.prefer_cloud_independent")


def source_violations(sources: DataFrame) -> DataFrame:
    """(id, problem) rows; an empty result means the registry is valid."""
    required = ["id", "name", "themes", "kind", "shape", "license", "description", "driver"]
    problems = F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required],
        F.when(F.size(F.array_except(F.coalesce("themes", F.array().cast("array<string>")), F.lit(list(V.THEMES)))) > 0, "unknown theme"),
        F.when(~F.col("kind").isin(*V.KINDS), "bad kind"),
        F.when(~F.col("shape").isin(*V.SHAPES), "bad shape"),
        F.when(~F.col("driver").isin(*V.DRIVERS), "bad driver"),
        F.when(~F.col("explicit_planner").isin(*V.PLANNERS), "unknown planner")))
    rowwise = sources.select("id", F.explode(problems).alias("problem"))
    duplicates = sources.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return rowwise.unionByName(duplicates)


def need_violations(needs: DataFrame) -> DataFrame:
    """(rule, theme, problem) rows for needs outside the vocabularies."""
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("theme").isin(*V.THEMES), F.lit(False)), "unknown theme"),
        F.when(~F.coalesce(F.col("temporal").isin(*V.TEMPORAL_MODES), F.lit(False)), "unknown temporal mode"),
        F.when(~F.coalesce(F.col("priority").isin(*V.PRIORITIES), F.lit(False)), "unknown priority")))
    return needs.select("rule", "theme", F.explode(problems).alias("problem"))


def check_keywords(rules: DataFrame) -> DataFrame:
    """Evaluates every keyword once against a fixed word, so that a pattern that does not compile stops the load."""
    return rules.select("id", F.explode("keywords").alias("keyword")).withColumn("compiles", F.call_function(
        "rlike", F.lit("probe"), F.col("keyword")).isNotNull())


def by_theme(sources: DataFrame, theme) -> DataFrame:
    return sources.where(F.array_contains("themes", theme))


def declared_assets_missing(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Static registry check: assets a source declares that its first catalogue item does not have."""
    first = items.groupBy("source_id").agg(F.min_by("assets", "item_id").alias("first_assets"), F.count("*").alias("n_items"))
    joined = sources.join(first, sources.id == first.source_id, "left")
    return joined.select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"),
                         F.array_except(F.map_keys("assets"), F.coalesce(F.map_keys("first_assets"), F.array().cast("array<string>"))).alias("missing"))


def check_totals(results: DataFrame) -> DataFrame:
    """Reachable and total sources of a check run with a boolean `ok` per source."""
    return results.agg(F.count_if("ok").alias("reachable"), F.count("*").alias("total"))

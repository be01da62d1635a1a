"""The acquisition record of a project as ordered text lines; every section is its own small relational query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions import scalars as S, verdicts as E
from tilewright.operators.ledger import still_missing

ORDER = ("project_id", "request_id", "plan_id", "part", "k")


def _lines(df: DataFrame, part: int, line: Column, k: Column | None = None, request: bool = True, plan: bool = True) -> DataFrame:
    """Lines with their place in the report: request and plan are empty where a section has none, so they sort first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.col("project_id"), (text("request_id") if request else F.lit("")).alias("request_id"), (text("plan_id") if plan else F.lit("")).alias("plan_id"),
                     F.lit(part).alias("part"), (F.lit("") if k is None else k.cast("string")).alias("k"), line.alias("line"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def header_lines(projects: DataFrame) -> DataFrame:
    """projects: project_id, name, objective, area_km2, country, start, end, epsg."""
    title = _lines(projects, 0, F.concat(F.lit("# "), F.col("name"), F.lit(" — data acquisition record")), request=False, plan=False)
    body = [F.concat(F.lit("- First ask: "), F.coalesce("objective", F.lit("(none)"))),
            F.concat(F.lit("- Area of interest: "), F.format_string("%,.0f", F.col("area_km2")), F.lit(" km² ("), F.coalesce("country", F.lit("country unknown")), F.lit(")")),
            F.concat(F.lit("- Period: "), F.col("start").cast("string"), F.lit(" → "), F.col("end").cast("string")),
            F.concat(F.lit("- Project CRS: EPSG:"), F.col("epsg").cast("string"))]
    for i, line in enumerate(body, 1):
        title = title.unionByName(_lines(projects, i, line, request=False, plan=False))
    return title


def request_lines(requests: DataFrame, needs: DataFrame, chosen: DataFrame, unmet: DataFrame) -> DataFrame:
    """requests: project_id, request_id, ask, rules ARRAY; needs: …, need_key, priority, why; chosen: request_id, need_key, source_id; unmet: …, need_key, why."""
    head = _lines(requests, 10, F.concat(F.lit("## Request "), F.col("request_id").cast("string"), F.lit(" — “"), F.col("ask"), F.lit("”")), plan=False)
    rules = _lines(requests, 11, F.concat(F.lit("Matched rules: "), F.array_join("rules", ", "), F.lit(".")), plan=False)
    table = needs.join(chosen, ["request_id", "need_key"], "left")
    rows = _lines(table, 12, _row(F.col("need_key"), F.col("priority"), F.coalesce("source_id", F.lit("—")), F.col("why")), F.col("need_key"), plan=False)
    # unmet needs close a request, so they sort behind every plan
    last = unmet.withColumn("plan_id", F.lit("~"))
    return head.unionByName(rules).unionByName(rows).unionByName(_lines(last, 90, F.concat(F.lit("- "), F.col("need_key"), F.lit(": "), F.col("why")), F.col("need_key")))


def plan_lines(plans: DataFrame, windows: DataFrame, transfers: DataFrame) -> DataFrame:
    """plans: project_id, request_id, plan_id, source_id, source_name, license, status, n_assets, windowed_bytes, unknown;
    windows: plan_id, label, verdict, verdict_text; transfers: plan_id, item, asset, seq, status, path, bytes, valid_fraction, sha256, error, reused.
    """
    where = plans.select("project_id", "request_id", "plan_id")
    head = _lines(plans, 20, F.concat(F.lit("### "), F.col("source_name"), F.lit(" (`"), F.col("source_id"), F.lit("`)")))
    licence = _lines(plans, 21, F.concat(F.lit("- Licence: "), F.col("license")))
    size = _lines(plans, 22, F.concat(F.lit("- Plan `"), F.col("plan_id").cast("string"), F.lit("` — status **"), F.col("status"), F.lit("**; "), F.col("n_assets").cast("string"), F.lit(" files, estimated "),
                                      S.megabytes(F.col("windowed_bytes")), F.when(F.col("unknown") > 0, F.concat(F.lit(" (+"), F.col("unknown").cast("string"), F.lit(" of unknown size)"))).otherwise("")))
    win = _lines(windows.join(where, "plan_id"), 30, _row(F.col("label"), F.col("verdict"), F.col("verdict_text")), F.col("label"))
    log = transfers.join(where, "plan_id")
    ok = log.where("status = 'ok'")
    valid = F.when(F.col("valid_fraction").isNull(), "—").otherwise(E.percent(F.col("valid_fraction")))
    order = F.lpad(F.col("seq").cast("string"), 20, "0")
    files = _lines(ok, 40, _row(F.concat(F.lit("`"), F.col("path"), F.lit("`")), F.format_string("%,d", F.col("bytes")), valid, F.concat(F.lit("`"), F.substring("sha256", 1, 16), F.lit("…`")),
                                F.when(F.col("reused"), "re-clipped from your library").otherwise("downloaded")), order)
    empty = ok.where("valid_fraction = 0")
    n_empty = _lines(empty.groupBy("project_id", "request_id", "plan_id").agg(F.count("*").alias("n")), 50, F.concat(F.col("n").cast("string"), F.lit(
        " file(s) have no valid pixels over the area (cloud or no observation on that date); they are kept for completeness:")))
    empties = _lines(empty, 51, F.concat(F.lit("- `"), F.col("path"), F.lit("`")), order)
    fails = _lines(still_missing(transfers.select("plan_id", "item", "asset", "seq", "status", "error")).join(where, "plan_id"), 60, F.concat(
        F.lit("- "), F.col("item").cast("string"), F.lit(" "), F.col("asset"), F.lit(": "), F.col("error")), F.concat_ws("/", F.col("item").cast("string"), "asset"))
    out = head
    for part in (licence, size, win, files, n_empty, empties, fails):
        out = out.unionByName(part)
    return out


def catalogue_lines(items: DataFrame) -> DataFrame:
    """items: project_id, item, source, window, assets ARRAY.  These sort behind every request."""
    last = items.withColumn("request_id", F.lit("~"))
    return _lines(last, 95, _row(F.col("item").cast("string"), F.col("source"), F.col("window"), F.array_join("assets", ", ")), F.col("item"), plan=False)


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*ORDER)

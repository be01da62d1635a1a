"""Acquisition records and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table
from queries.library import TR_SQL, transfers
from tilewright.operators import report as P
from tilewright.sources import sinks as K


def _sections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    requests = o.select((F.col("o_custkey") % 20).alias("project_id"), k.alias("request_id"), F.concat(F.lit("ask "), k.cast("string")).alias("ask"), F.array(F.lit("flood"), F.lit("rainfall")).alias("rules"))
    needs = o.select((F.col("o_custkey") % 20).alias("project_id"), k.alias("request_id"), F.explode(F.array(F.lit("water:static"), F.lit("sar:pair"))).alias("need_key"), F.lit("required").alias("priority"), F.lit("because").alias("why"))
    chosen = o.where("o_orderkey % 3 <> 0").select(k.alias("request_id"), F.lit("sar:pair").alias("need_key"), F.lit("sentinel-1-rtc").alias("source_id"))
    unmet = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 20).alias("project_id"), k.alias("request_id"), F.lit("sar:pair").alias("need_key"), F.lit("none").alias("why"))
    return requests, needs, chosen, unmet


_PRED = "lpad(CAST(seq AS VARCHAR), 20, '0')"


@query("k8_j17_request_report", """WITH o AS (SELECT o_custkey % 20 AS project_id, CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey AS k FROM orders), n AS (SELECT o.*, x AS need_key FROM o, (VALUES ('water:static'), ('sar:pair')) t(x))
SELECT project_id, request_id, '' AS plan_id, 10 AS part, '' AS k, '## Request ' || request_id || ' — “ask ' || request_id || '”' AS line FROM o UNION ALL SELECT project_id, request_id, '', 11, '', 'Matched rules: flood, rainfall.' FROM o
UNION ALL SELECT project_id, request_id, '', 12, need_key, '| ' || need_key || ' | required | ' || CASE WHEN need_key = 'sar:pair' AND k % 3 <> 0 THEN 'sentinel-1-rtc' ELSE '—' END || ' | because |' FROM n
UNION ALL SELECT project_id, request_id, '~', 90, 'sar:pair', '- sar:pair: none' FROM o WHERE k % 3 = 0""")
def request_report(spark, sf_dir):
    return P.request_lines(*_sections(spark, sf_dir)).select("project_id", "request_id", "plan_id", "part", "k", "line")


@query("k8_r5_plan_report", f"""WITH {TR_SQL}, p AS (SELECT DISTINCT plan_id FROM tr), t AS (SELECT *, CASE WHEN seq % 8 = 0 THEN NULL WHEN seq % 8 = 1 THEN 0.0 ELSE (seq % 8) / 8.0 END::DOUBLE AS vf FROM tr),
okk AS (SELECT DISTINCT plan_id, item, asset FROM tr WHERE status = 'ok'), f AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.plan_id, tr.item, tr.asset ORDER BY seq DESC) AS rn FROM tr LEFT JOIN okk USING (plan_id, item, asset) WHERE status <> 'ok' AND okk.plan_id IS NULL),
l AS (SELECT plan_id, 20 AS part, '' AS k, '### Source ' || CAST(plan_id AS VARCHAR) || ' (`s`)' AS line FROM p UNION ALL SELECT plan_id, 21, '', '- Licence: CC BY 4.0' FROM p
UNION ALL SELECT plan_id, 22, '', '- Plan `' || CAST(plan_id AS VARCHAR) || '` — status **complete**; 7 files, estimated 1,234.6 MB' || CASE WHEN plan_id % 2 = 1 THEN ' (+1 of unknown size)' ELSE '' END FROM p
UNION ALL SELECT plan_id, 30, '2024-01', '| 2024-01 | incomplete | few |' FROM p
UNION ALL SELECT plan_id, 40, {_PRED}, '| `f/' || CAST(seq AS VARCHAR) || '` | ' || format('{{:,}}', bytes) || ' | ' || CASE WHEN vf IS NULL THEN '—' ELSE CAST(CAST(round_even(vf * 100, 0) AS BIGINT) AS VARCHAR) || '%' END || ' | `' || substr(sha256, 1, 16) || '…` | ' || CASE WHEN reused THEN 're-clipped from your library' ELSE 'downloaded' END || ' |' FROM t WHERE status = 'ok'
UNION ALL SELECT plan_id, 50, '', CAST(count(*) AS VARCHAR) || ' file(s) have no valid pixels over the area (cloud or no observation on that date); they are kept for completeness:' FROM t WHERE status = 'ok' AND vf = 0 GROUP BY plan_id
UNION ALL SELECT plan_id, 51, {_PRED}, '- `f/' || CAST(seq AS VARCHAR) || '`' FROM t WHERE status = 'ok' AND vf = 0
UNION ALL SELECT plan_id, 60, CAST(item AS VARCHAR) || '/' || asset, '- ' || CAST(item AS VARCHAR) || ' ' || asset || ': ' || error FROM f WHERE rn = 1)
SELECT plan_id % 5 AS project_id, CAST(plan_id % 20 AS VARCHAR) AS request_id, CAST(plan_id AS VARCHAR) AS plan_id, part, k, line FROM l""")
def plan_report(spark, sf_dir):
    t = transfers(spark, sf_dir).withColumn("path", F.concat(F.lit("f/"), F.col("seq").cast("string"))).withColumn(
        "valid_fraction", F.when(F.col("seq") % 8 == 0, F.lit(None).cast("double")).when(F.col("seq") % 8 == 1, F.lit(0.0)).otherwise((F.col("seq") % 8) / 8))
    p = t.select("plan_id").distinct().select(
        (F.col("plan_id") % 5).alias("project_id"), (F.col("plan_id") % 20).alias("request_id"), "plan_id", F.lit("s").alias("source_id"), F.concat(F.lit("Source "), F.col("plan_id").cast("string")).alias("source_name"),
        F.lit("CC BY 4.0").alias("license"), F.lit("complete").alias("status"), F.lit(7).alias("n_assets"), F.lit(1_234_560_000).alias("windowed_bytes"), (F.col("plan_id") % 2).alias("unknown"))
    w = p.select("plan_id", F.lit("2024-01").alias("label"), F.lit("incomplete").alias("verdict"), F.lit("few").alias("verdict_text"))
    return P.ordered(P.plan_lines(p, w, t)).select("project_id", "request_id", "plan_id", "part", "k", "line")


@query("k8_project_header", """WITH p AS (SELECT c_custkey AS project_id, c_name, c_mktsegment, CAST(round(c_acctbal) AS BIGINT) * 7 AS a FROM customer)
SELECT project_id, 0 AS part, '# ' || c_name || ' — data acquisition record' AS line FROM p UNION ALL SELECT project_id, 1, '- First ask: ' || CASE WHEN project_id % 4 = 0 THEN '(none)' ELSE c_mktsegment END FROM p
UNION ALL SELECT project_id, 2, '- Area of interest: ' || format('{:,}', a) || ' km² (' || CASE WHEN project_id % 2 = 0 THEN 'IND' ELSE 'country unknown' END || ')' FROM p
UNION ALL SELECT project_id, 3, '- Period: 2024-01-01 → 2024-12-31' FROM p UNION ALL SELECT project_id, 4, '- Project CRS: EPSG:32643' FROM p""")
def project_header(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("objective"), (F.round("c_acctbal").cast("bigint") * 7).cast("double").alias("area_km2"),
        F.when(F.col("c_custkey") % 2 == 0, "IND").alias("country"), F.lit("2024-01-01").alias("start"), F.lit("2024-12-31").alias("end"), F.lit(32643).alias("epsg"))
    return P.header_lines(c).select("project_id", "part", "line")


@query("k8_catalogue_lines", """SELECT l_suppkey % 10 AS project_id, CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS k, '| ' || CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) || ' | src | 2024-01 | nir, red |' AS line FROM lineitem""")
def catalogue_lines(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("project_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.lit("src").alias("source"), F.lit("2024-01").alias("window"), F.array(F.lit("nir"), F.lit("red")).alias("assets"))
    return P.catalogue_lines(i).select("project_id", "k", "line")


@query("k7_recipe_documents", """SELECT o_orderkey AS plan_id, '{"plan_id":' || CAST(o_orderkey AS VARCHAR) || ',"source":"s' || CAST(o_custkey % 5 AS VARCHAR) || '","step":"monthly"}' AS document FROM orders""")
def recipe_documents(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("source"), F.lit("monthly").alias("step"), F.lit("complete").alias("status"), F.lit("x").alias("detail"))
    return K.recipe_documents(p)


@query("k8_estimate_labels", """WITH p AS (SELECT o_orderkey AS id, o_orderkey % 7 AS n, o_orderkey % 5 AS pr, o_orderkey % 3 AS lib, o_orderkey % 11 <> 0 AS known, o_orderkey % 2 AS unk, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) * 1000 + 7 END AS b FROM orders)
SELECT id, CASE WHEN n > 0 AND pr = n THEN 'have' WHEN n > 0 AND pr + lib = n THEN 'library' WHEN known AND unk > 0 AND b = 0 THEN 'unknown' WHEN known THEN CASE WHEN unk > 0 THEN '≥' ELSE '' END || CASE WHEN b >= 5e7 THEN format('{:.2f} GB', b / 1e9) ELSE format('{:.0f} MB', b / 1e6) END ELSE 'live' END AS label FROM p""")
def estimate_labels(spark, sf_dir):
    from tilewright.plans import requests as Q
    k = F.col("o_orderkey")
    b = F.when(k % 13 == 0, F.lit(0).cast("bigint")).otherwise(F.round("o_totalprice").cast("bigint") * 1000 + 7)
    return table(spark, sf_dir, "orders").select(k.alias("id"), Q.estimate_label(k % 7, k % 5, k % 3, k % 11 != 0, k % 2, b).alias("label"))

"""Needs to sources: keyword rules, union of needs, ranking, unmet reasons, fallbacks, complements, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table
from tilewright import vocab as V
from tilewright.functions import scalars as S, verdicts as E
from tilewright.operators import needs as N, resolve as R, windows as D
from tilewright.plans import layers as L, requests as Q
from tilewright.session import write_stage
from tilewright.sources import registry as G
from tilewright.sources.registry_rows import RULES, SOURCES


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _planner(s):
    a = s["access"]
    if s["shape"] != "series" or a["driver"] != "stac":
        return None
    return a.get("planner") or ("optical" if s["cloud_dependent"] else "sar" if "sar" in s["themes"] and a.get("group_by") == ["sat:relative_orbit"] else "products")


def _registry_sql():
    rows = []
    for pos, s in enumerate(SOURCES):
        box = s["coverage"] if isinstance(s["coverage"], list) else [None] * 4
        t = s["temporal"]
        for theme in s["themes"]:
            rows.append("(" + ", ".join(_lit(v) for v in (
                pos, s["id"], s["name"], theme, s["kind"], s["shape"], s["resolution_m"], t["type"], t["from"], t["to"], s["coverage"] == "global", *box,
                s["cloud_dependent"], s["access"].get("auth") == "earthdata", _planner(s), s["access"]["driver"])) + ")")
    return ("reg(pos, id, name, theme, kind, shape, res, ttype, frm, too, everywhere, bx0, by0, bx1, by1, cloud, login, planner, driver) AS (VALUES "
            + ",\n ".join(rows) + ")")


def _requests(spark, sf_dir):
    """Three needs per order, with a place, a period, a size and sometimes an override."""
    k = F.col("o_orderkey")
    themes = F.lit(list(V.THEMES))
    n = F.explode(F.array(*[F.struct(F.element_at(themes, ((k * 3 + i * 5) % 21 + 1).cast("int")).alias("theme"), F.element_at(
        F.lit(["static", "series", "pair"]), ((k + i) % 3 + 1).cast("int")).alias("temporal"), F.lit(i).alias("need_pos")) for i in range(3)])).alias("n")
    day = F.add_months(F.col("o_orderdate").cast("date"), ((k % 25) * 12).cast("int"))
    x, y = (F.col("o_custkey") % 340 - 170).cast("double"), (F.col("o_custkey") % 170 - 85).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("request_id"), n, day.cast("string").alias("start"), F.date_add(day, (k % 700).cast("int")).cast("string").alias("end"),
        F.struct(x.alias("minx"), y.alias("miny"), (x + 2).alias("maxx"), (y + 2).alias("maxy")).alias("box"), F.when(k % 3 == 0, "IND").alias("iso3"),
        (F.col("o_totalprice") * 0.5).alias("area_km2"), (k % 2 == 0).alias("prefer_cloud_independent"),
        F.when(k % 19 == 0, "sentinel-1-rtc").when(k % 19 == 1, "no-such-source").alias("override")).select(
        "request_id", "n.theme", "n.temporal", "n.need_pos", "start", "end", "box", "iso3", "area_km2", "prefer_cloud_independent", "override")


_THEME_SQL = "[" + ", ".join(_lit(t) for t in V.THEMES) + "]"
_NEED_SQL = _registry_sql() + f""",
need AS (SELECT o_orderkey AS request_id, i AS need_pos, {_THEME_SQL}[CAST((o_orderkey * 3 + i * 5) % 21 + 1 AS INT)] AS theme, ['static', 'series', 'pair'][CAST((o_orderkey + i) % 3 + 1 AS INT)] AS temporal,
 CAST(CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 25 AS INT)) AS DATE) AS VARCHAR) AS s,
 CAST(CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 25 AS INT)) AS DATE) + CAST(o_orderkey % 700 AS INT) AS VARCHAR) AS e,
 CAST(o_custkey % 340 - 170 AS DOUBLE) AS x, CAST(o_custkey % 170 - 85 AS DOUBLE) AS y, o_totalprice * 0.5 AS area, o_orderkey % 2 = 0 AS pref,
 CASE o_orderkey % 19 WHEN 0 THEN 'sentinel-1-rtc' END AS ovr FROM orders, range(3) t(i)),
fit AS (SELECT n.*, r.* EXCLUDE (theme), n.temporal = 'static' OR ttype = 'static' OR (frm <= substr(e, 1, 7) AND (too IS NULL OR too >= substr(s, 1, 7))) AS some_,
 n.temporal = 'static' OR ttype = 'static' OR (frm <= substr(s, 1, 7) AND (too IS NULL OR too >= substr(e, 1, 7))) AS full_
 FROM need n JOIN reg r ON r.theme = n.theme AND kind <> 'event' AND CASE WHEN n.temporal = 'static' THEN shape IN ('layer', 'query') ELSE shape = 'series' END
 AND (everywhere OR (x + 2 >= bx0 AND x <= bx1 AND y + 2 >= by0 AND y <= by1))),
cand AS (SELECT *, row_number() OVER (PARTITION BY request_id, theme, temporal ORDER BY login, NOT full_, pref AND cloud, kind <> 'raster', coalesce(res, 1e9), pos) AS rk FROM fit WHERE some_),
outs AS (SELECT request_id, theme, temporal, arg_min(name, pos) AS o_name, arg_min(coalesce(frm, '') || ' to ' || coalesce(too, 'now'), pos) AS o_span FROM fit WHERE NOT some_ GROUP BY 1, 2, 3),
usable AS (SELECT request_id, theme, temporal, arg_min(id, rk) AS id FROM cand WHERE NOT login AND NOT (area > 100000 AND shape = 'series' AND coalesce(planner IN ('optical', 'sar'), FALSE)) GROUP BY 1, 2, 3),
agg AS (SELECT request_id, theme, temporal, count(*) AS n, bool_and(shape = 'series' AND coalesce(planner IN ('optical', 'sar'), FALSE)) AS scenes, string_agg(id, ',' ORDER BY rk) AS alts, arg_min(name, rk) AS first_name FROM cand GROUP BY 1, 2, 3),
res AS (SELECT d.area, first_name, o_name, o_span, coalesce(d.area > 100000 AND coalesce(d.ovr, u.id) IN (SELECT id FROM reg WHERE shape = 'series' AND planner IN ('optical', 'sar')), FALSE) AS large, d.request_id, d.theme, d.temporal, d.need_pos, d.s, d.e, coalesce(d.ovr, u.id) AS chosen, coalesce(a.alts, '') AS alternatives,
 CASE WHEN coalesce(d.ovr, u.id) IS NOT NULL THEN NULL WHEN a.n > 0 AND d.area > 100000 AND a.scenes THEN 'too large' WHEN a.n > 0 THEN 'login' WHEN o_name IS NOT NULL THEN 'outside period' ELSE 'none' END AS unmet
 FROM need d LEFT JOIN usable u USING (request_id, theme, temporal) LEFT JOIN agg a USING (request_id, theme, temporal) LEFT JOIN outs USING (request_id, theme, temporal))"""


@query("w4_j20_ranked_sources", f"WITH {_NEED_SQL} SELECT request_id, theme, temporal, CAST(rk AS INT) AS rank, id AS source_id FROM cand")
def ranked(spark, sf_dir):
    return R.ranked_sources(_requests(spark, sf_dir), G.load_sources(spark)).drop("reasons")


@query("j1_f1_to_f4_t7_f15_resolution", f"WITH {_NEED_SQL} SELECT request_id, theme, temporal, chosen, alternatives, unmet FROM res")
def resolution(spark, sf_dir):
    r = R.resolve(_requests(spark, sf_dir), G.load_sources(spark))
    return r.select("request_id", "theme", "temporal", "chosen", F.array_join("alternatives", ",").alias("alternatives"), "unmet")


@query("f16_plan_groups", f"""WITH {_NEED_SQL} SELECT request_id, chosen AS source_id, temporal, CAST(count(*) AS BIGINT) AS n_needs, string_agg(theme, ',' ORDER BY theme) AS themes FROM res
 WHERE chosen IS NOT NULL AND NOT large AND NOT (temporal = 'pair' AND request_id % 2 = 1) GROUP BY 1, 2, 3""")
def plan_groups(spark, sf_dir):
    plans, _ = R.plan_groups(R.resolve(_requests(spark, sf_dir), G.load_sources(spark)), F.col("request_id") % 2 == 0, G.load_sources(spark))
    return plans.select("request_id", "source_id", "temporal", "n_needs", F.array_join("themes", ",").alias("themes"))


@query("u7_a25_unmet_needs", f"""WITH {_NEED_SQL}, un AS (SELECT request_id, theme, temporal, CASE WHEN chosen IS NULL THEN CASE unmet
   WHEN 'too large' THEN 'only scene-by-scene imagery (' || first_name || ') provides this, and the area is too large for it (limit 100,000 km²); name a smaller place'
   WHEN 'login' THEN 'available from ' || first_name || ' with a free NASA Earthdata token'
   WHEN 'outside period' THEN o_name || ' is published only from ' || o_span || ', which does not overlap ' || substr(s, 1, 7) || '…' || substr(e, 1, 7) || '; ask about a period within ' || o_span
   ELSE 'no registered source with theme ''' || theme || ''' for ' || temporal || ' data over this area/period' END
  WHEN temporal = 'pair' AND request_id % 2 = 1 THEN 'needs event date'
  ELSE (SELECT any_value(name) FROM reg WHERE reg.id = res.chosen) || ': the area (' || format('{{:,}}', CAST(round_even(area, 0) AS BIGINT)) || ' km²) is too large for scene-by-scene imagery (limit 100,000 km²); name a smaller place or use an area-wide product' END AS why
 FROM res WHERE chosen IS NULL OR large OR (temporal = 'pair' AND request_id % 2 = 1)),
met AS (SELECT DISTINCT request_id, theme FROM res WHERE chosen IS NOT NULL AND NOT large AND NOT (temporal = 'pair' AND request_id % 2 = 1))
SELECT u.request_id, u.theme, u.temporal, CASE WHEN m.theme IS NOT NULL THEN 'no ' || u.temporal || ' source for this period; ''' || u.theme || ''' is supplied in another form above' ELSE why END AS text
FROM un u LEFT JOIN met m USING (request_id, theme)""")
def unmet(spark, sf_dir):
    plans, un = R.plan_groups(R.resolve(_requests(spark, sf_dir), G.load_sources(spark)), F.col("request_id") % 2 == 0, G.load_sources(spark))
    return Q.softened(un, plans.select("request_id", F.explode("themes").alias("theme"))).select("request_id", "theme", "temporal", "text")


# ---- rules and needs -----------------------------------------------------------------------------------------------

ASKS_SQL = """asks AS (SELECT doc_id AS ask_id, CASE doc_id % 9 WHEN 0 THEN 'flood in Chitradurga in August ' || CAST(2000 + doc_id % 25 AS VARCHAR)
 WHEN 1 THEN 'NDVI from June to September ' || CAST(2000 + doc_id % 25 AS VARCHAR) || ' over Tumakuru' WHEN 2 THEN 'urban expansion of Bengaluru between 2005 and ' || CAST(2006 + doc_id % 19 AS VARCHAR)
 WHEN 3 THEN 'forest loss since ' || CAST(2000 + doc_id % 25 AS VARCHAR) WHEN 4 THEN 'drought during the ' || CAST(2000 + doc_id % 25 AS VARCHAR) || ' monsoon'
 WHEN 5 THEN 'flood on 2024-0' || CAST(1 + doc_id % 8 AS VARCHAR) || '-15 in Wayanad' WHEN 6 THEN 'road network of Mysuru'
 WHEN 7 THEN 'slope map of Coorg in ' || CAST(2000 + doc_id % 25 AS VARCHAR) ELSE text END AS text FROM documents)"""


def asks(spark, sf_dir):
    return (table(spark, sf_dir, "documents")).selectExpr("doc_id AS ask_id", """CASE doc_id % 9 WHEN 0 THEN concat('flood in Chitradurga in August ', 2000 + doc_id % 25)
 WHEN 1 THEN concat('NDVI from June to September ', 2000 + doc_id % 25, ' over Tumakuru') WHEN 2 THEN concat('urban expansion of Bengaluru between 2005 and ', 2006 + doc_id % 19)
 WHEN 3 THEN concat('forest loss since ', 2000 + doc_id % 25) WHEN 4 THEN concat('drought during the ', 2000 + doc_id % 25, ' monsoon')
 WHEN 5 THEN concat('flood on 2024-0', 1 + doc_id % 8, '-15 in Wayanad') WHEN 6 THEN 'road network of Mysuru' WHEN 7 THEN concat('slope map of Coorg in ', 2000 + doc_id % 25) ELSE text END AS text""")


def _portable(k: str) -> str:
    """Word boundaries as explicit classes, since RE2 knows only ASCII ones."""
    import re
    out = re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", k)
    return re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", out)


_RULE_SQL = "hits AS (" + " UNION ALL ".join(
    f"SELECT ask_id, {i} AS rule_pos, {_lit(r['id'])} AS rule FROM asks WHERE regexp_matches(text, {_lit('(?is)' + '|'.join('(?:' + _portable(k) + ')' for k in r['keywords']))})" for i, r in enumerate(RULES)) + ")"
_RN_SQL = "rn(rule_pos, rule, need_pos, theme, temporal, priority, p) AS (VALUES " + ", ".join(
    "(" + ", ".join(_lit(v) for v in (i, r["id"], j, n["theme"], n["temporal"], n["priority"], V.PRIORITIES.index(n["priority"]))) + ")" for i, r in enumerate(RULES) for j, n in enumerate(r["needs"])) + ")"


@query("j15_x4_keyword_rules", f"WITH {ASKS_SQL}, {_RULE_SQL} SELECT ask_id, rule FROM hits")
def keyword_rules(spark, sf_dir):
    return asks(spark, sf_dir).select("ask_id", F.explode(N.keyword_rules(F.col("text"))).alias("rule"))


@query("a1_u1_w7_needs_of_asks", f"""WITH {ASKS_SQL}, {_RULE_SQL}, {_RN_SQL}, m AS (SELECT h.ask_id, rn.*, row_number() OVER (PARTITION BY h.ask_id, theme, temporal ORDER BY p, rn.rule_pos, need_pos) AS k FROM hits h JOIN rn USING (rule))
SELECT ask_id, CAST(row_number() OVER (PARTITION BY ask_id ORDER BY p, theme, temporal) - 1 AS INT) AS need_rank, theme, temporal, priority, rule FROM m WHERE k = 1""")
def needs_of_asks(spark, sf_dir):
    a = asks(spark, sf_dir).select("ask_id", N.keyword_rules(F.col("text")).alias("rules"))
    return N.needs_of(a, G.rule_needs(G.load_rules(spark))).select("ask_id", "need_rank", "theme", "temporal", "priority", "rule")


@query("f10_needs_not_skipped", f"""WITH {ASKS_SQL}, {_RULE_SQL}, {_RN_SQL} SELECT DISTINCT h.ask_id, theme, temporal FROM hits h JOIN rn USING (rule) WHERE theme || ':' || temporal NOT IN ('water:static', 'transport:static')""")
def not_skipped(spark, sf_dir):
    a = asks(spark, sf_dir).select("ask_id", N.keyword_rules(F.col("text")).alias("rules"))
    return N.without_skipped(N.needs_of(a, G.rule_needs(G.load_rules(spark))), ["water:static", "transport:static"]).select("ask_id", "theme", "temporal")


@query("f16_asks_without_event_date", f"""WITH {ASKS_SQL}, {_RULE_SQL} SELECT DISTINCT ask_id FROM hits WHERE rule = 'flood' AND ask_id % 4 <> 0""")
def without_event(spark, sf_dir):
    a = asks(spark, sf_dir).select("ask_id", N.keyword_rules(F.col("text")).alias("rules"), (F.col("ask_id") % 4 == 0).alias("has_period"), F.lit(False).alias("has_event"))
    return N.needs_event_date(N.needs_of(a, G.rule_needs(G.load_rules(spark))), a)


@query("u6_unknown_chosen_rules", """SELECT o_orderkey AS ask_id, 'rule_' || CAST(o_orderkey % 5 AS VARCHAR) AS rule FROM orders WHERE o_orderkey % 7 = 0""")
def unknown_rules(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ask_id", "IF(o_orderkey % 7 = 0, concat('rule_', o_orderkey % 5), 'flood') AS rule")
    return N.unknown_rules(c, G.load_rules(spark)).select("ask_id", "rule")


@query("x7_vocabulary", r"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents)")
def vocabulary(spark, sf_dir):
    return N.vocabulary(table(spark, sf_dir, "documents"), "text")


# ---- fallbacks, complements, attention -----------------------------------------------------------------------------

_PRE, _POST = 30, 20  # days before and after an event
_V = ["feasible-single", "infeasible", "incomplete", "out-of-range", "feasible-composite", "feasible-single", "infeasible"]


def _planned(spark, sf_dir):
    """Plans of every request in need order, the windows of its own period or event with a verdict from the key, and their needs.

    A plan serves the needs of one source and one temporal mode; the event of a before/after plan is the middle of the period.
    """
    requests = _requests(spark, sf_dir)
    res = R.resolve(requests, G.load_sources(spark)).where("chosen IS NOT NULL AND temporal <> 'static'")
    src = G.load_sources(spark).select(F.col("id").alias("chosen"), "planner", F.col("yearly").alias("source_yearly"))
    base = write_stage(res.join(src, "chosen").select("request_id", "chosen", "planner", "source_yearly", "need_pos", "theme", "temporal", "candidates"), "resolved")
    plans = base.groupBy("request_id", F.col("chosen").alias("source_id"), "temporal", "planner", "source_yearly").agg(F.min("need_pos").alias("plan_pos"))
    needs = base.select("request_id", F.col("chosen").alias("source_id"), "temporal", "need_pos", F.concat_ws(":", "theme", "temporal").alias("need_key"), "candidates").join(
        plans.select("request_id", "source_id", "temporal", "plan_pos"), ["request_id", "source_id", "temporal"]).drop("source_id", "temporal")
    period = requests.select("request_id", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end")).distinct()
    asked = plans.join(period, "request_id").select("*", D.reference_date(F.col("start"), F.col("end")).alias("event"), F.lit(_PRE).alias("pre_days"), F.lit(_POST).alias("post_days"))
    month = F.year("w_start") * 12 + F.month("w_start")
    windows = D.windows_for(asked, "request_id", "plan_pos", "source_id").withColumn("verdict", F.element_at(
        F.lit(_V), ((F.col("request_id") * 5 + F.col("plan_pos") * 3 + month) % 7 + 1).cast("int")))
    return plans.drop("temporal", "source_yearly"), windows, needs


_PLANS_SQL = "RECURSIVE " + _NEED_SQL + f""",
met AS (SELECT * FROM res WHERE chosen IS NOT NULL AND temporal <> 'static'),
pm AS (SELECT DISTINCT id, planner, id IN ({', '.join(_lit(x['id']) for x in SOURCES if (x['temporal'].get('revisit_days') or 0) >= V.YEARLY_REVISIT_DAYS)}) AS yearly FROM reg),
plans AS (SELECT request_id, chosen AS source_id, temporal, planner, yearly, min(need_pos) AS plan_pos, min(CAST(s AS DATE)) AS s, min(CAST(e AS DATE)) AS e FROM met JOIN pm ON pm.id = chosen GROUP BY ALL),
spans AS (SELECT *, s + CAST(floor((e - s) / 2) AS INT) AS ev, CASE WHEN temporal = 'pair' THEN 'pair' WHEN yearly OR e - s > {V.LONG_PERIOD_DAYS} THEN 'yearly' ELSE 'monthly' END AS step FROM plans),
bare AS (
 SELECT request_id, plan_pos, source_id, strftime(m, '%Y-%m') AS label, greatest(CAST(m AS DATE), s) AS w_start, least(last_day(CAST(m AS DATE)), e) AS w_end
 FROM (SELECT *, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM spans WHERE step = 'monthly')
 UNION ALL SELECT request_id, plan_pos, source_id, CAST(y AS VARCHAR), greatest(make_date(y, 1, 1), s), least(make_date(y, 12, 31), e)
 FROM (SELECT *, unnest(generate_series(year(s), year(e))) AS y FROM spans WHERE step = 'yearly')
 UNION ALL SELECT request_id, plan_pos, source_id, 'pre', ev - {_PRE}, ev FROM spans WHERE step = 'pair'
 UNION ALL SELECT request_id, plan_pos, source_id, 'post', ev, ev + {_POST} FROM spans WHERE step = 'pair'),
win AS (SELECT *, [{', '.join(_lit(v) for v in _V)}][CAST((request_id * 5 + plan_pos * 3 + year(w_start) * 12 + month(w_start)) % 7 + 1 AS INT)] AS verdict FROM bare),
held AS (SELECT request_id, list(DISTINCT source_id) AS planned FROM plans GROUP BY 1),
bad AS (SELECT request_id, plan_pos, string_agg(label, ',' ORDER BY label) AS bad FROM win WHERE verdict = 'infeasible' GROUP BY 1, 2),
gaps AS (SELECT request_id, plan_pos, min(w_start) AS g0, max(w_end) AS g1, string_agg(label, ',' ORDER BY label) AS gap FROM win WHERE verdict = 'out-of-range' GROUP BY 1, 2),
pn AS (SELECT m.request_id, p.plan_pos, p.source_id, p.planner, m.need_pos, m.theme, m.temporal FROM met m JOIN plans p ON p.request_id = m.request_id AND p.source_id = m.chosen AND p.temporal = m.temporal),
fb_steps AS (SELECT n.request_id, n.plan_pos, n.need_pos, n.source_id, n.theme || ':' || n.temporal AS need_key, coalesce(list(c.id ORDER BY c.rk) FILTER (c.id IS NOT NULL), []) AS opts,
 row_number() OVER (PARTITION BY n.request_id ORDER BY n.plan_pos, n.need_pos) AS st
 FROM pn n JOIN bad USING (request_id, plan_pos) LEFT JOIN cand c ON c.request_id = n.request_id AND c.theme = n.theme AND c.temporal = n.temporal AND NOT c.cloud AND c.shape = 'series' AND c.driver = 'stac'
 WHERE n.planner = 'optical' GROUP BY 1, 2, 3, 4, 5),
fb AS (SELECT request_id, CAST(0 AS BIGINT) AS st, planned, CAST(NULL AS INT) AS plan_pos, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS need_key, CAST(NULL AS VARCHAR) AS alternative FROM held
 UNION ALL SELECT f.request_id, s.st, CASE WHEN len(list_filter(s.opts, lambda o: NOT list_contains(f.planned, o))) > 0 THEN list_append(f.planned, list_filter(s.opts, lambda o: NOT list_contains(f.planned, o))[1]) ELSE f.planned END,
  CAST(s.plan_pos AS INT), s.source_id, s.need_key, list_filter(s.opts, lambda o: NOT list_contains(f.planned, o))[1] FROM fb f JOIN fb_steps s ON s.request_id = f.request_id AND s.st = f.st + 1),
cp_steps AS (SELECT n.request_id, n.plan_pos, n.need_pos, n.source_id, n.theme || ':' || n.temporal AS need_key, list(c.id ORDER BY c.rk) AS opts,
 row_number() OVER (PARTITION BY n.request_id ORDER BY n.plan_pos, n.need_pos) AS st
 FROM pn n JOIN gaps g USING (request_id, plan_pos) JOIN cand c ON c.request_id = n.request_id AND c.theme = n.theme AND c.temporal = n.temporal AND c.shape = 'series' AND c.driver = 'stac'
  AND (c.ttype = 'static' OR (c.frm <= substr(CAST(g.g1 AS VARCHAR), 1, 7) AND (c.too IS NULL OR c.too >= substr(CAST(g.g0 AS VARCHAR), 1, 7)))) GROUP BY 1, 2, 3, 4, 5),
cp AS (SELECT request_id, CAST(0 AS BIGINT) AS st, planned, CAST([] AS INT[]) AS done, CAST(NULL AS INT) AS plan_pos, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS need_key, CAST(NULL AS VARCHAR) AS alternative FROM held
 UNION ALL SELECT f.request_id, s.st, CASE WHEN take THEN list_append(f.planned, pick) ELSE f.planned END, CASE WHEN take THEN list_append(f.done, CAST(s.plan_pos AS INT)) ELSE f.done END,
  CAST(s.plan_pos AS INT), s.source_id, s.need_key, CASE WHEN take THEN pick END
 FROM (SELECT f.*, s.st AS nst, list_filter(s.opts, lambda o: NOT list_contains(f.planned, o))[1] AS pick,
   len(list_filter(s.opts, lambda o: NOT list_contains(f.planned, o))) > 0 AND NOT list_contains(f.done, CAST(s.plan_pos AS INT)) AS take FROM cp f JOIN cp_steps s ON s.request_id = f.request_id AND s.st = f.st + 1) f
 JOIN cp_steps s ON s.request_id = f.request_id AND s.st = f.nst)"""


@query("j11_fallbacks", f"""WITH {_PLANS_SQL} SELECT request_id, plan_pos, source_id, need_key, alternative, bad FROM fb JOIN bad USING (request_id, plan_pos) WHERE alternative IS NOT NULL""")
def fallbacks(spark, sf_dir):
    plans, windows, needs = _planned(spark, sf_dir)
    return Q.fallbacks(plans, windows, needs, Q.planned_sources(plans)).select("request_id", "plan_pos", "source_id", "need_key", "alternative", F.array_join("bad", ",").alias("bad"))


@query("j12_u8_complements", f"""WITH {_PLANS_SQL} SELECT request_id, plan_pos, source_id, need_key, alternative, gap FROM cp JOIN gaps USING (request_id, plan_pos) WHERE alternative IS NOT NULL""")
def complements(spark, sf_dir):
    plans, windows, needs = _planned(spark, sf_dir)
    return Q.complements(plans, windows, needs, Q.planned_sources(plans), G.load_sources(spark)).select(
        "request_id", "plan_pos", "source_id", "need_key", "alternative", F.array_join("gap", ",").alias("gap"))


def _verdict_windows(spark, sf_dir):
    """Yearly windows of plans derived from line items, a verdict per window."""
    v = F.element_at(F.lit(list(V.VERDICTS)), ((F.col("l_orderkey") * 3 + F.year("l_shipdate")) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), (F.col("l_orderkey") % 9).cast("string").alias("source_id"), F.year("l_shipdate").cast("string").alias("label"),
        F.trunc("l_shipdate", "YEAR").alias("w_start"), v.alias("verdict")).distinct().withColumn("verdict_text", F.concat(F.lit("why "), F.col("label")))


_VW_SQL = f"""vw AS (SELECT DISTINCT l_orderkey AS plan_id, CAST(l_orderkey % 9 AS VARCHAR) AS source_id, CAST(year(l_shipdate) AS VARCHAR) AS label,
 [{', '.join(_lit(v) for v in V.VERDICTS)}][CAST((l_orderkey * 3 + year(l_shipdate)) % 5 + 1 AS INT)] AS verdict FROM lineitem)"""
_ISLANDS = """isl AS (SELECT {k}, y, y - row_number() OVER (PARTITION BY {k} ORDER BY y) AS g FROM (SELECT DISTINCT {k}, CAST(label AS INT) AS y FROM {t})),
runs AS (SELECT {k}, string_agg(r, ', ' ORDER BY a) AS runs FROM (SELECT {k}, min(y) AS a, CASE WHEN min(y) = max(y) THEN CAST(min(y) AS VARCHAR) ELSE CAST(min(y) AS VARCHAR) || '–' || CAST(max(y) AS VARCHAR) END AS r FROM isl GROUP BY {k}, g) GROUP BY {k})"""


@query("j13_t6_attention", f"""WITH {_VW_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY label) AS rn, count(*) OVER (PARTITION BY plan_id) AS n FROM vw WHERE verdict IN ('infeasible', 'incomplete', 'feasible-composite') AND plan_id % 11 <> 0),
o AS (SELECT plan_id, source_id, label FROM vw WHERE verdict = 'out-of-range' AND plan_id % 4 <> 0 AND plan_id % 11 <> 0), {_ISLANDS.format(k='plan_id', t='o')}
SELECT plan_id, source_id, replace(verdict, 'feasible-', '') AS level, label || ': why ' || label AS text FROM b WHERE rn <= 3
UNION ALL SELECT DISTINCT plan_id, source_id, 'incomplete', '… ' || CAST(n - 3 AS VARCHAR) || ' more windows (details in the plan file)' FROM b WHERE n > 3
UNION ALL SELECT DISTINCT o.plan_id, o.source_id, 'uncovered', CASE WHEN o.plan_id % 3 = 0 THEN 'fire/series, water/static: ' WHEN o.plan_id % 3 = 1 THEN 'water/static: ' ELSE '' END || 'no registered source has data for ' || runs FROM o JOIN runs USING (plan_id)""")
def attention(spark, sf_dir):
    w = _verdict_windows(spark, sf_dir)
    plans = w.select("plan_id").distinct()
    needs = plans.where("plan_id % 3 < 2").selectExpr("plan_id", "'water' AS theme", "'static' AS temporal").union(
        plans.where("plan_id % 3 = 0").selectExpr("plan_id", "'fire' AS theme", "'series' AS temporal"))
    filled = w.where("verdict = 'out-of-range' AND plan_id % 4 = 0").select("plan_id", "label")
    return Q.attention(w, filled, needs, plans.where("plan_id % 11 = 0"))


@query("a17_w5_year_runs", f"WITH {_VW_SQL}, {_ISLANDS.format(k='plan_id', t='vw')} SELECT plan_id, runs FROM runs")
def year_runs(spark, sf_dir):
    return Q.year_runs(_verdict_windows(spark, sf_dir), "plan_id")


@query("a15_verdict_histogram", f"""WITH {_VW_SQL},
vk AS (SELECT 'source ' || source_id AS k, label, verdict FROM vw UNION ALL SELECT 'plan ' || CAST(plan_id AS VARCHAR), label, verdict FROM vw),
c AS (SELECT k, count(*) AS n, string_agg(label || '=' || replace(verdict, 'feasible-', ''), ', ' ORDER BY label) AS named, min(label) || '…' || max(label) AS span,
 {', '.join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS v{i}" for i, v in enumerate(V.VERDICTS))} FROM vk GROUP BY 1)
SELECT k, CASE WHEN n <= 4 THEN named ELSE concat_ws(' ', {', '.join(f"CASE WHEN v{i} > 0 THEN '{v.replace('feasible-', '')}×' || CAST(v{i} AS VARCHAR) END" for i, v in enumerate(V.VERDICTS))}) || '  (' || span || ')' END AS summary FROM c""")
def verdict_histogram(spark, sf_dir):
    """By source, many windows each, and by plan, a year or two each."""
    w = _verdict_windows(spark, sf_dir)
    by = lambda key, word: Q.verdict_histogram(w, key).select(F.concat(F.lit(word), F.col(key).cast("string")).alias("k"), "summary")
    return by("source_id", "source ").unionByName(by("plan_id", "plan "))


@query("a16_worst_verdict", f"""WITH {_VW_SQL} SELECT plan_id, ['ok', 'composite', 'incomplete', 'infeasible'][max(CASE verdict WHEN 'infeasible' THEN 4 WHEN 'incomplete' THEN 3 WHEN 'out-of-range' THEN 3 WHEN 'feasible-composite' THEN 2 ELSE 1 END)] AS worst FROM vw GROUP BY 1""")
def worst_verdict(spark, sf_dir):
    return Q.worst_verdict(_verdict_windows(spark, sf_dir), "plan_id")


@query("f14_out_of_range_windows", """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e, CASE o_orderkey % 3 WHEN 0 THEN '1996' WHEN 1 THEN '1995-06' END AS frm,
 CASE o_orderkey % 5 WHEN 0 THEN '1998' WHEN 1 THEN '1997-07' END AS too, o_orderkey % 2 AS n FROM orders)
SELECT k AS request_id, n = 0 AND (substr(CAST(e AS VARCHAR), 1, len(coalesce(frm, '0000'))) < coalesce(frm, '0000') OR coalesce(substr(CAST(s AS VARCHAR), 1, len(too)) > too, FALSE)) AS out_of_range FROM r""")
def out_of_range(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), E.out_of_range(
        k % 2, d, F.date_add(d, 30), F.when(k % 3 == 0, "1996").when(k % 3 == 1, "1995-06"), F.when(k % 5 == 0, "1998").when(k % 5 == 1, "1997-07")).alias("out_of_range"))


@query("a9_rescaled_estimate", """WITH a AS (SELECT l_orderkey AS plan_id, l_linenumber AS w, CASE WHEN l_partkey % 6 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS size FROM lineitem),
f AS (SELECT plan_id, coalesce(sum(size), 0) AS fb, coalesce(sum(CAST(floor(size * 0.3::DOUBLE) AS BIGINT) + 2000000), 0) AS wb FROM a GROUP BY 1),
k AS (SELECT plan_id, count(*) AS n_assets, coalesce(sum(size), 0) AS kb, count(*) FILTER (size IS NULL) AS unknown FROM a WHERE w <= 3 GROUP BY 1)
SELECT plan_id, CAST(n_assets AS BIGINT) AS n_assets, CAST(kb AS BIGINT) AS full_bytes, CAST(floor(CAST(wb AS BIGINT) * CAST(kb AS BIGINT) / CASE WHEN fb = 0 THEN 1 ELSE CAST(fb AS BIGINT) END::DOUBLE) AS BIGINT) AS windowed_bytes, CAST(unknown AS BIGINT) AS unknown FROM k JOIN f USING (plan_id)""")
def rescaled(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS plan_id", "l_linenumber AS w", "IF(l_partkey % 6 <> 0, CAST(round(l_extendedprice * 100) AS BIGINT), NULL) AS size", "0.3D AS fraction")
    return L.rescale_kept(L.estimate(a, "plan_id"), a.where("w <= 3"), "plan_id")


@query("e6_why_lines", """WITH p AS (SELECT o_orderkey AS plan_id, 'src-' || CAST(o_custkey % 9 AS VARCHAR) AS source_id, o_orderkey % 3 AS k, o_orderkey % 7 AS n FROM orders)
SELECT plan_id, 'water/series (required) ← ' || source_id || ': extent' AS line FROM p
UNION ALL SELECT plan_id, '  ↳ added automatically: base is infeasible (cloud) for ' || array_to_string([CAST(2000 + i AS VARCHAR) for i in range(0, least(4, n + 1))], ', ') || CASE WHEN n + 1 > 4 THEN ' and ' || CAST(n + 1 - 4 AS VARCHAR) || ' more' ELSE '' END FROM p WHERE k = 1
UNION ALL SELECT plan_id, '  ↳ added automatically: base has no products for 2001–2003; this fills ' || CASE WHEN n = 0 THEN 'none of them' ELSE '2002' END FROM p WHERE k = 2""")
def why_lines(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS plan_id", "concat('src-', o_custkey % 9) AS source_id", "IF(o_orderkey % 3 = 1, 'base', NULL) AS fallback_for",
        "transform(sequence(0, CAST(o_orderkey % 7 AS INT)), i -> CAST(2000 + i AS STRING)) AS fallback_windows", "IF(o_orderkey % 3 = 2, 'base', NULL) AS complement_for",
        "'2001–2003' AS gap", "IF(o_orderkey % 7 = 0, '', '2002') AS filled")
    n = p.selectExpr("plan_id", "'water' AS theme", "'series' AS temporal", "'required' AS priority", "'extent' AS why")
    return Q.why_lines(p, n)

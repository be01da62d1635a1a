"""Files held, catalogue state and the ledger of required against transferred files."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import ITEMS_SQL, items, query, table
from tilewright.functions import polygons as P, scalars as S
from tilewright.operators import ledger as L, library as B
from tilewright.session import shared_folder
from tilewright.sources import catalogue as C, sinks as K


def held(spark, sf_dir):
    """Held files: one per (order, line), from line items (the pair is not unique there)."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    one = table(spark, sf_dir, "lineitem").groupBy(k, n).agg(
        F.min("l_partkey").alias("item"), F.min("l_suppkey").alias("project"), F.min(F.concat("l_returnflag", "l_linestatus")).alias("source"),
        F.min("l_shipdate").cast("date").alias("d"), F.round(F.min("l_extendedprice") * 100).cast("bigint").alias("bytes"))
    x, y = (k % 60).cast("double"), (n * 3).cast("double")
    return one.select(
        F.concat_ws("/", k.cast("string"), n.cast("string")).alias("path"), k.alias("k"), n.alias("n"), "item", "project", "source", F.when(n % 2 == 0, "red").otherwise("nir").alias("asset"),
        F.when(k % 3 == 0, 32644).otherwise(32643).alias("epsg"), (k % 4 != 0).alias("native_grid"), "d", "bytes",
        F.struct(x.alias("minx"), y.alias("miny"), (x + 4).alias("maxx"), (y + 4).alias("maxy")).alias("cover"))


LIB_SQL = """lib AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS path, l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS item, min(l_suppkey) AS project,
 min(l_returnflag || l_linestatus) AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'red' ELSE 'nir' END AS asset, CASE WHEN l_orderkey % 3 = 0 THEN 32644 ELSE 32643 END AS epsg,
 l_orderkey % 4 <> 0 AS native_grid, CAST(min(l_shipdate) AS DATE) AS d, CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS bytes, CAST(l_orderkey % 60 AS DOUBLE) AS x, CAST(l_linenumber * 3 AS DOUBLE) AS y
 FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def inventory(spark, sf_dir):
    """Files on disk: some are gone, some changed size or content."""
    h = held(spark, sf_dir)
    return h.where("(k + n) % 11 <> 0").select("path", F.when((F.col("k") + F.col("n")) % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("size"),
                                              F.concat(F.lit("c"), F.when((F.col("k") + F.col("n")) % 17 == 0, F.lit("x")).otherwise(F.col("path"))).alias("checksum"))


INV_SQL = """inv AS (SELECT path, CASE WHEN (k + n) % 13 = 0 THEN bytes + 1 ELSE bytes END AS size, 'c' || CASE WHEN (k + n) % 17 = 0 THEN 'x' ELSE path END AS checksum FROM lib WHERE (k + n) % 11 <> 0)"""


def required(spark, sf_dir):
    """Three assets per order: what plans ask for."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("n")).select(
        "plan_id", F.col("plan_id").alias("item"), F.col("n").cast("string").alias("asset"), (F.col("plan_id") % 2).cast("string").alias("window"))


REQ_SQL = "req AS (SELECT o_orderkey AS plan_id, o_orderkey AS item, CAST(n AS VARCHAR) AS asset FROM orders, range(1, 4) t(n))"


def recorded(spark, sf_dir):
    return held(spark, sf_dir).select(F.col("k").alias("item"), F.col("n").cast("string").alias("asset"), "path", F.col("bytes").alias("size"), F.concat(F.lit("c"), "path").alias("checksum"))


PRES_SQL = "pres AS (SELECT DISTINCT k AS item, CAST(n AS VARCHAR) AS asset FROM lib JOIN inv USING (path) WHERE bytes = size)"


def present(spark, sf_dir):
    return L.present_assets(recorded(spark, sf_dir), inventory(spark, sf_dir))


def transfers(spark, sf_dir):
    """Execution log with repeats and failures."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "event_id % 97 AS plan_id", "event_id % 997 AS item", "CAST(user_id % 3 AS STRING) AS asset", "IF(event_type = 'error' OR event_id % 5 = 0, 'failed', 'ok') AS status",
        "sha2(CAST(event_id % 1994 AS STRING), 256) AS sha256", "CAST(value * 1000 AS BIGINT) AS bytes", "event_id % 6 = 0 AS reused",
        "CASE event_id % 4 WHEN 0 THEN concat('HTTP 503 at https://h/x', event_id, '.tif?sig=abc') WHEN 1 THEN 'Timeout' WHEN 2 THEN 'no such file' ELSE 'bad header' END AS error")


TR_SQL = """tr AS (SELECT event_id AS seq, event_id % 97 AS plan_id, event_id % 997 AS item, CAST(user_id % 3 AS VARCHAR) AS asset, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
 sha256(CAST(event_id % 1994 AS VARCHAR)) AS sha256, CAST(trunc(value * 1000) AS BIGINT) AS bytes, event_id % 6 = 0 AS reused,
 CASE event_id % 4 WHEN 0 THEN 'HTTP 503 at https://h/x' || CAST(event_id AS VARCHAR) || '.tif?…' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'no such file' ELSE 'bad header' END AS error FROM events)"""


# ---- library -------------------------------------------------------------------------------------------------------

@query("k3_upsert_by_path", f"""WITH {LIB_SQL}, f AS (SELECT path, bytes + 5 AS bytes, DATE '2030-01-01' AS acquired FROM lib WHERE k % 5 = 0 UNION ALL SELECT 'new/' || path, bytes, DATE '2030-01-01' FROM lib WHERE k % 7 = 0)
SELECT path, bytes, acquired FROM f UNION ALL SELECT path, bytes, d FROM lib WHERE path NOT IN (SELECT path FROM f)""")
def upsert(spark, sf_dir):
    h = held(spark, sf_dir)
    old = h.select("path", "bytes", F.col("d").alias("acquired"))
    day = F.lit("2030-01-01").cast("date").alias("acquired")
    fresh = h.where("k % 5 = 0").select("path", (F.col("bytes") + 5).alias("bytes"), day).unionByName(h.where("k % 7 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "bytes", day))
    return B.upsert(old, fresh)


@query("k4_forget_missing", f"WITH {LIB_SQL}, {INV_SQL} SELECT path, bytes FROM lib WHERE path IN (SELECT path FROM inv)")
def forget(spark, sf_dir):
    return B.forget_missing(held(spark, sf_dir), inventory(spark, sf_dir)).select("path", "bytes")


def _needed(spark, sf_dir):
    """Needs for parts of items others hold: one per line, from a neighbouring project."""
    h = held(spark, sf_dir)
    x, y = F.col("cover.minx") + F.col("n") % 3, F.col("cover.miny") + F.col("n") % 2
    return h.select(F.concat(F.lit("q"), "path").alias("need_id"), F.col("k").alias("plan_id"), "source", "item", "asset", F.lit(32643).alias("epsg"), (F.col("project") + F.col("n") % 2).alias("project"),
                    F.struct(x.alias("minx"), y.alias("miny"), (x + 2).alias("maxx"), (y + 3).alias("maxy")).alias("box"), (F.col("k") % 9 == 0).alias("whole_file"))


_REUSE_SQL = f"""{LIB_SQL}, {INV_SQL}, nd AS (SELECT 'q' || path AS need_id, k AS plan_id, source, item, asset, project + n % 2 AS project, x + n % 3 AS bx, y + n % 2 AS by_, k % 9 = 0 AS whole_file FROM lib),
ru AS (SELECT nd.*, l.path AS held_path, l.project AS held_project, row_number() OVER (PARTITION BY need_id ORDER BY l.path) AS rn FROM nd JOIN lib l ON l.source = nd.source AND l.item = nd.item AND l.asset = nd.asset
 AND l.native_grid AND l.epsg = 32643 AND l.project <> nd.project AND l.x <= bx AND l.y <= by_ AND l.x + 4 >= bx + 2 AND l.y + 4 >= by_ + 3 JOIN inv ON inv.path = l.path AND inv.size = l.bytes)"""


@query("j8_reusable_files", f"WITH {_REUSE_SQL} SELECT need_id, held_path, held_project FROM ru WHERE rn = 1")
def reusable(spark, sf_dir):
    return B.reusable(_needed(spark, sf_dir), held(spark, sf_dir), inventory(spark, sf_dir))


@query("j9_library_hits", f"WITH {_REUSE_SQL} SELECT DISTINCT plan_id, item, asset FROM ru WHERE NOT whole_file")
def library_hits(spark, sf_dir):
    return B.library_hits(_needed(spark, sf_dir), held(spark, sf_dir), inventory(spark, sf_dir))


def _lib_areas(spark, sf_dir):
    s = F.col("s_suppkey")
    x, y = (s % 55).cast("double"), (s % 17).cast("double")
    return table(spark, sf_dir, "supplier").select(s.alias("area_id"), F.struct(x.alias("minx"), y.alias("miny"), (x + 0.5).alias("maxx"), (y + 0.25).alias("maxy")).alias("box"))


_OVER_SQL = f"""{LIB_SQL}, ar AS (SELECT s_suppkey AS area_id, CAST(s_suppkey % 55 AS DOUBLE) AS ax, CAST(s_suppkey % 17 AS DOUBLE) AS ay FROM supplier),
ov AS (SELECT area_id, lib.* FROM lib JOIN ar ON x <= ax + 0.5 AND x + 4 >= ax AND y <= ay + 0.25 AND y + 4 >= ay)"""


@query("j10_files_over_areas", f"WITH {_OVER_SQL} SELECT area_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, min(path) AS first_path FROM ov GROUP BY 1")
def files_over(spark, sf_dir):
    return B.totals_over(held(spark, sf_dir), _lib_areas(spark, sf_dir), 8.0, ["files", "bytes", "first_path"])


@query("a14_library_here", f"""WITH {_OVER_SQL} SELECT area_id, source, project, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, min(d) AS first_date, max(d) AS last_date FROM ov WHERE project <> 3 GROUP BY 1, 2, 3""")
def library_here(spark, sf_dir):
    return B.here(held(spark, sf_dir), _lib_areas(spark, sf_dir), 8.0, F.lit(3))


@query("a13_items_held", f"WITH {LIB_SQL} SELECT DISTINCT source, epsg, item FROM lib WHERE native_grid")
def items_held(spark, sf_dir):
    return B.items_held(held(spark, sf_dir))


@query("a12_library_summary", f"""WITH {LIB_SQL} SELECT CASE grouping_id(source, project) WHEN 1 THEN 'source' WHEN 2 THEN 'project' ELSE 'total' END AS level, source, project, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
 CAST(count(DISTINCT project) AS BIGINT) AS projects FROM lib GROUP BY GROUPING SETS ((source), (project), ())""")
def library_summary(spark, sf_dir):
    h = held(spark, sf_dir)
    # the distinct count needs the project apart from the grouping column
    s = B.summary(h.select("source", "project", "bytes"))
    return s.select("level", "source", "project", "files", "bytes", "projects")


@query("t9_sources_by_bytes", f"WITH {LIB_SQL} SELECT source, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(DISTINCT project) AS BIGINT) AS projects FROM lib GROUP BY 1 ORDER BY bytes DESC, source")
def by_source(spark, sf_dir):
    return B.by_source(held(spark, sf_dir))


@query("s15_scan_catalogue_into_library", f"""WITH {LIB_SQL}, {INV_SQL} SELECT path, project, k AS item, CASE WHEN k % 6 = 0 THEN 32643 ELSE epsg END AS epsg, CASE WHEN n = 1 THEN TRUE ELSE k % 5 = 0 END AS native_grid, bytes, 'ab' || path AS sha256 FROM lib WHERE path IN (SELECT path FROM inv)""")
def scan(spark, sf_dir):
    h = held(spark, sf_dir)
    asset = F.struct("path", F.col("bytes").alias("size"), F.concat(F.lit("1220ab"), "path").alias("checksum"), F.lit("https://x").alias("href"), F.when(F.col("n") == 1, True).alias("native_grid"))
    items = h.select("project", "source", F.col("k").alias("item"), F.lit("w").alias("window"), "d", F.when(F.col("k") % 6 != 0, F.col("epsg")).alias("epsg"), "cover", F.create_map(F.col("n").cast("string"), asset).alias("assets"))
    native = h.where("k % 5 = 0").select("project", F.col("k").alias("item"))
    return B.scan_catalogue(items, native, inventory(spark, sf_dir), F.lit(32643)).select("path", "project", "item", "epsg", "native_grid", "bytes", "sha256")


# ---- catalogue -----------------------------------------------------------------------------------------------------

@query("k1_merged_catalogue_items", f"""WITH {LIB_SQL}, o AS (SELECT k, string_agg(CAST(n AS VARCHAR) || '=' || CASE WHEN nw THEN 'new' ELSE 'old' END, ',' ORDER BY n) AS assets FROM
 (SELECT k, n, bool_or(s = 'new') AS nw FROM (SELECT k, n, 'old' AS s FROM lib WHERE n <= 3 AND k % 10 <> 0 UNION ALL SELECT k, n, 'new' FROM lib WHERE n >= 3 AND k % 3 = 0) GROUP BY 1, 2) GROUP BY 1)
SELECT k AS item, CASE WHEN EXISTS (SELECT 1 FROM lib WHERE lib.k = o.k AND n >= 3 AND k % 3 = 0) THEN 'new' ELSE 'old' END AS origin, assets FROM o""")
def merged_items(spark, sf_dir):
    h = held(spark, sf_dir)

    def side(df, tag):
        # assets of one item are few: bands of one scene
        return df.groupBy(F.col("k").alias("item")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string").alias("key"), F.lit(tag).alias("value")))).alias("assets")).withColumn("props", F.create_map(F.lit("origin"), F.lit(tag)))

    m = K.merge_items(side(h.where("n <= 3 AND k % 10 <> 0"), "old"), side(h.where("n >= 3 AND k % 3 = 0"), "new"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("assets")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("item", F.try_element_at("props", F.lit("origin")).alias("origin"), text.alias("assets"))


@query("k2_catalogue_links", f"WITH {LIB_SQL} SELECT DISTINCT project, k AS item, './items/' || CAST(k AS VARCHAR) || '.json' AS href, 'item' AS rel FROM lib ORDER BY project, item")
def links(spark, sf_dir):
    return K.catalogue_links(held(spark, sf_dir).select("project", F.col("k").alias("item")))


@query("a23_item_summary", f"WITH {LIB_SQL} SELECT k AS item, min(source) AS source, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS assets FROM lib GROUP BY 1")
def item_summary(spark, sf_dir):
    h = held(spark, sf_dir)
    it = h.groupBy(F.col("k").alias("item")).agg(F.create_map(F.lit("source"), F.min("source")).alias("props"),
                                                 F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string").alias("key"), F.col("path").alias("value")))).alias("assets"))
    return K.item_summary(it).select("item", "source", F.array_join("assets", ",").alias("assets"))


@query("k9_multihash", "SELECT doc_id, '1220' || sha256(text) AS checksum FROM documents")
def multihash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.multihash(F.col("text")).alias("checksum"))


# ---- ledger --------------------------------------------------------------------------------------------------------

@query("f12_present_assets", f"WITH {LIB_SQL}, {INV_SQL} SELECT DISTINCT k AS item, CAST(n AS VARCHAR) AS asset FROM lib JOIN inv USING (path) WHERE bytes = size AND 'c' || path = checksum")
def present_assets(spark, sf_dir):
    return L.present_assets(recorded(spark, sf_dir), inventory(spark, sf_dir), verify=True)


_LEDGER_SQL = f"""{LIB_SQL}, {INV_SQL}, {REQ_SQL}, {PRES_SQL}, gap AS (SELECT r.* FROM req r LEFT JOIN pres p USING (item, asset) WHERE p.item IS NULL),
hit AS (SELECT DISTINCT plan_id, item, asset FROM req WHERE item % 2 = 0 AND asset <> '3')"""


def _hits(spark, sf_dir):
    return required(spark, sf_dir).where("item % 2 = 0 AND asset <> '3'").select("plan_id", "item", "asset").distinct()


@query("j7_gaps", f"WITH {_LEDGER_SQL} SELECT plan_id, item, asset FROM gap")
def gaps(spark, sf_dir):
    return L.gaps(required(spark, sf_dir), present(spark, sf_dir)).select("plan_id", "item", "asset")


@query("u4_missing_but_in_library", f"WITH {_LEDGER_SQL} SELECT plan_id, item, asset FROM gap INTERSECT SELECT plan_id, item, asset FROM hit")
def fetchable(spark, sf_dir):
    return L.fetchable(L.gaps(required(spark, sf_dir), present(spark, sf_dir)), _hits(spark, sf_dir))


@query("j7_j9_actions", f"WITH {_LEDGER_SQL} SELECT r.plan_id, r.item, r.asset, CASE WHEN p.item IS NOT NULL THEN 'skip' WHEN h.item IS NOT NULL THEN 'reuse' ELSE 'fetch' END AS action FROM req r LEFT JOIN pres p USING (item, asset) LEFT JOIN hit h ON h.plan_id = r.plan_id AND h.item = r.item AND h.asset = r.asset")
def actions(spark, sf_dir):
    return L.actions(required(spark, sf_dir), present(spark, sf_dir), _hits(spark, sf_dir)).select("plan_id", "item", "asset", "action")


def _remaining(spark, sf_dir):
    miss = L.gaps(required(spark, sf_dir), present(spark, sf_dir))
    est = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS plan_id", "o_custkey AS request_id", "IF(o_orderkey % 8 = 0, 0L, 3L) AS n_assets", "CAST(round(o_totalprice * 1000) AS BIGINT) AS windowed_bytes")
    return L.remaining(est, miss, L.fetchable(miss, _hits(spark, sf_dir)))


_REM_SQL = f"""{_LEDGER_SQL}, rem AS (SELECT o_orderkey AS plan_id, o_custkey AS request_id, CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 3 END AS n_assets, CAST(round(o_totalprice * 1000) AS BIGINT) AS wb,
 (SELECT count(*) FROM gap WHERE plan_id = o_orderkey) AS m, (SELECT count(*) FROM gap JOIN hit USING (plan_id, item, asset) WHERE plan_id = o_orderkey) AS lib_n FROM orders),
rem2 AS (SELECT plan_id, request_id, n_assets, n_assets - m AS present, lib_n AS from_library, CASE WHEN n_assets > 0 THEN CAST(floor(wb * (m - lib_n) / n_assets::DOUBLE) AS BIGINT) ELSE 0 END AS to_fetch_bytes FROM rem)"""


@query("a10_remaining_to_fetch", f"WITH {_REM_SQL} SELECT plan_id, CAST(present AS BIGINT) AS present, CAST(from_library AS BIGINT) AS from_library, to_fetch_bytes FROM rem2")
def remaining(spark, sf_dir):
    return _remaining(spark, sf_dir).select("plan_id", "present", "from_library", "to_fetch_bytes")


@query("a11_request_totals", f"WITH {_REM_SQL} SELECT request_id, CAST(sum(to_fetch_bytes) AS BIGINT) AS total_bytes, CAST(sum(n_assets) AS BIGINT) AS total_files FROM rem2 GROUP BY 1")
def request_totals(spark, sf_dir):
    return L.request_totals(_remaining(spark, sf_dir))


@query("a11_run_totals", f"""WITH {TR_SQL} SELECT plan_id % 10 AS request_id, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS fetched, CAST(count(*) FILTER (status = 'ok' AND reused) AS BIGINT) AS reused, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
 CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'complete' ELSE 'partial' END AS state FROM tr GROUP BY 1""")
def run_totals(spark, sf_dir):
    t = transfers(spark, sf_dir)
    plans = t.select("plan_id", (F.col("plan_id") % 10).alias("request_id")).distinct()
    return L.run_totals(plans, t)


@query("a18_plan_status", f"""WITH {_LEDGER_SQL}, p AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 3 END AS n_assets, CASE WHEN o_orderkey % 16 = 0 THEN 0 ELSE 3 END AS n_acq FROM orders),
c AS (SELECT plan_id, count(*) AS m FROM gap GROUP BY 1), t AS (SELECT p.*, coalesce(m, 0) AS m, CASE WHEN n_assets = 0 THEN n_acq ELSE n_assets END AS total FROM p LEFT JOIN c USING (plan_id))
SELECT plan_id, CAST(total - m AS BIGINT) AS present, CAST(total AS BIGINT) AS total, CASE WHEN n_assets = 0 AND n_acq = 0 THEN 'skipped' WHEN m = 0 THEN 'complete' WHEN m = total THEN 'missing' ELSE 'partial' END AS state FROM t""")
def plan_status(spark, sf_dir):
    plans = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS plan_id", "IF(o_orderkey % 8 = 0, 0L, 3L) AS n_assets", "IF(o_orderkey % 16 = 0, 0L, 3L) AS n_acquire")
    return L.plan_status(plans, L.gaps(required(spark, sf_dir), present(spark, sf_dir)))


@query("a19_u5_job_progress", f"""WITH {_LEDGER_SQL}, d AS (SELECT DISTINCT l_orderkey AS plan_id, l_orderkey AS item, CAST(l_linenumber AS VARCHAR) AS asset FROM lineitem WHERE l_partkey % 2 = 0),
r AS (SELECT plan_id, count(*) AS c FROM (SELECT plan_id, item, asset FROM gap EXCEPT SELECT plan_id, item, asset FROM d) GROUP BY 1)
SELECT o_orderkey AS plan_id, CAST(3 AS BIGINT) AS total, CAST(3 - coalesce(c, 0) AS BIGINT) AS present FROM orders LEFT JOIN r ON r.plan_id = o_orderkey""")
def job_progress(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS plan_id", "l_orderkey AS item", "CAST(l_linenumber AS STRING) AS asset", "IF(l_partkey % 2 = 0, 'ok', 'failed') AS status")
    plans = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS plan_id", "3L AS total")
    return L.job_progress(plans, L.gaps(required(spark, sf_dir), present(spark, sf_dir)), t)


@query("w6_latest_log_entries", f"WITH {TR_SQL} SELECT plan_id, item, asset, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, item, asset ORDER BY seq DESC) AS rn FROM tr) WHERE rn = 1")
def latest_entries(spark, sf_dir):
    return L.latest_entries(transfers(spark, sf_dir)).select("plan_id", "item", "asset", "seq", "status")


@query("j18_f13_p12_still_missing", f"""WITH {TR_SQL}, ok AS (SELECT DISTINCT plan_id, item, asset FROM tr WHERE status = 'ok'), f AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.plan_id, tr.item, tr.asset ORDER BY seq DESC) AS rn
 FROM tr LEFT JOIN ok USING (plan_id, item, asset) WHERE status <> 'ok' AND ok.plan_id IS NULL)
SELECT plan_id, item, asset, error, error LIKE 'HTTP 503%' OR error = 'Timeout' AS transient FROM f WHERE rn = 1""")
def still_missing(spark, sf_dir):
    return L.still_missing(transfers(spark, sf_dir)).select("plan_id", "item", "asset", "error", "transient")


def _log_plans(t):
    return t.select("plan_id", F.concat(F.lit("s"), (F.col("plan_id") % 5).cast("string")).alias("source")).distinct()


_EXP_SQL = TR_SQL + """, lastok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, item, asset ORDER BY seq DESC) AS rn FROM tr WHERE status = 'ok') WHERE rn = 1),
ex AS (SELECT plan_id, 's' || CAST(plan_id % 5 AS VARCHAR) AS source, CAST(item AS VARCHAR) || '/' || asset AS file, sha256, bytes FROM lastok)"""


@query("k7_recipe_checksums", f"WITH {_EXP_SQL} SELECT plan_id, source, file, sha256, bytes FROM ex")
def recipe_checksums(spark, sf_dir):
    t = transfers(spark, sf_dir)
    return L.expected_checksums(_log_plans(t), t)


@query("j14_reconciled_recipe", f"""WITH {_EXP_SQL}, l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, item, asset ORDER BY seq DESC) AS rn FROM tr WHERE status = 'ok' AND seq % 3 <> 0) WHERE rn = 1)
SELECT ex.plan_id, source, file, CASE WHEN l2.sha256 IS NULL THEN 'missing' WHEN l2.sha256 = ex.sha256 THEN 'identical' WHEN source = 's1' THEN 'live' ELSE 'different' END AS outcome
FROM ex LEFT JOIN l2 ON l2.plan_id = ex.plan_id AND CAST(l2.item AS VARCHAR) || '/' || l2.asset = file""")
def reconciled(spark, sf_dir):
    t = transfers(spark, sf_dir)
    plans = _log_plans(t)
    return L.reconcile(L.expected_checksums(plans, t), t.where("seq % 3 <> 0"), plans.where("source = 's1'"))


@query("j4_acquisition_hrefs", """WITH it AS (SELECT p_partkey AS item, p_partkey % 3 AS m FROM part)
SELECT l_orderkey AS plan_id, l_linenumber AS n, l_partkey AS item, a AS asset, 'https://x/' || CAST(l_partkey AS VARCHAR) || '/' || a AS href FROM lineitem JOIN it ON it.item = l_partkey, (VALUES ('red'), ('nir')) t(a) WHERE a = 'red' OR m <> 0""")
def acquisition_hrefs(spark, sf_dir):
    k = F.col("p_partkey")
    url = lambda a: F.concat(F.lit("https://x/"), k.cast("string"), F.lit("/" + a))
    items = table(spark, sf_dir, "part").select(k.alias("item"), F.when(k % 3 == 0, F.create_map(F.lit("red"), url("red"))).otherwise(F.create_map(F.lit("red"), url("red"), F.lit("nir"), url("nir"))).alias("assets"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("item"), F.array(F.lit("red"), F.lit("nir")).alias("wanted"))
    return L.with_hrefs(a, items).select("plan_id", "n", "item", "asset", "href")


@query("a8_j6_p16_size_estimate", """WITH a AS (SELECT l_orderkey AS plan_id, CASE WHEN l_partkey % 6 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS size, coalesce(CASE WHEN l_suppkey % 4 <> 0 THEN (l_suppkey % 10) / 10.0::DOUBLE END, 1.0) AS f FROM lineitem)
SELECT plan_id, CAST(count(*) AS BIGINT) AS n_assets, CAST(coalesce(sum(size), 0) AS BIGINT) AS full_bytes, CAST(coalesce(sum(CAST(floor(size * f) AS BIGINT) + 2000000), 0) AS BIGINT) AS windowed_bytes, CAST(count(*) FILTER (size IS NULL) AS BIGINT) AS unknown FROM a GROUP BY 1""")
def size_estimate(spark, sf_dir):
    from tilewright.plans import layers
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS plan_id", "l_suppkey AS tile", "IF(l_partkey % 6 <> 0, CAST(round(l_extendedprice * 100) AS BIGINT), NULL) AS size")
    tiles = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS tile", "(s_suppkey % 10) / 10.0D AS fraction")
    return layers.estimate(L.with_fractions(a, tiles), "plan_id")


@query("j19_footprints_or_area", """SELECT o_orderkey AS plan_id, CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 0 THEN -1.0 ELSE c_custkey % 50 END::DOUBLE AS minx FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def footprints_or_area(spark, sf_dir):
    box = lambda x: F.struct(x.cast("double").alias("minx"), F.lit(0.0).alias("miny"), (x + 1).cast("double").alias("maxx"), F.lit(1.0).alias("maxy"))
    fp = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("item"), box(F.col("c_custkey") % 50).alias("box"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("item"))
    return L.with_footprints(a, fp, box(F.lit(-1))).select("plan_id", F.col("box.minx").alias("minx"))


@query("d8_refreshed_requests", """SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS old_end, DATE '1998-06-30' AS "end" FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-06-30'""")
def refreshed(spark, sf_dir):
    from tilewright.operators import windows
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("end"))
    return windows.refreshed(r, F.lit("1998-06-30").cast("date")).select("request_id", "old_end", "end")


# ---- tables written, changed and read back -------------------------------------------------------------------------

@query("s4_k1_item_table_search", f"""WITH {ITEMS_SQL},
fresh AS (SELECT source_id, item_id, d + 40 AS d, 1.0::DOUBLE AS cloud_cover, x0, y0 FROM items WHERE item_id % 10 = 0
 UNION ALL SELECT source_id, item_id + 10000000, d, cloud_cover, x0, y0 FROM items WHERE item_id % 50 = 0),
now AS (SELECT * FROM fresh UNION ALL SELECT source_id, item_id, d, cloud_cover, x0, y0 FROM items WHERE item_id % 10 <> 0)
SELECT source_id, item_id, strftime(d, '%Y-%m') AS month, cloud_cover FROM now
WHERE source_id IN ('src_click', 'src_error') AND x0 <= 4.5 AND x0 + 7 >= 2 AND y0 <= 6 AND y0 + 7 >= 1.5 AND d BETWEEN DATE '2024-06-10' AND DATE '2024-10-20'""")
def item_table(spark, sf_dir):
    box = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("x0", "minx"), ("y0", "miny"), ("x1", "maxx"), ("y1", "maxy"))])
    rows = (items(spark, sf_dir).withColumn("x1", F.col("x0") + 7).withColumn("y1", F.col("y0") + 7)
            .select("source_id", "item_id", "d", "cloud_cover", box.alias("footprint"), F.create_map(F.lit("tile"), F.col("tile").cast("string")).alias("props")))
    path = shared_folder(spark, "items")
    K.write_items(rows, path)
    moved = rows.where("item_id % 10 = 0").withColumn("d", F.date_add("d", 40)).withColumn("cloud_cover", F.lit(1.0))
    K.upsert_items(moved.unionByName(rows.where("item_id % 50 = 0").withColumn("item_id", F.col("item_id") + 10000000)), path)
    now = K.read_items(spark, path)
    found = [C.search_table(now, s, (2.0, 1.5, 4.5, 6.0), "2024-06-10", "2024-10-20") for s in ("src_click", "src_error")]
    return found[0].unionByName(found[1]).select("source_id", "item_id", "month", "cloud_cover")


@query("k5_appended_log", f"""WITH {TR_SQL} SELECT plan_id, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(seq) AS last_seq FROM tr GROUP BY 1, 2""")
def appended_log(spark, sf_dir):
    path = shared_folder(spark, "log")
    t = transfers(spark, sf_dir)
    for part in (0, 1):  # two runs append to one log
        K.append_log(t.where(F.col("seq") % 2 == part), path)
    return spark.read.parquet(path).groupBy("plan_id", "status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("seq").alias("last_seq"))


@query("k6_saved_documents", """SELECT CAST(o_custkey % 20 AS INT) AS project_id, o_orderkey AS request_id, CASE WHEN o_custkey % 20 < 5 THEN 'revised' ELSE 'ready' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS "start" FROM orders""")
def saved_documents(spark, sf_dir):
    path = shared_folder(spark, "requests")
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("int").alias("project_id"), F.col("o_orderkey").alias("request_id"), F.lit("ready").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    K.save_documents(r, path, "project_id")
    K.save_documents(r.where("project_id < 5").withColumn("status", F.lit("revised")), path, "project_id")  # only these projects are rewritten
    return spark.read.schema(r.schema).json(path).select("project_id", "request_id", "status", "start")


@query("g10_box_covers_and_overlaps", """WITH b AS (SELECT o_orderkey AS k, CAST(o_custkey % 50 AS DOUBLE) AS x, CAST(o_orderkey % 40 AS DOUBLE) AS y,
 CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 5e-10 WHEN 2 THEN 1e-6 WHEN 3 THEN 3 WHEN 4 THEN 10 ELSE -2 END::DOUBLE AS s FROM orders)
SELECT k, -1e-9::DOUBLE <= s AND x + 9 + 1e-9::DOUBLE >= x + s + 9 AND y + 8 + 1e-9::DOUBLE >= y + 4 AS covers, s <= 9 AND s + 9 >= 0 AS touches,
 round(greatest(0, least(x + 9, x + s + 9) - greatest(x, x + s)) * 4, 6) AS shared FROM b""")
def box_relations(spark, sf_dir):
    m = F.col("k") % 6
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).cast("double").alias("x"), (F.col("o_orderkey") % 40).cast("double").alias("y")).withColumn(
        "s", F.when(m == 0, 0.0).when(m == 1, 5e-10).when(m == 2, 1e-6).when(m == 3, 3.0).when(m == 4, 10.0).otherwise(-2.0))
    box = lambda x, y, w, h: F.struct(x.alias("minx"), y.alias("miny"), (x + w).alias("maxx"), (y + h).alias("maxy"))
    both = b.withColumn("a", box(F.col("x"), F.col("y"), 9, 8)).withColumn("b", box(F.col("x") + F.col("s"), F.col("y"), 9, 4))
    return both.select("k", P.box_covers(F.col("a"), F.col("b")).alias("covers"), P.boxes_touch(F.col("a"), F.col("b")).alias("touches"), F.round(P.box_overlap(F.col("a"), F.col("b")), 6).alias("shared"))

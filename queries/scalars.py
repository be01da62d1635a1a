"""Row-level functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, table
from queries.resolving import _planner, _lit
from tilewright import vocab as V
from tilewright.functions import scalars as S
from tilewright.sources import registry as R


@query("p9_safe_names", r"""SELECT page_id, rtrim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"))


@query("p10_cache_names", r"""SELECT page_id, rtrim(regexp_replace(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*[^?#]*)', 1), '/', '__'), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS name FROM pages""")
def cache_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.cache_name(F.col("url")).alias("name"))


@query("p11_slugs", r"""SELECT doc_id, sha256(coalesce(nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'project')) AS slug FROM documents""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.slug(F.col("text")), 256).alias("slug"))


@query("p12_redacted_pages", r"""SELECT page_id, sha256(regexp_replace(html || ' see ' || url || ' now', '(https?://[^\s''"?]+)\?[^\s''"]*', '\1?…', 'g')) AS html FROM pages""")
def redacted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(S.redact(F.concat("html", F.lit(" see "), "url", F.lit(" now"))), 256).alias("html"))


@query("p13_href_classes", r"""WITH h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://data.earthdatacloud.nasa.gov/lp-protected/' || url WHEN 1 THEN 'https://acct' || CAST(page_id AS VARCHAR) || '.blob.core.windows.net/c/x.tif'
 WHEN 2 THEN 'https://data.earthdatacloud.nasa.gov/public/x' WHEN 3 THEN 'https://x.earthdata.nasa.gov.evil.example/protected/x' ELSE url END AS href FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'protected' WHEN 1 THEN 'blob' ELSE 'plain' END AS class FROM h""")
def href_classes(spark, sf_dir):
    k, url = F.col("page_id"), F.col("url")
    href = (F.when(k % 5 == 0, F.concat(F.lit("https://data.earthdatacloud.nasa.gov/lp-protected/"), url))
            .when(k % 5 == 1, F.concat(F.lit("https://acct"), k.cast("string"), F.lit(".blob.core.windows.net/c/x.tif"))).when(k % 5 == 2, "https://data.earthdatacloud.nasa.gov/public/x")
            .when(k % 5 == 3, "https://x.earthdata.nasa.gov.evil.example/protected/x").otherwise(url))
    return table(spark, sf_dir, "pages").select("page_id", S.href_class(href).alias("class"))


@query("p14_size_texts", """SELECT o_orderkey AS id, CASE WHEN n >= 5e7 THEN format('{:.2f} GB', n / 1e9) ELSE format('{:.0f} MB', n / 1e6) END AS size FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * 1000 + 7 AS n FROM orders)""")
def size_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.size_text(F.round("o_totalprice").cast("bigint") * 1000 + 7).alias("size"))


@query("p15_partial_dates", """WITH v AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'live' WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS id, CASE k % 6 WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) WHEN 2 THEN CAST(date_trunc('year', d) AS DATE) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE d END AS d FROM v""")
def partial_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    v = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy")).when(k == 3, "live").when(k == 5, F.date_format(d, "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.partial_date(v).alias("d"))


@query("p17_nodata_values", f"""WITH p AS (SELECT p_partkey AS id, [{', '.join(_lit(k) for k in V.DTYPE_NODATA)}][CAST(p_partkey % 8 + 1 AS INT)] AS dt, CASE WHEN p_partkey % 5 = 0 THEN 0.0 END AS de, CASE WHEN p_partkey % 7 = 0 THEN 200.0 END AS ov FROM part)
SELECT id, CAST(coalesce(de, ov, CASE dt {' '.join(f"WHEN '{k}' THEN {v}" for k, v in V.DTYPE_NODATA.items())} END) AS DOUBLE) AS nodata FROM p""")
def nodata_values(spark, sf_dir):
    k = F.col("p_partkey")
    dt = F.element_at(F.lit(list(V.DTYPE_NODATA)), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), S.nodata_value(dt, F.when(k % 5 == 0, F.lit(0.0)), F.when(k % 7 == 0, F.lit(200.0))).alias("nodata"))


@query("p18_p19_planners", """WITH p AS (SELECT p_partkey AS k, ['layer', 'series', 'query', 'series'][CAST(p_size % 4 + 1 AS INT)] AS shape, CASE WHEN p_partkey % 9 = 0 THEN 'http' ELSE 'stac' END AS driver, CASE WHEN p_partkey % 7 = 0 THEN 'products' END AS ex, p_partkey % 2 = 0 AS cloud, p_partkey % 3 = 0 AS sar, p_partkey % 5 < 3 AS orbit, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 20 END AS rv FROM part)
SELECT k AS id, CASE WHEN shape = 'series' AND driver = 'stac' THEN coalesce(ex, CASE WHEN cloud THEN 'optical' WHEN sar AND orbit THEN 'sar' ELSE 'products' END) END AS planner, coalesce(rv, 0) >= 300 AS yearly FROM p""")
def planners(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), S.planner(
        F.element_at(F.lit(["layer", "series", "query", "series"]), (F.col("p_size") % 4 + 1).cast("int")), F.when(k % 9 == 0, "http").otherwise("stac"), F.when(k % 7 == 0, "products"), k % 2 == 0,
        F.when(k % 3 == 0, F.array(F.lit("sar"))).otherwise(F.array(F.lit("optical"))), F.when(k % 5 < 3, F.array(F.lit("sat:relative_orbit")))).alias("planner"),
        S.yearly(F.when(k % 4 != 0, F.col("p_size") * 20)).alias("yearly"))


@query("p20_chosen_assets", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'red,nir,green,swir16' WHEN 1 THEN 'green,nir,swir16,red,blue' WHEN 2 THEN 'red,nir' ELSE 'vv,vh' END AS assets FROM orders""")
def chosen_assets(spark, sf_dir):
    """Assets of the sources of registry for the themes a request names."""
    k = F.col("o_orderkey") % 4
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 3, "sentinel-1-rtc").otherwise("sentinel-2-l2a").alias("source_id"), F.when(k == 0, F.array(F.lit("vegetation"), F.lit("water"))).when(
        k == 1, F.array(F.lit("water"), F.lit("optical"))).when(k == 2, F.array(F.lit("sar"))).otherwise(F.array(F.lit("sar"), F.lit("water"))).alias("themes"))
    s = R.load_sources(spark).select(F.col("id").alias("source_id"), "theme_assets", "default_assets", F.map_keys("assets").alias("names"))
    return o.join(s, "source_id").select("id", F.array_join(S.chosen_assets(F.col("themes"), F.col("theme_assets"), F.col("default_assets"), F.col("names")), ",").alias("assets"))

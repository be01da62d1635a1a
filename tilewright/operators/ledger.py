"""What plans require against what is recorded and what was transferred: gaps, progress, status, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.functions import scalars as S
from tilewright.operators.library import newest

KEY = ["item", "asset"]


def present_assets(recorded: DataFrame, inventory: DataFrame, verify: bool = False) -> DataFrame:
    """Recorded (item, asset) pairs whose file exists with the recorded size, and checksum when `verify`.

    recorded: item, asset, path, size, checksum; inventory: path, size, checksum.
    """
    inv = inventory.select("path", F.col("size").alias("_size"), F.col("checksum").alias("_sum"))
    j = recorded.join(inv, "path").where(F.col("size") == F.col("_size"))
    return (j.where(F.col("checksum") == F.col("_sum")) if verify else j).select(*KEY).distinct()


def gaps(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required files that are not there; the window is not part of the key, since one item in two windows is one file."""
    return required.join(present.select(*KEY), KEY, "left_anti")


def fetchable(missing: DataFrame, hits: DataFrame) -> DataFrame:
    """(plan, item, asset) that are missing and in the library."""
    return hits.select("plan_id", *KEY).intersect(missing.select("plan_id", *KEY))


def actions(required: DataFrame, present: DataFrame, hits: DataFrame) -> DataFrame:
    """skip, reuse or fetch for every required file."""
    have = present.select(*KEY).distinct().withColumn("_have", F.lit(True))
    lib = hits.select("plan_id", *KEY).distinct().withColumn("_lib", F.lit(True))
    j = required.join(have, KEY, "left").join(lib, ["plan_id", *KEY], "left")
    return j.withColumn("action", F.when(F.col("_have"), "skip").when(F.col("_lib"), "reuse").otherwise("fetch")).drop("_have", "_lib")


def remaining(estimates: DataFrame, missing: DataFrame, from_library: DataFrame) -> DataFrame:
    """Present files, files from the library and bytes still to fetch per plan.  estimates: plan_id, n_assets, windowed_bytes."""
    m = missing.select("plan_id", *KEY).distinct().groupBy("plan_id").agg(F.count("*").alias("n_missing"))
    h = from_library.groupBy("plan_id").agg(F.count("*").alias("from_library"))
    n, zero = F.col("n_assets"), F.lit(0)
    j = (estimates.join(m, "plan_id", "left").join(h, "plan_id", "left").withColumn("n_missing", F.coalesce("n_missing", zero))
         .withColumn("from_library", F.coalesce("from_library", zero)))
    todo = S.share_of(F.col("windowed_bytes"), F.col("n_missing") - F.col("from_library"), n)
    return j.withColumn("present", n - F.col("n_missing")).withColumn("to_fetch_bytes", F.when(n > 0, todo).otherwise(0)).drop("n_missing")


def request_totals(plans: DataFrame) -> DataFrame:
    """Bytes and files of a request over its plans."""
    return plans.groupBy("request_id").agg(F.sum("to_fetch_bytes").alias("total_bytes"), F.sum("n_assets").alias("total_files"))


def run_totals(plans: DataFrame, transfers: DataFrame) -> DataFrame:
    """Fetched, reused and failed transfers per request and the status that follows.  plans: request_id, plan_id."""
    t = transfers.join(plans.select("request_id", "plan_id"), "plan_id").groupBy("request_id").agg(
        F.count_if(F.col("status") == "ok").alias("fetched"), F.count_if((F.col("status") == "ok") & F.col("reused")).alias("reused"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    return t.withColumn("state", F.when(F.col("failed") == 0, "complete").otherwise("partial"))


def plan_status(plans: DataFrame, missing: DataFrame) -> DataFrame:
    """complete, partial, missing or skipped per plan.  plans: plan_id, n_assets, n_acquire."""
    m = missing.groupBy("plan_id").agg(F.count("*").alias("n_missing"))
    total = F.coalesce(F.nullif("n_assets", F.lit(0).cast("bigint")), F.col("n_acquire"))
    j = plans.join(m, "plan_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0))).withColumn("total", total)
    skipped = (F.col("n_assets") == 0) & (F.col("n_acquire") == 0)
    state = (F.when(skipped, "skipped").when(F.col("n_missing") == 0, "complete").when(F.col("n_missing") == F.col("total"), "missing").otherwise("partial"))
    return j.withColumn("state", state).withColumn("present", F.col("total") - F.col("n_missing")).select("plan_id", "present", "total", "state")


def job_progress(plans: DataFrame, missing: DataFrame, transfers: DataFrame) -> DataFrame:
    """Files present per plan while a run is on: an ok entry in the log counts before the catalogue records it."""
    done = transfers.where("status = 'ok'").select("plan_id", *KEY)
    left = missing.select("plan_id", *KEY).distinct().join(done, ["plan_id", *KEY], "left_anti").groupBy("plan_id").agg(F.count("*").alias("_left"))
    return plans.join(left, "plan_id", "left").select("plan_id", "total", (F.col("total") - F.coalesce("_left", F.lit(0))).alias("present"))


def latest_entries(transfers: DataFrame) -> DataFrame:
    """Last log entry per (plan, item, asset)."""
    return newest(transfers, ["plan_id", *KEY], "seq")


def still_missing(transfers: DataFrame) -> DataFrame:
    """Last failure of files that never succeeded, with its error and whether trying again may help."""
    ok = transfers.where("status = 'ok'").select("plan_id", *KEY)
    failed = transfers.where("status <> 'ok'").join(ok, ["plan_id", *KEY], "left_anti")
    return newest(failed, ["plan_id", *KEY], "seq").withColumn("error", S.redact(F.col("error"))).withColumn("transient", S.transient(F.col("error")))


def expected_checksums(plans: DataFrame, transfers: DataFrame) -> DataFrame:
    """Recipe rows: checksum and size of every file that was produced, the last ok entry deciding.

    One row per file rather than one map per plan, so that a plan of any size can be exported.
    """
    ok = newest(transfers.where("status = 'ok'"), ["plan_id", *KEY], "seq")
    return plans.select("plan_id", "source").join(ok, "plan_id").select(
        "plan_id", "source", F.concat_ws("/", *KEY).alias("file"), "sha256", "bytes")


def reconcile(expected: DataFrame, transfers: DataFrame, live_sources: DataFrame) -> DataFrame:
    """identical, different, live or missing for every expected file; sources that change by design excuse a difference."""
    got = newest(transfers.where("status = 'ok'"), ["plan_id", *KEY], "seq").select("plan_id", F.concat_ws("/", *KEY).alias("file"), F.col("sha256").alias("_got"))
    live = live_sources.select("source").distinct().withColumn("_live", F.lit(True))
    j = expected.join(got, ["plan_id", "file"], "left").join(live, "source", "left")
    outcome = (F.when(F.col("_got").isNull(), "missing").when(F.col("_got") == F.col("sha256"), "identical").when(F.col("_live"), "live").otherwise("different"))
    return j.select("plan_id", "source", "file", outcome.alias("outcome"))


def live_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("driver").isin(*V.LIVE_DRIVERS)).select(F.col("id").alias("source"))


def with_fractions(acquire: DataFrame, tiles: DataFrame) -> DataFrame:
    """Share of a tile inside the area for every acquisition, one where the tile is unknown.  tiles: tile, fraction."""
    return acquire.join(tiles.select("tile", F.col("fraction").alias("_f")), "tile", "left").withColumn("fraction", F.coalesce("_f", F.lit(1.0))).drop("_f")


def with_hrefs(acquire: DataFrame, items: DataFrame) -> DataFrame:
    """Acquisitions joined to their items, one row per wanted asset with its address.  acquire: plan_id, item, wanted ARRAY."""
    j = acquire.join(items.select("item", "assets"), "item").withColumn("asset", F.explode("wanted"))
    return j.withColumn("href", F.try_element_at("assets", F.col("asset"))).where(F.col("href").isNotNull()).drop("assets", "wanted")


def with_footprints(acquire: DataFrame, footprints: DataFrame, area: Column) -> DataFrame:
    """Footprint of every acquisition; the whole area where the item is unknown.  footprints: item, box."""
    return acquire.join(footprints.select("item", F.col("box").alias("_b")), "item", "left").withColumn("box", F.coalesce("_b", area)).drop("_b")

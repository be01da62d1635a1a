"""Writers: catalogue upsert, listings, library table, execution log, requests, recipes and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tilewright.session import write_stage


def merge_items(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Catalogue items after an upsert: new properties and assets override, assets acquired earlier are kept.

    Both: keys…, props MAP, assets MAP.
    """
    keys = keys or ["item"]
    o = old.select(*keys, F.col("props").alias("_op"), F.col("assets").alias("_oa"))
    n = new.select(*keys, F.col("props").alias("_np"), F.col("assets").alias("_na"))
    j = o.join(n, keys, "full")
    # names are held under the alias so that the higher-order function sees a plain column
    kept = F.map_filter("_oa", lambda k, _: ~F.array_contains(F.map_keys("_na"), k))
    both = F.col("_oa").isNotNull() & F.col("_na").isNotNull()
    assets = F.when(both, F.map_concat(kept, F.col("_na"))).otherwise(F.coalesce("_na", "_oa"))
    return j.select(*keys, F.coalesce("_np", "_op").alias("props"), assets.alias("assets"))


def upsert_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Rewrite only the partitions that occur in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def catalogue_links(items: DataFrame) -> DataFrame:
    """Sorted item links of the catalogue root, as rows: a project may hold any number of items."""
    return items.select("project", "item").distinct().select(
        "project", "item", F.concat(F.lit("./items/"), F.col("item").cast("string"), F.lit(".json")).alias("href"), F.lit("item").alias("rel")).orderBy("project", "item")


def item_summary(items: DataFrame) -> DataFrame:
    """One line per catalogue item with its asset names in order.  items: item, props MAP, assets MAP."""
    p = lambda k: F.try_element_at("props", F.lit(k))
    return items.select("item", p("source").alias("source"), p("window").alias("window"), F.substring(F.coalesce(p("datetime"), F.lit("")), 1, 10).alias("date"),
                        F.sort_array(F.map_keys("assets")).alias("assets"), p("plan").alias("plan"))


def append_log(transfers: DataFrame, path: str) -> None:
    transfers.write.mode("append").parquet(path)


def save_documents(df: DataFrame, path: str, *partitions: str) -> None:
    """Request or plan documents as JSON, one partition per request."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).json(path)


def recipe_documents(plans: DataFrame, drop: tuple[str, ...] = ("execution", "detail", "status")) -> DataFrame:
    """Plan documents without their volatile fields, as JSON text next to their id."""
    keep = [c for c in plans.columns if c not in drop]
    return plans.select("plan_id", F.to_json(F.struct(*keep)).alias("document"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Report text in order, as consecutive part files; no single task holds the whole report.

    lines: report_id, section, line_no, line.
    """
    ordered = lines.repartitionByRange("report_id", "section", "line_no").sortWithinPartitions("report_id", "section", "line_no")
    ordered.select("line").write.mode("overwrite").text(path)


# ---- the item table, partitioned by source and month ---------------------------------------------------------------

ITEM_PARTITIONS = ("source_id", "month")


def _dated(items: DataFrame) -> DataFrame:
    return items.withColumn("month", F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("undated")))


def write_items(items: DataFrame, path: str, partitions: int | None = None) -> None:
    """Catalogue items as a Parquet table partitioned by source and month of `d`; partitions that occur in `items` are replaced.

    Rows are dealt by ranges of source, month and place, so a month with much of the catalogue is written by many tasks, and a file
    holds neighbouring footprints, whose bounds let a search skip it.
    """
    by = [*ITEM_PARTITIONS, "footprint.minx", "footprint.miny", "item_id"]
    rows = _dated(items)
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    upsert_partitions(dealt.sortWithinPartitions(*by), path, *ITEM_PARTITIONS)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The item table; months stay text."""
    schema = spark.read.parquet(path).schema
    for field in schema:
        if field.name == "month":
            field.dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)


def upsert_items(new: DataFrame, path: str) -> None:
    """New and changed items put into the table: a row replaces the one with its source and id, wherever the old one's month was.

    Only partitions that gain or lose a row are read and rewritten.  Of equal ids in `new` the last by date counts, then the one of largest hash.
    """
    spark = new.sparkSession
    order = F.struct(F.col("d"), F.xxhash64(*[c for c in new.columns if c not in ("props", "assets")]))
    one = new.groupBy("source_id", "item_id").agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    fresh = write_stage(_dated(one), "items")
    old = read_items(spark, path)
    moved = old.join(fresh.select("source_id", "item_id"), ["source_id", "item_id"], "left_semi").select(*ITEM_PARTITIONS)
    touched = write_stage(moved.union(fresh.select(*ITEM_PARTITIONS)).distinct(), "touched")
    kept = old.join(touched, list(ITEM_PARTITIONS), "left_semi").join(fresh.select("source_id", "item_id"), ["source_id", "item_id"], "left_anti")
    merged = write_stage(kept.unionByName(fresh, allowMissingColumns=True), "merged")
    write_items(merged.drop("month"), path)
    empty = touched.join(merged.select(*ITEM_PARTITIONS).distinct(), list(ITEM_PARTITIONS), "left_anti")
    _drop_partitions(spark, path, empty)


def _drop_partitions(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Folders of partitions that lost their last row; as many as months that an upsert emptied."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in gone.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/source_id={name(r.source_id)}/month={name(r.month)}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

"""The table of files held across projects: upsert, reuse lookup, overlap search and summaries.

Columns: path, project, source, item, asset, window, d, epsg, native_grid, cover (box struct), bytes, sha256, source_href, acquired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions import polygons as P
from tilewright.session import write_stage


def newest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row per key by `order`; an aggregate that combines on the map side, so a key with many rows is no hot spot."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(library: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows replace old ones with the same path."""
    both = library.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return newest(both, ["path"], "_new", "acquired").drop("_new")


def forget_missing(library: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows whose file is still listed."""
    return library.join(inventory.select("path"), "path", "left_semi")


def gone(library: DataFrame, inventory: DataFrame) -> DataFrame:
    return library.join(inventory.select("path"), "path", "left_anti")


def reusable(needed: DataFrame, library: DataFrame, inventory: DataFrame) -> DataFrame:
    """First held file that gives exactly what a download would.

    Same source, item and asset; on the source's own grid; in the wanted projection; present with its recorded size; covering
    what is needed; from another project.  needed: need_id, source, item, asset, box, epsg, project.
    """
    present = inventory.select("path", F.col("size").alias("_size"))
    held = (library.where("native_grid").join(present, "path").where(F.col("_size") == F.col("bytes"))
            .select("source", "item", "asset", F.col("path").alias("held_path"), F.col("project").alias("held_project"), F.col("epsg").alias("held_epsg"), "cover"))
    match = (needed.join(held, ["source", "item", "asset"])
             .where((F.col("held_project") != F.col("project")) & (F.col("held_epsg") == F.col("epsg")) & P.box_covers(F.col("cover"), F.col("box"))))
    return match.groupBy("need_id").agg(F.min(F.struct("held_path", "held_project")).alias("h")).select("need_id", "h.*")


def library_hits(needed: DataFrame, library: DataFrame, inventory: DataFrame) -> DataFrame:
    """Distinct (plan, item, asset) the library can supply; plans with whole-file downloads never reuse."""
    ok = needed.where(~F.col("whole_file"))
    return ok.join(reusable(ok, library, inventory).select("need_id"), "need_id", "left_semi").select("plan_id", "item", "asset").distinct()


def over(library: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Files whose cover meets an area (closed boxes).

    Both sides are laid on a coarse grid and joined on its squares; a pair is taken only in the square that holds the
    lower-left corner of its overlap, so no distinct is needed.  areas: area_id, box.
    """
    def spread(df: DataFrame, box: str) -> DataFrame:
        g = lambda c: F.floor(F.col(f"{box}.{c}") / cell).cast("int")
        return (df.withColumn("_gx", F.explode(F.sequence(g("minx"), g("maxx")))).withColumn("_gy", F.explode(F.sequence(g("miny"), g("maxy")))))

    j = spread(library, "cover").join(spread(areas.select("area_id", "box"), "box"), ["_gx", "_gy"])
    corner = lambda c: F.floor(F.greatest(F.col(f"cover.{c}"), F.col(f"box.{c}")) / cell).cast("int")
    return j.where(P.boxes_touch(F.col("cover"), F.col("box")) & (F.col("_gx") == corner("minx")) & (F.col("_gy") == corner("miny"))).drop("_gx", "_gy", "box")


def _totals() -> dict[str, tuple]:
    """Totals of files, each as its aggregate over rows and the aggregate that adds such totals up."""
    return {"files": (F.count("*"), F.sum), "bytes": (F.sum("bytes"), F.sum), "first_path": (F.min("path"), F.min),
            "first_date": (F.min("d"), F.min), "last_date": (F.max("d"), F.max)}


def totals_over(library: DataFrame, areas: DataFrame, cell: float, totals: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals (`_totals`) of the files whose cover meets an area, per area and `keys`: what grouping the rows of `over` gives.

    Files are added up by cover (a scene's files share it) before they meet an area, and areas of the same boxes are asked once, so no
    pair of file and area is made.  Rows of one key meet in one partition, and what leaves it is the result's rows.
    """
    known = _totals()
    # numbered once, so that a question is a number wherever files and results carry it
    asked = write_stage(areas.groupBy("area_id").agg(F.sort_array(F.collect_list("box")).alias("boxes")), "areas")
    shapes = write_stage(asked.select("boxes").distinct().withColumn("_shape", F.monotonically_increasing_id()), "boxes")
    own = library.groupBy(*keys, "cover").agg(*[known[t][0].alias(t) for t in totals])
    if keys:
        own = own.repartition(*keys)
    added = over(own, shapes.select(F.col("_shape").alias("area_id"), F.explode("boxes").alias("box")), cell)
    added = added.groupBy(*keys, F.col("area_id").alias("_shape")).agg(*[known[t][1](t).alias(t) for t in totals])
    return added.join(asked.join(shapes, "boxes").select("area_id", "_shape"), "_shape").select("area_id", *keys, *totals)


def items_held(library: DataFrame) -> DataFrame:
    """Items of a source held on their native grid, per projection."""
    return library.where("native_grid").select("source", "epsg", "item").distinct()


def summary(library: DataFrame) -> DataFrame:
    """Totals, per source and per project in one pass."""
    sets = [[F.col("source")], [F.col("project")], []]
    return (library.groupingSets(sets, "source", "project").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_distinct("project").alias("projects"))
        .withColumn("level", F.when(F.col("_g") == 1, "source").when(F.col("_g") == 2, "project").otherwise("total")).drop("_g"))


def by_source(library: DataFrame) -> DataFrame:
    return library.groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("project").alias("projects")).orderBy(
        F.desc("bytes"), "source")


def here(library: DataFrame, areas: DataFrame, cell: float, own_project: Column) -> DataFrame:
    """What other projects hold over every area, per source and project, with first and last date."""
    return totals_over(library.where(F.col("project") != own_project), areas, cell, ["files", "bytes", "first_date", "last_date"], ("source", "project"))


def scan_catalogue(items: DataFrame, native: DataFrame, inventory: DataFrame, project_epsg: Column) -> DataFrame:
    """Library rows from existing catalogue items: one per asset whose file exists.

    items: project, source, item, window, d, epsg, cover, assets MAP<name, STRUCT<path, size, checksum, href, native_grid>>;
    native: project, item known to be on the source's grid; the checksum loses its four-digit prefix.
    """
    rows = items.select("*", F.explode("assets").alias("asset", "a")).drop("assets")
    marks = native.select("project", "item").distinct().withColumn("_native", F.lit(True))
    return (rows.join(inventory.select(F.col("path").alias("_p")), F.col("a.path") == F.col("_p"), "left_semi").join(marks, ["project", "item"], "left")
            .select(F.col("a.path").alias("path"), "project", "source", "item", "asset", "window", "d", F.coalesce("epsg", project_epsg).alias("epsg"),
                    F.coalesce("a.native_grid", "_native", F.lit(False)).alias("native_grid"), "cover", F.col("a.size").alias("bytes"),
                    F.substring("a.checksum", 5, 1000).alias("sha256"), F.col("a.href").alias("source_href")))

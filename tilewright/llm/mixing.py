"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tilewright.llm.stages import stage

WEIGHTS = (5, 2, 1)
MOST = 3             # no source is repeated more often
BUCKET_ROWS = 50_000  # rows of a source that one range of keys is meant to hold


def _sized(of: str = ""):
    words = F.regexp_count(F.coalesce(F.col(f"{of}text"), F.lit("")), F.lit("[^ \\t-\\r]+"))
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(f"{of}doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.col(f"{of}source").alias("source"), words.cast("long").alias("size"), key.alias("key"), F.col(f"{of}doc_id").alias("doc_id")


def sizes(docs: DataFrame) -> DataFrame:
    """(source, size, key, doc_id) of every row: words of the text and a 60-bit hash-random key of doc_id."""
    return docs.select(*_sized())


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target) of every source.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes.  A source stops at `most`
    times its own size and the excess goes to the others by weight, until none is above: sources are filled in the order in
    which they reach their bound as the common factor grows, which is the fixed point of that sharing.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (turn % len(weights)).cast("int")).cast("long")
    ranked = W.orderBy(F.col("source_size").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(W.unboundedPreceding, -1), ranked.rowsBetween(0, W.unboundedFollowing)
    filled = (each.withColumn("weight", weight)
              .withColumn("left", (F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double"))
              .withColumn("shares", F.sum("weight").over(after).cast("double")))
    # the first source that stays below its bound stops the filling: it and all after it share what is left
    open_ = F.col("left") * F.col("weight") <= F.lit(float(most)) * F.col("source_size") * F.col("shares")
    first = filled.withColumn("open", open_).withColumn("at", F.row_number().over(ranked))
    stop = F.min(F.when(F.col("open"), F.struct("at", "left", "shares"))).over(W.partitionBy())
    done = first.withColumn("stop", stop)
    target = F.when(F.col("at") < F.coalesce(F.col("stop.at"), F.lit(1 << 62)), F.lit(float(most)) * F.col("source_size")).otherwise(
        F.col("stop.left") * F.col("weight") / F.col("stop.shares"))
    return done.select("source", "source_size", "n_rows", target.cast("double").alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`; reads doc_id, source and text only.

    size is the number of words, 0 for null and blank texts.  taken is the words that the mix takes: whole passes over the
    source as often as its budget holds them, then, in the order of the hash-random keys, documents until the budget is spent;
    the one at the cut gives the words that are left.  So a source's taken words are its target rounded down.  Equal keys
    (repeated doc_id) are ordered by id and size; repeated rows count each.  A null source is a source of its own, a null
    doc_id has a key like any other.  Sources without words take nothing; an empty table gives an empty one.

    Each source's keys are cut into ranges of about `bucket_rows` rows; sums of ranges are added up first, and rows are only
    ordered inside a range, so a source with a third of all rows is spread like all others.
    """
    sized = stage(sizes(docs), "sizes")
    each = stage(targets(sized, weights, most), "targets")
    return placed(sized, each, bucket_rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def placed(sized: DataFrame, each: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of `sizes` with its source's figures, whole passes, and the words that the cut leaves it in the last one."""
    ranges = F.ceil(F.col("n_rows") / F.lit(bucket_rows)).cast("long")
    each = each.withColumn("ranges", ranges).withColumn("budget", F.floor("target"))
    each = each.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
    each = each.withColumn("spare", F.col("budget") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "s")
    # the range grows with the key: upper 30 bits of the 60-bit key, scaled to the number of ranges
    rows = (sized.join(each, F.col("source").eqNullSafe(F.col("s"))).drop("s", "n_rows", "budget")
            .withColumn("range", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30)).drop("ranges"))
    sums = rows.groupBy(F.col("source").alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("s").orderBy("r").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("s", "r", F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    at = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (cut.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("spare") - at)))
            .withColumn("taken", F.col("passes") * F.col("size") + F.col("last")))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them; documents stay whole.

    The document at a source's cut is in if at least half of it is.  Each source then needs its passes and the last key taken
    only, so texts are not shuffled.  Documents without words are left out.
    """
    sized = stage(sizes(docs), "sizes")
    rows = placed(sized, stage(targets(sized, weights, most), "targets"), bucket_rows)
    taken = F.when((F.col("last") * 2 >= F.col("size")) & (F.col("last") > 0), _place("key", "doc_id", "size"))
    last = stage(rows.groupBy(F.col("source").alias("s")).agg(F.max("passes").alias("passes"), F.max(taken).alias("cut")), "cuts")
    whole = docs.select(F.struct("*").alias("row")).select("row", *_sized("row."))
    copies = F.col("passes") + F.coalesce(_place("key", "doc_id", "size") <= F.col("cut"), F.lit(False)).cast("long")
    many = whole.join(last, F.col("source").eqNullSafe(F.col("s"))).select(
        F.explode(F.array_repeat("row", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))).alias("row"))
    return many.select("row.*")


def _place(key: str, doc_id: str, size: str):
    return F.struct(F.col(key).alias("a"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("b"), F.col(size).alias("c"))


MIXING_SQL = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
e AS (SELECT source, sum(size)::BIGINT AS source_size, (list_value(5, 2, 1))[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight
 FROM s GROUP BY source),
f AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
 (sum(weight) OVER (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS shares,
 row_number() OVER (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST) AS place FROM e),
o AS (SELECT rest, shares, place FROM f WHERE rest * weight <= 3.0::DOUBLE * source_size * shares ORDER BY place LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN o.place IS NULL OR f.place < o.place THEN 3.0::DOUBLE * f.source_size ELSE o.rest * f.weight / o.shares END AS target
 FROM f LEFT JOIN o ON true),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
p AS (SELECT s.*, b.source_size, b.target, b.passes, b.budget - b.passes * b.source_size AS spare,
 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (passes * size + greatest(0, least(size, spare - before)))::BIGINT AS taken FROM p
"""

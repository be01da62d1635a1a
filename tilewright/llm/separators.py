"""Tokens of every document in flat token files without an index, found by their end-of-document ids.

A token file is a run of unsigned 16-bit ids kept as numbered blocks.  Blocks are searched for the end id one by one; what
crosses a block's edge is stitched by prefix sums and maxima over the blocks' counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tilewright.llm.stages import over_batches, stage
from tilewright.llm.tokens import Encoder, tokenizer_file
from tilewright.llm.words import chunks

END = 50256
BLOCK = 1 << 18  # ids in a block


def token_files(docs: DataFrame, path: str | None = None, block: int = BLOCK, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Flat files of all documents' ids, each document followed by the end id, and the order of documents in them.

    (file string, block long, ids binary) and (file, ordinal long, doc_id).  Every task writes a file.  An end id inside a
    text (from the special token's own string) is left out, or it would end the document.
    """
    path = path or tokenizer_file()

    def work(batches):
        import uuid
        encoder, name, number, ordinal, rest = Encoder.of(path), uuid.uuid4().hex, 0, 0, np.zeros(0, np.uint16)
        for batch in batches:
            for rows, _, _ in chunks(batch, "text"):
                ids = [np.frombuffer(b, np.uint32) for b in encoder.encode(rows.column("text").to_pylist())]
                flat = np.concatenate([x for one in ids for x in (one[one != end], [end])]).astype(np.uint16)
                rest = np.concatenate([rest, flat])
                n = len(ids)
                yield [pa.array([name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), np.arange(ordinal, ordinal + n), rows.column("doc_id")]
                ordinal += n
                full = len(rest) // block
                if full:
                    yield [pa.array([name] * full), np.arange(number, number + full), [rest[i * block:(i + 1) * block].tobytes() for i in range(full)],
                           pa.nulls(full, pa.int64()), pa.nulls(full, pa.int64())]
                    number, rest = number + full, rest[full * block:]
        if len(rest):
            yield [pa.array([name]), np.array([number]), [rest.tobytes()], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]

    made = over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "file string, block long, ids binary, ordinal long, doc_id long", work)
    kept = stage(made, "tokens")
    return kept.where("block IS NOT NULL").select("file", "block", "ids"), kept.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")


def counted(files: DataFrame, end: int = END) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in flat files (file, block, ids).

    start is the place of its first id in the file, n_tokens does not count the end id.  Ids after the last end id are a
    document with ended = false.  Blocks may have any length; a null or empty one holds nothing.  Documents may span blocks,
    and an end id next to another one is an empty document.  An empty table gives an empty one.
    """
    def work(batches):
        for batch in batches:
            names, blocks, sizes, places = [], [], [], []
            for name, block, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                flat = np.frombuffer(ids or b"", np.uint16)
                names.append(name)
                blocks.append(block)
                sizes.append(len(flat))
                places.append(np.flatnonzero(flat == end).astype(np.int32))
            yield [names, blocks, sizes, places]

    found = stage(over_batches(files.select("file", "block", "ids"), "file string, block long, n long, ends array<int>", work), "ends")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    sums = found.select("file", "block", "n", F.size("ends").alias("k"), last.alias("last"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    sums = sums.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(-1)))  # place of the end id before the block
    inside = found.select("file", "block", "ends").where(F.size("ends") > 0).join(sums.select("file", "block", "base", "first", "open"), ["file", "block"])
    each = inside.select("file", "base", "first", "open", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1)) + 1
    ended = each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = sums.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)).alias("end"))
    tail = whole.where("n > end + 1").select("file", "ordinal", (F.col("end") + 1).alias("start"), (F.col("n") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(tail)


def document_tokens(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) for each row of `docs` (doc_id, text): flat files are written, searched, and read against their order.

    Null and empty texts have no tokens.  Repeated rows and null ids are counted each.  An empty table gives an empty one.
    """
    files, order = token_files(docs, path, block)
    return counted(files).where("ended").join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")

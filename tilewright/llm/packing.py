"""Best-fit packing of documents into sequences: residual pieces are packed in partitions, nearly full bins leave, and the
underfull ones are merged in a tree as items of further best-fit rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import over_batches, stage
from tilewright.llm.tokens import Encoder, tokenizer_file
from tilewright.llm.words import chunks

LENGTH = 2048
END = 0
TASK_ITEMS = 200_000  # items that one task packs at once
FAN_IN = 8            # partitions whose underfull bins meet in the next round
FULL = 0.995          # a bin so full leaves at once


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id, cut into pieces of at most `length`."""
    path = path or tokenizer_file()

    def work(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for rows, _, _ in chunks(batch, "text"):
                out = [[], [], [], [], []]
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(rows.column("text").to_pylist())):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    edges = [0, *range(n % length or min(n, length), n, length), n] if n > length else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        for column, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))):
                            column.append(v)
                yield out
    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by falling size, each into the fullest bin that still holds it."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room that they have left
    open_ = 0  # bit r is set when some bin has room r
    out, bins = np.empty(len(sizes), np.int64), 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_ >> size
        if fits:
            r = size + ((fits & -fits).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        if r - size:
            room[r - size].append(b)
            open_ |= 1 << (r - size)
    return out


def _packed(batches, capacity, limit):
    """Rows of one task, each a bin of the round before, packed by best fit in lots of `limit`; a row for each bin made."""
    def flush(lot):
        lot = lot.sort_by([("used", "descending"), ("first", "ascending"), ("part", "ascending")])
        bins = best_fit(lot["used"].to_numpy().astype(np.int64), capacity)
        order = pa.array(np.argsort(bins, kind="stable"))
        n = np.bincount(bins)
        merged = lot.take(order)
        edges = np.concatenate([[0], np.cumsum(n)])
        out = []
        for name in ("ids", "parts", "starts", "lengths", "sums"):
            column = merged[name].combine_chunks()
            offsets = column.offsets.to_numpy()[edges]
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), column.values))
        out.append(pa.array(np.add.reduceat(merged["used"].to_numpy(), edges[:-1]).astype(np.int32)))
        return out

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            yield flush(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield flush(pa.Table.from_batches(held))


_BINS = "ids array<long>, parts array<int>, starts array<long>, lengths array<int>, sums array<long>, used int"


def _round(bins: DataFrame, tasks: int, length: int) -> DataFrame:
    dealt = bins.withColumn("first", F.get("ids", F.lit(0))).withColumn("part", F.get("parts", F.lit(0)))
    dealt = dealt.repartition(tasks, F.xxhash64("first", "part", F.get("starts", F.lit(0))))
    return stage(over_batches(dealt, _BINS, lambda b: _packed(b, length, TASK_ITEMS)), "bins")


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of `docs` (doc_id, text).

    A document is its token ids and one end id; a null or empty text is the end id alone.  Only a document longer than a
    sequence is cut, and only its first piece may then be short, so at most one piece of each document is packed; the others
    fill a sequence each.  Repeated rows are packed each.  Pieces of equal length are taken by id.  Null ids are packed like
    others.  An empty table gives an empty one.

    Round 1 packs each task's pieces by best fit, largest first.  Bins filled to FULL leave.  The rest are items of the next
    round on an eighth of the tasks, until one lot holds them all or a round no longer merges a twentieth of its bins; no task
    holds more than TASK_ITEMS items at once.  Each round is a table in the shared folder, so its bins stay as they were.
    """
    cut = stage(pieces(docs, length, path), "pieces")
    whole = cut.where(F.col("length") == length).select(F.array("doc_id").alias("ids"), F.array("piece").alias("parts"), F.array("start").alias("starts"),
                                                       F.array(F.col("length").cast("int")).alias("lengths"), F.array("ids_crc32").alias("sums"), F.lit(length).alias("used"))
    items = cut.where(F.col("length") < length).select(F.array("doc_id").alias("ids"), F.array("piece").alias("parts"), F.array("start").alias("starts"),
                                                      F.array(F.col("length").cast("int")).alias("lengths"), F.array("ids_crc32").alias("sums"), F.col("length").cast("int").alias("used"))
    n = items.count()
    tasks, done = max(1, -(-n // (TASK_ITEMS // 4))), [whole]
    while n:
        bins = _round(items, tasks, length)
        full = F.col("used") >= FULL * length
        left = bins.where(~full)
        m = left.count()
        if tasks == 1 or m > 0.95 * n:
            done.append(bins)
            break
        done.append(bins.where(full))
        items, n, tasks = left, m, max(-(-m // TASK_ITEMS), tasks // FAN_IN, 1)
    every = done[0]
    for bins in done[1:]:
        every = every.unionByName(bins)
    numbered = stage(every.withColumn("sequence_id", F.monotonically_increasing_id()), "sequences")

    def laid(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(5)]
            n = np.diff(lists[0].offsets.to_numpy())
            flat = [c.flatten() for c in lists]
            sizes = flat[3].to_numpy().astype(np.int64)
            end = np.cumsum(sizes)
            first = np.cumsum(n) - n  # every bin holds an item
            yield [flat[0], flat[1], flat[2], sizes, flat[4], np.repeat(batch.column("sequence_id").to_numpy(), n), end - sizes - np.repeat((end - sizes)[first], n)]
    return over_batches(numbered, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", laid)

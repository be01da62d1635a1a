"""Removal of byte strings that occur more than once anywhere in the corpus, by suffix arrays of shards.

1. Every window of `length` bytes has an anchor: the 32-byte string in it with the least hash, the leftmost of equals.  Equal
   windows have equal anchors at equal places, so only stretches of window starts with one anchor need to be compared.
   A stretch is described by the hash of its anchor and the hash of its context, the bytes that its windows cover.
2. A shuffle by anchor finds stretches whose whole context occurs again (all their windows are repeated) and anchors with
   several different contexts; anchors that occur once go.  Copies are folded in the map tasks before the shuffle.
3. One context of each kind is dealt by anchor into shards; an anchor with very many is split over several.  Each shard gets
   a suffix array by Larsson-Sadakane refinement: positions are sorted by 8 bytes, then groups that are still equal by twice
   as many, up to the window length.  Neighbours in the array with a common prefix of a whole window are repeats.  Kasai's
   scan computes those prefixes one position at a time; here "at least a window" is read from the ranks at that length.
4. For split anchors the shards' sorted window keys are merged by binary search.
5. The starts found are joined to their documents, and the bytes that their windows cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import importable, over_batches, signed, stage, whole_groups
from tilewright.llm.words import chunks, mix, powers

LENGTH = 200
ANCHOR = 32           # bytes; LENGTH has to be at least twice that
SHARD_CONTEXTS = 8192  # contexts of one anchor in a shard
SHARD_BYTES = 1 << 20
_POSITION = np.uint64((1 << 30) - 1)  # a text has fewer bytes
_COPY, _MULTI, _SPLIT = 1, 2, 4       # a stretch known as repeated; a context that occurs again; an anchor in several shards


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position; the last ones have none."""
    step, m = powers(ANCHOR + 1), 1
    out = mix(data.astype(np.uint64) + np.uint64(1))
    while m < ANCHOR:
        out = out[:-m] * step[m] + out[m:]
        m *= 2
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _window_keys(grams: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of `size` bytes from each `first`, out of its strings of ANCHOR bytes."""
    scale = powers(int(size.max()) // ANCHOR + 3, 0xA0761D6478BD642F)
    out = mix(size.astype(np.uint64)) + grams[first + size - ANCHOR] * scale[-1]
    for j in range(int(size.max()) // ANCHOR):
        ok = (j + 1) * ANCHOR <= size
        out[ok] += grams[first[ok] + j * ANCHOR] * scale[j + 1]
    return mix(out)


def stretches(data: np.ndarray, at: np.ndarray, length: int):
    """(text, first start, number of starts, anchor hash, context hash) of every stretch of window starts with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = _grams(data)
    width = length - ANCHOR + 1
    place = np.arange(len(grams), dtype=np.uint64)
    least = (_least((grams & ~_POSITION) | place, width) & _POSITION).astype(np.int64)
    ok = np.zeros(len(least) + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= length:
            ok[a:b - length + 1] = True
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (ok[1:-1] != ok[:-2])
    edge[at[(at > 0) & (at < len(edge))]] = True
    starts = np.flatnonzero(edge)
    first, n = starts[:-1], np.diff(starts)
    real = ok[first]
    first, n = first[real], n[real]
    if not len(first):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = least[first]
    return (np.searchsorted(at, first, "right") - 1, first, n, grams[anchor], _window_keys(grams, first, n + length - 1))


def _places(first, n, flags=0):
    return (first << 16) | (n << 4) | flags


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """(h, c, key, place): a row for each stretch; in one task, of equal contexts only one is sent on, the others are marked."""
    def work(batches):
        def flush():
            h, c, key, place = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((place, key, c, h))
            h, c, key, place = h[o], c[o], key[o], place[o]
            same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            again, more = np.concatenate([[False], same]), np.concatenate([same, [False]])
            place = place | np.where(again, _COPY, 0) | np.where(more & ~again, _MULTI, 0)
            own = ~again | (key != np.roll(key, 1)) | (place >> 4 != np.roll(place >> 4, 1))  # of repeated rows one is marked
            h = np.where(again, mix(key.view(np.uint64) + place.astype(np.uint64)), h)  # spread: they only pass through
            return [signed(h[own]), signed(c[own]), key[own], place[own]]
        held, n = [], 0
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                text, first, many, h, c = stretches(data, at, length)
                held.append((h, c, rows.column("key").to_numpy()[text], _places(first - at[text], many)))
                n += len(h)
                if n >= 1 << 20:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return over_batches(texts, "h long, c long, key long, place long", work)


def compared(rows: DataFrame, contexts: int) -> DataFrame:
    """(key, place, h, shard): stretches that are repeated as a whole, and one of each context of anchors that have several."""
    def work(batches):
        for h, c, key, place in whole_groups(batches):
            copy = (place & _COPY) > 0
            yield [key[copy], place[copy], h[copy], np.zeros(copy.sum(), np.int32)]
            h, c, key, place = h[~copy], c[~copy], key[~copy], place[~copy]
            if not len(h):
                continue
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            head = np.flatnonzero(new_c)
            size = np.diff(np.append(head, len(h)))
            multi = np.maximum.reduceat(place & _MULTI, head) > 0
            whole = np.repeat((size > 1) | multi, size)  # a context that occurs again, here or in a map task
            yield [key[whole], place[whole] & ~15 | _COPY, h[whole], np.zeros(whole.sum(), np.int32)]
            group = np.cumsum(new_h[head]) - 1
            kinds = np.bincount(group)
            rank = np.arange(len(head)) - (np.cumsum(kinds) - kinds)[group]
            some = kinds[group] > 1
            at = head[some]
            flags = np.where(whole[at], _MULTI, 0) | np.where(kinds[group][some] > contexts, _SPLIT, 0)
            yield [key[at], place[at] & ~15 | flags, h[at], (rank[some] // contexts).astype(np.int32)]
    dealt = rows.repartition("h").sortWithinPartitions("h", "c", "key", "place")
    return over_batches(dealt, "key long, place long, h long, shard int", work)


def contexts(marks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(h, shard, key, place, context) of the stretches to compare, with the bytes that their windows cover."""
    wanted = marks.where(F.col("place").bitwiseAND(F.lit(_COPY)) == 0).groupBy("key").agg(
        F.collect_list("place").alias("places"), F.collect_list("h").alias("hs"), F.collect_list("shard").alias("shards"))

    def work(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for key, text, places, hs, shards in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for place, h, shard in zip(places, hs, shards):
                    first = place >> 16
                    for column, v in zip(out, (h, shard, key, place, data[first:first + (place >> 4 & 0xFFF) + length - 1])):
                        column.append(v)
            yield out
    both = wanted.join(texts.dropDuplicates(["key"]), "key").select("key", "text", "places", "hs", "shards")
    return over_batches(both, "h long, shard int, key long, place long, context binary", work)


def ranks(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position by the `length` bytes from it, equal for equal strings; positions nearer than that to their
    context's end (`ends`) have no meaning.  Ranks are places in the suffix array, each group having that of its first."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j:n + j]
    rank = np.zeros(n, np.int64)
    active = np.flatnonzero(ends - np.arange(n) >= 8)
    key, have = key[active], 8
    while True:
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        old = rank[active]
        new_old = np.concatenate([[True], old[1:] != old[:-1]]) if len(key) else new
        at = np.arange(len(key))
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        if have == length:
            return rank
        sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
        active = active[np.repeat(sizes > 1, sizes)]
        more = min(2 * have, length)
        active = active[ends[active] - active >= more]
        key = (rank[active] << 32) | rank[active + more - have]
        have = more


def in_shards(rows: DataFrame, length: int) -> DataFrame:
    """(key, place, window, shard): runs of repeated starts (window null), and the windows of split anchors (one start each)."""
    def work(batches):
        for h, shard, key, place, offsets, data in _shards(batches):
            size = np.diff(offsets)
            ends = np.repeat(offsets[1:], size)
            rank = ranks(data, ends, length)
            starts = np.flatnonzero(ends - np.arange(len(data)) >= length)
            own = np.searchsorted(offsets, starts, "right") - 1
            # a rank once alone keeps its place, so equal ranks are equal windows
            _, inverse, count = np.unique(rank[starts], return_inverse=True, return_counts=True)
            multi = (place[own] & _MULTI) > 0
            known = (count[inverse] > 1) | multi
            begin = (place[own] >> 16) + starts - offsets[own]
            hit = known & ~multi
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (own[1:] == own[:-1])])) if len(hit) else starts
            stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (own[1:] == own[:-1]), [False]])) if len(hit) else starts
            none = pa.nulls(len(run), pa.int64())
            yield [key[own[run]], _places(begin[run], stop - run + 1), none, shard[own[run]]]
            split = np.flatnonzero((place[own] & _SPLIT) > 0)
            if len(split):
                once = split[np.unique(inverse[split], return_index=True)[1]]
                windows = _window_keys(_grams(data), starts[once], np.full(len(once), length))
                yield [key[own[once]], _places(begin[once], 1, np.where(known[once], _COPY, 0)), signed(windows ^ mix(h[own[once]].view(np.uint64))), shard[own[once]]]
    dealt = rows.repartition("h", "shard").sortWithinPartitions("h", "shard")
    return over_batches(dealt, "key long, place long, window long, shard int", work)


def _shards(batches):
    """Whole groups of (h, shard), sorted, in lots of about SHARD_BYTES: their columns, context offsets and bytes."""
    def columns(table):
        context = table["context"].combine_chunks()
        at = np.concatenate([[0], np.cumsum(pa.compute.binary_length(context).to_numpy())]).astype(np.int64)
        return *(table[c].to_numpy() for c in ("h", "shard", "key", "place")), at, np.frombuffer(b"".join(context.to_pylist()), np.uint8)
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= SHARD_BYTES:
            table = pa.Table.from_batches(held)
            h, shard = table["h"].to_numpy(), table["shard"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (shard[1:] != shard[:-1])) + 1])
            size = np.cumsum(pa.compute.binary_length(table["context"].combine_chunks()).to_numpy())
            last = 0
            for cut in cuts[1:]:
                if size[cut - 1] - (size[last - 1] if last else 0) >= SHARD_BYTES or cut == cuts[-1]:
                    yield columns(table.slice(last, cut - last))
                    last = cut
            held = table.slice(last).to_batches()
            n = sum(b.nbytes for b in held)
    if n:
        yield columns(pa.Table.from_batches(held))


def across_shards(windows: DataFrame) -> DataFrame:
    """(key, place) of windows of split anchors that are in two shards; place marks those that a shard already knew."""
    def work(batches):
        for window, _, key, place in whole_groups(batches):
            found = np.searchsorted(window, window, "right") - np.searchsorted(window, window, "left") > 1
            found &= (place & _COPY) == 0
            yield [key[found], place[found]]
    dealt = windows.select("window", "shard", "key", "place").repartition("window").sortWithinPartitions("window", "shard")
    return over_batches(dealt, "key long, place long", work)


def repeated_starts(texts: DataFrame, length: int = LENGTH, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(key, places) of every text of `texts` (key long, text) with repeated windows: runs of their starts, packed as
    first * 2^16 + number * 2^4.  Repeated rows share one key and one list, which has each run once."""
    marks = stage(compared(anchored(texts, length), shard_contexts), "anchors")
    runs = stage(in_shards(contexts(marks, texts, length), length), "runs")
    whole = marks.where(F.col("place").bitwiseAND(F.lit(_COPY)) > 0).select("key", "place")
    every = whole.union(runs.where("window IS NULL").select("key", "place")).union(across_shards(runs.where("window IS NOT NULL")))
    return stage(every.select("key", F.col("place").bitwiseAND(F.lit(~15)).alias("place")).distinct().groupBy("key").agg(F.collect_list("place").alias("places")), "starts")


def removed_runs(places: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows with the given starts."""
    out: list[tuple[int, int]] = []
    for place in sorted(places or ()):
        a, b = place >> 16, (place >> 16) + (place >> 4 & 0xFFF) - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame, length: int) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), "text").where(F.octet_length("text") >= length)


def deduplicated(docs: DataFrame, length: int = LENGTH, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs` (doc_id, text; others are not read).

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same or another row; the first
    occurrence goes too.  Strings are those of the input and end with their text.  A null text is empty, and texts shorter
    than `length` lose nothing.  Repeated rows are repeats of each other.  Rows are told apart by a 64-bit hash of id and
    text, so ids may be null or occur twice.  Texts are read whole, up to 2^30 bytes.  An empty table gives an empty one.
    """
    def work(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                data, end, kept = (text or "").encode(), 0, hashlib.sha256()
                runs = removed_runs(places, length)
                for a, b in runs:
                    kept.update(data[end:a])
                    end = b
                kept.update(data[end:])
                for column, v in zip(out, (doc, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest())):
                    column.append(v)
            yield out
    found = repeated_starts(_keyed(docs, length), length, shard_contexts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    both = rows.join(found, "key", "left").select("doc_id", "text", "places")
    return over_batches(both, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)


def cut_text(text: str, places: list[int] | None, length: int = LENGTH) -> str:
    """The text without its removed runs; a character goes only if all its bytes do."""
    data, end, out = text.encode(), 0, []
    for a, b in removed_runs(places, length):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[end:a])
        end = max(a, b)
    return b"".join([*out, data[end:]]).decode()


def deduplicated_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of `docs` with text cut as above at whole characters, and n_chars, if there, counted anew for them."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else cut_text(t, sorted(int(x) for x in p), length) for t, p in zip(text, places)], dtype=object)

    importable(docs.sparkSession)
    found = repeated_starts(_keyed(docs, length), length).select(F.col("key").alias("k"), "places")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k")).join(found, "k", "left")
    new = rows.withColumn("new", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(cut("row.text", "places")))
    counted = F.when(F.col("places").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new")) if "n_chars" in docs.columns else None
    fields = {"text": F.col("new"), "n_chars": counted}
    return new.select(*(fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

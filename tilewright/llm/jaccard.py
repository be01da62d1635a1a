"""Similarity join of documents on word shingles, exact at a Jaccard threshold.

1. Documents with equal shingle sets are one node.
2. A node is posted under its prefix: with shingles in one fixed order, two sets that overlap enough share one of the first
   n - ceil(t n) + 1.  Shingles that many documents share come last in that order, so a common passage is hardly posted.
   The order decides cost only, never the result.
3. A shuffle by shingle makes tiles; shingles with a single node go, and shingles of the same nodes are one tile.  Inside a tile rows are sorted by size, and only pairs
   in the band of sizes and at positions that still allow the overlap are looked at.
4. Each tile first pairs its nodes with one leader, then with a few hash-random rows whose component differs.
   What links is one component, and only pairs of different components are looked at afterwards: a group of near copies
   costs pairs in proportion to its size.
5. Bitmap signatures bound each pair's overlap from above by bit counts: (|A| + |B| - popcount(a xor b)) / 2.  For the pairs
   of different components that is done inside the tile, on folded signatures, before a pair is written.
6. What is left is decided by intersecting the sorted shingle arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tilewright.llm.components import components
from tilewright.llm.stages import over_batches, signed, stage, whole_groups
from tilewright.llm.words import chunks, mix, shingle_sets

HEAVY = 24           # a shingle in so many nodes goes to the end of the order ...
HEAVY_KEPT = 1 << 18  # ... for the most frequent ones; bounds what each task is sent to 4 MB
TRIES = 8            # hash-random rows of its tile that a row is paired with before all pairs of different components ...
ROUNDS = 2           # ... so often, each with the components found so far
SIGNATURE = 1024     # bits at most of the signatures that tiles compare; longer ones are folded
_FLUSH = 1 << 22     # shingles, postings or pairs that a task holds at once
_BLOCK = 512         # rows of a tile compared at once


def _set_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set: mixed sum of its mixed shingles and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets), dtype=np.uint64)])
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64)))


def _least_overlap(total, percent: int):
    """Smallest intersection i with 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _fresh(batches, width):
    """For each chunk: shingles, offsets, keys and the texts whose set the last `_FLUSH` shingles have not shown yet."""
    seen, held = set(), 0
    for batch in batches:
        for _, data, at in chunks(batch, "text"):
            sets, cut = shingle_sets(data, at, width)
            keys = _set_keys(sets, cut)
            new = []
            for i in np.flatnonzero(np.diff(cut)):
                if (k := int(keys[i])) not in seen:
                    seen.add(k)
                    new.append(i)
            held += len(sets)
            yield sets, cut, keys, new
            if held >= _FLUSH:
                seen, held = set(), 0


def heavy_shingles(docs: DataFrame, width: int, heavy: int = HEAVY, kept: int = HEAVY_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many sets and their counts, from all documents; at most `kept`, sorted by shingle."""
    def work(batches):
        def flush():
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= 2
            return [signed(names[some]), counts[some]]
        held, n = [], 0
        for sets, cut, _, new in _fresh(batches, width):
            held += [sets[cut[i]:cut[i + 1]] for i in new]
            n += len(sets)
            if n >= _FLUSH and held:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()
    counts = over_batches(docs.select("text"), "shingle long, n long", work).groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= heavy).orderBy(F.desc("n"), "shingle").limit(kept).toArrow()
    names, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], n[order]


def cards(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, node, bits) of every row: hash of id and text, set size, set key (null for an empty set), bitmap signature.

    The bitmap has the smallest power of two bits that is at least twice the set, 64 or more; a shingle flips one bit.
    """
    def work(batches):
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                sets, cut = shingle_sets(data, at, width)
                keys, sizes, bits = _set_keys(sets, cut), np.diff(cut), []
                for i, n in enumerate(sizes.tolist()):
                    flips = np.bincount((sets[cut[i]:cut[i + 1]] & np.uint64(signature_bits(n) - 1)).astype(np.int64), minlength=signature_bits(n))
                    bits.append(np.packbits((flips & 1).astype(np.uint8)).tobytes() if n else b"")
                yield [rows.column("doc_id"), rows.column("key"), sizes, pa.array(signed(keys), mask=sizes == 0), bits]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return over_batches(rows, "doc_id long, key long, n int, node long, bits binary", work)


def signature_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def postings(docs: DataFrame, width: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle int, node long, place long) of every node's prefix; place is size * 2^32 + position.

    The shingle is shortened to 32 bits: two that fall together make a tile larger and are told apart by the later steps.
    """
    names, counts = heavy

    def work(batches):
        for sets, cut, keys, new in _fresh(batches, width):
            shingles, nodes, places = [], [], []
            for i in new:
                own = sets[cut[i]:cut[i + 1]]
                n, k = len(own), _prefix(len(own), percent)
                if len(names):
                    j = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    often = np.where(names[j] == own, counts[j], 0)
                    if often.any():
                        own = own[np.argsort(often, kind="stable")]
                shingles.append(own[:k])
                nodes.append(np.full(k, keys[i], np.uint64))
                places.append(np.arange(k, dtype=np.int64) + (n << 32))
            if shingles:
                yield [(np.concatenate(shingles) >> np.uint64(32)).astype(np.uint32).view(np.int32), signed(np.concatenate(nodes)), np.concatenate(places)]
    return over_batches(docs.select("text"), "shingle int, node long, place long", work)


def shared_tiles(posts: DataFrame) -> DataFrame:
    """Postings of shingles with two nodes or more, each node once a tile, in order of tile, size and node.

    Shingles that the same nodes share, such as all those of one passage, make one tile, named by a hash of the nodes: each
    node's place there is its smallest, which allows every pair that one of the shingles allows.  Two sets of nodes with one
    hash would share a tile, which only adds pairs.
    """
    def work(batches):
        for shingle, node, place in whole_groups(batches):
            same = (shingle[1:] == shingle[:-1])
            again = np.concatenate([[False], same & (node[1:] == node[:-1])])
            shingle, node, place = shingle[~again], node[~again], place[~again]
            same = shingle[1:] == shingle[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if shared.any():
                shingle, node, place = shingle[shared], node[shared], place[shared]
                start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
                names = mix(np.add.reduceat(mix(node.view(np.uint64)), start))
                yield [signed(np.repeat(names, np.diff(np.append(start, len(shingle))))), node, place]
    dealt = posts.repartition("shingle").sortWithinPartitions("shingle", "place", "node")
    tiles = over_batches(dealt, "shingle long, node long, place long", work).groupBy("shingle", "node").agg(F.min("place").alias("place"))
    return tiles.repartition("shingle").sortWithinPartitions("shingle", "place", "node")


def _allowed(place_a, place_b, percent):
    """Whether sizes and positions leave room for the overlap, if this is the first shingle that the two share."""
    na, nb = place_a >> 32, place_b >> 32
    need = _least_overlap(na + nb, percent)
    return np.minimum(na - (place_a & 0xFFFFFFFF), nb - (place_b & 0xFFFFFFFF)) >= need


class _Pairs:
    """Pairs of a task without the repeats of the last flush."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, a, b):
        if len(a):
            self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            self.n += len(a)

    def flush(self):
        out = np.unique(np.concatenate(self.held, axis=1), axis=1) if self.held else np.zeros((2, 0), np.int64)
        self.held, self.n = [], 0
        return [out[0], out[1]]


def leader_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of each tile's nodes with the leader of their size band: the smallest node of the band by size."""
    def work(batches):
        pairs = _Pairs()
        for shingle, node, place in whole_groups(batches):
            start = np.concatenate([[0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1])
            for _ in range(64):  # a band ends where sizes no longer fit its leader; the rest of the tile starts the next
                tile = np.searchsorted(start, np.arange(len(shingle)), "right") - 1
                lead = start[tile]
                new = (shingle == shingle[lead]) & ((place[lead] >> 32) * 100 < percent * (place >> 32))
                first = np.flatnonzero(new & ~np.concatenate([[False], new[:-1] & (tile[1:] == tile[:-1])]))
                if not len(first):
                    break
                start = np.union1d(start, first)
            lead = start[np.searchsorted(start, np.arange(len(shingle)), "right") - 1]
            ok = (lead != np.arange(len(shingle))) & _allowed(place, place[lead], percent)
            pairs.add(node[ok], node[lead[ok]])
            if pairs.n >= _FLUSH:
                yield pairs.flush()
        if pairs.n:
            yield pairs.flush()
    return over_batches(tiles, "a long, b long", work).distinct()


def tried_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row with its neighbour and some hash-random rows of its tile, where components differ."""
    def work(batches):
        pairs = _Pairs()
        for shingle, node, place, part in whole_groups(batches):
            at = np.arange(len(shingle))
            start = np.searchsorted(shingle, shingle)
            size = np.searchsorted(shingle, shingle, "right") - start
            for turn in range(TRIES):
                other = at + 1 if turn == 0 else start + (mix(node.view(np.uint64) + np.uint64(turn)) % size.astype(np.uint64)).astype(np.int64)
                other = np.minimum(other, start + size - 1)
                ok = at[part != part[other]]
                ok = ok[_allowed(place[ok], place[other[ok]], percent)]
                pairs.add(node[ok], node[other[ok]])
                if pairs.n >= _FLUSH:
                    yield pairs.flush()
        if pairs.n:
            yield pairs.flush()
    return over_batches(tiles, "a long, b long", work).distinct()


def _cross(shingle, node, place, part, percent):
    """Rows (i, j) of one tile whose components differ and whose sizes and positions allow the overlap, lot by lot."""
    n, at = len(shingle), np.arange(len(shingle))
    for step in range(1, _BLOCK):
        at = at[at + step < n]
        at = at[shingle[at] == shingle[at + step]]
        if not len(at):
            return
        ok = at[(part[at] != part[at + step]) & _allowed(place[at], place[at + step], percent)]
        yield ok, ok + step
    for lo in at.tolist():  # tiles of over _BLOCK rows: each row with those further away in its size band
        hi = int(np.searchsorted(shingle, shingle[lo], "right"))
        hi = lo + int(np.searchsorted(place[lo:hi] >> 32, 100 * int(place[lo] >> 32) // percent + 1))
        rest = np.arange(min(lo + _BLOCK, hi), hi)
        rest = rest[(part[rest] != part[lo]) & _allowed(place[lo], place[rest], percent)]
        yield np.full(len(rest), lo), rest


def open_rows(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles that have a row of another component to be compared with."""
    def work(batches):
        for shingle, node, place, part in whole_groups(batches):
            wanted = np.zeros(len(shingle), bool)
            for i, j in _cross(shingle, node, place, part, percent):
                wanted[i] = wanted[j] = True
            yield [shingle[wanted], node[wanted], place[wanted], part[wanted]]
    return over_batches(tiles, "shingle long, node long, place long, component long", work)


def _matrix(column, size: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, each folded to `size` bits or shorter and then filled with zeros."""
    out = np.zeros((len(column), size // 8), np.uint8)
    for i, bits in enumerate(column.to_pylist()):
        bits = _folded(bits, size // 8)
        out[i, :len(bits)] = bits
    return out.view(np.uint64)


def cross_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components in one tile that their signatures' bit counts do not rule out.

    `tiles` has shingle, node, place, component, bits in order of shingle, place and node.
    """
    def work(batches):
        pairs = _Pairs()
        for table in _tiles_of(batches):
            shingle, node, place, part = (table.column(i).to_numpy() for i in range(4))
            bits = table.column(4)
            words = _matrix(bits, SIGNATURE)
            length = np.minimum([len(b) for b in bits.to_pylist()], SIGNATURE // 8)
            half = np.zeros_like(words)  # each bitmap folded once more, to be compared with shorter ones
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                if size > 8:
                    both = words[own].view(np.uint8)[:, :size]
                    half[own] = np.pad(both[:, :size // 2] ^ both[:, size // 2:], ((0, 0), (0, SIGNATURE // 8 - size // 2))).view(np.uint64)
            for i, j in _cross(shingle, node, place, part, percent):
                for lo in range(0, len(i), 1 << 16):
                    a, b = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
                    x = np.where((length[a] > length[b])[:, None], half[a], words[a])
                    y = np.where((length[b] > length[a])[:, None], half[b], words[b])
                    total = (place[a] >> 32) + (place[b] >> 32)
                    near = np.abs(np.log2(length[a]) - np.log2(length[b])) <= 1
                    ok = ~near | ((total - np.bitwise_count(x ^ y).sum(axis=1)) // 2 >= _least_overlap(total, percent))
                    pairs.add(node[a[ok]], node[b[ok]])
                    if pairs.n >= _FLUSH:
                        yield pairs.flush()
        if pairs.n:
            yield pairs.flush()
    return over_batches(tiles, "a long, b long", work).distinct()


def _tiles_of(batches, size: int = 1 << 17):
    """Arrow tables of whole tiles, as whole_groups has columns."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(held)
            shingle = table.column(0).to_numpy()
            end = int(np.searchsorted(shingle, shingle[-1]))
            if end:
                yield table.slice(0, end)
            held, n = table.slice(end).combine_chunks().to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held)


def _folded(bits: bytes, size: int) -> np.ndarray:
    """A power-of-two bitmap folded to a smaller one, as if it had been made with so many bits."""
    words = np.frombuffer(bits, np.uint8)
    while len(words) > size:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the bit counts of their signatures do not rule out."""
    def work(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(i) for i in range(6))
            na, nb = na.to_numpy().astype(np.int64), nb.to_numpy().astype(np.int64)
            differ = np.zeros(len(na), np.int64)
            for i, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist())):
                size = min(len(p), len(q))
                differ[i] = np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum()
            ok = (na + nb - differ) // 2 >= _least_overlap(na + nb, percent)
            yield [a.to_numpy()[ok], b.to_numpy()[ok]]
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return over_batches(both, "a long, b long", work)


def node_texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in `pairs`: the rows with the node's key, which other texts of the same id, or of none, do not have."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = wanted.join(nodes.select("node", "key"), "node")
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(keys, "key").select("node", "text")


def exact_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sorted shingle arrays intersect enough."""
    def sets_of(batches):
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                sets, cut = shingle_sets(data, at, width)
                keys = signed(_set_keys(sets, cut))
                mine = np.flatnonzero(keys == rows.column("node").to_numpy())
                if len(mine):
                    yield [keys[mine], [sets[cut[i]:cut[i + 1]].tobytes() for i in mine]]

    def work(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), bool)
            for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                j = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[j] == x).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield [a[ok], b[ok]]

    sets = stage(over_batches(node_texts(pairs, nodes, docs), "node long, shingles binary", sets_of).dropDuplicates(["node"]), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return over_batches(both, "a long, b long", work)


def _told(tiles: DataFrame, parts: DataFrame) -> DataFrame:
    """Tiles with each node's component so far."""
    return (tiles.join(parts, "node", "left").select("shingle", "node", "place", F.coalesce("component", "node").alias("component"))
            .repartition("shingle").sortWithinPartitions("shingle", "place", "node"))


def jaccard_components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long) of every row of `docs` (doc_id, text; others are not read).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct `width`-word shingles (the whole
    word sequence if shorter).  component_id is the smallest doc_id reached by links.  Null and empty texts and texts of white
    space have an empty set, link with nothing and keep their own id.  Repeated rows come out repeated, in one component; a
    null doc_id takes part in links, but names a component only if nothing else does.  An empty table gives an empty one.
    Long texts are read whole; ties do not arise.

    Equal sets are recognised by a 64-bit key of the set, shingles by 64-bit hashes.  The stages are written to the shared
    folder, so a lost executor costs one step.
    """
    card, nodes, named = _grouped(docs, percent, width)
    least = nodes.join(named, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    found = named.join(least, "component").select("node", F.col("least").alias("component_id"))
    return card.select("doc_id", "n", "node").join(found, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _grouped(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards of all rows, one row for each distinct set (node), and (node, component) of every node."""
    card = stage(cards(docs, width), "cards")
    nodes = card.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = stage(nodes, "nodes")
    tiles = stage(shared_tiles(postings(docs, width, percent, heavy_shingles(docs, width))), "tiles")

    def linked(pairs):
        return stage(exact_pairs(stage(bounded_pairs(pairs, nodes, percent), "bounded"), nodes, docs, width, percent), "links")

    links = linked(leader_pairs(tiles, percent))
    parts = stage(components(links), "parts")
    for _ in range(ROUNDS):
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(linked(tried_pairs(_told(tiles, parts), percent)))
        parts = stage(components(links), "parts")
    still = open_rows(_told(tiles, parts), percent).join(nodes.select("node", "bits"), "node").select("shingle", "node", "place", "component", "bits")
    last = linked(cross_pairs(still.repartition("shingle").sortWithinPartitions("shingle", "place", "node"), percent))
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(last)
    whole = nodes.select("node").join(stage(components(links), "components"), "node", "left")
    return card, nodes, whole.select("node", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each component: the smallest doc_id, then the smallest hash of id
    and text; an id that is null counts as largest.  Repeated rows are one document.  Rows without words link with nothing and all stay.
    """
    card, _, named = _grouped(docs, percent, width)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = card.join(named, "node").groupBy("component").agg(F.min(order)["key"].alias("k"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k"))
    blank = ~F.regexp_like(F.coalesce("row.text", F.lit("")), F.lit("[^ \\t-\\r]"))
    first = F.row_number().over(W.partitionBy("k").orderBy("k")) == 1
    chosen = rows.where(~blank).join(kept, "k", "left_semi").withColumn("first", first).where("first").select("row.*")
    return chosen.unionByName(rows.where(blank).select("row.*"))

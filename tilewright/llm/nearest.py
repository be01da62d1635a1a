"""Exact top-k search by vector-approximation files, blocks of queries against blocks of candidates.

Every candidate component is kept as a cell of four bits.  A block of candidates is first scanned by cells: the middle of a
cell and its half width give bounds of the inner product with each query.  Exact vectors are then read in the order of the
bounds until the k-th result is certain.  Blocks give k rows for each query, and those of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tilewright.llm.stages import over_batches, stage

BLOCK = 4096     # candidates that meet in one task
QUERIES = 1024   # queries that meet in one task
CELLS = 16       # cells for each component
SCALE = 256      # components become the floors of so many times themselves
_READ = 16       # exact vectors read at once


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, far, size), for vectors without null or non-finite components: v has the floors of scale * component.

    Where products of such floors may not fit a long, v is null, and far has the floors divided by scale, a power of two: doubles
    hold those exactly.
    """
    size = F.size("embedding").alias("size")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    far = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0 ** 43, F.floor(x.cast("double") * scale).cast("double") / scale).otherwise(x.cast("double")))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    near = F.forall("embedding", lambda x: F.abs(x.cast("double")) < F.when(F.size("embedding") <= 64, 2.0 ** 20).otherwise(2.0 ** 8))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(near, v).alias("v"), F.when(~near, far).alias("far"), size)


def cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component (four bits in a byte), and the low edge and width of each dimension's cells."""
    low = vectors.min(axis=0)
    width = np.maximum(1, -(-(vectors.max(axis=0) - low + 1) // CELLS))
    return ((vectors - low) // width).astype(np.uint8), low, width


def search_block(queries, ids, vectors, own, k):
    """(query, candidate, score) of the k best of `vectors` for each query by inner product, ties to the smaller id."""
    code, low, width = cells(vectors)
    middle = low + code * width + (width - 1) / 2
    guess = queries.astype(np.float64) @ middle.T
    reach = np.abs(queries.astype(np.float64)) @ ((width - 1) / 2 + (vectors.shape[1] + 8) * 2.0 ** -52 * (np.abs(low) + CELLS * width))  # and rounding
    guess[own[:, None] == ids[None, :]] = -np.inf
    out = []
    for q in range(len(queries)):
        bound = guess[q]
        order = np.argsort(-bound, kind="stable")
        order = order[:np.isfinite(bound).sum()]
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(order), _READ):
            if len(best_s) == k and bound[order[lo]] + reach[q] < best_s[-1]:
                break  # no vector further on can reach the k-th
            some = order[lo:lo + _READ]
            scores = np.concatenate([best_s, vectors[some] @ queries[q]])
            names = np.concatenate([best_i, ids[some]])
            keep = np.lexsort((names, -scores))[:k]
            best_s, best_i = scores[keep], names[keep]
        out.append((np.full(len(best_s), own[q]), best_i, best_s))
    return [np.concatenate(c) for c in zip(*out)]


def _numbers(far: np.ndarray) -> np.ndarray:
    """Floors as Python integers."""
    return np.array([[int(x) * SCALE if abs(x) >= 2.0 ** 60 else int(x * SCALE) for x in row] for row in far.tolist()], object).reshape(far.shape)


def search_far(queries, ids, vectors, own, k):
    """As search_block, of floors divided by SCALE, with scores as Python integers: those that float64 products leave open are computed."""
    with np.errstate(all="ignore"):
        guess = queries @ vectors.T
        error = (queries.shape[1] + 4) * 2.0 ** -52 * (np.abs(queries) @ np.abs(vectors).T)
        low, high = guess - error, guess + error
    unsure = ~np.isfinite(low) | ~np.isfinite(high)
    low[unsure], high[unsure] = -np.inf, np.inf
    exact, asked, out = _numbers(vectors), _numbers(queries), []
    for q in range(len(queries)):
        some = np.flatnonzero(ids != own[q])
        if len(some) > k:
            some = some[high[q, some] >= np.partition(low[q, some], -k)[-k]]
        found = sorted(zip((-x for x in exact[some] @ asked[q]), ids[some].tolist()))[:k] if len(some) else []
        out += [(int(own[q]), i, -x) for x, i in found]
    return out


def _ordered(score: int) -> tuple[int | None, int, bytes]:
    """The score if a long holds it, else null; the side on which it does not fit, and bytes that sort as such scores do."""
    if -2 ** 63 <= score < 2 ** 63:
        return score, 0, b""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return (None, 1, raw) if score > 0 else (None, -1, bytes(255 - b for b in raw))


def top_k(rows: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `rows` (vec_id, embedding) whose id is divisible by `every`, the k rows
    of highest integer inner product, ties to the smaller id; all if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do those without an id.  All others do, whatever
    their size: products that may not fit a long are computed as Python integers.  A score that no long holds comes out null,
    with its exact rank.  A query meets vectors of its own length, except rows of its
    own id.  Repeated rows count as often as they occur, as candidates; a repeated query is answered once.  An empty table
    gives an empty one.  Both sides are dealt into blocks of bounded size by a hash of the id.
    """
    vectors = stage(integer_vectors(rows), "vectors")
    n, m = vectors.count(), vectors.where(F.col("vec_id") % every == 0).count()
    many, few = max(1, -(-n // block)), max(1, -(-m // queries))
    asked = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = asked.select("vec_id", "v", "far", "size", F.lit(True).alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(few)).cast("int").alias("q"),
                         F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("c"))
    told = vectors.select("vec_id", "v", "far", "size", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("q"),
                          F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(many)).cast("int").alias("c"))

    def work(batches):
        def answer(held):
            t = pa.Table.from_batches(held)
            ids, asked = t["vec_id"].to_numpy(), t["query"].to_numpy()
            near = t["v"].is_valid().to_numpy()
            if not asked.any() or asked.all() or not t["size"][0].as_py():
                return
            rows = {True: np.flatnonzero(near), False: np.flatnonzero(~near)}
            v = {some: np.stack([np.asarray(x, kind) for x in t[name].combine_chunks().take(pa.array(rows[some])).to_numpy(zero_copy_only=False)])
                 for some, name, kind in ((True, "v", np.int64), (False, "far", np.float64)) if len(rows[some])}
            for a in v:
                for b in v:
                    q, c = asked[rows[a]], ~asked[rows[b]]
                    if not q.any() or not c.any():
                        continue
                    if a and b:
                        found = search_block(v[a][q], ids[rows[b]][c], v[b][c], ids[rows[a]][q], k)
                        yield [*found, np.zeros(len(found[0]), np.int32), [b""] * len(found[0])]
                    else:
                        x, y = (v[z][m] / SCALE if z else v[z][m] for z, m in ((a, q), (b, c)))
                        found = [(i, j, *_ordered(s)) for i, j, s in search_far(x, ids[rows[b]][c], y, ids[rows[a]][q], k)]
                        if found:
                            yield [list(column) for column in zip(*found)]
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(keys[a]) != at:
                    yield from answer(held)
                    held = []
                at = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer(held)

    met = asked.unionByName(told).select("vec_id", "v", "size", "query", "q", "c", "far")
    met = met.repartition(many * few, "size", "q", "c").sortWithinPartitions("size", "q", "c")
    found = over_batches(met, "query_id long, vec_id long, score long, side int, over binary", work)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("over"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

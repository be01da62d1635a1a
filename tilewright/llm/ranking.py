"""Quality scores learned from preference pairs (Bradley-Terry): logistic loss on feature differences.

Features are shares and rates of a text's bytes, words and lines.  Labelled texts are paired, a good one with a poor one of
similar length; the weights make the good one's score the larger.  The raw score is mapped to 0..1 so that 0.7, the
threshold, lies at the quantile of training scores that separates the labels best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.rules import STOP_WORDS
from tilewright.llm.stages import over_batches, stage
from tilewright.llm.words import chunks, shingle_sets, word_hashes, word_spans

TRAINING_ROWS = 20_000  # labelled rows at most, those of least hash
PAIRS = 100_000
THRESHOLD = 0.7
FEATURES = ("length", "brief", "symbols", "digits", "capitals", "points", "foreign", "word_length", "stop_words", "distinct_words",
            "distinct_windows", "distinct_lines", "line_length", "same_bytes")
_SYMBOL, _DIGIT, _CAPITAL, _POINT, _LETTER = (np.isin(np.arange(256), list(x)) for x in (
    b"#*$%&|<>@^~_{}[]=+\\/", b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-", bytes([*range(65, 91), *range(97, 123)])))


def _stop_hashes() -> np.ndarray:
    words = [w.encode() for w in STOP_WORDS]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    return np.unique(word_hashes(data, np.concatenate([[0], end[:-1]]), end))


_STOPS = _stop_hashes()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has a row of its own kind (brief = 1, the rest 0)."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    starts, ends, first = word_spans(data, at)
    words = np.diff(first).astype(float)

    def each(mask):  # number of marked bytes in each text
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    hashes = word_hashes(data, starts, ends)
    stop = np.concatenate([[0], np.cumsum(np.isin(hashes, _STOPS))])
    chars = np.concatenate([[0], np.cumsum(ends - starts)])
    ink = (chars[first[1:]] - chars[first[:-1]]).astype(float)
    lines = each(data == 10) + 1
    distinct = np.array([len(set(data[a:b].tobytes().split(b"\n"))) for a, b in zip(at[:-1], at[1:])], float)
    same = np.concatenate([[False], data[1:] == data[:-1]]) if len(data) else np.zeros(0, bool)
    w, i = np.maximum(words, 1), np.maximum(ink, 1)
    out = np.stack([
        np.log1p(words), 1 / (1 + words), each(_SYMBOL[data]) / i, each(_DIGIT[data]) / i, each(_CAPITAL[data]) / i, each(_POINT[data]) / i,
        each(data >= 128) / i, np.minimum(ink / w, 30) / 10, (stop[first[1:]] - stop[first[:-1]]) / w, np.diff(shingle_sets(data, at, 1)[1]) / w,
        np.diff(shingle_sets(data, at, 3)[1]) / np.maximum(words - 2, 1), distinct / lines, np.log1p(size / lines) / 5, each(same) / i], axis=1)
    out[words == 0] = 0
    out[words == 0, 1] = 1
    return out if n else np.zeros((0, len(FEATURES)))


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with their steps: each also as its place among fixed edges, so that a weight can bend."""
    edges = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
    return np.concatenate([x, *(np.maximum(x - e, 0) for e in edges)], axis=1)


def fitted(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 250, seed: int = 7) -> dict:
    """Weights, and the two numbers that map a raw score to 0..1, from labelled feature rows."""
    z = expanded(x)
    middle, spread = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = (z - middle) / spread
    rng = np.random.default_rng(seed)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(z.shape[1])
    if len(yes) and len(no):
        a, b = rng.choice(yes, pairs), rng.choice(no, pairs)
        half = pairs // 2  # half of the pairs are of similar length
        near = no[np.argsort(x[no, 0], kind="stable")]
        at = np.searchsorted(x[near, 0], x[a[:half], 0]) + rng.integers(-5, 6, half)
        b[:half] = near[np.clip(at, 0, len(near) - 1)]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            lot = rng.integers(0, pairs, 4096)
            d = z[a[lot]] - z[b[lot]]
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(axis=0) + 1e-4 * w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w -= 0.05 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    raw = z @ w
    cuts = np.quantile(raw, np.linspace(0.005, 0.995, 199)) if len(raw) else np.zeros(1)
    right = [((raw >= c) == good).mean() if len(raw) else 0 for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return {"middle": middle, "spread": spread, "weights": w, "cut": float(cuts[best[len(best) // 2]]), "scale": float(raw.std() / 2 + 1e-9) if len(raw) else 1.0}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    raw = ((expanded(x) - model["middle"]) / model["spread"]) @ model["weights"]
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip((raw - model["cut"]) / model["scale"] + shift, -40, 40)))


def _held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def scored(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text), learned from `labels` (doc_id, quality).

    Learns from at most `training_rows` labelled rows (the bound of the sample; those of least hash of the id) whose crc32 is
    not 2 modulo 4; only the text makes features.  Labels other than 0 and 1 are ignored, as are repeated and conflicting ones
    beyond the first by value.  Null, empty and blank texts have features of their own and so a score.  Repeated rows are scored each;
    a null doc_id is not held out.  Without labels of both kinds all scores are equal.  An empty table gives an empty one.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows), "labels")
    texts = ids.join(some, "doc_id").select("doc_id", "text", "quality")

    def labelled(batches):
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                x = features(data, at)
                yield [rows.column("doc_id"), rows.column("quality").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))]

    table = over_batches(texts, "doc_id long, quality int, x array<double>", labelled).toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    model = fitted(x, table["quality"].to_numpy() == 1)

    def judge(batches):
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                yield [rows.column("doc_id"), score(features(data, at), model)]

    found = over_batches(ids, "doc_id long, score double", judge)
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

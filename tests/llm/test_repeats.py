"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tilewright.llm.repeats import _keyed, anchored, compared, contexts, cut_text, deduplicated, deduplicated_documents, ranks, repeated_starts

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("places", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def brute(rows, w=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s:s + w] for _, d in data for s in range(len(d) - w + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - w + 1):
            if seen[d[s:s + w]] > 1:
                gone[s:s + w] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone].tobytes())
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefghij éü\n") for _ in range(n))
    passage, line = fresh(420), fresh(230)
    texts = ["", None, "short", "a" * 500, "ab" * 300, "ab" * 99, fresh(199), fresh(200), fresh(5000)]
    texts += [fresh(rng.randrange(300)) + passage[rng.randrange(100):] + fresh(rng.randrange(300)) for _ in range(40)]
    texts += ["\n".join([line] * rng.randrange(1, 4)) + fresh(rng.randrange(50)) for _ in range(12)]
    base = fresh(1500)
    for _ in range(15):
        k = rng.randrange(len(base))
        texts.append(base[:k] + "#" + base[k:rng.randrange(k, len(base) + 1)])
    texts += [base, base, texts[8][100:299], texts[8][300:500], texts[8][4800:]]
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,contexts", [(1, 8192), (2, 3)])
def test_against_all_windows(spark, seed, contexts):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = deduplicated(df, shard_contexts=contexts).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges_and_documents(spark):
    t = "é" * 150
    rows = [(None, t, None, 5), (1, t, None, None), (1, t, None, None), (2, "x" + "é" * 99 + "y", "p", 7), (3, "z" + "é" * 99 + "w", "p", 7), (4, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, deduplicated(df).collect()), key=str) == brute([r[:2] for r in rows])
    got = deduplicated_documents(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "", None, 0), (1, "", None, 0), (1, "", None, 0), *rows[3:5], rows[5]], key=str)
    assert cut_text("aé" + "b" * 200, [(2 << 16) | (1 << 4)]) == "aéb"
    assert deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_are_equal_for_equal_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    r = ranks(data, np.full(3000, 3000), 200)
    names = {}
    for i in range(2801):
        names.setdefault(bytes(data[i:i + 200]), set()).add(int(r[i]))
    assert all(len(v) == 1 for v in names.values()) and len({*map(max, names.values())}) == len(names)
    order = sorted(range(2801), key=lambda i: bytes(data[i:i + 200]))
    assert [int(r[i]) for i in order] == sorted(int(r[i]) for i in order)


def test_thousands_of_equal_rows(spark):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    text, part = fresh(900), fresh(300)
    rows = [(1, text)] * 3000 + [(None, part + text[:400])] * 50 + [(i, fresh(40) + part[:250] + text[300:600] + fresh(30)) for i in range(5, 15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    keyed = _keyed(df, 200)
    assert repeated_starts(keyed).selectExpr("max(size(places))").first()[0] < 200
    found = contexts(compared(anchored(keyed, 200), 8192), keyed, 200)
    assert found.count() == found.select("h", "shard", "key", "place").distinct().count() > 0
    want = brute([(1, text)] * 2 + [(None, part + text[:400])] * 2 + rows[3050:])
    got = deduplicated(df).collect()
    assert len(got) == len(rows) and sorted({tuple(r) for r in got}, key=str) == sorted(set(want), key=str)


@pytest.mark.parametrize("length", [100, 64])
def test_shorter_windows(spark, length):
    rng = random.Random(length)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    part = fresh(150)
    rows = [(i, fresh(rng.randrange(20)) + part[:rng.randrange(length - 5, 150)] + fresh(rng.randrange(20))) for i in range(40)] + [(50, part[:length]), (51, fresh(length)), (52, fresh(length - 1))]
    got = deduplicated(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), length).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)

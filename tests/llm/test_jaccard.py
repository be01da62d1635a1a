"""The similarity join against all pairs of plain Python sets."""

import random
import re

import pytest
from pyspark.sql import types as T

from tilewright.llm.jaccard import _grouped, jaccard_components, node_texts, one_of_each

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def shingles(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(data)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10 ** 5)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for size, edits in ((30, 1), (80, 2), (80, 3), (200, 5), (12, 1), (6, 1)):
        texts += family(rng, fresh(size), 25, edits)
    texts += [" ".join(fresh(rng.randrange(5, 120)) + passage + fresh(rng.randrange(0, 60))) for _ in range(60)]
    texts += ["one two", "ONE\ttwo", "one two three", "", None, " \t\n", "a", "a", "éÉ x", "ÉÉ x", "a b c d e", "a b c d e f"]
    texts += [texts[3], texts[3].upper(), " ".join(["same"] * 400), " ".join(["same"] * 900), " ".join(fresh(20000))]
    rng.shuffle(texts)
    return [(7 * i - 40, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA).repartition(5)
    got = jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty_null_and_repeated(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", None), (4, "a b c d e f", None), (4, "a b c d e f", None), (4, "other words", None), (2, None, None), (2, "", None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 1, 4), (2, 0, 2), (2, 0, 2)], key=str)


def test_near_copies_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    text = " ".join(base)
    rows = [(None, "p " + text, None), (None, "q " + text, None), (8, "far away " * 9, None)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == [(8, 8), (None, None), (None, None)]
    assert one_of_each(spark.createDataFrame(rows, SCHEMA)).count() == 2
    chain = [(5, " ".join(base[12:]), None), (None, text, None), (9, " ".join(base[:48]), None)]  # 5 and 9 link only through the one without id
    x, y, z = (shingles(t) for _, t, _ in chain)
    assert 100 * len(x & z) < 75 * len(x | z) and 100 * len(x & y) >= 75 * len(x | y) and 100 * len(y & z) >= 75 * len(y | z)
    got = jaccard_components(spark.createDataFrame(chain, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == [(5, 5), (9, 5), (None, 5)]
    assert one_of_each(spark.createDataFrame(chain, SCHEMA)).count() == 1


def test_many_texts_of_one_id(spark):
    rng = random.Random(4)
    texts = [t for k in range(20) for t in family(rng, [f"w{k}_{i}" for i in range(60)], 15, 1)]
    df = spark.createDataFrame([(3, t, None) for t in texts] + [(1, texts[0] + " end", None)], SCHEMA)
    got = jaccard_components(df).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute([(3, t) for t in texts] + [(1, texts[0] + " end")])
    _, nodes, _ = _grouped(df, 75, 5)
    pairs = nodes.selectExpr("node AS a", "node AS b")
    assert node_texts(pairs, nodes, df).count() == nodes.count() == len(set(texts)) + 1

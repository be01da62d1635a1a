"""Each stage of the pipeline against plain Python on its own input."""

import random
from collections import Counter

from pyspark.sql import types as T

import corpus_pipeline as P
from test_jaccard import brute as components_of
from test_repeats import brute as repeats_of

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(seed=4):
    rng = random.Random(seed)
    words = "the of and to in it was for with that".split() + [f"w{i}" for i in range(4000)]
    fresh = lambda n: [rng.choice(words[:10]) if rng.random() < 0.3 else rng.choice(words[10:]) for _ in range(n)]
    passage, base, texts = fresh(70), fresh(150), []
    texts += [" ".join(fresh(rng.randrange(40, 300))) for _ in range(40)]
    texts += [" ".join(fresh(60) + passage + fresh(60)) for _ in range(8)]
    for _ in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = "edited"
        texts.append(" ".join(copy))
    texts += ["# | " * 100, "the same words " * 60, "", None, " ".join(fresh(3000)), texts[0], texts[1].upper()]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2]]


def test_stages_in_turn(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    good = P.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    good_rows = [tuple(r) for r in good.collect()]
    assert {r[0] for r in good_rows} == {r[0] for r in rows if r[1] and len(r[1].split()) >= 50 and "#" not in r[1] and "the same words" not in r[1]}
    one = P.near_copies(spark, spark.createDataFrame(good_rows, SCHEMA), "")
    one_rows = [tuple(r) for r in one.collect()]
    assert one.columns == docs.columns
    assert sorted(r[0] for r in one_rows) == sorted({c for _, _, c in components_of([r[:2] for r in good_rows])})
    cut = P.repeated_passages(spark, spark.createDataFrame(one_rows, SCHEMA), "")
    cut_rows = [tuple(r) for r in cut.collect()]
    kept = {i: n - gone for i, n, gone, _, _ in repeats_of([r[:2] for r in one_rows])}
    assert {r[0]: len(r[1].encode()) for r in cut_rows} == kept and all(len(r[1]) == r[4] for r in cut_rows)
    assert any(len(r[1]) < 700 for r in cut_rows)
    mix = P.source_mix(spark, spark.createDataFrame(cut_rows, SCHEMA), "")
    assert mix.columns == docs.columns
    mix_rows = [tuple(r) for r in mix.collect()]
    assert set(mix_rows) <= set(cut_rows) and max(Counter(mix_rows).values()) <= 3
    total = sum(len(r[1].split()) for r in cut_rows)
    assert abs(sum(len(r[1].split()) for r in mix_rows) - total) < 0.4 * total
    packed = P.best_fit_packing(spark, spark.createDataFrame(mix_rows, SCHEMA), "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in mix_rows)
    assert sum(r.start == 0 for r in packed) == len(mix_rows)


def test_empty_table_and_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (1, "a " * 80, None, None, None)], SCHEMA)
    for docs in (spark.createDataFrame([], SCHEMA), odd):
        for name, stage in P.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()
            docs = spark.createDataFrame(docs.collect(), docs.schema)

"""Blocks of the meaning match: few copies of the vectors, the same best examples."""

import random

import numpy as np

from tilewright.operators import meaning as M


def test_larger_blocks_give_the_same_best_examples(spark, monkeypatch):
    rng = random.Random(5)
    v = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    e = spark.createDataFrame(v, "example_id long, rule int, vec array<double>")
    q = e.selectExpr("example_id AS q_id", "vec")
    monkeypatch.setattr(M, "SLICE", 7)
    m = np.array([x[2] for x in v])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, r): max((s[i, j], j) for j in range(300) if j % 3 == r)[1] for i in range(300) for r in range(3)}
    assert {(r.q_id, r.rule): r.example_id for r in M.best_per_rule(q, e, others_only=True).collect()} == want
    assert {(r.q_id, r.rule): r.example_id for r in M.best_per_rule(q, e, 2, 3, others_only=True).collect()} == want

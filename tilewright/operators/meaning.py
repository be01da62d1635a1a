"""Matching questions to rules by sentence vectors, and the evaluation of that matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V

BLOCK = 16384  # vectors of either side in one task
SLICE = 1024   # questions of a task that are scored at once


def pooled(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors under the mask, scaled to unit length."""
    dim = F.size(F.get(tokens, F.lit(0)))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    zero = F.transform(F.sequence(F.lit(1), dim), lambda _: F.lit(0.0))
    total = F.aggregate(F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / weight)
    norm = F.greatest(F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(mean, lambda x: x / norm)


def best_per_rule(questions: DataFrame, examples: DataFrame, q_blocks: int | None = None, e_blocks: int | None = None, others_only: bool = False) -> DataFrame:
    """Similarity of every question to the closest example of every rule, with that example.

    A block matrix product: questions and examples are cut into blocks by hash, every pair of blocks meets in one task as
    two small matrices, and only the best example per (question, rule) leaves it.  A task holds about BLOCK vectors of either side and
    at most SLICE x BLOCK scores at once, whatever the size of either side; larger blocks are copied fewer times.  questions: q_id, vec; examples: rule, example_id, vec.  With `others_only` a question
    that is an example itself is not compared with its own id.
    """
    asked = 0 if q_blocks else questions.count()
    # few questions are still dealt to every task
    p = q_blocks or max(1, math.ceil(asked / BLOCK), min(math.ceil(asked / SLICE), questions.sparkSession.sparkContext.defaultParallelism))
    r = e_blocks or max(1, math.ceil(examples.count() / BLOCK))
    q = questions.select("q_id", "vec", F.pmod(F.xxhash64("q_id"), F.lit(p)).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"))
    e = examples.select("rule", "example_id", "vec", F.pmod(F.xxhash64("example_id"), F.lit(r)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(p - 1).cast("bigint"))).alias("p"))
    q_type, rule_type, id_type = (dict(d.dtypes)[c] for d, c in ((questions, "q_id"), (examples, "rule"), (examples, "example_id")))
    schema = f"q_id {q_type}, rule {rule_type}, score double, example_id {id_type}"

    def block(qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or es.empty:
            return pd.DataFrame({"q_id": [], "rule": [], "score": [], "example_id": []})
        es = es.sort_values(["rule", "example_id"], kind="stable")
        asked, known = (np.stack(v["vec"].to_numpy()).astype(np.float64) for v in (qs, es))
        own = pd.Index(es["example_id"]).get_indexer(qs["q_id"]) if others_only else np.full(len(qs), -1)
        rules, first = np.unique(es["rule"].to_numpy(), return_index=True)
        ids, q_ids = es["example_id"].to_numpy(), qs["q_id"].to_numpy()
        out = []
        for a in range(0, len(qs), SLICE):
            mine, part = own[a:a + SLICE], q_ids[a:a + SLICE]
            scores = asked[a:a + SLICE] @ known.T
            scores[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
            for k, rule in enumerate(rules):
                lo, hi = first[k], first[k + 1] if k + 1 < len(rules) else len(ids)
                at = scores[:, lo:hi].argmax(axis=1)
                out.append(pd.DataFrame({"q_id": part, "rule": rule, "score": scores[np.arange(len(part)), lo + at], "example_id": ids[lo + at]}))
        return pd.concat(out, ignore_index=True)

    parts = q.groupBy("p", "r").cogroup(e.groupBy("p", "r")).applyInPandas(block, schema).where(F.col("score") > float("-inf"))
    return parts.groupBy("q_id", "rule").agg(F.max(F.struct("score", "example_id")).alias("b")).select("q_id", "rule", "b.score", "b.example_id")


def _ranked(best: DataFrame) -> DataFrame:
    """Rules of a question from closest to farthest; as many as there are rules."""
    return best.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("score", "rule", "example_id")), asc=False).alias("ranked"))


def match(best: DataFrame, off_topic: DataFrame, keywords: DataFrame, min_score: float = V.MEANING_MIN_SCORE, margin: float = V.MEANING_MARGIN,
          add: float = V.MEANING_ADD_TO_KEYWORDS) -> DataFrame:
    """Rules meant beyond the keyword matches.

    With keyword matches only the closest rule may be added, and only when it is confident; without, every rule near the
    best one, unless the question is at least as close to everyday requests.  off_topic: q_id, null_score; keywords: q_id, rules ARRAY.
    """
    none = F.array().cast(f"array<{dict(best.dtypes)['rule']}>")
    j = (_ranked(best).join(off_topic, "q_id", "left").join(keywords, "q_id", "left").withColumn("kw", F.coalesce("rules", none))
         .withColumn("top", F.get("ranked", F.lit(0))))
    top = F.col("top.score")
    with_kw = F.filter(F.slice("ranked", 1, 1), lambda r: (r["score"] >= add) & ~F.array_contains("kw", r["rule"]))
    rejected = (top < min_score) | (top <= F.coalesce("null_score", F.lit(-1.0)))
    alone = F.filter("ranked", lambda r: r["score"] >= F.greatest(F.lit(min_score), top - margin))
    taken = F.when(F.size("kw") > 0, with_kw).when(rejected, F.slice("ranked", 1, 0)).otherwise(alone)
    return j.select("q_id", F.explode(taken).alias("m")).select("q_id", "m.rule", "m.score", "m.example_id")


def suggestions(raw: DataFrame, masked: DataFrame, n: int = 3) -> DataFrame:
    """Likeliest rules of a question nothing matched: the better of the scores with and without place names."""
    m = masked.select("q_id", "rule", F.col("score").alias("_m"))
    j = raw.join(m, ["q_id", "rule"], "left").withColumn("score", F.greatest("score", F.coalesce("_m", F.lit(-1.0))))
    top = j.groupBy("q_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "rule"))), 1, n).alias("t"))
    return top.select("q_id", F.posexplode("t").alias("pos", "t")).select("q_id", "pos", "t.rule", (-F.col("t.s")).alias("score"))


def correct(predicted: Column, primary: Column, allowed: Column) -> Column:
    """A prediction is right when it holds the primary rule and nothing outside the allowed ones; off-topic must be empty."""
    inside = F.size(F.array_except(predicted, F.array_append(allowed, primary))) == 0
    return F.when(primary.isNull(), F.size(predicted) == 0).otherwise(F.array_contains(predicted, primary) & inside)


def accuracy(cases: DataFrame) -> DataFrame:
    """Right answers and cases per split.  cases: split, predicted, primary, allowed."""
    return cases.withColumn("_ok", correct(F.col("predicted"), F.col("primary"), F.col("allowed"))).groupBy("split").agg(
        F.count_if("_ok").alias("ok"), F.count("*").alias("n"))


def predict(ranked: Column, kw: Column, null_score: Column, threshold: Column, margin: Column, add: Column) -> Column:
    """Predicted rules for one setting of the thresholds."""
    top = F.get(ranked, F.lit(0))
    with_top = F.when((top["score"] >= add) & ~F.array_contains(kw, top["rule"]), F.array_append(kw, top["rule"])).otherwise(kw)
    near = F.transform(F.filter(ranked, lambda r: (r["score"] >= top["score"] - margin) & (r["score"] >= threshold)), lambda r: r["rule"])
    return F.when(F.size(kw) > 0, with_top).when((top["score"] < threshold) | (top["score"] <= null_score), F.slice(kw, 1, 0)).otherwise(near)


THRESHOLDS = [round(0.30 + 0.025 * i, 3) for i in range(15)]
MARGINS = [0.0, 0.02, 0.04, 0.06]
ADDS = [0.5, 0.55, 0.6, 0.65, 0.7, 9.9]


def grid_search(best: DataFrame, cases: DataFrame) -> DataFrame:
    """Right answers for every setting of the three thresholds, best setting first.

    The settings (a fixed 15 x 4 x 6 list) are an array literal exploded per question and summed on the map side; nothing is
    shuffled but one row per setting and task.  Only the tuning half counts; the rest stays held out.
    cases: q_id, kw, null_score, primary, allowed, split.
    """
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("margin"), F.lit(a).alias("add")) for t in THRESHOLDS for m in MARGINS for a in ADDS])
    j = _ranked(best).join(cases.where("split = 'tune'"), "q_id").select("*", F.explode(grid).alias("g"))
    ok = correct(predict(F.col("ranked"), F.col("kw"), F.col("null_score"), F.col("g.threshold"), F.col("g.margin"), F.col("g.add")), F.col("primary"), F.col("allowed"))
    return j.groupBy("g.threshold", "g.margin", "g.add").agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


def best_setting(scores: DataFrame) -> DataFrame:
    """Most right answers; ties go to the threshold nearest 0.45, then the smaller addition, then larger threshold and margin."""
    key = F.struct("ok", (-F.abs(F.col("threshold") - 0.45)).alias("d"), (-F.col("add")).alias("a"), "threshold", "margin")
    return scores.agg(F.max_by(F.struct("threshold", "margin", "add", "ok", "n"), key).alias("b")).select("b.*")

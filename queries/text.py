"""Periods and places in question texts, matching by meaning, and its evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from queries.base import query, table
from queries.resolving import ASKS_SQL, _lit, asks
from tilewright import vocab as V
from tilewright.functions import text as X
from tilewright.operators import meaning as M

TODAY = dt.date(2026, 9, 26)
_B0, _B1 = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _p(name):
    return f"regexp_extract(t, {_lit(_B0 + '(' + X.PERIOD_PATTERNS[name] + ')' + _B1)}, 1)"


def _g(name, m, i):
    return f"regexp_extract({m}, {_lit(X.PERIOD_PATTERNS[name])}, {i})"


def _mn(w):
    return f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', substr({w}, 1, 3)) + 2) // 3 AS INT)"


def _first(y, m="1"):
    return f"make_date(CAST({y} AS INT), {m}, 1)"


_NUM = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.NUMBER_WORDS.items()) + " ELSE TRY_CAST(w AS INT) END"
_N = list(X.PERIOD_PATTERNS)
PERIOD_SQL = ASKS_SQL + f""", low AS (SELECT ask_id, text, lower(text) AS t FROM asks),
iso AS (SELECT *, regexp_extract_all(regexp_replace(t, '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g'), {_lit(_B0 + '(' + X.ISO + ')' + _B1)}, 1) AS ds FROM low),
pat AS (SELECT *, {', '.join(f'{_p(n)} AS m{i}' for i, n in enumerate(_N))} FROM iso),
kind AS (SELECT *, CASE WHEN len(ds) >= 2 AND TRY_CAST(ds[1] AS DATE) IS NOT NULL AND TRY_CAST(ds[2] AS DATE) IS NOT NULL THEN 'iso2' WHEN len(ds) = 1 AND TRY_CAST(ds[1] AS DATE) IS NOT NULL THEN 'iso1'
 {' '.join(f"WHEN m{i} <> '' THEN 'k{i}'" for i in range(len(_N)))} END AS kind, {_g('last n', 'm6', 1)} AS w, CASE WHEN {_g('monsoon of year', 'm4', 1)} <> '' THEN {_g('monsoon of year', 'm4', 1)} ELSE {_g('monsoon of year', 'm4', 2)} END AS my,
 CAST({_mn('m8')} AS INT) AS mm, DATE '2026-09-26' AS today FROM pat),
period AS (SELECT ask_id, text, CASE kind WHEN 'iso2' THEN least(TRY_CAST(ds[1] AS DATE), TRY_CAST(ds[2] AS DATE)) WHEN 'iso1' THEN TRY_CAST(ds[1] AS DATE) - 30
  WHEN 'k0' THEN {_first(_g(_N[0], 'm0', 2), _mn(_g(_N[0], 'm0', 1)))} WHEN 'k1' THEN {_first(_g(_N[1], 'm1', 3), _mn(_g(_N[1], 'm1', 1)))} WHEN 'k2' THEN {_first(_g(_N[2], 'm2', 2), _mn(_g(_N[2], 'm2', 1)))}
  WHEN 'k3' THEN {_first(f"least({_g(_N[3], 'm3', 1)}, {_g(_N[3], 'm3', 2)})")} WHEN 'k4' THEN {_first('my', '6')} WHEN 'k5' THEN {_first(_g(_N[5], 'm5', 1))}
  WHEN 'k6' THEN today - CAST(({_NUM}) * CASE WHEN {_g('last n', 'm6', 2)} LIKE 'year%' THEN 365 ELSE 30 END AS INT) WHEN 'k7' THEN DATE '2026-06-01'
  WHEN 'k8' THEN make_date(CASE WHEN mm <= 9 THEN 2026 ELSE 2025 END, mm, 1) WHEN 'k9' THEN {_first('m9')} END AS p_start,
 CASE kind WHEN 'iso2' THEN greatest(TRY_CAST(ds[1] AS DATE), TRY_CAST(ds[2] AS DATE)) WHEN 'iso1' THEN TRY_CAST(ds[1] AS DATE) + 30
  WHEN 'k0' THEN last_day({_first(_g(_N[0], 'm0', 4), _mn(_g(_N[0], 'm0', 3)))}) WHEN 'k1' THEN last_day({_first(_g(_N[1], 'm1', 3), _mn(_g(_N[1], 'm1', 2)))}) WHEN 'k2' THEN last_day({_first(_g(_N[2], 'm2', 2), _mn(_g(_N[2], 'm2', 1)))})
  WHEN 'k3' THEN least(today, last_day({_first(f"greatest({_g(_N[3], 'm3', 1)}, {_g(_N[3], 'm3', 2)})", '12')})) WHEN 'k4' THEN least(today, last_day({_first('my', '9')})) WHEN 'k5' THEN today WHEN 'k6' THEN today
  WHEN 'k7' THEN today WHEN 'k8' THEN least(today, last_day(make_date(CASE WHEN mm <= 9 THEN 2026 ELSE 2025 END, mm, 1))) WHEN 'k9' THEN least(today, last_day({_first('m9', '12')})) END AS p_end,
 CASE kind WHEN 'iso2' THEN ds[1] || ' … ' || ds[2] WHEN 'iso1' THEN ds[1] {' '.join(f"WHEN 'k{i}' THEN m{i}" for i in range(len(_N)))} END AS p_text, CASE kind WHEN 'iso1' THEN TRY_CAST(ds[1] AS DATE) END AS p_event FROM kind)"""


@query("x1_periods_in_text", f"WITH {PERIOD_SQL} SELECT ask_id, p_start, p_end, p_text, p_event FROM period")
def periods(spark, sf_dir):
    p = X.parse_period(F.col("text"), TODAY)
    return asks(spark, sf_dir).select("ask_id", p.alias("p")).select("ask_id", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), F.col("p.text").alias("p_text"), F.col("p.event").alias("p_event"))


def _places(spark, sf_dir):
    a = asks(spark, sf_dir).withColumn("p", X.parse_period(F.col("text"), TODAY))
    return a.withColumn("places", X.place_candidates(F.col("text"), F.col("p.text"), X.stop_words()))


_STOP = "[" + ", ".join(_lit(w) for w in X.stop_words()) + "]"
_LINKS = "[" + ", ".join(_lit(w) for w in V.NAME_LINKS) + "]"
_ADMIN = "[" + ", ".join(_lit(w) for w in V.ADMIN_WORDS) + "]"
_PREP = "[" + ", ".join(_lit(w) for w in V.PREPOSITIONS) + "]"
_ENDS = "[" + ", ".join(_lit(w) for w in V.END_WORDS) + "]"
PLACES_SQL = PERIOD_SQL + f""",
st AS (SELECT {_STOP} AS stop), tx AS (SELECT ask_id, text, CASE WHEN p_text IS NULL THEN text ELSE regexp_replace(text, '(?i)' || regexp_escape(p_text), ' ', 'g') END AS t FROM period),
parts AS (SELECT ask_id, text, t, string_split(regexp_replace(t, {_lit('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])' + X.PLACE_PATTERN)}, '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM tx),
seg AS (SELECT ask_id, i, split_part(ps[i + 1], chr(2), 1) AS nm, rtrim(replace(ps[i], chr(2), ''), E' \\n\\t\\r') AS bf FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM parts)),
wd AS (SELECT ask_id, i, bf, regexp_split_to_array(nm, '\\s+') AS ws FROM seg),
ld AS (SELECT ask_id, i, bf, ws[coalesce(list_position(list_transform(ws, lambda w: list_contains(stop, trim(lower(w), '.,'))), FALSE), len(ws) + 1):] AS ws, stop FROM wd, st),
tl AS (SELECT ask_id, i, bf, stop, trim(array_to_string(ws[1:len(ws) - coalesce(list_position(list_reverse(list_transform(ws, lambda w: list_contains({_LINKS}, lower(w)))), FALSE), len(ws) + 1) + 1], ' '), ' .,') AS nm FROM ld WHERE len(ws) > 0),
cap AS (SELECT ask_id, i, nm, CASE WHEN list_contains({_PREP}, lower(regexp_extract(bf, '(\\S+)$', 1))) THEN 0 WHEN bf = '' OR right(bf, 1) IN ('.', '!', '?') THEN 2 ELSE 1 END AS rk FROM tl WHERE nm <> '' AND NOT list_contains(stop, lower(nm))),
cap1 AS (SELECT ask_id, nm, min(i) AS i, arg_min(rk, i) AS rk FROM cap GROUP BY 1, 2),
lowr AS (SELECT ask_id, unnest(range(1, len(rs) + 1)) AS i, unnest(rs) AS r FROM (SELECT ask_id, regexp_extract_all(t, {_lit('(?i)' + chr(92) + 'b' + X.LOWER_PATTERN)}, 1) AS rs FROM tx WHERE ask_id NOT IN (SELECT ask_id FROM cap1))),
lw AS (SELECT ask_id, i, list_transform(regexp_split_to_array(r, '\\s+'), lambda w: trim(w, '.,;:!?')) AS ws FROM lowr),
lf AS (SELECT ask_id, i, ws, stop, coalesce(list_position(list_transform(ws, lambda w, k: k > 1 AND list_contains({_ADMIN}, lower(w))), TRUE), len(ws)) AS a,
 coalesce(list_position(list_transform(ws, lambda w, k: NOT (k > 1 AND list_contains({_ADMIN}, lower(w))) AND (list_contains({_ENDS}, lower(w)) OR list_contains(stop, lower(w)) OR regexp_full_match(lower(w), '(19|20)[0-9]{{2}}'))), TRUE), len(ws) + 1) - 1 AS e FROM lw, st),
ln AS (SELECT ask_id, i, stop, array_to_string(ws[1:least(a, e)], ' ') AS nm FROM lf),
ld1 AS (SELECT ask_id, lower(nm) AS l, min(i) AS i, arg_min(nm, i) AS nm FROM ln WHERE nm <> '' AND NOT list_contains(stop, lower(nm)) GROUP BY 1, 2),
pl AS (SELECT ask_id, nm AS place, rk, i FROM cap1 UNION ALL SELECT ask_id, CASE WHEN nm = lower(nm) THEN array_to_string(list_transform(regexp_split_to_array(regexp_replace(nm, '([^\\p{{L}}])(\\p{{L}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda w: upper(left(w, 1)) || substr(w, 2)), '') ELSE nm END, 0, i FROM ld1),
pos AS (SELECT ask_id, CAST(row_number() OVER (PARTITION BY ask_id ORDER BY rk, i) - 1 AS INT) AS pos, place FROM pl)"""


@query("x2_x3_places_in_text", f"WITH {PLACES_SQL} SELECT ask_id, pos, place FROM pos")
def places(spark, sf_dir):
    return _places(spark, sf_dir).select("ask_id", F.posexplode("places").alias("pos", "place"))


@query("x6_masked_questions", f"""WITH {PLACES_SQL}, l AS (SELECT ask_id, list(place ORDER BY pos) AS ps FROM pos GROUP BY 1)
SELECT p.ask_id, sha256(coalesce(list_reduce(list_prepend(p.text, l.ps), lambda a, b: replace(a, b, 'the area')), p.text)) AS masked FROM period p LEFT JOIN l USING (ask_id)""")
def masked(spark, sf_dir):
    return _places(spark, sf_dir).select("ask_id", F.sha2(X.mask_places(F.col("text"), F.col("places")), 256).alias("masked"))


# ---- meaning -------------------------------------------------------------------------------------------------------

def _sides(spark, sf_dir):
    """Every vector is a question, and an example of its label for all others."""
    v = table(spark, sf_dir, "embeddings")
    q = v.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"))
    e = v.select(F.col("label").alias("rule"), F.col("vec_id").alias("example_id"), F.col("embedding").alias("vec"))
    return q, e


def _best(spark, sf_dir):
    return M.best_per_rule(*_sides(spark, sf_dir), others_only=True)


_SIM_SQL = """sim AS (SELECT q.vec_id AS q_id, e.label AS rule, e.vec_id AS example_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id),
best AS (SELECT q_id, rule, max(s) AS score, max(row(s, example_id))[2] AS example_id FROM sim GROUP BY 1, 2),
kw AS (SELECT vec_id AS q_id, CASE WHEN vec_id % 3 = 0 THEN [CAST(vec_id // 10 % 9 AS INT)] ELSE CAST([] AS INT[]) END AS rules FROM embeddings),
nul AS (SELECT q_id, score AS null_score FROM best WHERE rule = 9), rk AS (SELECT b.*, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rule DESC) AS rn, max(score) OVER (PARTITION BY q_id) AS top FROM best b WHERE rule <> 9)"""


@query("j16_a22_closest_example_per_rule", f"WITH {_SIM_SQL} SELECT q_id, rule, round(score, 5) AS score, example_id FROM best")
def closest(spark, sf_dir):
    return _best(spark, sf_dir).select("q_id", "rule", F.round("score", 5).alias("score"), "example_id")


def _keywords(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS q_id", "IF(vec_id % 3 = 0, array(CAST((vec_id div 10) % 9 AS INT)), CAST(array() AS array<int>)) AS rules")


@query("x5_u2_rules_by_meaning", f"""WITH {_SIM_SQL}
SELECT rk.q_id, rk.rule, round(rk.score, 5) AS score, example_id FROM rk JOIN kw USING (q_id) LEFT JOIN nul USING (q_id)
WHERE CASE WHEN len(rules) > 0 THEN rn = 1 AND score >= 0.5 AND NOT list_contains(rules, rule) ELSE top >= 0.325 AND top > coalesce(null_score, -1) AND score >= greatest(0.325, top - 0.06) END""")
def by_meaning(spark, sf_dir):
    b = _best(spark, sf_dir)
    off = b.where("rule = 9").select("q_id", F.col("score").alias("null_score"))
    return M.match(b.where("rule <> 9"), off, _keywords(spark, sf_dir)).select("q_id", "rule", F.round("score", 5).alias("score"), "example_id")


@query("t4_suggested_rules", f"""WITH {_SIM_SQL}, z AS (SELECT b.q_id, b.rule, greatest(b.score, coalesce(m.score - 0.05 + 0.01 * b.rule, -1)) AS score FROM best b LEFT JOIN best m ON m.q_id = b.q_id AND m.rule = b.rule AND m.rule % 2 = 0)
SELECT q_id, CAST(pos - 1 AS INT) AS pos, rule, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rule) AS pos FROM z) WHERE pos <= 3""")
def suggested(spark, sf_dir):
    b = _best(spark, sf_dir)
    masked_ = b.where("rule % 2 = 0").withColumn("score", F.col("score") - 0.05 + 0.01 * F.col("rule"))
    return M.suggestions(b, masked_).select("q_id", "pos", "rule", F.round("score", 5).alias("score"))


def _cases(spark, sf_dir):
    """Evaluation cases: the label of a question is its primary rule, label 9 is off-topic."""
    v = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS q_id", "IF(label = 9, NULL, label) AS primary", "array(CAST((label + 1) % 9 AS INT)) AS allowed", "IF(vec_id % 2 = 0, 'tune', 'test') AS split")
    off = _best(spark, sf_dir).where("rule = 9").select("q_id", F.col("score").alias("null_score"))
    return v.join(_keywords(spark, sf_dir).withColumnRenamed("rules", "kw"), "q_id").join(off, "q_id", "left").withColumn("null_score", F.coalesce("null_score", F.lit(-1.0)))


_CASE_SQL = _SIM_SQL + """, cs AS (SELECT vec_id AS q_id, CASE WHEN label <> 9 THEN label END AS prim, [CAST((label + 1) % 9 AS INT)] AS allowed, CASE WHEN vec_id % 2 = 0 THEN 'tune' ELSE 'test' END AS split, coalesce(null_score, -1) AS ns, rules AS kwr
 FROM embeddings JOIN kw ON kw.q_id = vec_id LEFT JOIN nul ON nul.q_id = vec_id)"""
_OK = "CASE WHEN prim IS NULL THEN len({p}) = 0 ELSE list_contains({p}, prim) AND len(list_filter({p}, lambda x: x <> prim AND NOT list_contains(allowed, x))) = 0 END"


@query("e1_e3_accuracy_by_split", f"""WITH {_CASE_SQL}, pr AS (SELECT c.*, coalesce((SELECT list(rule) FROM rk WHERE rk.q_id = c.q_id AND score >= top - 0.06 AND score >= 0.325 AND top >= 0.325 AND top > ns), CAST([] AS INT[])) AS near, (SELECT rule FROM rk WHERE rk.q_id = c.q_id AND rn = 1) AS tr, (SELECT top FROM rk WHERE rk.q_id = c.q_id AND rn = 1) AS ts FROM cs c),
p2 AS (SELECT *, CASE WHEN len(kwr) > 0 THEN CASE WHEN ts >= 0.5 AND NOT list_contains(kwr, tr) THEN list_append(kwr, tr) ELSE kwr END ELSE near END AS p FROM pr)
SELECT 'keywords' AS method, split, CAST(count(*) FILTER ({_OK.format(p='kwr')}) AS BIGINT) AS ok, CAST(count(*) AS BIGINT) AS n FROM p2 GROUP BY split
UNION ALL SELECT 'keywords and meaning', split, CAST(count(*) FILTER ({_OK.format(p='p')}) AS BIGINT), CAST(count(*) AS BIGINT) FROM p2 GROUP BY split""")
def accuracy(spark, sf_dir):
    c = _cases(spark, sf_dir)
    ranked = M._ranked(_best(spark, sf_dir).where("rule <> 9"))
    both = c.join(ranked, "q_id").withColumn("predicted", M.predict(F.col("ranked"), F.col("kw"), F.col("null_score"), F.lit(0.325), F.lit(0.06), F.lit(0.5)))
    base = M.accuracy(c.withColumn("predicted", F.col("kw"))).withColumn("method", F.lit("keywords"))
    return base.unionByName(M.accuracy(both).withColumn("method", F.lit("keywords and meaning"))).select("method", "split", "ok", "n")


_GRID_SQL = f"""{_CASE_SQL}, g AS (SELECT th, mg, ad FROM (VALUES {', '.join(f'({t})' for t in M.THRESHOLDS)}) a(th), (VALUES {', '.join(f'({m})' for m in M.MARGINS)}) b(mg), (VALUES {', '.join(f'({a})' for a in M.ADDS)}) c(ad)),
rl AS (SELECT q_id, list(rule ORDER BY rn) AS rs, list(score ORDER BY rn) AS ss FROM rk GROUP BY 1),
pg AS (SELECT cs.*, th::DOUBLE AS th, mg::DOUBLE AS mg, ad::DOUBLE AS ad, CASE WHEN len(kwr) > 0 THEN CASE WHEN ss[1] >= ad::DOUBLE AND NOT list_contains(kwr, rs[1]) THEN list_append(kwr, rs[1]) ELSE kwr END
 WHEN ss[1] < th::DOUBLE OR ss[1] <= ns THEN CAST([] AS INT[]) ELSE list_filter(rs, lambda x, i: ss[i] >= ss[1] - mg::DOUBLE AND ss[i] >= th::DOUBLE) END AS p FROM cs JOIN rl USING (q_id), g WHERE cs.split = 'tune'),
sc AS (SELECT th, mg, ad, count(*) FILTER ({_OK.format(p='p')}) AS ok, count(*) AS n FROM pg GROUP BY 1, 2, 3)"""


@query("e2_threshold_grid", f"WITH {_GRID_SQL} SELECT th AS threshold, mg AS margin, ad AS add, CAST(ok AS BIGINT) AS ok, CAST(n AS BIGINT) AS n FROM sc")
def threshold_grid(spark, sf_dir):
    return M.grid_search(_best(spark, sf_dir).where("rule <> 9"), _cases(spark, sf_dir))


@query("e2_best_setting", f"WITH {_GRID_SQL} SELECT th AS threshold, mg AS margin, ad AS add, CAST(ok AS BIGINT) AS ok, CAST(n AS BIGINT) AS n FROM sc ORDER BY ok DESC, -abs(th - 0.45) DESC, -ad DESC, th DESC, mg DESC LIMIT 1")
def best_setting(spark, sf_dir):
    return M.best_setting(M.grid_search(_best(spark, sf_dir).where("rule <> 9"), _cases(spark, sf_dir)))


@query("x8_pooled_vectors", """WITH t AS (SELECT vec_id // 5 AS q_id, embedding AS v, CASE WHEN vec_id % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS m FROM embeddings),
d AS (SELECT q_id, i AS dim, sum(v[i + 1]::DOUBLE * m) / greatest(sum(m), 1e-9) AS x FROM t, range(64) r(i) GROUP BY 1, 2)
SELECT q_id, CAST(dim AS INT) AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY q_id)), 1e-12), 5) AS x FROM d""")
def pooled(spark, sf_dir):
    # the tokens of one sentence: five per sentence
    t = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 5").alias("q_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.col("embedding").alias("v")))).alias("l"))
    p = M.pooled(F.transform("l", lambda s: s["v"]), F.transform("l", lambda s: F.when(s["vec_id"] % 5 == 4, 0.0).otherwise(1.0)))
    return t.select("q_id", F.posexplode(p).alias("dim", "x")).select("q_id", "dim", F.round("x", 5).alias("x"))

"""Quality rules: a table of thresholds compiled into one projection of built-in functions, no user function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = "[ \\t-\\r]+"     # 0x20 and 0x09-0x0D
SYMBOLS = "[#*$%&|<>]"

#: Function words of English, German, French and Spanish.
STOP_WORDS = tuple(sorted(set((
    "the of and to in is that it was for on are as with his they at be this from have or by had not but what all were when we there "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el y los del las por con no su para al lo como más o pero sus").split())))

#: (rule, measure, least, most): a document is kept if every measure lies between its bounds; null is no bound.
THRESHOLDS = (
    ("mean_word_length", lambda m: F.try_divide(m("word_chars"), m("n_words")), 2.0, 15.0),
    ("symbol_ratio", lambda m: F.try_divide(m("n_symbols"), m("word_chars")), None, 0.05),
    ("stop_word_ratio", lambda m: F.try_divide(m("n_stop_words"), m("n_words")), 0.03, None),
    ("duplicate_line_ratio", lambda m: F.try_divide(m("n_dup_lines"), m("n_lines")), None, 0.5),
)


def measures(docs: DataFrame) -> DataFrame:
    """(row, m): every row of `docs` as a struct and the struct of its measures.  Needs column text; a null text has no words."""
    text, row = F.coalesce("row.text", F.lit("")), docs.select(F.struct("*").alias("row"))
    words = row.select("row", F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    grams = words.select("row", "words", F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("grams"))
    placed = grams.select(
        "row", "grams", F.size("words").alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^ \\t-\\r]"))).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform(
            "grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("placed"))
    twice = placed.withColumn("starts", F.array_sort(F.transform(
        F.filter("placed", lambda x, k: ((k > 0) & (F.get("placed", k - 1)["g"] == x["g"]))
                 | F.coalesce(F.get("placed", k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, s: F.struct(
        s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"])
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return twice.select("row", F.struct(
        whole(F.col("n_words")).alias("n_words"), whole(F.col("word_chars")).alias("word_chars"),
        whole(F.col("n_symbols")).alias("n_symbols"), whole(F.size("lines")).alias("n_lines"),
        whole(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        whole(F.when(F.col("starts").isNotNull(), covered)).alias("n_repeat_words"),
        whole(F.col("n_stop_words")).alias("n_stop_words")).alias("m"))


def verdict(m, rules=THRESHOLDS) -> tuple[Column, Column, Column]:
    """(base_failed, kept, rules broken) from the measures, by one comparison for each bound."""
    base = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    broken = []
    for name, value, least, most in rules:
        v = value(m)
        out = F.lit(False) if least is None else v < least
        out = out if most is None else out | (v > most)
        broken.append(F.when(F.coalesce(out, F.lit(False)), F.lit(name)))
    failed = F.array_compact(F.array(F.when(base, F.lit("base")), *broken))
    return base, F.size(failed) == 0, failed


def judged(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), broken (names).

    One row for each row of `docs`, repeats included; only doc_id and text are read.  A null, empty or blank text has no words
    and fails the base rule.  Texts are read whole.  Ratios of nothing break no rule.  An empty table gives an empty one.
    """
    m = lambda c: F.col("m")[c]
    base, kept, broken = verdict(m, rules)
    return measures(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), *(m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"), kept.alias("kept"), broken.alias("broken"))


def kept_documents(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """The rows of `docs`, all columns, that break no rule.  The row is passed through a generator, so that the measures are
    computed once and not again in a pushed-down filter."""
    m = lambda c: F.col("m")[c]
    _, kept, _ = verdict(m, rules)
    return measures(docs).select(F.inline(F.when(kept, F.array("row"))))


def rules_sql() -> str:
    """The same result as DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars,
 len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(lines) AS n_lines,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 list_filter([CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN 'base' END,
 CASE WHEN n_words > 0 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 15.0) THEN 'mean_word_length' END,
 CASE WHEN word_chars > 0 AND n_symbols / word_chars > 0.05 THEN 'symbol_ratio' END,
 CASE WHEN n_words > 0 AND n_stop / n_words < 0.03 THEN 'stop_word_ratio' END,
 CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_line_ratio' END], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, len(broken) = 0 AS kept,
 broken FROM b"""

"""From questions to data needs: keyword rules, chosen rules, union of needs with the best priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import vocab as V
from tilewright.sources.registry_rows import RULES


def priority_rank(priority: Column) -> Column:
    return F.array_position(F.lit(list(V.PRIORITIES)), priority).cast("int") - 1


def keyword_rules(text: Column, rules: list[dict] = RULES) -> Column:
    """Ids of the rules with a keyword in the text, in rule order.

    A rule's patterns form one literal alternation, which Spark compiles once; the rules are configuration, so no join
    between questions and rules is needed.  Case and word boundaries follow Unicode.
    """
    # patterns are lower case; the long s is the one letter that folds to an ASCII letter but has another lower case
    folded = F.translate(F.lower(text), "ſ", "s")
    hits = [F.when(folded.rlike("(?U)" + "|".join(f"(?:{k})" for k in r["keywords"])), F.lit(r["id"])) for r in rules]
    return F.array_compact(F.array(*hits))


def how_matched(keyword: Column, meaning: Column, chosen: Column | None = None) -> Column:
    """Rule id -> why it was taken.  A choice by the user replaces everything; keywords come before meaning."""
    extra = F.filter(meaning, lambda m: ~F.array_contains(keyword, m["rule"]))
    both = F.map_concat(F.map_from_entries(F.transform(keyword, lambda r: F.struct(r.alias("k"), F.lit("keyword").alias("v")))),
                        F.map_from_entries(F.transform(extra, lambda m: F.struct(m["rule"].alias("k"), F.concat(
                            F.lit("meaning: close to “"), m["example"], F.lit("” ("), F.format_string("%.2f", m["score"]), F.lit(")")).alias("v")))))
    if chosen is None:
        return both
    by_user = F.map_from_entries(F.transform(chosen, lambda r: F.struct(r.alias("k"), F.lit("chosen by you").alias("v"))))
    return F.when(F.size(chosen) > 0, by_user).otherwise(both)


def unknown_rules(choices: DataFrame, rules: DataFrame) -> DataFrame:
    """Chosen rule ids that do not exist.  choices: ask_id, rule."""
    return choices.join(rules.select(F.col("id").alias("rule")), "rule", "left_anti")


def needs_of(asks: DataFrame, rule_needs: DataFrame, rules_column: str = "rules") -> DataFrame:
    """Union of the needs of every matched rule; a duplicate (theme, temporal) keeps the better priority, then the earlier rule.

    Returns ask_id, theme, temporal, priority, rule, why, prefer_cloud_independent and `need_rank` (priority, then theme).
    """
    matched = asks.select("ask_id", F.explode(rules_column).alias("rule")).join(rule_needs, "rule")
    keep = F.min(F.struct(priority_rank(F.col("priority")).alias("p"), "rule_pos", "need_pos", "rule", "priority", "why", "prefer_cloud_independent"))
    one = matched.groupBy("ask_id", "theme", "temporal").agg(keep.alias("n")).select(
        "ask_id", "theme", "temporal", "n.priority", "n.rule", "n.why", "n.prefer_cloud_independent", F.col("n.p").alias("_p"))
    # a question has at most as many needs as the vocabulary has (theme, mode) pairs
    ranked = one.groupBy("ask_id").agg(F.sort_array(F.collect_list(F.struct("_p", "theme", "temporal", "priority", "rule", "why", "prefer_cloud_independent"))).alias("l"))
    return ranked.select("ask_id", F.posexplode("l").alias("need_rank", "n")).select(
        "ask_id", "need_rank", "n.theme", "n.temporal", "n.priority", "n.rule", "n.why", "n.prefer_cloud_independent")


def event_type_of(rules_matched: Column, rules: list[dict] = RULES) -> Column:
    """Event type of the first matched rule that has one."""
    return F.get(F.filter(F.transform(F.filter(F.lit([r["id"] for r in rules]), lambda i: F.array_contains(rules_matched, i)), lambda i: F.try_element_at(
        F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["event_type"] or "")]), i)), lambda t: t != ""), F.lit(0))


def without_skipped(needs: DataFrame, skip: list[str]) -> DataFrame:
    return needs.where(~F.concat_ws(":", "theme", "temporal").isin(*skip)) if skip else needs


def needs_event_date(needs: DataFrame, asks: DataFrame) -> DataFrame:
    """Questions with a before/after need and neither a period nor an event.  asks: ask_id, has_period, has_event."""
    pair = needs.where(F.col("temporal") == "pair").select("ask_id").distinct()
    return asks.where(~F.col("has_period") & ~F.col("has_event")).join(pair, "ask_id", "left_semi").select("ask_id")


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """Distinct plain words of three letters or more."""
    plain = F.lower(F.replace(F.col(column), F.lit("\\b"), F.lit(" ")))
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z]{3,}"), F.lit(0)))).alias("word")).distinct()

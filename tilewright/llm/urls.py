"""URL filters: rules on host and path first, and for the rest trust and distrust passed along links between hosts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import stage

#: (verdict, rule): the host up to the first slash, the beginning of the path from there on.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-5  # of an even share: the movement in all at which scores count as final
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = "(?i)(?:href|src)\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s<>\\\\]+)"


def parts(pages: DataFrame) -> DataFrame:
    """Column url's host and path added to `pages` (page_id, url, ...)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(bare, "/")
    host = F.when(slash > 0, F.substring_index(bare, "/", 1)).otherwise(bare)
    path = F.when(slash > 0, F.substring(bare, slash, F.length(bare))).otherwise(F.lit(""))
    return pages.withColumns({"host": F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of(rules=RULES):
    """(rule, verdict) of columns host and path: the longest rule whose host is the host or above it and whose path begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, from absolute and protocol-relative href and src of every page's html.

    The weight is the share of the source's outgoing links; links of one page to one host are summed before the shuffle.
    """
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    named = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = named.groupBy("src").agg(F.sum("n").alias("out"))
    return named.join(total, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, hosts: int, damping: float = DAMPING) -> DataFrame:
    """(host, score) by PageRank personalised to `seeds` (host, seed; seeds sum to 1) over `edges` (src, dst, weight) between `hosts` hosts.

    A host without links gives its score back to the seeds.  Rounds go on until scores move in all by less than TOLERANCE of an even share, so
    no host's score is further from its end than that times 1 / (1 - damping).  Each round moves them by `damping` of the one before at
    most, so their number grows with the logarithm of the number of hosts; far more raise an error rather than stop early.
    """
    enough = TOLERANCE / max(1, hosts)
    seeds = stage(seeds, "seeds")
    now, ends = seeds.select("host", F.col("seed").alias("score")), edges.select(F.col("src").alias("host")).distinct()
    if not edges.take(1) or not seeds.take(1):
        return now
    for _ in range(20 + 2 * math.ceil(math.log(enough) / math.log(damping))):
        lost = now.join(ends, "host", "left_anti").agg(F.sum("score")).first()[0] or 0.0
        sent = now.join(edges, now["host"] == edges["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight") * damping).alias("got"))
        back = seeds.select("host", (F.col("seed") * (1 - damping + damping * lost)).alias("got"))
        new = stage(sent.select(F.col("dst").alias("host"), "got").union(back).groupBy("host").agg(F.sum("got").alias("score")), "scores")
        moved = new.join(now.withColumnRenamed("score", "old"), "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        now = new
        if moved < enough:
            return now
    raise RuntimeError("scores of hosts do not settle: weights of a host's links must sum to 1")


def judged(pages: DataFrame, rules=RULES, threshold: float = 1.0, least: float = 0.2) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of `pages` (page_id, url, html).

    A url that a rule fits has the rule's verdict.  Otherwise its host decides: a host is blocked if its distrust is more than
    `threshold` times its trust and more than `least` of an even share of all distrust.  Trust starts at hosts most of whose judged pages
    are allowed by rules and follows links; distrust starts at hosts most of whose pages are blocked and goes from a page to
    the pages that link to it.  Hosts that neither reaches are allowed.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed; null html has no links.  Repeated
    rows are judged each and count each.  An empty table gives an empty one.  Host tables grow with the number of hosts and are
    joined by shuffle or, where Spark has measured them small, by broadcast.
    """
    rule, verdict = rule_of(rules)
    rows = parts(pages.select("page_id", "url", "html"))
    slim = stage(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "urls")
    edges = stage(host_edges(rows), "edges")
    each = slim.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    each = stage(each, "hosts")

    def seeds(column):
        some = each.where(F.col(column) * 2 > F.col("n")).select("host", F.col(column).alias("k"))
        return some.select("host", (F.col("k") / F.lit(some.agg(F.sum("k")).first()[0] or 1)).alias("seed"))

    n_hosts = each.count()
    trust = spread(edges, seeds("good"), n_hosts)
    total = edges.groupBy("dst").agg(F.sum("weight").alias("in"))
    turned = stage(edges.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("in")).alias("weight")), "edges")
    distrust = spread(turned, seeds("bad"), n_hosts)
    share = least / max(1, n_hosts)
    hosts = (each.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
             .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    bad = (F.col("distrust") > threshold * F.col("trust")) & (F.col("distrust") > share)
    known = slim.join(hosts, "host", "left")
    return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")), F.lit("allow")).alias("verdict"),
                        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import collocations, extraction, jaccard, licences, mixing, nearest, packing, ranking, repeats, rules, separators, spelling, urls
from tilewright.session import configure

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return register


@query("op1_ngram_jaccard_join")
def op1(spark, table):
    """Documents with their shingle set size and the component of links at Jaccard 0.75 or more."""
    return jaccard.jaccard_components(table("documents"), percent=75, width=5)


@query("op2_url_filters")
def op2(spark, table):
    """Every page's host, path, rule and verdict, by rules first and by trust and distrust along links otherwise."""
    return urls.judged(table("pages"))


@query("op3_suffix_array_dedup")
def op3(spark, table):
    """Bytes left of every document once strings of 200 bytes that start anywhere else are removed."""
    return repeats.deduplicated(table("documents"), 200)


@query("op4_licence_scan")
def op4(spark, table):
    """Licence statements in all documents with their family."""
    return licences.scanned(table("documents"))


@query("op5_best_fit_packing")
def op5(spark, table):
    """Pieces of all documents packed into sequences of 2,048 tokens."""
    return packing.packed(table("documents"), 2048)


@query("op6_source_mixing", mixing.MIXING_SQL)
def op6(spark, table):
    """Words that a mix of the sources at weights 5, 2, 1 takes of every document."""
    return mixing.mixed(table("documents"))


@query("op7_quality_ranking")
def op7(spark, table):
    """Quality score of every document, learned from pairs of labelled ones."""
    return ranking.scored(table("documents"), table("labels"))


@query("op8_exact_top_k", nearest.NEAREST_SQL)
def op8(spark, table):
    """The five vectors of highest integer inner product with every fiftieth vector."""
    return nearest.top_k(table("embeddings"), k=5, every=50)


@query("op9_token_counts")
def op9(spark, table):
    """Tokens of every document, counted between end ids of flat token files."""
    return separators.document_tokens(table("documents"))


@query("op10_quality_rules", rules.rules_sql())
def op10(spark, table):
    """Counts of every document and the verdict of the threshold table."""
    return rules.judged(table("documents"))


@query("op11_html_extraction")
def op11(spark, table):
    """Main text of every page, by tree scoring."""
    return extraction.extracted(table("pages"))


@query("op12_spelling_variants")
def op12(spark, table):
    """Every word of all documents with its more frequent form, the root of its forms and its number of near words."""
    return spelling.spelling_variants(table("documents"), letters=6, least=5, times=5)


@query("op13_phrase_collocations", collocations.COLLOCATION_SQL)
def op13(spark, table):
    """The 2,000 collocations of highest score of every language."""
    return collocations.collocations(table("documents"), least=30, share=80, first=2000)

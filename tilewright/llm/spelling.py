"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by pivotal grams.

1. Every word is cut into bigrams, ordered by how many words hold them.  The rarest three places (with all that tie) are its
   prefix; two of them that do not overlap and are rarest together, chosen by dynamic programming, are its pivots.
2. One edit spoils at most one pivot.  Of two near words, the one whose prefix ends earlier in the order therefore has a pivot
   that the other holds in its prefix.
3. Position limits: the edit lies before or behind the pivot.  So the text from the word's start to the pivot's end is the same in both
   words, or the text from the pivot to the word's end is.  That text and its side are the key of an equi-join of pivots with
   prefixes; lengths differ by one at most.
4. Pairs are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import over_batches, stage

LETTERS = re.compile("[a-zÀ-ÿ]+")
DELETED = 199        # one run in so many loses a code point
_HELD = 1 << 19      # words that a task counts before it passes them on


def spelled(doc_id, run: str) -> str:
    """The lower-cased run as it counts in that document: without one code point if its checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DELETED else run[:h % len(run)] + run[h % len(run) + 1:]


def word_counts(docs: DataFrame, letters: int, least: int) -> DataFrame:
    """(word, n) of all words of at least `letters` code points and `least` occurrences in `docs`."""
    def work(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: dict[str, int] = {}
                # bytes.lower() changes A-Z alone
                for run in LETTERS.findall(str(text).encode().lower().decode()) if text.is_valid else ():
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    if len(run) >= letters and len(word := spelled(doc_id, run)) >= letters:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= _HELD:
                    yield [list(counts), list(counts.values())]
                    counts = {}
        if counts:
            yield [list(counts), list(counts.values())]
    found = over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "word string, n long", work)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of every bigram in the order from rare to frequent.  The alphabet has 90 letters, so there are 8,100 at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counted = words.where(F.length("word") >= 2).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: i for i, r in enumerate(counted.orderBy("n", "gram").collect())}


def prefix_of(word: str, ranks: dict[str, int], edits: int = 1) -> tuple[list[tuple[int, int]], int]:
    """(place, rank) of the word's rarest 2 * edits + 1 bigrams and all that tie with the last, in order of place; rank of the last."""
    grams = [(ranks[word[i:i + 2]], i) for i in range(len(word) - 1)]
    last = sorted(grams)[min(2 * edits, len(grams) - 1)][0]
    return [(i, r) for r, i in grams if r <= last], last


def pivots_of(prefix: list[tuple[int, int]], wanted: int = 2) -> list[int]:
    """Places of `wanted` bigrams of the prefix that do not overlap and whose ranks sum to the least.

    best[k] is the cheapest choice of k bigrams so far, by sum and places; a bigram can follow only what ended before it.
    """
    best: list[list] = []  # for each bigram in order of place, the best choices of 0 .. wanted bigrams among it and those before
    for j, (place, rank) in enumerate(prefix):
        before = best[j - 1] if j else [(0, ())] + [None] * wanted
        free = j - 1
        while free >= 0 and prefix[free][0] > place - 2:
            free -= 1
        ended = best[free] if free >= 0 else [(0, ())] + [None] * wanted
        row = [before[0]]
        for k in range(1, wanted + 1):
            taken = (ended[k - 1][0] + rank, (*ended[k - 1][1], place)) if ended[k - 1] else None
            row.append(min((x for x in (before[k], taken) if x), default=None))
        best.append(row)
    return list(best[-1][wanted][1])


def keyed_grams(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(word, length, last, pivot, key) twice for each bigram of every word's prefix: side and text that an edit on the other side leaves."""
    def work(batches):
        for batch in batches:
            names, lengths, lasts, chosen, keys = [], [], [], [], []
            for word in batch.column(0).to_pylist():
                prefix, last = prefix_of(word, ranks)
                pivots = set(pivots_of(prefix))
                for place, _ in prefix:
                    names += [word, word]
                    keys += ["<" + word[:place + 2], ">" + word[place:]]
                    chosen += [place in pivots] * 2
                    lasts += [last, last]
                    lengths += [len(word)] * 2
            yield [names, lengths, lasts, chosen, keys]
    return over_batches(words.select("word"), "word string, length int, last int, pivot boolean, key string", work)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all near words, each pair in both directions."""
    grams = stage(keyed_grams(words, bigram_ranks(words)), "grams")
    pivot = grams.where("pivot").select("key", F.col("word").alias("a"), F.col("length").alias("la"), F.col("last").alias("x"))
    other = grams.select("key", F.col("word").alias("b"), F.col("length").alias("lb"), F.col("last").alias("y"))
    # of two words, the one whose prefix ends first brings the pivots; of prefixes that end alike, both do
    met = pivot.join(other, "key").where((F.col("a") != F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= 1) & (F.col("x") <= F.col("y")))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "near")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word in `forms` (word, form): where following forms ends.

    Each round joins a word's form so far with the form's own, so rounds grow with the logarithm of the longest chain; n grows
    fivefold with each link, so chains are short.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if not step.where("next IS NOT NULL").take(1):
            return now
        now = stage(step.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `docs` (doc_id, text; others are not read).

    Runs of A-Z, a-z and U+00C0-U+00FF in whole texts have A-Z lower-cased; `spelled` drops a code point of some.  Words are the
    distinct results of at least `letters` (6 or more) code points and `least` occurrences n.  Near words differ by one inserted,
    deleted or replaced code point; n_near is their number.  A word's form is its near word of largest n, of equal ones the smallest
    in code-point order, if that n is `times` the word's or more, else null; form_n is the form's n.  root follows forms to the
    last and is the word itself if it has none.

    Null and empty texts and texts without letters have no words; a null doc_id counts as an empty one in the checksum; repeated
    rows count each; runs of any length count whole.  An empty table gives an empty one.  Counts are combined in tasks, so a
    frequent word is not a hot key; bigrams in many words split by the texts beside them.
    """
    if letters < 4:
        raise ValueError("words need at least three bigrams of which two do not overlap: letters must be 4 or more")
    words = stage(word_counts(docs, letters, least), "words")
    n_of = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = F.min(F.struct((-F.col("n_b")).alias("o"), F.col("b").alias("form")))
    near = near_pairs(words).join(n_of, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("m"))
    some = words.join(near, "word", "left")
    fits = -F.col("m.o") >= times * F.col("n")
    told = stage(some.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("m.form")).alias("form"),
                             F.when(fits, -F.col("m.o")).alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

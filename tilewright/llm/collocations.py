"""Collocations: phrases of two to four words that occur together more often than their parts would let one expect.

1. Every shard of texts (a chunk of one task) becomes a count transducer per language: the windows of four words that begin at
   each word, sorted, as a weighted acyclic automaton whose arcs say how often a phrase begins there.
2. The space of paths is cut into prefix ranges of about equal weight.  Each shard's automaton is cut at the same places, and
   a range's parts are united, weights added.  A frequent first word, pair or triple spreads over several ranges; what
   a cut divides is added up afterwards.
3. Phrases that occur often enough are looked up part by part: the paths of all first parts and of all rests are composed
   with the counted paths, which is an equi-join on language and labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tilewright.llm import transducer as T
from tilewright.llm.stages import over_batches, stage
from tilewright.llm.words import chunks, mix, word_hashes, word_spans

SHARD = 1 << 22         # bytes of text in one shard
RANGE_WINDOWS = 1 << 20  # windows in one range, about
MOST_RANGES = 1 << 20    # cut points are held by the driver and every task: 8 MB at most; beyond, ranges grow
SAMPLE = 1 / 32          # rows read to place the cuts, which decide balance only
_EVERY = 16
_SLICES = 64
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_ENDS] = 0x20
_BITS = (9, 18, 12, 12, 12)  # of the language and the four words in a path's place


def _windows(data: np.ndarray, at: np.ndarray):
    """Lower-cased bytes, starts and ends of words, their text, and for each word the number of words up to the end of its piece, at most DEPTH."""
    plain = _PLAIN[data]
    starts, ends, first = word_spans(plain, at)
    owner = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    piece = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts]
    joined = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
    left = np.ones(len(starts), np.int64)
    for _ in range(T.DEPTH - 1):
        left[:-1] = np.where(joined, np.minimum(left[1:] + 1, T.DEPTH), 1)
    return plain, starts, ends, owner, left


def _hash_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def _places(lang: np.uint64, hashes: np.ndarray, paths: np.ndarray, fill: int = 0) -> np.ndarray:
    """Where paths lie in the space that is cut into ranges: leading bits of language and words.  hashes[0] is 0, the end.

    `fill` 1 gives the last place of all paths that begin with the given labels (-1: any label).
    """
    out = np.full(len(paths), lang >> np.uint64(64 - _BITS[0]), np.uint64)
    for d, bits in enumerate(_BITS[1:]):
        own = hashes[paths[:, d]] >> np.uint64(64 - bits) if d < paths.shape[1] else np.full(len(paths), (1 << bits) - 1 if fill else 0, np.uint64)
        out = (out << np.uint64(bits)) | own
    return out.astype(np.int64)


def _shards(batch):
    """For each chunk and language: language, its hash, words, their hashes after a leading 0, sorted paths of labels, windows counted."""
    for rows, data, at in chunks(batch, "text", SHARD):
        plain, starts, ends, owner, left = _windows(data, at)
        if not len(starts):
            continue
        hashes = word_hashes(plain, starts, ends)
        names, where, label = np.unique(hashes, return_index=True, return_inverse=True)
        words = [plain[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        padded = np.concatenate([label + 1, np.zeros(T.DEPTH, np.int64)])
        langs = rows.column("lang").dictionary_encode()
        of = langs.indices.to_numpy()[owner]
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(of == code) if len(langs.dictionary) > 1 else np.arange(len(starts))
            if len(own):
                paths = np.stack([np.where(left[own] > d, padded[own + d], 0) for d in range(T.DEPTH)], axis=1)
                yield lang, _hash_of([lang.encode()])[0] if lang else np.uint64(0), words, np.concatenate([[np.uint64(0)], names]), paths


def _renumbered(paths: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Paths and words with only the words that the paths hold."""
    used, new = np.unique(np.concatenate([[0], paths.ravel()]), return_inverse=True)
    return new[1:].reshape(paths.shape), [words[i - 1] for i in used[1:].tolist()]


def range_cuts(docs: DataFrame) -> np.ndarray:
    """Places that cut the paths of all windows into ranges of about equal weight, from a sample of the rows."""
    def work(batches):
        for batch in batches:
            for _, lang, _, hashes, paths in _shards(batch):
                yield [np.sort(_places(lang, hashes, paths))[_EVERY // 2::_EVERY]]
    places = stage(over_batches(docs.sample(fraction=SAMPLE, seed=5), "place long", work), "places")
    windows = places.count() * _EVERY / SAMPLE
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_RANGES, max(least, math.ceil(windows / RANGE_WINDOWS)))
    found = places.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] if windows and n > 1 else None
    return np.unique(np.array(found or [], np.int64))


def shard_transducers(docs: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(lang, range, automaton) of every shard: its windows of one language and prefix range."""
    def work(batches):
        for batch in batches:
            for lang, place, words, hashes, paths in _shards(batch):
                own = np.searchsorted(cuts, _places(place, hashes, paths), "right")
                order = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
                out = []
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    part, kept = _renumbered(paths[order[lo:hi]], words)
                    automaton = T.build(part[T.sorted_rows(part)], np.ones(len(part), np.int64))
                    out.append((int(own[order[lo]]), T.to_bytes(automaton, kept)))
                yield [[lang] * len(out), [r for r, _ in out], [b for _, b in out]]
    return over_batches(docs, "lang string, range int, automaton binary", work)


def _united(lang: str, number: int, blobs: list[bytes], cuts: np.ndarray, least: int):
    """Counts of one range: phrases, their length and number; those below `least` only where a cut divides their paths."""
    label, words, parts = {}, [], []
    for blob in blobs:
        levels, own = T.from_bytes(blob)
        new = np.array([0, *(label.setdefault(w, len(label) + 1) for w in own)], np.int64)
        paths, weights = T.expand(levels)
        parts.append((new[paths], weights))
    words, levels = list(label), T.union(parts)
    hashes, place = np.concatenate([[np.uint64(0)], _hash_of(words)]), _hash_of([lang.encode()])[0] if lang else np.uint64(0)
    phrases, lengths, counts = [""], [0], [int(levels[0][1].sum())]
    above = []  # for each depth, the arc that an arc hangs from
    for d, (labels, weights, _) in enumerate(levels):
        above.append(np.repeat(np.arange(len(levels[d - 1][0])), levels[d - 1][2]) if d else None)
        some = np.flatnonzero(labels)
        path, arc = np.zeros((len(some), d + 1), np.int64), some
        for k in range(d, -1, -1):
            path[:, k] = levels[k][0][arc]
            arc = above[k][arc] if k else arc
        ends = [np.searchsorted(cuts, _places(place, hashes, path, fill), "right") for fill in (0, 1)]
        kept = np.flatnonzero((weights[some] >= least) | (ends[0] != ends[1]))
        phrases += [b" ".join(words[i - 1] for i in row).decode() for row in path[kept].tolist()]
        lengths += [d + 1] * len(kept)
        counts += weights[some[kept]].tolist()
    return [[lang] * len(counts), phrases, lengths, counts]


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to four words with f >= least, and as the phrase of no words the count of all words."""
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    cuts = range_cuts(docs)

    def work(batches):
        key, held = None, []
        for batch in batches:
            for number, lang, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (number, lang) and held:
                    yield _united(key[1], key[0], held, cuts, least)
                    held = []
                key = (number, lang)
                held.append(blob)
        if held:
            yield _united(key[1], key[0], held, cuts, least)

    dealt = shard_transducers(docs, cuts).select("range", "lang", "automaton").repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "lang")
    parts = over_batches(dealt, "lang string, phrase string, words int, f long", work)
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its `first` phrases of two to four words by score.

    Texts of `docs` (text, lang; others are not read) have A-Z lower-cased and are split at .,;:!? and 0x0A-0x0D into pieces, and
    those at spaces and tabs into words.  a is how often the phrase occurs inside pieces, overlaps included, at least `least`
    times; l and r are the counts of its two parts at the cut of lowest score floor(2000000 a / (l + r)), the earliest of equal
    ones; n is the number of all words of the language.  A phrase goes if its words lie inside a longer one of at most four
    words, itself kept or not, that occurs at least `least` times and in `share` hundredths of its cases or more.  Equal scores
    are ranked by a, then by the phrase's bytes.

    A null language is `und`, together with rows that say so; null and empty texts and texts of separators add nothing, a
    language of only such rows has no rows, repeated rows count each, texts are read whole, and an empty table gives an empty one.
    Arithmetic is on decimals.  Words are told apart by 64-bit hashes inside a shard and by their bytes between shards.
    """
    counts = stage(phrase_counts(docs, least), "phrases")
    list_of = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), list_of.alias("w"))
    cut = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = lambda name, n: counts.where("words BETWEEN 1 AND 3").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    weighed = cut.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).withColumn("score", score)
    lowest = weighed.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda lo: F.array_join(F.slice("w", lo, n), " "))))
    inside = candidates.where("words >= 3").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    taken = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~taken)
    by = (F.desc("m.score"), F.desc("a"), "phrase")
    # a language's first ones are among the first of each of its slices, so one task orders a bounded number of rows
    slices = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(_SLICES)))
    some = slices.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*by))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= first)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")


#: The same by counting every phrase in full.
COLLOCATION_SQL = """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w
 FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
spans AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM spots),
counts AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY 1),
cand AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words >= 2 AND f >= 30),
cuts AS (SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:words], ' ') AS rp
 FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)),
weighed AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts c
 JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp),
lowest AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_lengths AS (SELECT lang, w, words, a, unnest(range(2, words)) AS m FROM cand),
inner_places AS (SELECT lang, w, a, m, unnest(range(1, words - m + 2)) AS i FROM inner_lengths),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM inner_places GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
 WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

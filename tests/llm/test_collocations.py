"""Collocations against brute force and, on the given tables, against their SQL; count transducers against counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from harness import compare, connect
from tilewright.llm import collocations as C, transducer as T
from tilewright.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(rows, least=30, share=80, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in frequent.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= share * a for q, b in frequent.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, rank int, a int")
    return sorted(tuple(r) for r in C.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "hall", "a", "of", "é", "#tag", "x y"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? ", ";", "\x0b"]
    fixed = ["New York City Hall", "of a of a of a", "hall of"]
    make = lambda: "".join((rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed)) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    return [(make(), rng.choice(["en", "fr", None, "und"])) for _ in range(docs)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = result(spark, rows, least=8, first=40)
        assert got == brute(rows, least=8, first=40) and len(got) > 40


def test_small_ranges_and_shards(spark, monkeypatch):
    """Phrases whose paths several cuts divide are added up again; shards of every few texts are united."""
    rows = corpus(3, 200) + [("of a " * 3000, "en")]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x or "und" for _, x in rows]})
    places = np.unique(np.concatenate([C._places(lang, hashes, paths) for _, lang, _, hashes, paths in C._shards(batch)]))
    monkeypatch.setattr(C, "range_cuts", lambda docs: places[::9])
    monkeypatch.setattr(C, "SHARD", 400)
    assert result(spark, rows, least=12) == brute(rows, least=12)


def test_defined_cases(spark):
    rows = [(None, "en"), ("", "en"), (" ., \t\n", "de"), ("Go on go on " * 20000, None), ("a b c d e. " * 40, "und"), ("a b c d e. " * 40, "und")]
    got = result(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {"und"}
    assert result(spark, []) == [] and result(spark, [(None, None), ("", "en")]) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of some 10^13: 2,000,000 times that passes a long."""
    a = 9 * 10**12 + 7
    counts = [("en", "", 0, 3 * a), ("en", "x", 1, a + 5), ("en", "y", 1, a + 3), ("en", "x y", 2, a)]
    monkeypatch.setattr(C, "phrase_counts", lambda docs, least: spark.createDataFrame(counts, "lang string, phrase string, words int, f long"))
    assert result(spark, [("x", "en")]) == [("en", 1, "x y", a, a + 5, a + 3, 3 * a, 2000000 * a // (2 * a + 8))]


def test_given_tables_against_sql(spark):
    assert compare(spark, connect(SMALL), QUERIES["op13_phrase_collocations"], ORACLES["op13_phrase_collocations"], SMALL) == ""


def test_transducers():
    rng = np.random.default_rng(1)
    parts, total = [], Counter()
    for n in (0, 1, 5, 3000):
        paths = rng.integers(0, 4, (n, T.DEPTH))
        weights = rng.integers(1, 9, n)
        order = T.sorted_rows(paths)
        levels, words = T.from_bytes(T.to_bytes(T.build(paths[order], weights[order]), [b"a", b"", "é".encode()]))
        rows, sums = T.expand(levels)
        own = Counter()
        for p, w in zip(map(tuple, paths.tolist()), weights.tolist()):
            own[p] += w
        assert dict(zip(map(tuple, rows.tolist()), sums.tolist())) == own and words == [b"a", b"", "é".encode()]
        assert all(int(x[1].sum()) == weights.sum() for x in levels)
        parts.append((rows, sums))
        total += own
    rows, sums = T.expand(T.union(parts))
    assert dict(zip(map(tuple, rows.tolist()), sums.tolist())) == total
    wide = rng.integers(0, 1 << 20, (500, T.DEPTH)) % rng.choice([3, 1 << 20], (500, 1))
    assert wide[T.sorted_rows(wide)].tolist() == sorted(wide.tolist())

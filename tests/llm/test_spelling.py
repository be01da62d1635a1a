"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tilewright.llm import spelling

COLUMNS = "doc_id long, text string, word string, n long"


def brute(rows, least=5, times=5):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    form, count = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, words, size=5):
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(words)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 5, 30])
        for _ in range(3):
            i = rng.randrange(len(w))
            pool += [rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])] * rng.randint(1, 7)
    return [(d, " ".join(rng.choices(pool, k=size * len(pool)))) for d in range(4)]


def test_against_brute_force(spark):
    for seed, words in ((1, 12), (2, 40)):
        rows = corpus(seed, words)
        assert result(spark, rows) == brute(rows)


def test_repeated_letters_and_equal_prefixes(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "ababab", "bababa", "abababa", "cababab", "aababab"]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(5 * 5 ** (k % 3))))]
    assert result(spark, rows) == brute(rows)


def test_defined_cases(spark):
    long = "Straße" * 3000
    rows = [(None, "Colour colour COLOUR colour, colour"), (None, None), (2, ""), (2, "... 12 世界"), (3, f"{long} " * 5),
            (4, "colour " * 30), (4, "colour " * 30), (5, "color1colours× " * 5 + "Ärger-ärger " * 9)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        result(spark, [], letters=3)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 26 + ["abcdhg"] * 140 + ["abcihg"] * 800 + ["zbcdef"] * 26))]
    got = {r[0]: r for r in result(spark, rows)}
    assert got["abcdef"][1:3] == ("abcdeg", "abcihg") and got["abcihg"][1:3] == (None, "abcihg")  # equal n: the smaller word
    assert result(spark, rows) == brute(rows)


def test_pivots_do_not_overlap_and_are_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randint(6, 12)))
        ranks = {a + b: r for r, (a, b) in enumerate(sorted(((a, b) for a in "abcdef" for b in "abcdef"), key=lambda _: rng.random()))}
        prefix, last = spelling.prefix_of(word, ranks)
        cost = dict(prefix)
        pairs = [(cost[i] + cost[j], (i, j)) for i in cost for j in cost if j >= i + 2]
        assert min(pairs)[1] == tuple(spelling.pivots_of(prefix)) and max(cost.values()) == last and len(prefix) >= 3


def test_checksum_is_of_id_and_run():
    hit = next(d for d in range(10000) if zlib.crc32(f"{d}:received".encode()) % 199 == 0)
    k = zlib.crc32(f"{hit}:received".encode()) % 8
    assert spelling.spelled(hit, "received") == "received"[:k] + "received"[k + 1:] and spelling.spelled(None, "x") == "x"

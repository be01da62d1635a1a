"""URL filters, licence scan, quality ranking, token counts, top-k, rules and mixing against plain computations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tilewright.llm import licences, mixing, nearest, ranking, rules, separators, urls
from test_packing import ODD, whole

L, S, I = T.LongType(), T.StringType(), T.IntegerType()
schema = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
DOCS = schema(doc_id=L, text=S, source=S, n_words=S)
SF = "/root/testdata/sf0.01"


def test_urls_rules_and_odd_rows(spark):
    given = {"http://A.Example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
             "x://net/es/?a": ("net", "/es/", "net/es/", "block"), "http://b.net/es": ("b.net", "/es", None, "allow"), "http://foo.com": ("foo.com", "", None, "allow"),
             "http://foo.com?u=/": ("foo.com", "", None, "allow"), "http://foo.com/": ("foo.com", "/", "com/", "allow"), "http://xcom/": ("xcom", "/", None, "allow"),
             "no scheme/com/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c.net/fr/": ("b:", "//c.net/fr/", None, "allow"),
             "http://É.COM/ü#x": ("É.com", "/ü", "com/", "allow")}
    rows = [(i, u, None, "h") for i, u in enumerate(given)] + [(0, "http://A.Example.com/en/x", None, "h"), (None, "http://net/fr/1", "<a href='//'>", None)]
    df = spark.createDataFrame(rows, schema(page_id=L, url=S, html=S, host=S))
    got = [tuple(r) for r in urls.judged(df).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = [(i, *v) for i, v in enumerate(given.values())] + [(0, *given["http://A.Example.com/en/x"]), (None, "net", "/fr/1", "net/fr/", "block")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert urls.judged(spark.createDataFrame([], df.schema)).collect() == []


def page_rank(edges, seeds, damping=0.85):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(200):
        lost = sum(v for h, v in score.items() if h not in out)
        new = {h: s * (1 - damping + damping * lost) for h, s in seeds.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + damping * score.get(a, 0) * w / out[a]
        score = new
    return score


def test_urls_link_graph(spark):
    rng = random.Random(3)
    hosts = [f"g{i}.com" for i in range(6)] + [f"n{i}.org" for i in range(12)] + [f"b{i}.net" for i in range(4)]
    rows, count = [], Counter()
    for i in range(160):
        src = rng.choice(hosts)
        near = [h for h in hosts if h[-3:] != ("net" if src[0] == "g" else "com")]
        links = [hosts[-1]] * 6 if src in ("n1.org", "n2.org") else [rng.choice([h for h in near if h not in ("n1.org", "n2.org", hosts[-1])]) for _ in range(rng.randrange(4))]
        rows.append((i, f"http://{src}/" + ("fr/" if src.startswith("b") else "p"), " ".join(rng.choice([f'<a href="http://{h}/x">', f"<IMG SRC='//{h.upper()}?q'>", f"<a href=https://{h}>"]) for h in links)))
        count.update((src, h) for h in links if h != src)
    got = {r.host: r for r in urls.judged(spark.createDataFrame(rows, schema(page_id=L, url=S, html=S))).collect()}
    pages = Counter(re.match(r"http://([^/]*)", r[1])[1] for r in rows)
    seeds = lambda p: {h: n / sum(v for k, v in pages.items() if k.startswith(p)) for h, n in pages.items() if h.startswith(p)}
    trust, bad = page_rank(count, seeds("g")), page_rank({(b, a): n / sum(v for (x, y), v in count.items() if x == a) for (a, b), n in count.items()}, seeds("b"))
    for h, r in got.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=1e-5) and r.distrust == pytest.approx(bad.get(h, 0), abs=1e-5)
        own = {"g": "allow", "b": "block"}.get(h[0]) or ("block" if bad.get(h, 0) > max(trust.get(h, 0), 0.2 / len(pages)) else "allow")
        assert r.verdict == own
    assert {r.verdict for h, r in got.items() if h in ("n1.org", "n2.org")} == {"block"} and "allow" in {r.verdict for h, r in got.items() if h[0] == "n"}


def test_licences(spark):
    lines = {"Released under the MIT License.": "mit", "this file is licensed under the apache license, version 2.0 (the license)": "apache", "All rights reserved.": "reserved",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "LICENSED UNDER CC BY-SA 4.0": "cc-by-sa",
             "we met under the bridge and all of the lights were on": None, "his license was taken in general": None, "the rights of all": None, "x " * 3000: None, "": None}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mine = [(10 ** 6 + i, f"first line\n{t}\nlast", None, None) for i, t in enumerate(lines)] + [(None, None, None, None), (5 * 10 ** 6, "", None, None)]
    got = licences.scanned(docs.union(spark.createDataFrame(mine, DOCS).select("doc_id", "text"))).collect()
    assert {(r.doc_id - 10 ** 6, r.line, r.family) for r in got if r.doc_id >= 10 ** 6} == {(i, 1, f) for i, f in enumerate(lines.values()) if f}
    told = re.compile(r"licensed under|released under the|all rights reserved", re.I)
    want = {(r.doc_id, i) for r in docs.collect() for i, x in enumerate(r.text.split("\n")) if told.search(x)}
    assert {(r.doc_id, r.line) for r in got if r.doc_id < 10 ** 6} == want
    assert licences.scanned(spark.createDataFrame([], DOCS)).collect() == []


def test_background_is_the_lines_of_least_hash(spark):
    rows = [(i, f"line {i % 700} of many\nthe same line in every text\n \n") for i in range(3000)] + [(None, None), (-1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lines = docs.selectExpr("explode(split(text, '\n')) AS line").where("trim(line) <> ''").selectExpr("line", "xxhash64(line) AS h")
    least = [r.line for r in sorted(lines.collect(), key=lambda r: (r.h, r.line))]
    for wanted in (0, 1, 5, 400, 6000, 9000):
        assert licences._background(docs, wanted) == least[:wanted]
    assert licences._background(docs.limit(0), 5) == []


def test_licences_wrapped_embedded_and_several(spark):
    rng = random.Random(3)
    plain = "the old harbour lies north of three towns that met every spring to trade salt and wool for grain".split()
    words = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    cases = [("This work is licensed under the\nGNU General Public License, version 3", {(0, "gpl")}),
             (f"{words(40)}\n{words(3)} Released under\nthe MIT License {words(60)}", {(1, "mit")}),
             (f"{words(400)} Licensed under the Apache License, Version 2.0 {words(500)}", {(0, "apache")}),
             ("Licensed under the MIT license and\nthe Apache License, Version 2.0", {(0, "mit"), (0, "apache")}),
             (f"Released under the MIT License. {words(70)} All rights reserved. {words(30)}", {(0, "mit"), (0, "reserved")}),
             (f"{words(30)} This work is licensed under the\n\nGNU {words(30)}", set()), (words(2000), set()),
             ("Licensed under the GNU Lesser General Public License, version 2", {(0, "lgpl")}), ("Licensed under CC BY-NC 4.0\nx", {(0, "cc-by-nc")})]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mine = spark.createDataFrame([(10 ** 6 + i, t, None, None) for i, (t, _) in enumerate(cases)], DOCS).select("doc_id", "text")
    got = [r for r in licences.scanned(docs.union(mine)).collect() if r.doc_id >= 10 ** 6]
    for i, (text, want) in enumerate(cases):
        assert {(r.line, r.family) for r in got if r.doc_id == 10 ** 6 + i} == want, text[:200]
    assert len(got) == sum(len(w) for _, w in cases) and all(r.text in cases[r.doc_id - 10 ** 6][0] for r in got)


def test_ranking_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10 ** 7, None, None, None), (10 ** 7 + 1, "", None, None), (None, "x", None, None), (0, "again", None, None)], DOCS).select("doc_id", "text")
    got = ranking.scored(docs.select("doc_id", "text").union(odd), labels.selectExpr("doc_id", "quality", "toxic AS text")).collect()
    assert len(got) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97
    assert ranking.scored(docs.where("false"), labels.where("false")).collect() == []


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_token_counts(spark, block):
    texts = [*ODD, None, "word " * 400, "a"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(1, " ", None, None), (None, "no id", None, None)]
    got = separators.document_tokens(spark.createDataFrame(rows, DOCS).repartition(3), block=block).collect()
    want = [(i, len([x for x in whole(t)[:-1] if x != separators.END])) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    flat = np.array([1, 2, 50256, 50256, 3, 4, 5, 50256, 6], np.uint16)
    files = [("f", i, flat[i * 2:i * 2 + 2].tobytes()) for i in range(5)] + [("g", 0, None), ("h", 0, b"")]
    found = separators.counted(spark.createDataFrame(files, schema(file=S, block=L, ids=T.BinaryType()))).collect()
    assert sorted(map(tuple, found)) == [("f", 0, 0, 2, True), ("f", 1, 3, 0, True), ("f", 2, 4, 3, True), ("f", 3, 8, 1, False)]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(50, [1.0] * 6), (7, None), (8, [1.0, None] * 3), (9, [float("nan")] * 6), (100, [0.5, 0.25]), (3, [2.0, 1.0]), (None, [1.0] * 6), (150, [])]
    rows += [(401 + i, rows[1][1]) for i in range(7)]
    df = spark.createDataFrame(rows, schema(vec_id=L, embedding=T.ArrayType(T.DoubleType())))
    got = defaultdict(list)
    for r in nearest.top_k(df, block=64, queries=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    good = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in {i for i, _ in good if i % 50 == 0}:
        asked = [v for i, v in good if i == q]
        if len(asked) == 1 and asked[0]:
            want = sorted(((-sum(a * b for a, b in zip(asked[0], v)), i) for i, v in good if i != q and len(v) == len(asked[0])))[:5]
            assert got[q] == [(-s, i) for s, i in want]
    assert nearest.top_k(df.where("false")).collect() == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    size = lambda i: 10.0 ** rng.integers(-2, 9) if i < 250 else 2.0 ** rng.choice([0, 18, 19.99, 27, 60, 1000])
    rows = [(i, [float(x) for x in rng.normal(size=5) * size(i)]) for i in range(300)]
    rows += [(300 + i, [2.0 ** 21, -2.0 ** 21 - i % 3 / 256, 0.5, 1e300 if i == 4 else 0.0, -1e-9]) for i in range(7)] + [(350, [float("inf")] * 5), (351, [2.0 ** 20] * 5)]
    rows += [(1000 + i, [2.0 ** 19 + i % 2 / 256] * 200) for i in range(60)]  # 200 products that no long holds together
    got = defaultdict(list)
    for r in nearest.top_k(spark.createDataFrame(rows, schema(vec_id=L, embedding=T.ArrayType(T.DoubleType()))), block=64, queries=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    floors = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows if i != 350}
    for q in (i for i in floors if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(floors[q], v)), i) for i, v in floors.items() if i != q and len(v) == len(floors[q]))[:5]
        assert got[q] == [(-s if -2 ** 63 <= -s < 2 ** 63 else None, i) for s, i in want]


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_rules_and_mixing_edges(spark):
    rng = random.Random(9)
    texts = ["", None, " \x0b\x0c\r\n\t", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "é# # 日本 a\u00a0b \u2003 c", "w " * 5000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(120))) + "\n" + "the of " * rng.randrange(30) for _ in range(60)]
    rows = [(i, t, None if i % 5 == 0 else f"é{i % 4}" if i % 3 else f"z{i % 2}", "x") for i, t in enumerate(texts)] + [(3, "a b", "é1", "x"), (None, "no id here", "only", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = rules.judged(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain_rules(t)) for i, t, _, _ in rows], key=str)
    assert rules.kept_documents(df).columns == df.columns
    for bucket in (5, 50_000):
        mix = mixing.mixed(df, bucket_rows=bucket).collect()
        assert len(mix) == len(rows)
        size, target, taken, each = Counter(), {}, Counter(), {}
        for r in mix:
            size[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source], each[r.source] = r.target, r.source_size
            assert 0 <= r.taken <= 3 * r["size"]
        assert size == Counter(each) and all(taken[s] == int(target[s]) for s in target)
        order = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        free, left, want = set(order), sum(size.values()), {}
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * size[s]}
            if not over:
                break
            want.update({s: 3 * size[s] for s in over})
            left -= sum(3 * size[s] for s in over)
            free -= over
        want.update(share)
        assert target == pytest.approx(want)
    assert mixing.mixed(df.where("false")).collect() == [] and rules.judged(df.where("false")).collect() == []

"""Packing: pieces against ids encoded whole, gapless sequences, and few of them."""

import random
import struct
import zlib
from collections import defaultdict

from pyspark.sql import types as T
from tokenizers import Tokenizer

from tilewright.llm.packing import best_fit, packed
from tilewright.llm.tokens import Encoder, tokenizer_file

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType())])
ODD = ["", " ", "  a", "a  b", "a   b ", "x \n y", "x\n \ny", "a   b", "it's  <|endoftext|>  so", "é　 　ü", "tab\t tab", "don't we'll ,  no", "\n\n a\n\n b \n", "end   ", "日本 語 12 345"]


TOKENIZER = Tokenizer.from_file(tokenizer_file())


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def test_stretches_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice([" ", "  ", "a", "the", "\n", "'s", "9", ".", "é", "\t", " "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([*range(9, 14), *range(32, 0x17F), 0x2019, 0x2026, 0x20AC])) for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) + [0] for b in Encoder.of(tokenizer_file()).encode(texts)] == [whole(t) for t in texts]


def test_pieces_and_places(spark):
    rng = random.Random(2)
    texts = [*ODD, None, "word " * 5000, "z " * 2047, "z " * 2046 + "z"] + [" ".join(f"v{rng.randrange(999)}" for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "no id", "x")]
    got = packed(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = sorted((str(i), k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, t, _ in rows for ids in [whole(t)]
                  for edges in [[0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]]
                  for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_best_fit_and_empty(spark):
    import numpy as np
    assert best_fit(np.array([5, 5, 3, 7]), 10).tolist() == [1, 1, 0, 0]
    assert packed(spark.createDataFrame([], SCHEMA)).collect() == []

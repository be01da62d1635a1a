"""Token ids of whole texts by a byte-level BPE file, learning the ids of each space-separated stretch only once.

The pre-tokenizer of such files never joins what stands before a single space with what follows it, so a text's ids are those
of its stretches, each with its leading space.  Texts where white space surrounds a space, or that hold a special token's
string, are encoded whole.  Stretches of Latin letters, digits and common signs, on which both libraries agree, are encoded
by the faster of two with the same vocabulary; all others by the tokenizer file itself.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

_AROUND = re.compile(r"\s \s")
_COMMON = re.compile("[\\t\\n\\r -~¡-¬®-ſ‐-‧€]*")
KEPT = 300_000  # stretches that one Python worker remembers before it starts anew


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian 32-bit words.  One for each Python worker and file."""

    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # ids of a space and the stretch
        self.first: dict[str, bytes] = {}  # ids of a stretch that begins a text
        ranks, self.fast = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], known: dict[str, bytes], before: str) -> None:
        rest = []
        for s in new:
            if self.fast and _COMMON.fullmatch(s):
                known[s] = array("I", self.fast.encode_ordinary(before + s)).tobytes()
            else:
                rest.append(s)
        known.update(zip(rest, self._ids([before + s for s in rest])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) + len(self.first) > KEPT:
            self.known, self.first = {}, {}
        out: list[bytes] = [b""] * len(texts)
        cut, whole, new, heads = [], [], set(), set()
        for i, text in enumerate(texts):
            if text:
                if _AROUND.search(text) or any(s in text for s in self.special):
                    whole.append(i)
                else:
                    parts = text.split(" ")
                    head = parts.pop(0)
                    heads.add(head)
                    new.update(set(parts).difference(self.known))
                    cut.append((i, head, parts))
        self._learn(list(new), self.known, " ")
        self._learn([s for s in heads if s not in self.first], self.first, "")
        for i, head, parts in cut:
            out[i] = self.first[head] + b"".join(map(self.known.__getitem__, parts))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out

"""Token ids of a lower-casing word BPE vocabulary file, fast where words repeat.

Ids are those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``. White space
never joins two tokens of such a vocabulary, so a text's ids are those of its words one after another, and words are kept
with their ids. New words are merged all at once by the ranks of the same file. Texts with characters whose normal form or case
depends on more than themselves, controls, or special tokens go through ``tokenizers`` whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex
import tiktoken

#: Words that a tokenizer keeps, in two generations.
KEPT = 400_000
#: Fixed value: how this kind of vocabulary splits words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_OTHER = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞€]|<\\|")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters, suffix = _byte_letters(), spec["model"]["end_of_word_suffix"]
        ranks, size = {}, max(spec["model"]["vocab"].values()) + 1
        self._ends = np.zeros(size, bool)
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            end = token.endswith(suffix)
            # A space ends each word below; no word holds one.
            ranks[bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + b" " * end] = i
            self._ends[i] = end
        self._bpe = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        parts = [SPLIT.findall(w.lower()) for w in words]
        ids = np.array(self._bpe.encode_ordinary("".join(" ".join(p) + " " for p in parts if p)), "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        at = ends[np.cumsum([0, *(len(p) for p in parts)])]
        data = ids.tobytes()
        for w, a, b in zip(words, at.tolist(), at[1:].tolist()):
            self._new[w] = data[4 * a : 4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if _OTHER.search(t) else t.split() for t in texts]
        missing = set().union(*(w for w in split if w)).difference(self._new)
        found = {w: self._old[w] for w in missing if w in self._old}
        if len(self._new) + len(missing) > KEPT:
            needed = set().union(*(w for w in split if w)) - missing
            self._old, self._new = self._new, {w: self._new[w] for w in needed}
        self._new.update(found)
        if rest := [w for w in missing if w not in found]:
            self._learn(rest)
        get = self._new.__getitem__
        return [np.array(self._plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]


def load(path: str) -> WordTokenizer:
    """A tokenizer without words yet. The process keeps none: Python workers outlive their task and would hold its words beside later stages."""
    return WordTokenizer(path)

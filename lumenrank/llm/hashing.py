"""Hashes of words and word shingles over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", inv)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _powers[:n], _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs of bytes other than white space, A-Z lower-cased) and each text's first word, with an end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    data = LOWER[data]
    letter = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, starts)


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence; none without words."""
    h, at = word_hashes(texts)
    salt = [U(int(x)) for x in mix(np.arange(1, k + 1, dtype=np.uint64) * U(_BASE)) | U(1)]
    n = len(h) - k + 1
    full = h[:0]
    if n > 0:
        full = h[:n] * salt[0]
        for j in range(1, k):
            full = full + h[j : j + n] * salt[j]
        full = mix(full)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            s = np.array([(b - a) * 0x1234567], np.uint64)
            for j in range(b - a):
                s = s + h[a + j : a + j + 1] * salt[j]
            out.append(mix(s))
        else:
            out.append(h[:0])
    return out

"""Repeated passages by a distributed merge sort of suffixes that never re-compares known prefixes.

A byte goes if a ``WINDOW``-byte string that covers it also starts in a document with a smaller id. Each such string holds one
anchor, the gram of ``GRAM`` bytes with the least hash in it (by 32 bits; the leftmost of equals), so equal strings have equal anchors at equal offsets.

1. Documents ask, for the hash of each of their anchors, whether another document has it too.
2. Documents that share anchors form sorted runs of suffixes that start at them: the text from the anchor on, and the
   text before it read backwards. Equal contexts of a run become one entry of their least document; the others are settled.
   Runs are front-coded, dealt out by the gram, and merged by loser trees that compare common-prefix lengths first and
   characters only beyond them. Prefix classes of the two merged orders then tell, for every offset, which windows are equal, and the
   least document of each.
3. Removed windows go back to their documents.

An anchor in ``HOT`` documents or more is cut into its windows, each an entry of its own dealt out by its whole string,
so that a passage shared by any part of the documents never meets in one task; within a task its windows have become one entry each before.
A false match of the hashes in 1 costs work, never a wrong result.

Null text counts as empty. Texts under 50 bytes keep all bytes. Rows that repeat an id do not remove from each other and each get a row; a null
id neither removes nor loses anything. Other columns are not read. No documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import BYTE, U, mix, powers

WINDOW, GRAM = 50, 24
LEFT = WINDOW - GRAM
HOT = 1024
CHUNK = 1 << 20
#: Text of a bucket, about.
BUCKET_BYTES = 16 << 20
FILL = 0xFF  # no UTF-8 text has this byte


def anchors(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts in one array (where each starts, and its size): text number, anchor, first and last window of each anchor, and its hash."""
    none = np.zeros(0, np.int64)
    n = np.maximum(0, size - WINDOW + 1)
    if not n.sum():
        return none, none, none, none, none.astype(np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    low, at = (h >> U(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32)
    width = 1
    while width < LEFT + 1:
        step = min(width, LEFT + 1 - width)
        first = low[:-step] <= low[step:]
        low, at = np.where(first, low[:-step], low[step:]), np.where(first, at[:-step], at[step:])
        width += step
    p = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    q = at[p].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    last = np.concatenate([new[1:], [len(p)]]) - 1
    q = q[new]
    return np.searchsorted(starts, q, side="right") - 1, q, p[new], p[last], h[q]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array with a gap of filling bytes around each, where each starts, and sizes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes([FILL]) * WINDOW
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(gap + b"".join(r + gap for r in raw), np.uint8), WINDOW + np.cumsum(size + WINDOW) - size - WINDOW, size


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a hash; the bucket in the high half."""
    return (((h >> U(32)) % U(buckets)) << U(32) | (h & U(0xFFFFFFFF))).astype(np.int64)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, int] = {}
        for batch in common.slices(batches, "text", CHUNK):
            t, _, _, _, h = anchors(*_laid(common.texts(batch, "text")))
            ids = batch.column("doc_id").to_numpy()
            key = _key(h, buckets)
            order = np.lexsort((key, t))
            t, key = t[order], key[order]
            once = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[: len(t)]
            t, key = t[once], key[once]
            # Anchors common here already: only the first HOT documents ask, the others know the answer.
            value, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            known = np.zeros(len(key), bool)
            for v in np.flatnonzero(count >= 8):
                at = np.flatnonzero(inverse == v)
                had = asked.get(int(value[v]), 0)
                known[at[max(0, HOT - had) :]] = True
                asked[int(value[v])] = had + len(at)
            out: list[tuple] = []
            mine = common_bucket(ids, buckets)
            if known.any():
                for b in np.unique(mine[t[known]]):
                    at = known & (mine[t] == b)
                    out.append((int(b), True, *_answered(ids[t[at]], key[at] << 1 | 1)))
            t, key = t[~known], key[~known]
            order = np.argsort(key >> 32, kind="stable")
            t, key = t[order], key[order]
            cut = np.searchsorted(key >> 32, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                at = slice(cut[b], cut[b + 1])
                who, n = t[at], key[at].astype(np.uint32)
                head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                packed = np.concatenate([ids[who[head]], np.diff(np.concatenate([head, [len(who)]]))]).astype(np.int64)
                out.append((int(b), False, packed.tobytes(), n.tobytes()))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["bucket", "known", "docs", "keys"])

    return run


def common_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A document's bucket. ``buckets`` is prime, so regular ids spread evenly; SQL's pmod gives the same."""
    return np.mod(ids.astype(np.int64), buckets)


def _answered(docs: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Answers in little space: each document with how many it gets, then their keys by size as differences, compressed."""
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    head = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    packed = np.concatenate([docs[head], np.diff(np.concatenate([head, [len(docs)]]))]).astype(np.int64)
    planes = np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T  # equal bytes side by side
    return packed.tobytes(), zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _read_answers(docs: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = np.frombuffer(docs, np.int64)
    d = np.repeat(d[: len(d) // 2], d[len(d) // 2 :])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(keys), np.uint8).reshape(8, -1)
    return d, np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _answer(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Asking documents whose anchor another one has: rows (bucket of the documents, ids, key << 1 | hot)."""
        docs, keys = [], []
        out: list[tuple] = []
        bucket = table.column("bucket")[0].as_py()
        for known, d, k in zip(table.column("known").to_pylist(), table.column("docs"), table.column("keys")):
            if known:
                out.append((bucket, d.as_py(), k.as_py()))
                continue
            d = np.frombuffer(d.as_buffer(), np.int64)
            docs.append(np.repeat(d[: len(d) // 2], d[len(d) // 2 :]))
            keys.append(np.frombuffer(k.as_buffer(), np.uint32))
        if keys:
            docs, keys = np.concatenate(docs), np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            docs, keys = docs[order], keys[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.concatenate([head, [len(keys)]]))
            size = np.repeat(size, size)
            at = size > 1
            docs, value = docs[at], ((np.int64(bucket) << 32 | keys[at].astype(np.int64)) << 1) | (size[at] >= HOT)
            mine = common_bucket(docs, buckets)
            order = np.argsort(mine, kind="stable")
            docs, value, mine = docs[order], value[order], mine[order]
            cut = np.searchsorted(mine, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                out.append((int(b), *_answered(docs[cut[b] : cut[b + 1]], value[cut[b] : cut[b + 1]])))
        cols = zip(*out) if out else [[]] * 3
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "docs", "keys"])

    return run


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common-prefix lengths of sorted byte rows with the row before, and what follows the prefixes, end to end."""
    same = np.zeros(rows.shape, bool)
    same[1:] = rows[1:] == rows[:-1]
    lcp = np.where(same.all(1), rows.shape[1], (~same).argmax(1)).astype(np.uint8)
    return lcp, rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width)[None, :] >= lcp[:, None]
    rows = np.zeros((len(lcp), width), np.uint8)
    rows[own] = rest
    source = np.maximum.accumulate(np.where(own, np.arange(len(lcp))[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, 0)


def words(rows: np.ndarray) -> list[int]:
    """Byte rows as big-endian words of eight bytes, which compare as the bytes do, one row after the other."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").ravel().tolist()


def merge(runs: list[tuple[list[int], list[int]]], width: int) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs of (strings as words, common-prefix lengths with the string before); ``width`` bytes each.

    Returns run, place and common-prefix length with the one before, in merged order. Two candidates are told apart by their prefix
    lengths with the last winner; only if these are equal are words compared, from the one where the prefix ends.
    """
    k = len(runs)
    strings, prefixes = [r[0] for r in runs], [r[1] for r in runs]
    ends, place = [len(p) for p in prefixes], [0] * k
    lead = [0 if n else -1 for n in ends]  # prefix length with the last winner; -1: the run is over
    n = -(-width // 8)
    now = [0] * k  # where the present string's words begin
    tree = [-1] * k
    out_run, out_place, out_lcp = [], [], []

    def better(a: int, b: int) -> bool:
        """Whether run a's string comes before run b's of equal ``lead``; the loser's becomes its prefix length with the winner."""
        x = lead[a]
        if x < 0:
            return a < b
        s, t, f, g = strings[a], strings[b], now[a], now[b]
        i = x >> 3
        while i < n:
            p, q = s[f + i], t[g + i]
            if p != q:
                m = (i << 3) + 8 - (((p ^ q).bit_length() + 7) >> 3)
                if p < q:
                    lead[b] = m
                    return True
                lead[a] = m
                return False
            i += 1
        lead[b if a < b else a] = width
        return a < b

    winner = -1
    for leaf in range(k):
        w, node = leaf, (leaf + k) >> 1
        while node:
            other = tree[node]
            if other < 0:
                tree[node] = w
                w = -1
                break
            if lead[other] > lead[w] or (lead[other] == lead[w] and better(other, w)):
                tree[node], w = w, other
            node >>= 1
        if w >= 0:
            winner = w
    add_run, add_place, add_lcp = out_run.append, out_place.append, out_lcp.append
    while winner >= 0 and lead[winner] >= 0:
        at = place[winner]
        add_run(winner)
        add_place(at)
        add_lcp(lead[winner])
        at += 1
        place[winner] = at
        if at < ends[winner]:
            x = lead[winner] = prefixes[winner][at]
            now[winner] += n
        else:
            x = lead[winner] = -1
        w, node = winner, (winner + k) >> 1
        while node:
            other = tree[node]
            y = lead[other]
            if y > x:
                tree[node], w, x = w, other, y
            elif y == x and better(other, w):
                tree[node], w = w, other
            node >>= 1
        winner = w
    return out_run, out_place, out_lcp


#: A run of entries: for each its document, mask, how often it occurs and where; both orders front-coded; all in one compressed value.
PARTS = (("docs", np.int64), ("masks", np.int32), ("times", np.int32), ("spots", np.int32), ("lcp_r", np.uint8), ("rest_r", np.uint8), ("to_r", np.int32), ("lcp_l", np.uint8), ("rest_l", np.uint8))


def pack_run(**parts) -> bytes:
    data = [np.ascontiguousarray(parts.get(name, ()), kind).tobytes() if not isinstance(parts.get(name), bytes) else parts[name] for name, kind in PARTS]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in data], np.int64).tobytes() + b"".join(data))


def unpack_run(packed: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    sizes = np.frombuffer(data[: 8 * len(PARTS)], np.int64)
    ends = 8 * len(PARTS) + np.cumsum(sizes)
    return {name: np.frombuffer(data[e - n : e], kind) for (name, kind), n, e in zip(PARTS, sizes.tolist(), ends.tolist())}


def _form_runs(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            said_docs, said = (np.concatenate(c) for c in zip(*(_read_answers(d.as_py(), k.as_py()) for d, k in zip(right.column("docs"), right.column("keys")))))
            order = np.lexsort((said, said_docs))
            said_docs, said = said_docs[order], said[order]
            left = left.take(pa.array(np.argsort(left.column("doc_id").to_numpy(), kind="stable")))
            texts = left.filter(pa.array(np.isin(left.column("doc_id").to_numpy(), said_docs)))
            parts = [_occurrences(b, said_docs, said, buckets) for b in common.slices(iter(texts.combine_chunks().to_batches()), "text", CHUNK)]
            if parts := [p for p in parts if len(p[0])]:
                out = _entries(*(np.concatenate(c) for c in zip(*parts)), buckets)
        cols = zip(*out) if out else [[]] * 2
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.binary()))], names=["bucket", "run"])

    return run


def _pair(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64)) + keys.view(np.uint64) * U(0x9E3779B97F4A7C15)


def _occurrences(batch: pa.RecordBatch, said_docs: np.ndarray, said: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Rows of the text from an anchor on and before it, document, place in it, mask of offsets, and where to."""
    data, starts, size = _laid(common.texts(batch, "text"))
    ids = batch.column("doc_id").to_numpy()
    t, q, a, b, h = anchors(data, starts, size)
    value = _key(h, buckets) << 1
    near = slice(np.searchsorted(said_docs, ids.min()), np.searchsorted(said_docs, ids.max(), side="right"))
    told = _pair(said_docs[near], said[near])
    keep = np.isin(_pair(ids[t], value), told) + 2 * np.isin(_pair(ids[t], value | 1), told)
    at, hot = np.flatnonzero(keep == 1), np.flatnonzero(keep >= 2)
    after = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    before = np.lib.stride_tricks.sliding_window_view(data, LEFT)
    cold = np.concatenate([after[q[at]], before[q[at] - LEFT][:, ::-1]], 1)
    first, last = q[at] - b[at], q[at] - a[at]
    place = np.arange(WINDOW + LEFT)[None, :]
    cold[(place >= WINDOW - first[:, None]) & (place < WINDOW) | (place >= WINDOW + last[:, None])] = FILL  # no window of this anchor goes further
    mask = (np.int64(1) << (last + 1)) - (np.int64(1) << first)
    to = (h[at] >> U(32)) % U(buckets)
    n = b[hot] - a[hot] + 1
    p = np.repeat(a[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hot) else np.zeros(0, np.int64)
    tp = np.repeat(t[hot], n)
    single = after[p]
    weight = np.multiply.accumulate(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
    to_hot = mix((BYTE[single] * weight[None, :]).sum(1, dtype=np.uint64)) % U(buckets) if len(p) else np.zeros(0, np.uint64)
    rows = np.concatenate([cold, np.concatenate([single, np.full((len(p), LEFT), FILL, np.uint8)], 1)])
    return rows, np.concatenate([ids[t[at]], ids[tp]]), np.concatenate([q[at] - starts[t[at]], p - starts[tp]]), np.concatenate([mask, np.ones(len(p), np.int64)]), np.concatenate([to, to_hot]).astype(np.int64)


def _entries(rows: np.ndarray, docs: np.ndarray, spots: np.ndarray, masks: np.ndarray, to: np.ndarray, buckets: int) -> list[tuple]:
    """Settled occurrences, and for each bucket a run of entries sorted and front-coded both ways."""
    order = np.lexsort((docs, np.ascontiguousarray(rows).view(f"S{WINDOW + LEFT}").ravel(), to))
    rows, docs, spots, masks, to = rows[order], docs[order], spots[order], masks[order], to[order]
    head = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1) | (to[1:] != to[:-1])])
    group = np.cumsum(head) - 1
    own = docs == docs[head][group]  # occurrences in the least document wait for the merge
    out: list[tuple] = []
    done = ~own
    home = common_bucket(docs, buckets)  # what is settled goes where its document is
    for b in np.unique(home[done]):
        at = done & (home == b)
        out.append((int(b), pack_run(docs=docs[at], masks=masks[at], spots=spots[at])))
    times = np.bincount(group[own], minlength=group[-1] + 1)
    waiting = spots[own].astype(np.int32)
    after = np.concatenate([[0], np.cumsum(times)])
    rows, docs, masks, to = rows[head], docs[head], masks[head], to[head]
    cut = np.searchsorted(to, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        at = slice(cut[b], cut[b + 1])
        r = rows[at]
        lcp_r, rest_r = front_code(r[:, :WINDOW])
        before = np.ascontiguousarray(r[:, WINDOW:])
        by_left = np.argsort(before.view(f"S{LEFT}").ravel(), kind="stable")
        lcp_l, rest_l = front_code(before[by_left])
        out.append((int(b), pack_run(docs=docs[at], masks=masks[at], times=times[at], spots=waiting[after[cut[b]] : after[cut[b + 1]]], lcp_r=lcp_r, rest_r=rest_r, to_r=by_left, lcp_l=lcp_l, rest_l=rest_l)))
    return out


def _merged(runs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    decoded = []
    for lcp, rest in runs:
        decoded.append((words(front_decode(lcp, rest, width)), lcp.tolist()))
    return tuple(np.array(c, np.int64) for c in merge(decoded, width))


def _judge(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Merges a bucket's runs; rows (bucket of the documents, ids, places, masks of removed windows)."""
        found_docs, found_spots, found_masks = [], [], []
        runs = []
        for packed in table.column("run"):
            r = unpack_run(packed.as_py())
            if len(r["lcp_r"]):
                runs.append(r)
            else:
                found_docs.append(r["docs"])
                found_spots.append(r["spots"])
                found_masks.append(r["masks"])
        if sum(len(r["docs"]) for r in runs) > 1:  # entries of one run may share windows too
            docs, masks, times, spots, to_left = (np.concatenate([r[c] for r in runs]) for c in ("docs", "masks", "times", "spots", "to_r"))
            base = np.concatenate([[0], np.cumsum([len(r["docs"]) for r in runs])])
            which, place, lcp_r = _merged([(r["lcp_r"], r["rest_r"]) for r in runs], WINDOW)
            by_right = base[which] + place
            which, place, lcp_l = _merged([(r["lcp_l"], r["rest_l"]) for r in runs], LEFT)
            by_left = base[which] + to_left[base[which] + place]
            del runs, which, place
            n = len(docs)
            removed = np.zeros(n, np.int32)
            right, left = np.empty(n, np.int64), np.empty(n, np.int64)
            for o in range(LEFT + 1):
                at = np.flatnonzero(masks >> o & 1)
                if len(at) < 2:
                    continue
                right[by_right] = np.cumsum(lcp_r < WINDOW - o)
                left[by_left] = np.cumsum(lcp_l < o)
                same = right[at] * (n + 1) + left[at]
                order = np.argsort(same, kind="stable")
                same, d = same[order], docs[at][order]
                head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
                least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.concatenate([head, [len(d)]])))
                removed[at[order][least < d]] |= np.int32(1 << o)
            each = np.repeat(removed, times)
            hit = each != 0
            found_docs.append(np.repeat(docs, times)[hit])
            found_spots.append(spots[hit])
            found_masks.append(each[hit])
        out: list[tuple] = []
        if found_docs:
            docs, spots, masks = np.concatenate(found_docs), np.concatenate(found_spots), np.concatenate(found_masks)
            mine = common_bucket(docs, buckets)
            order = np.argsort(mine, kind="stable")
            docs, spots, masks, mine = docs[order], spots[order], masks[order], mine[order]
            cut = np.searchsorted(mine, np.arange(buckets + 1))
            out = [(int(b), docs[cut[b] : cut[b + 1]].tobytes(), spots[cut[b] : cut[b + 1]].tobytes(), masks[cut[b] : cut[b + 1]].astype(np.int32).tobytes()) for b in np.flatnonzero(np.diff(cut))]
        cols = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 3))], names=["bucket", "docs", "spots", "masks"])

    return run


def _removed(size: int, spots: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of a document's bytes go."""
    edge = np.zeros(size + 1, np.int64)
    for o in range(LEFT + 1):
        p = spots[masks >> o & 1 == 1] - o
        np.add.at(edge, p, 1)
        np.add.at(edge, p + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(apply):
    """Hands each document of a bucket its removed bytes (None: none) and gathers what ``apply`` makes of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            docs = np.frombuffer(b"".join(right.column("docs").to_pylist()), np.int64)
            spots, masks = (np.frombuffer(b"".join(right.column(c).to_pylist()), np.int32) for c in ("spots", "masks"))
            order = np.argsort(docs, kind="stable")
            docs, spots, masks = docs[order], spots[order].astype(np.int64), masks[order].astype(np.int64)
        else:
            docs = np.zeros(0, np.int64)

        def gone(doc_id: int | None, raw: bytes) -> np.ndarray | None:
            if doc_id is None:
                return None
            lo, hi = np.searchsorted(docs, doc_id), np.searchsorted(docs, doc_id, side="right")
            return _removed(len(raw), spots[lo:hi], masks[lo:hi]) if hi > lo else None

        return apply(left, gone)

    return run


def _windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, docs, spots, masks): windows to remove, written down. ``docs`` has bucket, doc_id, text."""
    texts = docs.where("doc_id is not null").select("bucket", "doc_id", "text")
    asked = texts.select("doc_id", "text").mapInArrow(_ask(buckets), "bucket int, known boolean, docs binary, keys binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(buckets), "bucket int, docs binary, keys binary")
    runs = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_form_runs(buckets), "bucket int, run binary")
    return common.materialize(runs.groupBy("bucket").applyInArrow(_judge(buckets), "bucket int, docs binary, spots binary, masks binary"), "removed")


def _bucketed(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", name: str = "bucket") -> DataFrame:
    """Rows without id link with nothing: their bucket follows a hash of their text, so that they do not meet in one."""
    return docs.withColumn(name, F.pmod(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)), F.lit(buckets)).cast("int"))


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """The first prime from the text's bytes over ``BUCKET_BYTES`` on, or from the shuffle partitions if these are more.

    A bucket's texts are one task's; tasks exchange up to the square of the buckets of small rows.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    n = max(common.partitions(docs.sparkSession), size // BUCKET_BYTES) + 1
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    buckets = bucket_count(docs, text_col)
    docs = _bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), buckets)

    def apply(left: pa.Table, gone) -> pa.Table:
        out = []
        for i, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = gone(i, raw)
            if cut is None:
                out.append((i, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            else:
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                out.append((i, len(raw), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~cut].tobytes()).hexdigest()))
        cols = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    windows = _windows(docs, buckets)
    return docs.groupBy("bucket").cogroup(windows.groupBy("bucket")).applyInArrow(_finish(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of the text. A character of which only a part would go stays whole."""
    buckets = bucket_count(docs, text_col)
    kept, name = docs, next(f"_bucket{i}" for i in range(len(docs.columns) + 1) if f"_bucket{i}" not in docs.columns)
    own = _bucketed(kept.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), buckets)

    def apply(left: pa.Table, gone) -> pa.Table:
        texts = []
        for i, text in zip(left.column(id_col).to_pylist(), left.column(text_col).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = gone(i, raw)
            if cut is not None:
                b = np.frombuffer(raw, np.uint8)
                lead = np.flatnonzero((b & 0xC0) != 0x80)
                whole = np.repeat(np.logical_and.reduceat(cut, lead), np.diff(np.concatenate([lead, [len(b)]])))
                text = b[~whole].tobytes().decode("utf-8", "surrogatepass")
            texts.append(text)
        table = left.drop_columns([name])
        return table.set_column(table.schema.get_field_index(text_col), text_col, pa.array(texts, table.schema.field(text_col).type))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    windows = _windows(own, buckets)
    return _bucketed(kept, buckets, id_col, text_col, name).groupBy(name).cogroup(windows.groupBy("bucket")).applyInArrow(_finish(apply), schema)

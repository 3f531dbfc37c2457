"""Best-fit packing by exact complements.

Documents become pieces of at most ``CAPACITY`` tokens. Only the histogram of piece lengths (at most ``CAPACITY`` numbers) comes to
the driver. From the longest length down, the gap that a length leaves is filled exactly by one, two or three lengths whose sum
the index of single, pair and triple sums holds and whose counts allow it, as often as they allow; where no sum fits, the
longest length that fits goes in and the smaller gap is tried again. Patterns with their multiplicities are the plan. Each piece then
finds its place by its rank among pieces of its length: its rank in its partition plus an offset for the
partition, so that no length, however common, meets in one task.

Null text counts as empty (its document is the closing id 0 alone). Repeated rows are packed each; null ids pass through. Other
columns are not read. No documents, no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, wordbpe

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their rank among those of their length in the partition, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = wordbpe.load(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in common.slices(batches, "text", 1 << 20):
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(common.texts(batch, "text"))):
                ids += bytes(4)
                for k in range(0, len(ids), 4 * capacity):
                    piece = ids[k : k + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((i, k // (4 * capacity), k // 4, n, zlib.crc32(piece), part, int(seen[n])))
                    seen[n] += 1
            cols, types = zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in PIECES.split(", ")])
        del tokenizer  # with its words; the slices were given back before
        common.release()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.materialize(source.mapInArrow(run, PIECES), "pieces")


class _Sums:
    """Which lengths are there, and sums of one, two or three of them under their counts."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.bits = 0
        self.mirror = 0
        self.top = len(counts) - 1
        for x in np.flatnonzero(counts):
            self._set(int(x))

    def _set(self, x: int) -> None:
        self.bits |= 1 << x
        self.mirror |= 1 << (self.top - x)

    def use(self, x: int, k: int) -> None:
        self.n[x] -= k
        if not self.n[x]:
            self.bits &= ~(1 << x)
            self.mirror &= ~(1 << (self.top - x))

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit``, or 0."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((1 << (limit + 1)) - 2) else 0

    def pair(self, total: int, limit: int) -> tuple[int, int] | None:
        """Longest x <= limit with total - x there as well: bit x of ``bits`` and of the mirror shifted to this total."""
        shift = self.top - total
        other = self.mirror >> shift if shift >= 0 else self.mirror << -shift
        both = self.bits & other & ((1 << (min(limit, total - 1) + 1)) - 2)
        while both:
            x = both.bit_length() - 1
            if x != total - x or self.n[x] > 1:
                return x, total - x
            both &= ~(1 << x)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.n[gap]:
            return (gap,)
        if two := self.pair(gap, gap - 1):
            return two
        x = self.longest(gap - 2)
        while x and 3 * x >= gap:  # the longest of three is a third at least
            self.n[x] -= 1
            if not self.n[x]:
                self.bits &= ~(1 << x)
                self.mirror &= ~(1 << (self.top - x))
            two = self.pair(gap - x, x)
            self.n[x] += 1
            self._set(x)
            if two:
                return x, *two
            x = self.longest(x - 1)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths from the longest) with how many sequences are filled so."""
    counts = np.zeros(capacity + 1, object)
    for x, n in histogram.items():
        counts[x] = n
    s, out = _Sums(counts), []
    while x := s.longest(capacity):
        used, gap = Counter([x]), capacity - x
        s.use(x, 1)
        while gap:
            if fill := s.exact(gap):
                used.update(fill)
                for y in fill:
                    s.use(y, 1)
                break
            if not (y := s.longest(gap)):
                break
            used[y] += 1
            s.use(y, 1)
            gap -= y
        more = min(int(s.n[y]) // k for y, k in used.items())
        if more:
            for y, k in used.items():
                s.use(y, k * more)
        out.append((tuple(sorted(used.elements(), reverse=True)), 1 + more))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each pattern's share of the ranks begins, how often it takes the length, its first sequence and the offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for x, k in Counter(lengths).items():  # in the pattern's order
            rows.setdefault(x, []).append((taken[x], k, sequence, offset))
            taken[x] += k * times
            offset += x * k
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, vocabulary, capacity)
    counts = common.materialize(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity), capacity)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "part", before.alias("before"))
    # as many rows as lengths times partitions: dealt by both keys, so that neither side is sent whole to anyone
    ranked = cut.join(offsets.hint("shuffle_hash"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                begin, times, first, start = where[int(x)]
                j = np.searchsorted(begin, rank[at], side="right") - 1
                k = rank[at] - begin[j]
                sequence[at], offset[at] = first[j] + k // times[j], start[j] + k % times[j] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

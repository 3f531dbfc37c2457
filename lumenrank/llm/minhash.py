"""Near duplicates by SetSketch registers.

A document's set holds its distinct 5-word shingles. A sketch has ``M`` registers: the least of exponential variates over the set,
put on a scale of base ``BASE`` and truncated to 16 bits. Registers of unions are the larger ones, so sketches merge; registers of
similar sets agree. Documents with equal sets form a class, and only class representatives go on. Bands of ``ROWS``
registers bring candidates together; the registers' order relations give the similarity's likelihood, and a pair whose likelihood
speaks against the threshold by ``e**PRUNE`` is dropped; all others are confirmed on the full sets.

In a band's bucket each member is first compared with the least one. Buckets whose members still lie in different components
are then compared completely, in blocks of ``BLOCK`` members, each pair of blocks a task of its own with exact intersections; of the links
found only those that join components leave the task. So no bucket is expanded into rows for its pairs, none is collected
whole, and no pair of a bucket that could join components stays uncompared. At similarity 0.85 a pair misses all bands with probability 2e-8.

Sets are sets of 64-bit hashes of shingles, and equal sets are known by their size and two 64-bit sums: links are confirmed by hash.

Null and empty texts, and texts of white space, have no shingles and link with nothing. A null id has no component and is kept.
Rows that repeat an id are one node that links by each of its texts; each gets a row with its own ``n_shingles`` and the id's component.
Other columns are not read. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import U, mix, shingle_sets

M, ROWS = 96, 4
BASE = 1.001
RATE = 64.0
PRUNE = 20.0
BLOCK = 256
_seed = mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))
_XOR, _MUL = _seed[:M], _seed[M:] | U(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes: for each, floor(1 - log_BASE(x)) of the least variate x, in 0..65535."""
    out = np.empty(M)
    for i in range(0, M, 8):
        out[i : i + 8] = np.min((s[:, None] ^ _XOR[i : i + 8]) * _MUL[i : i + 8], axis=0) if len(s) < 4096 else [np.min((s ^ x) * m) for x, m in zip(_XOR[i : i + 8], _MUL[i : i + 8])]
    x = -np.log1p(-np.minimum((out + 0.5) * 2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of registers, that also holds the band's number."""
    r = registers.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(r) + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + r[:, j])
    return h.view(np.int64)


def likelihood(plus: np.ndarray, minus: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity of the grid (columns) given how many registers are larger, smaller, equal, and the set sizes."""
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * grid), p(v - u * grid)
    out = plus[:, None] * np.log(np.maximum(a, 1e-12)) + minus[:, None] * np.log(np.maximum(b, 1e-12)) + equal[:, None] * np.log(np.maximum(1 - a - b, 1e-12))
    return np.where(grid <= np.minimum(u / v, v / u) + 1e-12, out, -np.inf)


def plausible(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of ``percent`` or more cannot be ruled out: by the sizes exactly, else by the likelihood ratio."""
    t = percent / 100
    grid = np.unique(np.concatenate([np.linspace(0, t, 40, endpoint=False), np.linspace(t, 1, 20)]))
    ll = likelihood((regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1), (regs_a == regs_b).sum(1), n_a.astype(float), n_b.astype(float), grid)
    above = ll[:, grid >= t - 1e-12].max(1)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (ll.max(1) - above <= PRUNE)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            sets = shingle_sets(common.texts(batch, "text"), k)
            regs = [sketch(s) if len(s) else np.zeros(0, np.uint16) for s in sets]
            flat = [bands(r) if len(r) else np.zeros(0, np.int64) for r in regs]
            sig = [f"{len(s)}-{int(np.bitwise_xor.reduce(mix(s + U(1)))):x}-{int(np.add.reduce(s)):x}" if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.string()), pa.array(flat, pa.list_(pa.int64())), _binary(regs)], names=["doc_id", "n", "sig", "bands", "regs"])

    return common.materialize(docs.mapInArrow(run, "doc_id long, n long, sig string, bands array<long>, regs binary"), "sketches")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set) of the given ids: a row for each of an id's different sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(shingle_sets(common.texts(batch, "text"), k))], names=["doc_id", "set"])

    wanted = docs.join(ids.distinct(), "doc_id", "left_semi")
    return common.materialize(wanted.mapInArrow(run, "doc_id long, set binary").distinct(), "sets")


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose intersection is at least ``percent`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "set_a"):
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links that join the labels of a block's members, from exact intersections."""
        ids, labels = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
        raw = [x.as_py() for x in table.column("set")]
        first = np.array(list({(int(i), x): k for k, (i, x) in enumerate(zip(ids, raw))}.values()))
        first = first[np.argsort(ids[first], kind="stable")]
        ids, labels = ids[first], labels[first]
        a, b = [], []
        if len(np.unique(labels)) > 1:
            sets = [np.frombuffer(raw[i], np.uint64) for i in first]
            n = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = count[column] > 1
            owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
            both = np.zeros((len(sets), len(sets)), np.float32)
            width = int(column.max()) + 1 if len(column) else 0
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            for at in range(0, width, 8192):
                lo, hi = np.searchsorted(column, (at, at + 8192))
                x = np.zeros((len(sets), min(8192, width - at)), np.float32)
                x[owner[lo:hi], column[lo:hi] - at] = 1
                both += x @ x.T
            both = both.astype(np.int64)
            hit = np.argwhere(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
            root = {int(x): int(x) for x in np.unique(labels)}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in hit[labels[hit[:, 0]] != labels[hit[:, 1]]]:
                p, q = find(int(labels[i])), find(int(labels[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = sketches(docs, k)
    known = made.where("doc_id is not null and n > 0")
    first = known.groupBy("sig").agg(F.min("doc_id").alias("class"))
    # Grouped and joined by different expressions, so that rows of a hot class can be split.
    member = known.select("doc_id", F.reverse("sig").alias("s")).join(first.select(F.reverse("sig").alias("s"), "class"), "s").select("doc_id", "class").distinct()
    member = common.materialize(member, "classes")
    # An id that stands for several texts joins their classes, and has a sketch and a set of each.
    least = member.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("most"))
    several = least.where("class != most").select("doc_id", F.col("class").alias("a"))
    same = member.join(several, "doc_id").where("class != a").select("a", F.col("class").alias("b"))
    heads = common.materialize(known.join(member.where("doc_id = class").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "sig"]), "heads")

    band = heads.select("doc_id", F.explode("bands").alias("key"))
    filled = band.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    multi = band.withColumn("j", F.bitwise_not("key")).join(filled.withColumn("j", F.bitwise_not("key")).drop("key"), "j").select("key", "doc_id", "n", "least")
    multi = common.materialize(multi, "buckets")
    sets = full_sets(docs, multi.select("doc_id"), k)

    pairs = multi.where("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = heads.select("doc_id", "n", "regs")
    pairs = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "a").join(side.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("regs_a", "regs_b"))
                ok = plausible(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    pairs = common.materialize(pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(likely, "a long, b long"), "pairs")
    one = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    links = common.materialize(_confirm(pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b"), percent).unionAll(same), "confirmed")
    found = common.materialize(components(links), "components")

    # What is left: buckets of three and more whose members are in different components.
    named = multi.where("n > 2").select("key", "doc_id").join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    named = common.materialize(named, "named")
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    rest = named.withColumn("j", F.bitwise_not("key")).join(mixed.select(F.bitwise_not("key").alias("j"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "j")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "doc_id", "label").join(sets, "doc_id")
    more = rest.groupBy("key", "x", "y").applyInArrow(_block(percent), "a long, b long")
    more = common.materialize(more, "confirmed")
    if not more.isEmpty():
        found = common.materialize(components(links.unionAll(more)), "components")

    joined = least.select("doc_id", "class").join(found.select(F.col("id").alias("class"), "component"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("c"))
    out = made.select("doc_id", "n").join(joined, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

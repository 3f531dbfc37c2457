"""Near-duplicate vectors by a robust-pruned flat graph.

Unit vectors are dealt to shards by the nearest centroid (fitted on a bounded sample; as many as the rows ask for, beyond ``FLAT`` in two
levels) and also to each centroid that is nearly as near, so shards overlap; shards never mix labels. A shard of more than ``CAP`` vectors is
split by a hash of the id into blocks. In each block a graph is built: nearest candidates and some random ones, robust-pruned. A vector's
adjacency lists from all its shards are united. Each vector then searches, in batches, its own shard's blocks: greedy search
from the block's medoid and its own node, then range expansion through every node within the threshold; two blocks search each other in one task,
so a link found from either end counts for both. Similarities are computed in double precision, and only pairs at the threshold or above link.
Recall is audited after every search against brute force on a bounded query set, as the mean over queries that have links (1 if none has);
below ``MIN_RECALL`` the search is done again with wider shards and beams, and a last search below ``LEAST_RECALL`` is an error.

Tasks keep counts and links that join local components; pairs leave a task only where they cross shards. Vectors with equal
components and label are one node with a count, so exact copies are never expanded.

Vectors without label or id, null, zero, empty, or with null or non-finite components link with nothing (an absent id has no component and is kept).
Vectors of different length never link. Rows that repeat an id and vector count once and each get a row. Of an id's different vectors the one of
the smallest key stands for it in the result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

CAP, TARGET, FLAT, MAX_CENTROIDS = 4096, 1500, 256, 8192
SAMPLE, AUDIT, MIN_RECALL, LEAST_RECALL = 8192, 200, 0.97, 0.9
NEAR, RANDOM, DEGREE, ALPHA = 32, 48, 32, 1.2
BEAM, AT_ONCE, BATCH = 32, 4, 256
MARGIN = 0.08
log = logging.getLogger(__name__)


def _raw(x: np.ndarray) -> bytes:
    """A vector of doubles, in 32 bits where that loses nothing; equal vectors, equal bytes."""
    with np.errstate(over="ignore"):
        narrow = x.astype("<f4")
    return b"f" + narrow.tobytes() if (narrow == x).all() else b"d" + x.astype("<f8").tobytes()


def _units(rows: list[bytes]) -> np.ndarray:
    if all(r[:1] == b"f" for r in rows):
        x = np.frombuffer(b"".join(r[1:] for r in rows), "<f4").reshape(len(rows), -1).astype(np.float64)
    else:
        x = np.array([np.frombuffer(r[1:], "<f4" if r[:1] == b"f" else "<f8") for r in rows], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, grp (label and length), dim, key (of equal vectors), raw: of vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, v, y in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), batch.column("y").to_pylist()):
                if i is None or y is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64) + 0.0  # -0.0 becomes 0.0
                if np.isfinite(x).all() and x.any():
                    raw = _raw(x)
                    out.append((i, f"{y}/{len(x)}", len(x), hashlib.md5(f"{y}/".encode() + raw).hexdigest(), raw))
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()))], names=["vec_id", "grp", "dim", "key", "raw"])

    picked = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("y"))
    return common.materialize(picked.mapInArrow(run, "vec_id long, grp string, dim int, key string, raw binary"), "vectors")


def _means(x: np.ndarray, n: int, steps: int) -> np.ndarray:
    rng = np.random.default_rng(6)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if len(own := x[near == j]):
                m = own.sum(0)
                c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


class Centroids:
    """Centroids of unit vectors: one level, or cells of which each has its own."""

    def __init__(self, x: np.ndarray, n: int, steps: int = 12):
        if n <= FLAT:
            self.cells, self.leaves = None, [_means(x, n, steps)]
        else:
            self.cells = _means(x, math.ceil(math.sqrt(n)), steps)
            near = (x @ self.cells.T).argmax(1)
            per = math.ceil(n / len(self.cells))
            self.leaves = [_means(x[near == j], per, steps) if (near == j).any() else self.cells[j : j + 1] for j in range(len(self.cells))]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in self.leaves])])

    def assign(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, centroid, and whether it is the row's nearest: for each row all centroids within ``margin`` of that."""
        if self.cells is None:
            cells = [np.arange(len(x))]
        else:
            s = x @ self.cells.T
            cells = [np.flatnonzero(c) for c in (s >= s.max(1, keepdims=True) - margin).T]
        row, leaf, sim = [], [], []
        for j, at in enumerate(cells):
            if len(at):
                s = x[at] @ self.leaves[j].T
                r, c = np.nonzero(s >= s.max(1, keepdims=True) - margin)
                row.append(at[r]), leaf.append(c + self.first[j]), sim.append(s[r, c])
        row, leaf, sim = (np.concatenate(a) for a in (row, leaf, sim))
        order = np.lexsort((leaf, -sim, row))
        row, leaf, sim = row[order], leaf[order], sim[order]
        head = np.concatenate([[True], row[1:] != row[:-1]])
        keep = sim >= sim[head][np.cumsum(head) - 1] - margin
        return row[keep], leaf[keep], head[keep]


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency (rows of ``DEGREE`` node numbers, -1 for none) of the robust-pruned graph over unit vectors."""
    n = len(x)
    if n == 1:
        return np.full((1, DEGREE), -1, np.int64)
    rng = np.random.default_rng(n)
    adj = np.full((n, DEGREE), -1, np.int64)
    f = x.astype(np.float32)
    near = min(NEAR, n - 1)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        rows = np.arange(hi - lo)
        sim = f[lo:hi] @ f.T
        sim[rows, rows + lo] = -2
        cand = np.concatenate([np.argpartition(-sim, near - 1, axis=1)[:, :near], rng.integers(0, n, (hi - lo, RANDOM))], axis=1)
        s = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * s))
        alive = s > -2
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        for r in range(DEGREE):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            p = cand[rows, first]
            adj[lo:hi, r] = np.where(some, p, -1)
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", f[p], f[cand])))
            alive &= ~(some[:, None] & (ALPHA * between <= far))
            alive[rows, first] = False
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) numbers at ``threshold`` or above. ``own``: each query's node, or -1 where it is not in this graph."""
    n, out_q, out_v = len(x), [], []
    medoid = int((x @ x.sum(0)).argmax())
    width = min(beam, n)
    for lo in range(0, len(q), BATCH):
        y, mine = q[lo : lo + BATCH], own[lo : lo + BATCH]
        m = len(y)
        rows = np.arange(m)
        seen, inside = np.zeros((m, n + 1), bool), np.zeros((m, n), bool)
        seen[:, n] = True  # the place of absent neighbours
        ids, sims, open_ = np.full((m, width), n, np.int64), np.full((m, width), -np.inf), np.zeros((m, width), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = medoid, y @ x[medoid], True
        seen[:, medoid] = True
        inside[:, medoid] = sims[:, 0] >= threshold
        while open_.any():
            pick = np.argsort(np.where(open_, -sims, np.inf), axis=1, kind="stable")[:, :AT_ONCE]
            nodes = np.where(np.take_along_axis(open_, pick, 1), np.take_along_axis(ids, pick, 1), n)
            np.put_along_axis(open_, pick, False, 1)
            nbr = np.where(nodes[:, :, None] < n, adj[np.minimum(nodes, n - 1)], n).reshape(m, -1)
            nbr[nbr < 0] = n
            r, c = np.nonzero(~seen[rows[:, None], nbr])
            pair = np.unique(r * (n + 1) + nbr[r, c])
            r, v = pair // (n + 1), pair % (n + 1)
            seen[r, v] = True
            got = (y[r] * x[v]).sum(1)
            inside[r[got >= threshold], v[got >= threshold]] = True
            place = np.arange(len(r)) - np.searchsorted(r, r)
            k = int(place.max()) + 1 if len(r) else 0
            new_ids, new_sims = np.full((m, k), n, np.int64), np.full((m, k), -np.inf)
            new_ids[r, place], new_sims[r, place] = v, got
            ids, sims, open_ = np.concatenate([ids, new_ids], 1), np.concatenate([sims, new_sims], 1), np.concatenate([open_, new_sims > -np.inf], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            ids, sims, open_ = (np.take_along_axis(a, best, 1) for a in (ids, sims, open_))
        has = mine >= 0
        seen[rows[has], mine[has]] = True
        inside[rows[has], mine[has]] = True
        r, v = np.nonzero(inside)
        while len(r):
            nbr = adj[v]
            w = np.repeat(r, adj.shape[1])
            nbr = np.where(nbr < 0, n, nbr).ravel()
            fresh = ~seen[w, nbr]
            pair = np.unique(w[fresh] * (n + 1) + nbr[fresh])
            r, v = pair // (n + 1), pair % (n + 1)
            seen[r, v] = True
            ok = (y[r] * x[v]).sum(1) >= threshold
            r, v = r[ok], v[ok]
            inside[r, v] = True
        inside[rows[has], mine[has]] = False
        a, b = np.nonzero(inside)
        out_q.append(a + lo)
        out_v.append(b)
    return np.concatenate(out_q), np.concatenate(out_v)


def _build(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    adj = build_graph(_units([table.column("raw")[int(i)].as_py() for i in order]))
    near = [ids[a[a >= 0]].tolist() for a in adj]
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "near": pa.array(near, pa.list_(pa.int64()))})


def _graph(table: pa.Table, ids: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = {int(i): k for k, i in enumerate(ids[node])}
    lists = table.column("near")
    wide = [[at[v] for v in lists[int(k)].as_py() or [] if v in at] for k in node]
    adj = np.full((len(node), max([1, *map(len, wide)])), -1, np.int64)
    for k, row in enumerate(wide):
        adj[k, : len(row)] = row
    return adj


def _search(threshold: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows of a block, or of two that search each other: counts (kind n), pairs across shards (p), joining links (e)."""
        ids, home, copies, block = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "home", "copies", "block"))
        out: list[tuple] = []
        blocks = [np.flatnonzero(block == b) for b in np.unique(block)]
        blocks = [at[np.argsort(ids[at])] for at in blocks]
        if home.any() and (len(blocks) == 2 or table.column("x")[0] == table.column("y")[0]):
            x = _units(table.column("raw").to_pylist())
            a, b = [], []
            for node, asking in [(blocks[0], blocks[0])] if len(blocks) == 1 else [(blocks[0], blocks[1]), (blocks[1], blocks[0])]:
                query = asking[home[asking]]
                if len(query):
                    own = np.searchsorted(ids[node], ids[query]) if node is asking else np.full(len(query), -1)
                    r, v = range_search(x[node], _graph(table, ids, node), x[query], own, threshold, beam)
                    a.append(query[r]), b.append(node[v])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                both = home[b]
                pair = np.unique(np.sort(np.stack([a[both], b[both]], 1), axis=1), axis=0)  # found from either end
                counts = np.bincount(pair[:, 0], copies[pair[:, 1]], len(ids)) + np.bincount(pair[:, 1], copies[pair[:, 0]], len(ids))
                out += [("n", int(ids[k]), int(counts[k]), 0, 0) for k in np.flatnonzero(counts)]
                for p, q in zip(a[~both], b[~both]):
                    p, q = (p, q) if ids[p] < ids[q] else (q, p)
                    out.append(("p", int(ids[p]), int(ids[q]), int(copies[p]), int(copies[q])))
                root: dict[int, int] = {}

                def find(k: int) -> int:
                    root.setdefault(k, k)
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                for p, q in zip(ids[a].tolist(), ids[b].tolist()):
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                out += [("e", k, find(k), 0, 0) for k in list(root) if find(k) != k]
        cols = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4))], names=["kind", "a", "b", "ca", "cb"])

    return run


def find_links(nodes: DataFrame, threshold: float, margin: float, beam: int) -> DataFrame:
    """kind, a, b, ca, cb: what the search of all ``nodes(vec_id, grp, dim, raw, copies)`` found."""
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("grp").alias("g"), F.mode("dim").alias("dim")).first()
    n = min(MAX_CENTROIDS, max(1, math.ceil(size["n"] / (TARGET * max(1, size["g"])))))
    sample = [r["raw"] for r in nodes.where(F.col("dim") == (size["dim"] or 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 8 * n)).select("raw").collect()]
    centroids = Centroids(_units(sample), n) if sample and n > 1 else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fits = batch.column("dim").to_numpy() == size["dim"] if centroids is not None else np.zeros(batch.num_rows, bool)
                row, shard, home = np.flatnonzero(~fits), np.zeros((~fits).sum(), np.int64), np.ones((~fits).sum(), bool)
                if fits.any():
                    mine = np.flatnonzero(fits)
                    r, c, h = centroids.assign(_units([batch.column("raw")[int(k)].as_py() for k in mine]), margin)
                    row, shard, home = (np.concatenate(p) for p in ((row, mine[r]), (shard, c), (home, h)))
                yield pa.RecordBatch.from_arrays([*batch.select(["vec_id", "grp", "raw", "copies"]).take(pa.array(row)).columns, pa.array(shard, pa.int32()), pa.array(home, pa.bool_())], names=["vec_id", "grp", "raw", "copies", "shard", "home"])

    dealt = common.materialize(nodes.select("vec_id", "grp", "raw", "copies", "dim").mapInArrow(assign, "vec_id long, grp string, raw binary, copies long, shard int, home boolean"), "shards")
    sizes = dealt.groupBy("grp", "shard").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("blocks"))
    # Joined by another expression than grouped by, so that a hot shard's rows can be split.
    tag = F.concat_ws("|", "grp", "shard")
    dealt = dealt.withColumn("t", tag).join(sizes.select(tag.alias("t"), "blocks"), "t").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = common.materialize(dealt, "blocks")
    lists = dealt.select("grp", "shard", "block", "vec_id", "raw").groupBy("grp", "shard", "block").applyInArrow(_build, "vec_id long, near array<long>")
    united = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    rows = dealt.join(common.materialize(united, "graph"), "vec_id", "left").select("grp", "shard", "vec_id", "raw", "copies", "home", "near", "block", "blocks")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", "shard", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "vec_id", "raw", "copies", "home", "near")
    found = rows.groupBy("grp", "shard", "x", "y").applyInArrow(_search(threshold, beam), "kind string, a long, b long, ca long, cb long")
    return common.materialize(found, "found")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Recall of ``counts(vec_id, n)`` against brute force over all rows: the mean over those of a bounded query set that have links, 1 if none has."""
    asked = nodes.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(queries).select("vec_id", "grp", "raw").collect()
    if not asked:
        return 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for r in asked:
            by.setdefault(r["grp"], []).append((r["vec_id"], bytes(r["raw"])))
        total = dict.fromkeys((r["vec_id"] for r in asked), 0)
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            ids, copies = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy()
            for g, qs in by.items():
                if len(at := np.flatnonzero(grp == g)):
                    x = _units([batch.column("raw")[int(k)].as_py() for k in at])
                    for i, raw in qs:
                        near = (x * _units([raw])).sum(1) >= threshold
                        total[i] += int(copies[at][near & (ids[at] != i)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["vec_id", "n"])

    true = {r["vec_id"]: r["n"] for r in nodes.select("vec_id", "grp", "raw", "copies").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    got = {r["vec_id"]: r["n"] for r in counts.where(F.col("vec_id").isin(list(true))).collect()}
    shares = [min(n, got.get(i, 0)) / n for i, n in true.items() if n]
    return sum(shares) / len(shares) if shares else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``."""
    usable = valid(vectors, id_col, vec_col, label_col)
    once = usable.groupBy("vec_id").agg(F.min(F.struct("key", "grp", "dim", "raw")).alias("m")).select("vec_id", "m.*")
    classes = once.groupBy("key").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    # Grouped and joined by different expressions, so that rows of a hot vector can be split.
    once = once.withColumn("k", F.reverse("key")).join(classes.select(F.reverse("key").alias("k"), "head", "copies"), "k").drop("k", "key")
    once = common.materialize(once, "nodes")
    nodes = once.where("vec_id = head")
    margin, beam = MARGIN, BEAM
    for attempt in range(3):
        found = find_links(nodes, threshold, margin, beam)
        pairs = found.where("kind = 'p'").distinct()
        counts = found.where("kind = 'n'").select(F.col("a").alias("vec_id"), F.col("b").alias("n")).unionAll(pairs.select(F.col("a").alias("vec_id"), F.col("cb").alias("n"))).unionAll(pairs.select(F.col("b").alias("vec_id"), F.col("ca").alias("n")))
        counts = common.materialize(counts.groupBy("vec_id").agg(F.sum("n").alias("n")), "counts")
        recall = audit(nodes, counts, threshold)
        log.info("search %d: recall %.4f at margin %.2f and beam %d", attempt + 1, recall, margin, beam)
        if recall >= MIN_RECALL:
            break
        margin, beam = margin * 2, beam * 2
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall of {recall:.3f} after {attempt + 1} searches")
    links = found.where("kind != 'n'").select("a", "b")
    named = components(links)
    member = once.select("vec_id", "head", "copies").join(counts.select(F.col("vec_id").alias("head"), "n"), "head", "left").join(named.select(F.col("id").alias("head"), "component"), "head", "left")
    member = member.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "head").alias("c"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(member, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

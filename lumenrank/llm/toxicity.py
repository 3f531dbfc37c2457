"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are words and, for longer words, their four-letter stems: all that the labelled examples have. Document frequencies
of these terms are counted over all documents. Labelled examples are indexed over all their terms, with each block's largest weight of
each term; a query visits the blocks of the highest upper bounds, then all others whose bound can improve its ``K`` best, so the
neighbours are exact. What the commonest terms give to all cosines is one matrix product a batch. A second index holds only the terms that go
with label 1 (a G-test over distinct examples) and votes beside the first; it takes nothing from it. Votes weighted by cosine are calibrated by a logistic fit on examples that are not
in the index that they ask, weighted to the classes' true shares.

Bounds: at most ``PER_CLASS`` examples a class. A query's terms that no labelled example has match
none and are in no norm, which scales all its cosines alike. Null text counts as empty; texts without a known term
have no neighbours and get the calibrated score of no votes. Repeated rows get equal scores, null ids pass
through. Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import labelled

PER_CLASS = 3000
K = 16
BLOCK, FIRST, BATCH = 256, 4, 256
#: Terms that a larger share of the examples has are a matrix instead of postings.
HEAVY = 0.03
#: Bytes of text at a time: words, numbers and sorted keys of a text take several times its size beside the index.
SLICE = 1 << 20
#: Above the rounding of products of 32 bits.
MARGIN = 1e-5
MIN_G = 20.0


def word_lists(texts: pa.Array) -> pa.Array:
    """Words of texts: runs of letters, in lower case."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"\P{L}+", " ")))


def words(text: str) -> list[str]:
    return [w for w in word_lists(pa.array([text], pa.string()))[0].as_py() if w]


def _stem(word: str) -> str:
    return word[:4] + "*" if len(word) > 5 else ""


def choose_terms(rows: list[tuple[str, int, int]], min_g: float = MIN_G) -> list[str]:
    """Terms over-represented in label 1 by the G statistic. Examples of the same words count once."""
    counts, n, seen = (Counter(), Counter()), [0, 0], set()
    for text, y, _ in rows:
        ws = set(words(text))
        key = y, hashlib.sha256(" ".join(sorted(ws)).encode("utf-8", "surrogatepass")).digest()
        if key in seen:
            continue
        seen.add(key)
        n[y] += 1
        counts[y].update(ws | ({_stem(w) for w in ws} - {""}))
    found = []
    for term, a in counts[1].items():
        b = counts[0][term]
        if a < 3 or (a + 0.5) * (n[0] + 1) < 6 * (b + 0.5) * (n[1] + 1):
            continue
        total, g = a + b, 0.0
        for seen_n, share in ((a, n[1] / sum(n)), (b, n[0] / sum(n))):
            if seen_n:
                g += 2 * seen_n * math.log(seen_n / (total * share))
        if g >= min_g:
            found.append(term)
    return sorted(found)


Counts = tuple[np.ndarray, np.ndarray]  # numbers of terms, and how often each occurs


def _terms(texts: pa.Array, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text number * number of terms + term, how often), sorted, of texts at once: each distinct word and its stem are looked up once."""
    lists = word_lists(texts)
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    own = np.array([ids.get(w, -1) if w else -1 for w in known] or [-1], np.int64)
    stem = np.array([ids.get(_stem(w), -1) if len(w) > 5 else -1 for w in known] or [-1], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    base = np.repeat(np.arange(len(texts)) * len(ids), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = [(base + t)[t >= 0] for t in (own[code], stem[code])]
    return np.unique(np.concatenate(found), return_counts=True)


def term_counts(texts: pa.Array, ids: dict[str, int]) -> list[Counts]:
    if not ids:
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32))] * len(texts)
    key, n = _terms(texts, ids)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * len(ids))
    key, n = (key % len(ids)).astype(np.int32), n.astype(np.int32)
    return [(key[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[np.ndarray, int]:
    """Over all documents; what comes to the driver is bounded by the vocabulary."""
    ids = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(ids) + 1, np.int64)
        for batch in common.slices(batches, "t", SLICE):
            df[:-1] += np.bincount(_terms(batch.column("t"), ids)[0] % len(ids), minlength=len(ids))
            df[-1] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["i", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(ids) + 1, np.int64)
    df[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return df[:-1], int(df[-1])


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each lo to before its hi, and how many each has."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


@dataclass
class Index:
    """Block-max inverted index over weighted example vectors; ``ids`` carries what evidence shows.

    Terms that more than ``HEAVY`` of the examples have would make each query visit every block; their weights are a matrix, and what they give
    to each cosine is one product for a batch of queries. All other terms have postings, sorted by term and row. An entry is what a block has of
    a term: ``entries`` says where a term's begin, ``postings`` where an entry's begin. A block's bound is the largest product of its rows plus
    the entries' largest weights.
    """

    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    entries: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    postings: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    cells: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, vectors: list[Counts], labels: list[int], ids: list[int], idf: np.ndarray, heavy: float = HEAVY) -> Index:
        keep = [i for i, v in enumerate(vectors) if len(v[0])]
        rows = np.repeat(np.arange(len(keep), dtype=np.int32), [len(vectors[i][0]) for i in keep])
        none = np.zeros(0, np.int32)
        terms = np.concatenate([none, *(vectors[i][0] for i in keep)])
        weights = (1 + np.log(np.concatenate([none, *(vectors[i][1] for i in keep)]))) * idf[terms]
        weights /= np.sqrt(np.bincount(rows, weights * weights, len(keep)))[rows]
        often = np.bincount(terms, minlength=len(idf)) > heavy * len(keep)
        column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        at = often[terms]
        cells, values = np.stack([rows[at], column[terms[at]]]), weights[at]
        rows, terms, weights = rows[~at], terms[~at], weights[~at]
        order = np.lexsort((rows, terms))
        rows, terms, weights = rows[order], terms[order], weights[order]
        own = np.array([labels[i] for i in keep], float), np.array([ids[i] for i in keep], np.int64)
        return cls(idf, *own, *cls._entries(terms, rows, weights, len(idf)), rows, weights, column, cells, values)

    @staticmethod
    def _entries(terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where terms' entries begin, the entries' blocks and largest weights, and where their postings begin."""
        block = rows // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])[: len(rows)])
        most = np.maximum.reduceat(weights, head) if len(head) else weights
        return np.searchsorted(terms[head], np.arange(n_terms + 1)), block[head], most, np.concatenate([head, [len(rows)]])

    def __getstate__(self) -> dict:
        """For tasks: no entries, which postings give again, and numbers as short as they may be."""
        short = np.min_scalar_type(max(self.cells.max(initial=0), len(self.ids)))
        per_term, per_row = np.diff(self.postings[self.entries]), np.diff(self._cells_of)
        return {"idf": self.idf, "labels": self.labels, "ids": self.ids, "column": self.column, "weights": self.weights, "values": self.values} | {
            k: v.astype(short) for k, v in (("rows", self.rows), ("per_term", per_term), ("per_row", per_row), ("columns", self.cells[1]))
        }

    def __setstate__(self, state: dict) -> None:
        rows, per_term, per_row, columns = (state.pop(k).astype(np.int32) for k in ("rows", "per_term", "per_row", "columns"))
        self.__dict__.update(state, rows=rows, cells=np.stack([np.repeat(np.arange(len(per_row), dtype=np.int32), per_row), columns]))
        terms = np.repeat(np.arange(len(per_term), dtype=np.int32), per_term)
        self.entries, self.blocks, self.block_max, self.postings = self._entries(terms, rows, self.weights, len(self.idf))

    def weigh(self, counts: Counts) -> Counts:
        """Terms and weights of a vector of length 1."""
        t, n = counts
        if not len(t):
            return t, np.zeros(0)
        w = (1 + np.log(n)) * self.idf[t]
        norm = math.sqrt(w @ w)
        return (t, w / norm) if norm else (t[:0], w[:0])

    @cached_property
    def _product(self) -> np.ndarray:
        """Heavy terms by examples in 32 bits, made where it is used. The only matrix: doubles are summed from the cells, which are sorted by row."""
        matrix = np.zeros((int(self.column.max(initial=-1)) + 1, len(self.ids)), np.float32)
        matrix[self.cells[1], self.cells[0]] = self.values
        return matrix

    @cached_property
    def _cells_of(self) -> np.ndarray:
        """Where each example's cells begin."""
        return np.searchsorted(self.cells[0], np.arange(len(self.ids) + 1))

    def _heavy_sums(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the heavy terms of a query give to the cosines of rows, in doubles."""
        q = np.zeros(len(self._product))
        q[columns] = weights
        at, n = _spans(self._cells_of[rows], self._cells_of[rows + 1])
        return np.bincount(np.repeat(np.arange(len(rows)), n), q[self.cells[1][at]] * self.values[at], len(rows))

    def nearest(self, counts: Counts, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k best examples, exact; ties go to the smaller row."""
        return next(self.nearest_of([counts], k))[:2]

    def nearest_of(self, queries: list[Counts], k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, Counts]]:
        """The same for many, with each query's weights. Products are of 32 bits and choose candidates with a margin for rounding; cosines of candidates are summed in doubles."""
        for start in range(0, len(queries), BATCH):
            vectors = [self.weigh(c) for c in queries[start : start + BATCH]]
            some = [i for i, (t, _) in enumerate(vectors) if len(t) and len(self.ids)]
            q = np.zeros((len(some), len(self._product)), np.float32)
            for row, i in enumerate(some):
                c = self.column[vectors[i][0]]
                q[row, c[c >= 0]] = vectors[i][1][c >= 0]
            products, row = q @ self._product, iter(range(len(some)))
            for t, w in vectors:
                if len(t) and len(self.ids):
                    yield *self._best(t, w, products[next(row)], k), (t, w)
                else:
                    yield np.zeros(0, np.int64), np.zeros(0), (t, w)

    def _best(self, terms: np.ndarray, weights: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n_blocks = -(-len(self.ids) // BLOCK)
        column = self.column[terms]
        light, lw = terms[column < 0], weights[column < 0]
        e, n = _spans(self.entries[light], self.entries[light + 1])
        w, blocks = np.repeat(lw, n), self.blocks[e]
        bound = np.maximum.reduceat(product, np.arange(0, len(product), BLOCK)) + np.bincount(blocks, w * self.block_max[e], n_blocks)
        sims = np.zeros(n_blocks * BLOCK)
        sims[: len(product)] = product
        sims[len(product) :] = -1.0
        light_sims, by_block = np.zeros(n_blocks * BLOCK), sims.reshape(n_blocks, BLOCK)
        todo, floor = np.zeros(n_blocks, bool), 0.0
        todo[np.argsort(-bound, kind="stable")[:FIRST]] = True
        visited = todo
        for last in (False, True):  # the blocks of the highest bounds, then all others that can improve on them
            at = np.flatnonzero(todo[blocks])
            if len(at):
                p, n = _spans(self.postings[e[at]], self.postings[e[at] + 1])
                light_sims += np.bincount(self.rows[p], np.repeat(w[at], n) * self.weights[p], len(light_sims))
            if not last:
                seen = (by_block[todo] + light_sims.reshape(n_blocks, BLOCK)[todo]).ravel()
                if len(seen) > k:
                    floor = max(0.0, float(np.partition(seen, len(seen) - k)[len(seen) - k]) - MARGIN)
                todo = ~visited & (bound > 0) & (bound >= floor - MARGIN)
                visited = visited | todo
        own = np.flatnonzero(visited)
        whole = by_block[own] + light_sims.reshape(n_blocks, BLOCK)[own]
        a, b = np.nonzero((whole >= floor - MARGIN) & (whole > 0))
        if len(a) > k:  # more than needed: cut again before the exact sums
            value = whole[a, b]
            near = value >= np.partition(value, len(value) - k)[len(value) - k] - MARGIN
            a, b = a[near], b[near]
        hit = own[a] * BLOCK + b
        exact = light_sims[hit] + self._heavy_sums(hit, column[column >= 0], weights[column >= 0])
        hit, exact = hit[exact > 1e-12], exact[exact > 1e-12]
        best = np.lexsort((hit, -np.round(exact, 12)))[:k]
        return hit[best], exact[best]

    def votes_of(self, queries: list[Counts]) -> Iterator[tuple[float, float, np.ndarray, np.ndarray, Counts]]:
        for rows, sims, vector in self.nearest_of(queries):
            if not len(rows):
                yield 0.0, 0.0, rows, sims, vector
                continue
            y = self.labels[rows]
            yield float((sims * y).sum()) / K, float((sims * (1 - y)).sum()) / K, rows, sims, vector


@dataclass
class Model:
    terms: list[str]
    index: Index | None
    flags: np.ndarray
    flagged: Index | None
    beta: tuple[float, ...]
    prior: float


def _among(counts: Counts, flags: np.ndarray) -> Counts:
    at = flags[counts[0]]
    return counts[0][at], counts[1][at]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, seed: int = 4) -> Model:
    rows, (n0, n1) = labelled(docs, labels, label_col, per_class, seed)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    every: set[str] = set()
    commonest = []
    for text, _, _ in rows:
        count = Counter(words(text))
        every.update(count)
        commonest.append(max(count.items(), key=lambda x: (x[1], x[0]))[0] if count else "")
    terms = sorted(every | ({_stem(w) for w in every} - {""}))
    if not terms or len({y for _, y, _ in rows}) < 2:
        return Model([], None, np.zeros(0, bool), None, (), prior)
    # Blocks of one language have close bounds: rows go by their commonest word.
    order = sorted(range(len(rows)), key=lambda i: (commonest[i], rows[i][2]))
    rows = [rows[i] for i in order]
    df, n = document_frequencies(docs, terms)
    idf = np.log((n + 1) / (df + 1)) + 1
    ids = {t: i for i, t in enumerate(terms)}
    flags = np.zeros(len(terms), bool)
    flags[[ids[t] for t in choose_terms(rows)]] = True
    vectors = [v for at in range(0, len(rows), BATCH) for v in term_counts(pa.array([t for t, _, _ in rows[at : at + BATCH]], pa.string()), ids)]
    views = (vectors, [_among(v, flags) for v in vectors])
    y = np.array([k for _, k, _ in rows], float)
    names = [i for _, _, i in rows]
    fold = np.arange(len(rows)) % 2
    x = np.zeros((len(rows), 4))
    for side in (0, 1):  # each half asks an index of the other
        other = np.flatnonzero(fold != side)
        for at, view in zip((0, 2), views):
            index = Index.build([view[i] for i in other], [int(y[i]) for i in other], [names[i] for i in other], idf)
            mine = np.flatnonzero(fold == side)
            x[mine, at : at + 2] = [v[:2] for v in index.votes_of([view[i] for i in mine])]
    share = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    beta = common.logistic(x * 4, y, share * len(y), ridge=0.05)
    index, flagged = (Index.build(view, y.astype(int).tolist(), names, idf) for view in views)
    return Model(terms, index, flags, flagged, tuple(beta), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", evidence: bool = False) -> DataFrame:
    """``docs`` with the calibrated probability of label 1, and, if asked, its heaviest terms and nearest examples (id, cosine, label)."""
    kept = docs.drop(out_col, *(["evidence"] if evidence else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{out_col}` double" + ", evidence array<string>" * evidence
    # A closure's bytes would stay in the worker beside the index that is made of them; a broadcast is read from its file, once for a worker's tasks.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids, beta = {t: i for i, t in enumerate(model.terms)}, np.array(model.beta)
        for batch in common.slices(batches, text_col, SLICE):
            p, why = [model.prior] * batch.num_rows, [[]] * batch.num_rows
            if model.index is not None:
                why = []
                counts, x = term_counts(batch.column(text_col), ids), []
                for (a, b, rows, sims, (t, w)), (c, d, *_) in zip(model.index.votes_of(counts), model.flagged.votes_of([_among(x, model.flags) for x in counts])):
                    x.append((4 * a, 4 * b, 4 * c, 4 * d, 1.0))
                    if evidence:
                        top = np.lexsort((t, -w))[:3]
                        why.append([f"{model.terms[t[i]]}:{w[i]:.3f}" for i in top] + [f"doc {model.index.ids[r]}:{s:.3f}:{int(model.index.labels[r])}" for r, s in zip(rows[:3], sims[:3])])
                p = common.sigmoid(np.array(x) @ beta)
            extra = [pa.array(p, pa.float64())] + [pa.array(why, pa.list_(pa.string()))] * evidence
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, out_col, *["evidence"] * evidence])

    return kept.mapInArrow(run, schema)

"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled texts. A text is cut into pieces of
``PIECE`` bytes (all of them), each is compressed with either dictionary, and the normalised difference of the sums,
``(good - bad) / (good + bad)``, goes, with the larger compressed size's share of the text's, through a logistic calibration fitted on
labelled texts that the dictionaries have not seen, weighted to the classes' true shares. The share tells texts that compress
well with either dictionary, such as one word over and over. A text that a dictionary remembers compresses far better than any that calibration
saw: so the share is that of the dictionary that knows the text less, both inputs are held to the range that calibration saw, and the score
never rises with the difference.

Bounds: at most ``PER_CLASS`` whole texts of each class and ``MAX_BYTES`` of them are learned from, chosen by a hash of the row's id;
class shares are counted over all labelled rows. Null text counts as empty; empty texts get the calibrated score of difference 0 and share one half.
Repeated rows each get the same score, null ids pass through, other columns are not inputs. Without labels of both classes
every score is the share of label 1 (0.5 without labels). No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS = 2000
#: Bytes of text that a fit may bring to the driver; examples that would go beyond are not in the sample.
MAX_BYTES = 256 << 20
PIECE = 1024
DICT_BYTES = 112640
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    beta: tuple[float, ...]
    prior: float
    low: tuple[float, float] = (0.0, 0.0)
    high: tuple[float, float] = (0.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int, int]], tuple[int, int]]:
    """A bounded sample (text, label, id) of the rows that may be learned from, in a fixed order, and the classes' counts over all of them."""
    may = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~common.held_out(F.col("i")))
    counts = {r["y"]: r["n"] for r in may.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = may.where(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where(F.col("i").isNotNull())
    rows = texts.join(F.broadcast(picked.distinct()), "i")  # at most 2 * per_class ids are broadcast
    # Equal texts of a label count once, by their smallest id; of an id's different texts the one of the smallest hash is taken.
    # All texts are read once: those of the picked ids are written down, and both what is chosen and its texts come from there.
    rows = common.materialize(rows.withColumns({"h": F.sha2("t", 256), "b": F.octet_length("t").cast("long")}), "labelled")
    order = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 62))
    one = rows.select("i", "y", "h", "b").groupBy("i", "y").agg(F.min(F.struct("h", "b")).alias("m")).groupBy("y", "m").agg(F.min(F.struct(order.alias("o"), F.col("i"))).alias("k"))
    chosen, total = [], 0
    for r in sorted(one.collect(), key=lambda r: (r["k"]["o"], r["k"]["i"], r["y"])):  # at most 2 * per_class rows without texts
        if total + r["m"]["b"] <= MAX_BYTES:
            total += r["m"]["b"]
            chosen.append((r["k"]["i"], r["y"], r["m"]["h"]))
    if not chosen:
        return [], (counts.get(0, 0), counts.get(1, 0))
    # From Arrow, as a table of the plan: rows of a list would start a second family of Python workers beside the first on every executor.
    i, y, h = zip(*chosen)
    table = docs.sparkSession.createDataFrame(pa.table({"i": pa.array(i, pa.int64()), "y": pa.array(y, pa.int32()), "h": pa.array(h, pa.string())}))
    found = rows.drop("y").join(F.broadcast(table), ["i", "h"]).select("i", "y", "t").distinct().collect()
    place = {(i, y): n for n, (i, y, _) in enumerate(chosen)}
    found.sort(key=lambda r: place[r["i"], r["y"]])
    return [(r["t"], r["y"], r["i"]) for r in found], (counts.get(0, 0), counts.get(1, 0))


def _pieces(text: str, size: int = PIECE) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def build_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or, where there are too few samples to train one, the texts' last bytes as raw content."""
    samples = [p for t in texts for p in _pieces(t)]
    try:
        if len(samples) > 200:
            return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        pass
    return b"".join(samples)[-size:] or b"\n" * 16


class Scorer:
    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self._c = []
        for content in (good, bad):
            d = zstd.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            self._c.append(zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[float, float]:
        """Normalised compressed-size difference of the whole text, below 0 for good text, and the larger compressed share."""
        pieces = _pieces(text)
        if not pieces:
            return 0.0, 0.5
        a, b = (sum(len(c.compress(p)) for p in pieces) for c in self._c)
        return (a - b) / (a + b), max(a, b) / sum(map(len, pieces))


def _inputs(x: np.ndarray) -> np.ndarray:
    """Difference and the share's logarithm, each with its parts beyond bends, so that the tails have slopes of their own."""
    z, share = x[:, 0] * 20, np.log(np.maximum(x[:, 1], 1e-3))
    return np.column_stack([z, np.maximum(z, 0), np.minimum(z + 1, 0), share, np.minimum(share + 1.2, 0), np.minimum(share + 1.8, 0)])


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of ``_inputs``; a part that would let the score rise with the difference is left out, and the rest fitted again."""
    a = _inputs(x)
    live = np.ones(a.shape[1], bool)
    while True:
        beta = np.zeros(a.shape[1] + 1)
        beta[np.append(live, True)] = common.logistic(a[:, live], y, w, ridge=0.05)
        wrong = [i for i in (1, 2) if live[i] and beta[0] + beta[i] > 0] or [0] * bool(live[0] and beta[0] > 0)
        if not wrong:
            return beta
        live[wrong] = False


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, seed: int = 9) -> Model:
    rows, (n0, n1) = labelled(docs, labels, label_col, per_class, seed)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    by = {y: [t for t, k, _ in rows if k == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        return Model(b"", b"", (), prior)
    half = {y: (by[y][::2], by[y][1::2]) for y in (0, 1)}
    good, bad = build_dictionary(half[1][0]), build_dictionary(half[0][0])
    s = Scorer(good, bad)
    x = np.array([s.sizes(t) for y in (0, 1) for t in half[y][1]])
    y = np.array([k for k in (0, 1) for _ in half[k][1]], float)
    share = np.where(y == 1, prior / max(1, len(half[1][1])), (1 - prior) / max(1, len(half[0][1])))
    return Model(good, bad, tuple(_calibrate(x, y, share * len(y)).tolist()), prior, tuple(x.min(axis=0).tolist()), tuple(x.max(axis=0).tolist()))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of label 1 in ``out_col`` (replaced if it is there)."""
    kept = docs.drop(out_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{out_col}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.good, model.bad) if model.beta else None
        for batch in common.slices(batches, text_col):
            if s:
                x = _inputs(np.clip([s.sizes(t) for t in common.texts(batch, text_col)], model.low, model.high))
                p = common.sigmoid(np.column_stack([x, np.ones(len(x))]) @ np.array(model.beta))
            else:
                p = np.full(batch.num_rows, model.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)

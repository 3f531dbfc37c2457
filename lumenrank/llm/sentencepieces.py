"""SentencePiece encoding and decoding with a parallel max-plus scan over chunks of giant documents.

For a vocabulary of merges, a sequence of pieces is the encoding exactly if each neighbouring two are: merged from
characters, no merge crosses their border. So the last piece of each prefix's encoding follows from those of shorter
prefixes, and encoding is a path of weight 0 in a lattice whose other steps weigh minus infinity. A border of two chunks has as
states the pieces that reach or cross it. A chunk yields the matrix of path weights from each state at its start to
each at its end; matrices combine by max-plus products, which are associative, in blocks and then over blocks; the one finite path gives each chunk
its entry and exit states, and each chunk is traced back on its own. Where white space or a character
outside the vocabulary stands, all paths meet, so a chunk's matrix needs work only near its ends, and its ids between the first and the last such
place are known at once: they are traced in the pass that makes the matrix, with those of each state's way to them.

Null and empty texts have no ids. Rows that repeat an id each get a row, null ids pass through, other columns are not read.
Only vocabularies of merges with identity normalisation are taken; anything else raises ValueError. No documents, no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 8192
GIANT = 2 * CHUNK
BLOCK = 64
KEPT = 200_000
SPACE = "▁"
NEVER = -np.inf


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = {k: v for k, v in _fields(f.read()) if k in (2, 3)}
        trainer, normalizer = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
        if trainer.get(3, 1) != 2 or normalizer.get(1) != b"identity" or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only merge vocabularies with identity normalisation and all white space kept are supported")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if trainer.get(35) else None
        self.unknown = sp.unk_id()
        self.byte_of = {i: b for b, i in enumerate(self.bytes or [])}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.longest = max(map(len, self.ids))
        covered = set("".join(self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with white space after other characters are not supported")
        #: Text between places that no piece crosses.
        outside = "\n" if "\n" not in covered else ""
        self.segment = re.compile(f"{SPACE}+[^{SPACE}{outside}]*|[^{SPACE}{outside}]+" + (f"|{outside}" if outside else ""))
        self.covered = covered
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self._fits: dict[tuple[str, str], bool] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def fits(self, a: str | None, b: str) -> bool:
        """Whether pieces a and b stay apart when their characters are merged together."""
        if a is None or a not in self.rank or b not in self.rank:
            return True
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        parts, border, rank = [*a, *b], len(a), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return border == 1 and len(parts) == 2
            if at + 1 == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at + 1 < border

    def last_pieces(self, text: str, start: int, end: int, before: str | None) -> dict[int, str]:
        """For each place up to ``end`` that a path from ``start`` (after piece ``before``) reaches: its last piece."""
        last: dict[int, str | None] = {start: before}
        ids, longest, known, fits, prefixes = self.ids, self.longest, self._fits.get, self.fits, self.prefixes
        for i in range(start, end):
            if i not in last:
                continue
            a = last[i]
            for j in range(i + 1, min(end, i + longest) + 1):
                t = text[i:j]
                if j not in last and (t in ids or j == i + 1):
                    ok = known((a, t))
                    if fits(a, t) if ok is None else ok:
                        last[j] = t
                if t not in prefixes:
                    break
        return last

    def path(self, text: str) -> list[str]:
        """The one path through text that starts and ends where all paths meet: longest pieces first, and back where none fits."""
        end, ids, longest, known, fits = len(text), self.ids, self.longest, self._fits.get, self.fits
        out: list[str] = []
        dead: set[tuple[int, str]] = set()
        i, j, last = 0, min(len(text), self.longest), None
        while i < end:
            while j > i:  # the longest piece that fits, a character at least
                t = text[i:j]
                if t in ids or j == i + 1:
                    ok = known((last, t))
                    if (fits(last, t) if ok is None else ok) and (not dead or (j, t) not in dead):
                        out.append(t)
                        i, j, last = j, min(end, j + longest), t
                        break
                j -= 1
            else:  # none: a shorter one than the last
                t = out.pop()
                dead.add((i, t))
                i, j = i - len(t), i - 1
                last = out[-1] if out else None
        return out

    def trace(self, last: dict[int, str], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> bytes:
        """Ids (little-endian 32-bit) of text that starts and ends where no piece crosses; segments are kept in two generations."""
        parts = self.segment.findall(text)
        out = list(map(self._new.get, parts))
        if None in out:
            for k, s in enumerate(parts):
                if out[k] is not None:
                    continue
                if (got := self._new.get(s)) is None:
                    if (got := self._old.get(s)) is None:
                        ids = self.to_ids(self.path(s))
                        got = struct.pack(f"<{len(ids)}i", *ids)
                    if len(s) < 64:
                        if len(self._new) >= KEPT:
                            self._old, self._new = self._new, {}
                        self._new[s] = got
                out[k] = got
        return b"".join(out)

    def lay(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def meets(self, text: str, i: int) -> bool:
        """Whether all paths meet at place i: white space begins there, or a character outside the vocabulary stands beside it."""
        a, b = text[i - 1], text[i]
        return (b == SPACE and a != SPACE) or a not in self.covered or b not in self.covered

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """Pieces (begin, end) that reach or cross a border of the text, in a fixed order."""
        if border <= 0:
            return [(0, 0)]
        if border >= len(text):
            border = len(text)
        out = []
        for i in range(max(0, border - self.longest), border):
            for j in range(border, min(len(text), i + self.longest) + 1):
                t = text[i:j]
                if t in self.ids or (j == i + 1 and t not in self.ids):
                    out.append((i, j))
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Chunk:
    """Characters ``start`` to ``end`` of a laid-out text, of which ``text`` holds these with a margin on both sides."""

    def __init__(self, v: Vocabulary, text: str, start: int, end: int, first: bool, last: bool):
        self.v, self.text, self.start, self.end = v, text, start, end
        self.entry = [(0, 0)] if first else v.states(text, start)
        self.exit = [(i, j) for i, j in v.states(text, end) if not last or j == len(text)]

    def _before(self, state: tuple[int, int]) -> str | None:
        return self.text[state[0] : state[1]] or None

    def _exits(self, last: dict[int, str]) -> np.ndarray:
        return np.array([0.0 if last.get(j) == self.text[i:j] else NEVER for i, j in self.exit])

    def matrix(self) -> np.ndarray:
        """Weights of paths from each entry state (row) to each exit state (column)."""
        reach = max([j for _, j in self.exit], default=self.end)
        return np.array([self._exits(self.v.last_pieces(self.text, s[1], reach, self._before(s))) for s in self.entry])

    def ids(self, entry: int, exit_: int) -> bytes:
        """Ids of the pieces that begin in this chunk, on the path between two states, where no two paths meet."""
        v, start, stop = self.v, self.entry[entry][1], self.exit[exit_][1]
        return np.array(v.to_ids(v.trace(v.last_pieces(self.text, start, stop, self._before(self.entry[entry])), start, stop)), "<i4").tobytes()

    def scan(self) -> tuple[np.ndarray, list[bytes], bytes, list[bytes]] | None:
        """Matrix, ids from each entry state to where all paths meet first, from there to where they meet last, and on to each exit state.

        None if they meet nowhere in the chunk: its ids then have to wait for its states.
        """
        v, reach = self.v, max([j for _, j in self.exit], default=self.end)
        low, high = max([j for _, j in self.entry]) + 1, self.end - 1
        a = next((i for i in range(low, high) if v.meets(self.text, i)), None)
        if a is None:
            return None
        b = next(i for i in range(high, a - 1, -1) if v.meets(self.text, i))
        into, heads = [], []
        for s in self.entry:
            last = v.last_pieces(self.text, s[1], a, self._before(s))
            into.append(0.0 if a in last else NEVER)
            heads.append(np.array(v.to_ids(v.trace(last, s[1], a)), "<i4").tobytes() if a in last else b"")
        last = v.last_pieces(self.text, b, reach, None)
        out = self._exits(last)
        tails = [np.array(v.to_ids(v.trace(last, b, j)), "<i4").tobytes() if w == 0 else b"" for (_, j), w in zip(self.exit, out)]
        return np.array(into)[:, None] + out[None, :], heads, v.segments(self.text[a:b]), tails


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i4").tobytes() + np.packbits(m > NEVER).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    rows, cols = np.frombuffer(data[:8], "<i4")
    bits = np.unpackbits(np.frombuffer(data[8:], np.uint8), count=int(rows) * int(cols)).reshape(rows, cols)
    return np.where(bits, 0.0, NEVER)


def _chunk_of(v: Vocabulary, r: dict) -> Chunk:
    return Chunk(v, r["text"], r["start"], r["end"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)


CHUNKS = "doc_id long, key string, block int, chunk int, chunks int, text string, start int, end int"


def _split(vocabulary: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in common.slices(batches, "text"):
            out = []
            for i, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), common.texts(batch, "text")):
                text = v.lay(text)
                n = max(1, len(text) // size)
                for c in range(n):
                    a, b = c * size, len(text) if c == n - 1 else (c + 1) * size
                    lo, hi = max(0, a - v.longest), min(len(text), b + v.longest)
                    out.append((i, key, c // BLOCK, c, n, text[lo:hi], a - lo, b - lo))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=[f.split()[0] for f in CHUNKS.split(", ")])

    return run


def _squeeze(ids: bytes) -> bytes:
    """Ids in little space: 16 bits each where they fit, compressed."""
    x = np.frombuffer(ids, "<i4")
    narrow = not len(x) or int(x.max()) < 1 << 16
    return bytes([narrow]) + zstandard.ZstdCompressor(level=1).compress(x.astype("<u2" if narrow else "<i4").tobytes())


def _unsqueeze(data: bytes) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, "<u2").astype("<i4").tobytes() if data[0] else raw


SCANNED = "doc_id long, key string, block int, chunk int, m binary, body binary, heads array<binary>, tails array<binary>, text string, start int, end int, chunks int"


def _scan(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in common.slices(batches, "text"):
            out = []
            for r in batch.to_pylist():
                c, place = _chunk_of(v, r), (r["doc_id"], r["key"], r["block"], r["chunk"])
                if (got := c.scan()) is None:
                    out.append((*place, _pack(c.matrix()), None, None, None, r["text"], r["start"], r["end"], r["chunks"]))
                else:
                    m, heads, middle, tails = got
                    out.append((*place, _pack(m), _squeeze(middle), heads, tails, None, None, None, None))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), types)], names=[f.split()[0] for f in SCANNED.split(", ")])

    return run


def _combine(table: pa.Table) -> pa.Table:
    """The product of a block's matrices."""
    rows = sorted(dict(zip(table.column("chunk").to_pylist(), table.column("m").to_pylist())).items())
    m = _unpack(rows[0][1])
    for _, x in rows[1:]:
        m = times(m, _unpack(x))
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "m": pa.array([_pack(m)], pa.binary())})


def _path(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """States at the borders of consecutive matrices on the finite path between two states."""
    back = [None] * len(matrices)
    reach = np.full(matrices[-1].shape[1], NEVER)
    reach[exit_] = 0
    for k in range(len(matrices) - 1, -1, -1):
        back[k] = reach
        reach = (matrices[k] + reach[None, :]).max(1)
    states = [entry]
    for m, rest in zip(matrices, back):
        way = m[states[-1]] + rest
        if way.max() == NEVER:
            raise ValueError("no path through the chunks")
        states.append(int(way.argmax()))
    return states


def _top(table: pa.Table) -> pa.Table:
    """States at the borders of a document's blocks."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("m").to_pylist()))
    matrices = [_unpack(m) for _, m in rows]
    total = np.zeros((1, 1))
    for m in matrices:
        total = times(total, m)
    s = _path(matrices, 0, int(total[0].argmax()))
    return pa.table({"key": pa.array([table.column("key")[0].as_py()] * len(rows), pa.string()), "block": pa.array([b for b, _ in rows], pa.int32()), "entry": pa.array(s[:-1], pa.int32()), "exit": pa.array(s[1:], pa.int32())})


def _inside(left: pa.Table, right: pa.Table) -> pa.Table:
    """States at the borders of a block's chunks."""
    rows = sorted(dict(zip(left.column("chunk").to_pylist(), left.column("m").to_pylist())).items())
    s = _path([_unpack(m) for _, m in rows], right.column("entry")[0].as_py(), right.column("exit")[0].as_py())
    return pa.table({"key": pa.array([left.column("key")[0].as_py()] * len(rows), pa.string()), "chunk": pa.array([c for c, _ in rows], pa.int32()), "entry": pa.array(s[:-1], pa.int32()), "exit": pa.array(s[1:], pa.int32())})


def _assemble(vocabulary: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A document's ids, once for each row that it was given in: what lies between its chunks' states, end to end."""
        v, parts, n = load(vocabulary), [], 0
        states = dict(zip(right.column("chunk").to_pylist(), zip(right.column("entry").to_pylist(), right.column("exit").to_pylist())))
        order = np.argsort(left.column("chunk").to_numpy(), kind="stable")
        before = -1
        for k in order.tolist():
            chunk = left.column("chunk")[k].as_py()
            n += chunk == 0
            if chunk == before:
                continue
            before = chunk
            entry, exit_ = states[chunk]
            if (body := left.column("body")[k].as_py()) is None:
                parts.append(_chunk_of(v, left.slice(k, 1).to_pylist()[0]).ids(entry, exit_))
            else:
                parts += [left.column("heads")[k][entry].as_py(), _unsqueeze(body), left.column("tails")[k][exit_].as_py()]
        return pa.table({"doc_id": pa.array([left.column("doc_id")[0].as_py()] * n, pa.int64()), "ids": pa.array([b"".join(parts)] * n, pa.binary())})

    return run


def encode_giants(docs: DataFrame, vocabulary: str, size: int = CHUNK) -> DataFrame:
    """(doc_id, ids as little-endian 32-bit integers) of ``docs(doc_id, text)``, by the scan over chunks.

    Text is cut and read once, where it lies: a chunk yields its matrix, and its ids but for the choice of its states, which the matrices make.
    Matrices, states and ids are shuffled; text is only where no two paths of a chunk meet.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256))
    chunks = docs.select("doc_id", key.alias("key"), "text").mapInArrow(_split(vocabulary, size), CHUNKS)
    scanned = common.materialize(chunks.mapInArrow(_scan(vocabulary), SCANNED), "scanned")
    matrices = scanned.select("key", "block", "chunk", "m")
    blocks = matrices.groupBy("key", "block").applyInArrow(_combine, "key string, block int, m binary")
    borders = blocks.groupBy("key").applyInArrow(_top, "key string, block int, entry int, exit int")
    inside = matrices.groupBy("key", "block").cogroup(borders.groupBy("key", "block")).applyInArrow(_inside, "key string, chunk int, entry int, exit int")
    bodies = scanned.drop("m", "block")
    return bodies.groupBy("key").cogroup(inside.groupBy("key")).applyInArrow(_assemble(vocabulary), "doc_id long, ids binary")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """(doc_id, ids binary, n_ids): documents up to ``giant`` characters are one chunk; giant ones are scanned in chunks."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in common.slices(batches, "text"):
            ids = [v.segments(v.lay(t)) for t in common.texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    small = docs.where(n <= giant).mapInArrow(whole, "doc_id long, ids binary")
    large = encode_giants(docs.where(n > giant), vocabulary, size)
    return small.unionAll(large).withColumn("n_ids", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in common.slices(batches, "ids"):
            raw = batch.column("ids").to_pylist()
            text = [v.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")

"""Media columns: ISO base media files in a binary column, described from their boxes alone.

``describe`` walks a file's nested boxes and decodes the sample tables of each track, and the runs of movie
fragments, into codec, duration and the byte ranges of keyframes without touching the payload; ``read_payload``
follows the tables and returns the stored bytes. ``describe_media`` does so for a binary column of any table.
``encode`` lays a payload out as an audio track of unsigned 8-bit samples (``raw ``), 64 bytes a sample-table
entry, in chunks, with sync samples marked; ``store_media`` makes such a column of whole texts.

Null text counts as empty; an empty text still stores 64 zero bytes. A null file has null results, a file that is
no whole container an ``error`` and otherwise nulls. Rows stay as they are: repeated rows and null ids each give
a row. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from . import common

UNIT = 64
#: Fixed values of the container: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Fixed values of the container: sample entries that hide a format, bytes of a sample entry before its boxes, durations that say nothing.
PROTECTED = {b"encv", b"enca", b"enct", b"encs"}
ENTRY_HEAD = {b"vide": 78, b"soun": 28}
UNKNOWN = {0, (1 << 32) - 1, (1 << 64) - 1}
#: Boxes in boxes; a deeper file counts as broken.
MAX_DEPTH = 32


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes, rate: int = 8000, per_chunk: int = 256, sync_every: int = 128) -> bytes:
    """A file with one track; ``payload`` must be a positive multiple of 64 bytes. Equal payloads, equal files."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    chunks = -(-n // per_chunk)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(payload) + (1 << 20) + chunks * 8 >= 1 << 32
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    syncs = range(1, n + 1, sync_every)

    def moov(base: int) -> bytes:
        runs = [(1, per_chunk, 1)] if n % per_chunk == 0 else ([(1, per_chunk, 1)] if chunks > 1 else []) + [(chunks, n % per_chunk, 1)]
        offsets = [base + i * per_chunk * UNIT for i in range(chunks)]
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(syncs)), struct.pack(f">{len(syncs)}I", *syncs)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(">I", chunks), struct.pack(f">{chunks}Q", *offsets)) if wide else _full(b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}I", *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQ", 0, 0, rate, n * UNIT), struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * UNIT), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, rate, n * UNIT), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(base) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, start of the body, end) of the boxes of one level. Broken sizes raise ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError(f"box header cut short at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box header cut short at {start}")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        elif size == 0:
            size = end - start
        stop = start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} has a wrong size")
        yield kind, start, body, stop
        start = stop


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, start of the body, end) of every box, nested ones and sample entries after their parent."""
    if path.count("/") >= MAX_DEPTH:
        raise ValueError("boxes are nested too deeply")
    for kind, _, body, stop in boxes(data, start, end):
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        elif kind == b"stsd":
            yield from walk(data, body + 8, stop, here)


def _ints(data: bytes, at: int, stop: int, n: int, code: str) -> np.ndarray:
    kind = np.dtype(">" + code)
    if at + n * kind.itemsize > stop:
        raise ValueError("a sample table is cut short")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _codec(data: bytes, at: int, stop: int, handler: bytes) -> str:
    """The first sample entry's kind; of a protected entry the format that it hides."""
    kind, _, body, end = next(boxes(data, at + 8, stop), (None, 0, 0, 0))
    if kind is None:
        raise ValueError("no sample entry")
    if kind in PROTECTED:
        for child, _, a, b in boxes(data, body + ENTRY_HEAD.get(handler, 8), end):
            if child == b"sinf":
                kind = next((data[c : c + 4] for leaf, _, c, _ in boxes(data, a, b) if leaf == b"frma"), kind)
    return kind.decode("latin-1")


def _sizes(data: bytes, found: dict[str, tuple[int, int]]) -> np.ndarray:
    if "stz2" in found:
        at, stop = found["stz2"]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            pairs = _ints(data, at + 12, stop, (n + 1) // 2, "u1")
            return np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n]
        if bits not in (8, 16):
            raise ValueError("sample sizes of an unknown width")
        return _ints(data, at + 12, stop, n, f"u{bits // 8}")
    at, stop = found["stsz"]
    unit, n = struct.unpack_from(">II", data, at + 4)
    if unit and unit * n > len(data):
        raise ValueError("the sample tables do not fit the file")
    return np.full(n, unit, np.int64) if unit else _ints(data, at + 12, stop, n, "u4")


def _track(data: bytes, start: int, end: int) -> dict:
    found: dict[str, tuple[int, int]] = {}
    for path, a, b in walk(data, start, end):
        found.setdefault(path.rpartition("/")[2], (a, b))
    if "stz2" in found:
        found.setdefault("stsz", found["stz2"])
    for need in ("mdhd", "stsd", "stts", "stsc", "stsz"):
        if need not in found:
            raise ValueError(f"no {need} box")
    if "co64" not in found and "stco" not in found:
        raise ValueError("no chunk offsets")
    number = None
    if "tkhd" in found:
        at, _ = found["tkhd"]
        (number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    handler = data[found["hdlr"][0] + 8 : found["hdlr"][0] + 12] if "hdlr" in found else b""
    at, _ = found["mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, stop = found["stts"]
    times = _ints(data, at + 8, stop, 2 * struct.unpack_from(">I", data, at + 4)[0], "u4")
    sizes = _sizes(data, found)
    at, stop = found.get("co64") or found["stco"]
    offsets = _ints(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0], "u8" if "co64" in found else "u4")
    at, stop = found["stsc"]
    runs = _ints(data, at + 8, stop, 3 * struct.unpack_from(">I", data, at + 4)[0], "u4").reshape(-1, 3)
    lasting = np.diff(np.append(runs[:, 0], len(offsets) + 1))
    if (lasting < 0).any() or lasting.sum() != len(offsets) or (lasting * runs[:, 1]).sum() != len(sizes):
        raise ValueError("the sample tables do not fit the file")
    per = np.repeat(runs[:, 1], lasting)
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], np.cumsum(per)])
    ends = offsets + before[first[1:]] - before[first[:-1]]
    starts = np.repeat(offsets - before[first[:-1]], per) + before[:-1]
    if (offsets < 0).any() or (ends > len(data)).any():
        raise ValueError("the sample tables do not fit the file")
    if "stss" in found:
        at, stop = found["stss"]
        sync = np.unique(_ints(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0], "u4")) - 1
        sync = sync[(sync >= 0) & (sync < len(sizes))]
    else:
        sync = np.arange(len(sizes))
    return {
        "id": number,
        "handler": handler.decode("latin-1"),
        "codec": _codec(data, *found["stsd"], handler),
        "timescale": scale,
        "duration": duration,
        "total": int((times[::2] * times[1::2]).sum()),
        "samples": len(sizes),
        "chunks": list(zip(offsets.tolist(), ends.tolist())),
        "keyframes": list(zip(starts[sync].tolist(), (starts + sizes)[sync].tolist())),
    }


def _run(data: bytes, at: int, stop: int, base: int, where: int, default: tuple[int, int, int], track: dict) -> int:
    """Adds one run of a fragment's samples to its track; returns where its bytes end."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    duration, size, kind = default
    if flags & 1:
        where, at = base + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & 4:
        (first,), at = struct.unpack_from(">I", data, at), at + 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if n > len(data):
        raise ValueError("a run does not fit the file")
    values = _ints(data, at, stop, n * len(fields), "u4").reshape(n, len(fields))
    column = {f: values[:, i] for i, f in enumerate(fields)}
    sizes = column.get(0x200, np.full(n, size, np.int64))
    marks = column.get(0x400, np.full(n, kind, np.int64)).copy()
    if first is not None and n and 0x400 not in column:
        marks[0] = first
    ends = where + np.cumsum(sizes)
    end = int(ends[-1]) if n else where
    if where < 0 or end > len(data):
        raise ValueError("a run does not fit the file")
    key = np.flatnonzero(marks & 0x10000 == 0)
    track["samples"] += n
    track["total"] += int(column[0x100].sum()) if 0x100 in column else n * duration
    track["chunks"].append((where, end))
    track["keyframes"] += zip((ends - sizes)[key].tolist(), ends[key].tolist())
    return end


def _fragment(data: bytes, moof: int, body: int, stop: int, tracks: dict[int, dict], defaults: dict[int, tuple[int, int, int]]) -> None:
    end = moof
    for number, (kind, _, a, b) in enumerate(x for x in boxes(data, body, stop) if x[0] == b"traf"):
        track = None
        for leaf, _, at, last in boxes(data, a, b):
            if leaf == b"tfhd":
                flags, own = struct.unpack_from(">II", data, at)
                if own not in tracks:
                    raise ValueError(f"a fragment of track {own}, which is not there")
                track, default, at = tracks[own], list(defaults.get(own, (0, 0, 0))), at + 8
                base = moof if flags & 0x20000 or not number else end
                if flags & 1:
                    (base,), at = struct.unpack_from(">Q", data, at), at + 8
                at += 4 if flags & 2 else 0
                for i, f in enumerate((8, 16, 32)):
                    if flags & f:
                        (default[i],), at = struct.unpack_from(">I", data, at), at + 4
                end = base
            elif leaf == b"trun":
                if track is None:
                    raise ValueError("a run before its fragment's header")
                end = _run(data, at, last, base, end, tuple(default), track)


def describe(data: bytes) -> dict:
    """The tracks of a file: codec, time scale, duration, samples, byte ranges of chunks and keyframes; those of the first also by themselves. No sample is decoded."""
    try:
        tracks, defaults, moofs = [], {}, []
        for kind, start, body, stop in boxes(data):
            if kind == b"moof":
                moofs.append((start, body, stop))
            if kind != b"moov":
                continue
            for inner, _, a, b in boxes(data, body, stop):
                if inner == b"trak":
                    tracks.append(_track(data, a, b))
                elif inner == b"mvex":
                    for leaf, _, c, _ in boxes(data, a, b):
                        if leaf == b"trex":
                            own, _, *default = struct.unpack_from(">5I", data, c + 4)
                            defaults[own] = tuple(default)
        if not tracks:
            raise ValueError("no track")
        by_id = {t["id"]: t for t in tracks}
        for moof in moofs:
            _fragment(data, *moof, by_id, defaults)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box is cut short: {e}") from e
    for t in tracks:
        total = t.pop("total")
        t["duration"] = total if t["duration"] in UNKNOWN else t["duration"]
    return {**tracks[0], "tracks": tracks}


def read_payload(data: bytes, info: dict | None = None) -> bytes:
    """The stored bytes of all tracks, one track after the other."""
    return b"".join(data[a:b] for t in (info or describe(data))["tracks"] for a, b in t["chunks"])


def _ms(track: dict) -> int:
    return track["duration"] * 1000 // max(1, track["timescale"])


def feature(info: dict) -> str:
    """Codec, duration in ms, samples, keyframes, and the first and last keyframe's byte ranges of the first track, as one string."""
    keys = info["keyframes"]
    ranges = f"{keys[0][0]}-{keys[0][1]},{keys[-1][0]}-{keys[-1][1]}" if keys else ""
    return f"{info['codec'].strip()};ms={_ms(info)};n={info['samples']};key={len(keys)};at={ranges}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media file (``media``, binary) of each whole text. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw = [t.encode("utf-8", "surrogatepass") for t in common.texts(batch, "text")]
            columns = [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(pad(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACK = pa.struct([("id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", _RANGES)])
DESCRIPTION = pa.schema([("media_bytes", pa.int64()), ("feature", pa.string()), ("tracks", pa.list_(_TRACK)), ("error", pa.string())])
DIGESTS = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string())])


def describe_media(df: DataFrame, media_col: str = "media", digests: bool = False) -> DataFrame:
    """The table with its files' description in place of the files: size, feature, tracks and, for broken files, the error.

    ``digests`` reads the payload back through the sample tables and adds its size and SHA-256, the CRC-32 of its last 64 bytes and
    the file's SHA-256. A column of ``df`` with the name of a result gives way to it.
    """
    new = pa.schema([*DESCRIPTION, *(DIGESTS if digests else [])])
    others = [c for c in df.columns if c not in {media_col, *new.names}]

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        row = {"media_bytes": len(data)}
        try:
            info = describe(data)
        except ValueError as e:
            return row | {"error": str(e)}
        row |= {"feature": feature(info), "tracks": [
            {"id": t["id"], "handler": t["handler"], "codec": t["codec"].strip(), "duration_ms": _ms(t), "samples": t["samples"], "keyframes": [{"start": a, "end": b} for a, b in t["keyframes"]]}
            for t in info["tracks"]
        ]}
        if digests:
            back = read_payload(data, info)
            row |= {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]), "media_sha256": hashlib.sha256(data).hexdigest()}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, media_col):
            rows = [one(d) for d in batch.column(media_col).to_pylist()]
            found = [pa.array([r.get(f.name) for r in rows], f.type) for f in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *found], names=[*others, *new.names])

    kept = df.select(*others, F.col(media_col).cast("binary").alias(media_col))
    return kept.mapInArrow(run, StructType([*(df.schema[c] for c in others), *from_arrow_schema(new)]))

import base64
import gc
import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenrank.llm import media, packing, warc, wordbpe
from lumenrank.llm.queries import vocabulary

ODD = ["", None, "a", "naïve – café €5", "日本語 text", "áb", "x\x1cy", "<|endoftext|> z", "İstanbul ΣΑΣ", "it's we're I'll 12 3!!", "  a b", "word " * 3000]


def docs(spark, texts, extra=True):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), wordbpe.load(path)
    rnd = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("abcXYZ éß'.,-!\n\t0189ñ") for _ in range(80)) for _ in range(300)]
    for t, ids in zip(texts, fast.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_plan_fills_exactly_where_it_can():
    assert packing.plan({1000: 4, 1048: 2, 500: 2, 24: 4, 2048: 3}) == [((2048,), 3), ((1048, 1000), 2), ((1000, 1000, 24, 24), 1), ((500, 500, 24, 24), 1)]
    assert packing.plan({}) == [] and packing.plan({7: 3}) == [((7, 7, 7), 1)]
    rnd = random.Random(2)
    for _ in range(30):
        h = {rnd.randint(1, 2048): rnd.randint(1, 9) for _ in range(rnd.randint(1, 60))}
        made = packing.plan(h)
        used = {}
        for lengths, n in made:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == h


def test_workers_keep_no_tokenizer(spark):
    """Workers wait for later tasks: a tokenizer with its words would stay in each of them beside later stages."""

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "WordTokenizer" for x in gc.get_objects())])], names=["n"])

    packing.pieces(docs(spark, ODD * 4).repartition(4), vocabulary("word_bpe_49k.json"))
    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_pack(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ODD + ["same words here"] * 50
    got = packing.pack(docs(spark, texts).repartition(3), vocabulary("word_bpe_49k.json")).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == list(range(0, len(ids), 2048))
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.pack(docs(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_media(spark):
    for n in (64, 128, 64 * 256, 64 * 257, 64 * 1000):
        data = bytes(random.Random(n).randbytes(n))
        stored = media.encode(data)
        info = media.describe(stored)
        assert media.read_payload(stored, info) == data and info["codec"] == "raw " and info["duration"] == n
        assert len(info["keyframes"]) == -(-n // 64 // 128) and all(stored[a:b] in data for a, b in info["keyframes"])
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError):
            media.encode(bad)
    with pytest.raises(ValueError):
        media.describe(media.encode(bytes(64))[:-1])
    stored = media.store_media(docs(spark, ["", None, "é" * 32, "é" * 32, "x" * 65]))
    got = {r["doc_id"]: r for r in media.describe_media(stored, digests=True).collect()}
    assert [got[i]["payload_bytes"] for i in range(5)] == [64, 64, 64, 64, 128] and got[2]["media_sha256"] == got[3]["media_sha256"]
    assert got[4]["payload_sha256"] == hashlib.sha256(b"x" * 65 + bytes(63)).hexdigest() and got[4]["tail_crc32"] == zlib.crc32(b"x" + bytes(63))
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    assert all(got[i]["media_bytes"] == len(f) and got[i]["media_sha256"] == hashlib.sha256(f).hexdigest() for i, f in files.items())
    assert got[4]["feature"] == "raw;ms=16;n=2;key=1;at=%d-%d,%d-%d" % ((len(files[4]) - 128, len(files[4]) - 64) * 2)  # the first keyframe is the last
    assert media.describe_media(media.store_media(docs(spark, []))).count() == 0


def _trak(number, handler, entry, sizes, offsets, per, sync=None, duration=0):
    """A track whose chunks hold ``per`` samples each."""
    full, box = media._full, media._box
    tables = [
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, len(sizes), 10)),
        full(b"stsc", struct.pack(">IIII", 1, 1, per, 1)) if offsets else full(b"stsc", bytes(4)),
        full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
        full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets)),
    ]
    if sync is not None:
        tables.append(full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)))
    head = full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, duration, 0))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0))
    return box(b"trak", tkhd, box(b"mdia", head, full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", box(b"stbl", *tables))))


def _two_tracks():
    """Video of 4 samples in 2 chunks, protected, keyframes 1 and 3; audio of 2 samples; chunks alternate."""
    box, full = media._box, media._full
    hidden = box(b"sinf", box(b"frma", b"avc1"))
    video, audio = box(b"encv", bytes(78), hidden), box(b"mp4a", bytes(28), full(b"esds", bytes(3)))
    data = bytes(range(100))
    for base in (0, None):
        at = 0 if base == 0 else len(moov) + 8
        v = _trak(1, b"vide", video, [5, 6, 7, 8], [at, at + 31], 2, [1, 3], 40)
        a = _trak(2, b"soun", audio, [20, 30], [at + 11, at + 46], 1, None, 0)
        moov = box(b"moov", v, a)
    return moov + box(b"mdat", data), len(moov) + 8, data


def _fragments(sizes, at_moof):
    """A file without samples of its own and two fragments; sizes in the run, keyframes by flags."""
    box, full = media._box, media._full
    trex = full(b"trex", struct.pack(">5I", 7, 1, 25, 0, 0x10000))
    out = box(b"moov", _trak(7, b"vide", box(b"hvc1", bytes(78)), [], [], 1), box(b"mvex", trex))
    keys, payload = [], b""
    for i in range(2):
        def moof(offset):
            run = full(b"trun", struct.pack(f">IiI{len(sizes)}I", len(sizes), offset, 0, *sizes), flags=0x1 | 0x4 | 0x200)
            return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000 if at_moof else 0), run))
        size = len(moof(0))
        body = bytes([i + 1]) * sum(sizes)
        start = len(out) + size + 8
        out += moof(size + 8) + box(b"mdat", body)
        keys.append((start, start + sizes[0]))
        payload += body
    return out, keys, payload


def test_media_tracks_and_fragments(spark):
    two, at, data = _two_tracks()
    video, audio = media.describe(two)["tracks"]
    assert (video["codec"], audio["codec"], video["handler"], audio["id"]) == ("avc1", "mp4a", "vide", 2)
    assert video["keyframes"] == [(at, at + 5), (at + 31, at + 38)] and audio["keyframes"] == [(at + 11, at + 31), (at + 46, at + 76)]
    assert (video["duration"], audio["duration"]) == (40, 20)  # a duration of 0 is taken from the samples
    assert media.read_payload(two) == data[:11] + data[31:46] + data[11:31] + data[46:76]
    for at_moof in (True, False):
        parts, keys, payload = _fragments([3, 4, 9], at_moof)
        info = media.describe(parts)
        assert info["keyframes"] == keys and info["samples"] == 6 and info["duration"] == 150 and media.read_payload(parts) == payload
    deep = b""
    for _ in range(2000):
        deep = media._box(b"moov", deep)
    broken = [b"", b"abc", two[:-1], deep, two.replace(b"stsz", b"xxxx"), media._box(b"moov", media._box(b"trak", media._full(b"mdhd")))]
    rnd = random.Random(3)
    for _ in range(400):  # whatever the bytes are, a description or a ValueError
        bad = bytearray(rnd.choice([two, parts]))
        for _ in range(3):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        try:
            media.describe(bytes(bad))
        except ValueError:
            pass
    rows = [(i, f, "x", 1) for i, f in enumerate([two, None, *broken])]
    got = {r["k"]: r for r in media.describe_media(spark.createDataFrame(rows, "k int, media binary, feature string, other int"), digests=True).collect()}
    assert [t["codec"] for t in got[0]["tracks"]] == ["avc1", "mp4a"] and got[0]["error"] is None and got[0]["other"] == 1
    assert got[1]["media_bytes"] is None and got[1]["error"] is None and got[1]["feature"] is None
    assert all(got[i]["error"] and got[i]["tracks"] is None and got[i]["media_bytes"] == len(broken[i - 2]) for i in range(2, len(rows)))


def test_zip_directories():
    for force in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.comment = b"PK\x05\x06 not the end"
            with z.open(zipfile.ZipInfo("a/b.txt"), "w", force_zip64=force) as f:
                f.write(b"hello")
            z.writestr("c", b"x" * 100, zipfile.ZIP_DEFLATED)
        size = len(raw.getvalue())
        found = {m.name: m for m in warc.members(raw, size)}
        at = warc.data_start(raw, found["a/b.txt"])
        assert raw.getvalue()[at : at + found["a/b.txt"].size] == b"hello"
        with pytest.raises(ValueError):
            warc.data_start(raw, found["c"])
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)


def test_zip64_end_record():
    """Counts beyond 16 bits only stand in the ZIP64 end record."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(65537):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    assert len(warc.members(raw, len(raw.getvalue()))) == 65537


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, None, "aa"), (2, "http://x", "aa"), (9, "u", None), (None, "u", ""), (7, "u", "zz"), (7, "u", "zz"), (8, "w\n", "zz"), (None, "q", "only"), (10, "é", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(5, 2, "revisit", 2), (2, 2, "response", None), (9, 0, "response", None), (None, 0, "revisit", 9), (7, 2, "response", None), (7, 2, "response", None), (8, 2, "revisit", 7), (None, 4, "response", None), (10, 10000, "response", None)], key=str)
    small = warc.round_trip(pages, min_revisit_bytes=3).where("record_type = 'revisit'")
    assert small.count() == 0 and warc.round_trip(pages.limit(0)).count() == 0
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=1)
    paths = [r["path"].removeprefix("file://") for r in manifest.collect()]
    assert sum(r["records"] for r in manifest.collect()) == len(rows) == len(paths)
    with zipfile.ZipFile(paths[0]) as z:  # other readers can open what is written
        record = gzip.decompress(z.read(warc.DATA))
        assert record.startswith(b"WARC/1.1\r\n") and z.getinfo(warc.DATA).compress_type == 0
    parsed = warc.parse_record(record)
    if parsed["warc-type"] == "response":
        assert parsed["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(parsed["payload"]).digest()).decode()

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenrank.llm import components, embeddings, minhash, suffixes
from lumenrank.llm.hashing import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def reach(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words(rnd, n):
    return [rnd.choice(["the", "and", "of"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def edited(rnd, base, n):
    out = list(base)
    for _ in range(n):
        out[rnd.randrange(len(out))] = "".join(rnd.choice("xyz") for _ in range(6))
    return out


def texts():
    rnd = random.Random(7)
    out = ["", None, "   \n", "one", "ONE", "one two three", "One\ttwo\n three", "a b c d e", "a b c d e f"]
    base = words(rnd, 120)
    out += [" ".join(edited(rnd, base, rnd.randint(0, 6))) for _ in range(60)]  # links to some of the group only
    base = words(rnd, 3000)
    out += [" ".join(edited(rnd, base, 9)) for _ in range(4)] + [" ".join(base)] * 3
    out += [" ".join(words(rnd, rnd.randint(5, 80))) for _ in range(40)]
    return out


def true_sets(ts):
    out = []
    for t in ts:
        w = WORD.findall((t or "").encode().translate(LOWER))
        out.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_shingles():
    ts = texts()
    assert [len(s) for s in shingle_sets([t or "" for t in ts])] == [len(s) for s in true_sets(ts)]


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    ts = texts()
    sets = true_sets(ts)
    links = [(i, j) for i in range(len(ts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = reach(range(len(ts)), links)
    rows = [(i, t, "x", 1) for i, t in enumerate(ts)] + [(None, ts[7], "x", 1), (7, ts[7], "x", 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string, n long"), 85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 85).count() == 0


def test_ids_that_stand_for_different_texts(spark):
    """A node for each id: it links by each of its texts, and each row gets the id's one component."""
    a, b, c = ("one two three four five six " + w for w in ("seven eight", "other words here", "quite another thing"))
    rows = [(0, b), (1, a), (1, b), (2, a), (3, c), (3, c), (4, None), (4, c), (5, "lone text of five words")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = {t: len(s) for t, s in zip((a, b, c, None), true_sets([a, b, c, None]))}
    want = [(0, n[b], 0, True), (1, n[a], 0, False), (1, n[b], 0, False), (2, n[a], 0, False), (3, n[c], 3, True), (3, n[c], 3, True), (4, 0, 3, False), (4, n[c], 3, False), (5, 1, 5, True)]
    assert got == sorted(want)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (minhash.merge(minhash.sketch(np.unique(a)), minhash.sketch(np.unique(b))) == minhash.sketch(both)).all()
    grid = np.linspace(0, 1, 101)
    for share in (0.3, 0.6, 0.9):
        k = int(4000 * share / (1 + share))
        x, y = both[: 2000], np.concatenate([both[2000 - k : 2000], both[2000 : 4000 - k]])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        s, t = minhash.sketch(x), minhash.sketch(y)
        ll = minhash.likelihood(*(np.array([v]) for v in ((s > t).sum(), (s < t).sum(), (s == t).sum())), np.array([len(x)]), np.array([len(y)]), grid)[0]
        assert abs(grid[ll.argmax()] - true) < 0.2


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(df).collect()}
    want = reach({x for p in links if None not in p for x in p}, [p for p in links if None not in p])
    linked = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def brute_cut(rows):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, t in rows:
        raw = (t or "").encode()
        cut = np.zeros(len(raw) + 1, int)
        if i is not None:
            for p in range(len(raw) - 49):
                if first[raw[p : p + 50]] < i:
                    cut[p] += 1
                    cut[p + 50] -= 1
        cut = np.cumsum(cut[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 5, 1024])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rnd = random.Random(hot)
    passage = "".join(rnd.choice("abcdefgh é") for _ in range(180))
    rows = [(0, ""), (1, None), (2, "x" * 49), (3, "x" * 50), (4, "x" * 120), (5, "y" * 200), (6, "y" * 60 + "z" + "y" * 60), (7, "short"), (8, "ab" * 100), (9, "ba" * 100)]
    for i in range(10, 40):
        a, b = sorted(rnd.randrange(len(passage)) for _ in range(2))
        rows.append((i, "".join(rnd.choice("uvwxyz") for _ in range(rnd.randrange(60))) + passage[a:b] + "".join(rnd.choice("uvwxyz") for _ in range(rnd.randrange(60)))))
    rows += [(40, passage), (41, passage), (41, passage), (None, passage), (42, "\x00" * 80), (43, "\x00" * 55)]
    rnd.shuffle(rows)
    got = suffixes.repeated_passages(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, bucket int"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute_cut(rows)))
    cut = suffixes.cut_passages(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, bucket int"))
    assert cut.count() == len(rows) and cut.columns == ["doc_id", "text", "bucket"] and {r["bucket"] for r in cut.collect()} == {5}
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_documents_in_one_bucket(spark):
    """Ids of one document bucket, a passage in different surroundings: each gram bucket gets a single run."""
    rnd = random.Random(12)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(60))
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    step = suffixes.bucket_count(docs)
    rows = [(step * i, "".join(rnd.choice("uvwxyz") for _ in range(40)) + passage + "".join(rnd.choice("uvwxyz") for _ in range(40))) for i in range(5)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, docs.schema))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute_cut(rows)))


def test_settled_windows_go_to_their_documents():
    """What needs no merge is not the work of one bucket."""
    passage = "shared passage of more than fifty bytes that many documents have, word for word"
    buckets = 7
    ids = list(range(40))
    data, starts, size = suffixes._laid([passage] * 40)
    t, q, a, b, h = suffixes.anchors(data, starts, size)
    said = np.unique(suffixes._key(h, buckets) << 1)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([passage] * 40)], names=["doc_id", "text"])
    found = suffixes._occurrences(batch, np.repeat(ids, len(said)), np.tile(said, 40), buckets)
    settled = [(x[0], suffixes.unpack_run(x[1])["docs"]) for x in suffixes._entries(*found, buckets) if not len(suffixes.unpack_run(x[1])["lcp_r"])]
    assert len(settled) == buckets and all((d % buckets == at).all() for at, d in settled) and len(np.unique(np.concatenate([d for _, d in settled]))) == 39


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(5)
    runs, every = [], []
    for n in (0, 1, 7, 200, 33):
        rows = np.frombuffer(b"".join(sorted(bytes(rng.integers(97, 99, 13, dtype=np.uint8)) for _ in range(n))), np.uint8).reshape(n, 13)
        lcp, rest = suffixes.front_code(rows) if n else (np.zeros(0, np.uint8), b"")
        if n:
            assert (suffixes.front_decode(lcp, np.frombuffer(rest, np.uint8), 13) == rows).all()
        runs.append((suffixes.words(rows), lcp.tolist()))
        every.append([r.tobytes() for r in rows])
    which, place, lcp = suffixes.merge(runs, 13)
    merged = [every[w][p] for w, p in zip(which, place)]
    assert merged == sorted(x for r in every for x in r)
    for a, b, n in zip(merged, merged[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == 13 or a[n] != b[n])


@pytest.mark.parametrize("flat", [256, 1])
def test_embeddings(spark, monkeypatch, flat):
    monkeypatch.setattr(embeddings, "FLAT", flat)
    monkeypatch.setattr(embeddings, "CAP", 60)
    monkeypatch.setattr(embeddings, "TARGET", 80)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = base[0] + 0.08 * rng.normal(size=(90, 16))
    rest = base[1:40] + 0.05 * rng.normal(size=(39, 16))
    x = np.concatenate([base, near, rest, np.repeat(base[5:6], 20, 0)]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v], int(i) % 2) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [None] + [1.0] * 15, 0), (1003, [float("nan")] + [1.0] * 15, 0), (1004, [1.0, 2.0], 0), (1005, [1.0, 2.0], 0), (1006, rows[0][1], None), (None, rows[0][1], 0), (1007, [], 1), (1008, [float("inf")] * 16, 1)]
    got = {}
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd + rows[:1]], "vec_id long, embedding array<float>, label int, component_id string")
    out = embeddings.near_vectors(df).collect()
    assert len(out) == len(rows) + len(odd) + 1
    for r in out:
        if r["vec_id"] is not None:
            got[r["vec_id"]] = (r["n_links"], r["component_id"], r["kept"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    lab = np.arange(len(x)) % 2
    g = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(g, False)
    want = reach(range(len(x)), np.argwhere(np.triu(g)).tolist())
    found = sum(min(got[i][0], int(g[i].sum())) for i in range(len(x)))
    assert found >= 0.97 * g.sum() and all(got[i][0] <= g[i].sum() for i in range(len(x)))
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) >= 0.97
    for i in (1000, 1001, 1002, 1003, 1006, 1007, 1008):
        assert got[i] == (0, i, True)
    assert got[1004] == (1, 1004, True) and got[1005] == (1, 1004, False)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_without_links_are_searched_once(spark, monkeypatch):
    searches, recall = [], []
    search, audit = embeddings.find_links, embeddings.audit
    monkeypatch.setattr(embeddings, "find_links", lambda *a: searches.append(1) or search(*a))
    monkeypatch.setattr(embeddings, "audit", lambda *a: recall.append(audit(*a)) or recall[-1])
    x = np.random.default_rng(3).normal(size=(60, 24))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["kept"]) for r in embeddings.near_vectors(df).collect()} == {(0, True)}
    assert searches == [1] and recall == [1.0]
    monkeypatch.setattr(embeddings, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        embeddings.near_vectors(df)


def test_vectors_are_compared_as_doubles(spark):
    """Components beyond 32 bits, and a cosine that 32 bits would round over the threshold."""
    rows = [(1, [1e60, 2e60], "a"), (2, [1e60, 2.0000001e60], "a"), (3, [0.0, 1e-300], "a"), (4, [0.0, 5e-300], "a"), (5, [1e60, -1e60], "a"), (5, [1.0, 1.0], "a"), (5, [1e60, -1e60], "a")]
    for i, c in ((10, 0.98 - 1e-10), (12, 0.98 + 1e-10)):
        rows += [(i, [1.0, 0.0], str(i)), (i + 1, [c, math.sqrt(1 - c * c)], str(i))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 1 and got[10] == got[11] == 0 and got[12] == got[13] == 1

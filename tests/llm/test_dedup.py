"""SimHash, embedding and passage deduplication against plain versions."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import components as cc
from textloom.llm import embedding_dedup as ed
from textloom.llm import simhash as sh
from textloom.llm import suffix_dedup as sd


def plain_components(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(links + links[:9] + [(None, 3)], "u long, v long")).collect()))
    want = plain_components(341, links)
    for i in range(341):
        assert got.get(i, i) == want[i]
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_print(text):
    words = [w for w in bytes(text or "", "utf-8").lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [
    None, "", " \t\n", "one", "One  TWO three", "a b c d", "A B\x0bC\x0cD", "ÄÖ ab\u00a0c d e", "x " * 70000, "long" * 20000,
    "the quick brown fox jumps over the lazy dog again and again", "a b c d e a b c d e a b c d",
]


def test_fingerprint():
    for t in TEXTS:
        if t is None or len(t) < 5000:
            assert sh.fingerprint((t or "").encode()) == plain_print(t), t
    assert sh.fingerprint(("x " * 70000).encode()) == xxhash.xxh64_intdigest(b"x x x x", 42)


def test_gray_order_search():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    codes = np.unique(np.concatenate([[b ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, m))) for m in rng.integers(0, 9, 60)] for b in base]))
    cut = len(codes) // 3
    want = {(i, j) for i, j in itertools.combinations(range(len(codes)), 2) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    i, j = sh.search(sh.Node(codes), sh.Node(codes), 4, True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    i, j = sh.search(sh.Node(codes[:cut]), sh.Node(codes[cut:]), 4, False)
    assert set(zip(i.tolist(), (j + cut).tolist(), strict=True)) == {(a, b) for a, b in want if a < cut <= b}


@pytest.mark.parametrize("tile", [4, 1024])
def test_near_duplicates(spark, tile):
    rnd = random.Random(tile)
    words = [f"w{k}" for k in range(900)]
    docs = list(TEXTS)
    for _ in range(12):
        text = rnd.choices(words, k=120)
        for _ in range(rnd.randrange(1, 9)):
            copy = list(text)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append(" ".join(copy))
    docs += docs[3:6]
    df = spark.createDataFrame([(i + 10, t, "x", 1) for i, t in enumerate(docs)] + [(None, "one", "x", 1)],
                               "doc_id long, text string, code string, component_id int")
    got = sh.near_duplicates(df, 4, tile).collect()
    prints = [plain_print(t) for t in docs]
    links = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = plain_components(len(docs), links)
    assert len(got) == len(docs) + 1
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id - 10]:016x}" and r.component_id == want[r.doc_id - 10] + 10
        else:
            assert r.component_id == 13
    assert sh.near_duplicates(df.limit(0), 4).count() == 0


def test_hot_group_spans_tiles(spark):
    """Codes that differ in few bits only: one block value holds nearly all of them."""
    rnd = random.Random(9)
    codes = sorted({sum(1 << b for b in rnd.sample(range(20), rnd.randrange(6))) for _ in range(500)})
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, id long").repartition(5)
    got = dict(map(tuple, cc.components(sh.near_codes(df, 2, 16)).collect()))
    links = [(i, j) for i, j in itertools.combinations(range(len(codes)), 2) if (codes[i] ^ codes[j]).bit_count() <= 2]
    want = plain_components(len(codes), links)
    assert all(got.get(i, i) == want[i] for i in range(len(codes)))


def test_quantised_bounds_are_safe():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 33))
    q, scale, error = ed.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ed.int_products(q, q) * scale[:, None] * scale
    assert (np.abs(near - unit @ unit.T) <= error[:, None] + (1 + error[:, None]) * error + 1e-9).all()
    wide = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (ed.int_products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(8, 16))
    for i in range(160):
        v = base[i % 8] * rng.uniform(0.1, 50) + rng.normal(size=16) * (0.3 if i % 3 else 0.05)
        rows.append((i + 1000, [float(x) for x in v], int(i % 8 // 4)))
    rows += [(5000 + k, rows[3][1], rows[3][2]) for k in range(6)]
    rows += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [None] + [1.0] * 15, 1), (6003, [float("nan")] * 16, 1),
             (6004, [float("inf")] * 16, 1), (6005, rows[0][1], None), (6006, [], 1), (6007, [1.0], 1), (6008, [2.0], 1),
             (6009, [x * 1e200 for x in rows[0][1]], rows[0][2]), (6010, [x * 1e-200 for x in rows[0][1]], rows[0][2]),
             (6011, [-0.0, 1.0], 0), (6012, [0.0, 1.0], 0), (3, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, ok string")
    got = {r.vec_id: r for r in ed.near_vectors(df, 0.93, 16).collect()}
    assert len(got) == len(rows)

    def fine(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = (np.array(v[1]) / np.abs(v[1]).max() for v in (a, b))
            if x @ y / np.sqrt(x @ x * (y @ y)) >= 0.93:
                links.append((i, j))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    want = plain_components(len(rows), [(place[i], place[j]) for i, j in links])
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert g.n_links == sum(i in x for x in links)
        assert g.component_id == rows[order[want[place[i]]]][0] and g.kept == (g.component_id == g.vec_id)
    assert ed.near_vectors(df.limit(0)).count() == 0


def plain_removed(docs, length):
    """(removed flags by byte) of (doc_id, bytes) rows."""
    least = {}
    for d, b in docs:
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                least[s] = min(d, least.get(s, d))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def check_removal(spark, docs, length, gram):
    texts = [(d, t) for d, t in docs]
    df = spark.createDataFrame([(i, d, t, 5) for i, (d, t) in enumerate(texts)], "row int, doc_id long, text string, n_spans int")
    got = {r.row: r for r in sd.remove_repeats(df.repartition(3), length, gram).collect()}
    assert len(got) == len(docs)
    data = [(d, (t or "").encode()) for d, t in docs]
    for i, ((_, b), gone) in enumerate(zip(data, plain_removed(data, length), strict=True)):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), spans), (i, docs[i])
        assert bytes(r.kept) == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "gram", "letters", "seed"), [(12, 5, "ab", 1), (12, 5, "abc", 2), (9, 3, "ab\0", 3), (50, 20, "abcdefgh", 4)])
def test_removal_equals_plain(spark, length, gram, letters, seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    pool = [make(length + rnd.randrange(30)) for _ in range(6)]
    docs = [(rnd.randrange(60), "".join(rnd.choice([rnd.choice(pool), make(rnd.randrange(15)), "é"]) for _ in range(rnd.randrange(7)))) for _ in range(70)]
    docs += [(100, None), (101, ""), (102, "ab" * 200), (103, "ab" * 150), (None, docs[0][1] * 3), (104, docs[5][1]), docs[5], docs[6]]
    check_removal(spark, docs, length, gram)


def test_removal_edges(spark):
    passage = "A passage of well over fifty bytes, which several documents share word for word."
    docs = [(5, "x" + passage), (7, passage + "y"), (2, "no"), (9, passage * 2), (11, "z" * 49 + passage), (8, "€" * 40 + passage)]
    check_removal(spark, docs, 50, 20)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(empty).count() == 0 and sd.remove_repeats(empty, kept=None).columns[-1] == "kept_sha256"
    cut = spark.createDataFrame([(1, "€" * 30), (2, "a" + "€" * 30 + "é")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sd.remove_repeats(cut, kept="text").collect()} == {1: "€" * 30, 2: "aé"}


def test_hash_buckets_are_of_one_size():
    """Smallest hashes of windows are small numbers; the buckets that tasks hold must share them evenly all the same."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts, pa.binary())], names=["doc_id", "data"])
    sizes = Counter()
    for b in sd._hash_runs(40, 50, 20)([batch]):
        for bucket, owner in zip(b["bucket"].to_pylist(), b["owner"].to_pylist(), strict=True):
            sizes[bucket] += len(sd._unpacked(owner, np.uint32))
    assert len(sizes) == 40 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4), max_size=12), min_size=1, max_size=7))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    shared = lambda a, b: next((k for k in range(4) if a[k] != b[k]), 4)
    given_ = [(r, [0] + [shared(a, b) for a, b in zip(r, r[1:], strict=False)] if r else []) for r in runs]
    order, lcp = sd.merge(given_)
    at, merged = [0] * len(runs), []
    for k in order:
        merged.append(runs[k][at[k]])
        at[k] += 1
    assert merged == sorted(x for r in runs for x in r)
    assert lcp == [0] * bool(merged) + [shared(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_front_coding():
    rng = np.random.default_rng(0)
    rows = np.unique(rng.integers(0, 3, (200, 7)).astype(np.uint8), axis=0)
    lcp = np.array([0] + [int((a != b).argmax()) for a, b in zip(rows, rows[1:], strict=False)])
    assert (sd.front_decoded(lcp, rows[np.arange(7) >= lcp[:, None]], 7) == rows).all()


def test_chain_through_a_row_without_doc_id(spark):
    """Two documents whose only link is a text between them that no doc_id names."""
    base = " ".join(f"w{i}" for i in range(300)).split()
    texts = [" ".join(base)]
    for k in range(1, 40):  # texts that drift away from the first one
        texts.append(" ".join(f"v{i}" if i < 3 * k else w for i, w in enumerate(base)))
    codes = {r.doc_id: int(r.code) & (1 << 64) - 1 for r in sh.fingerprints(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    apart = lambda x, y: (codes[x] ^ codes[y]).bit_count()
    a, m, b, reach = max(
        ((x, y, z, max(apart(x, y), apart(y, z))) for x in range(40) for y in range(x + 1, 40) for z in range(y + 1, 40)
         if apart(x, z) > max(apart(x, y), apart(y, z))), key=lambda t: (-t[3], t[0]))
    rows = spark.createDataFrame([(1, texts[a]), (None, texts[m]), (2, texts[b])], "doc_id long, text string")
    assert {r.component_id for r in sh.near_duplicates(rows, reach).collect()} == {1}
    alone = sh.near_duplicates(rows.where("doc_id is null"), reach).collect()
    assert [r.component_id for r in alone] == [None]

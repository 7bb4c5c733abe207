"""The attention model, the conversation trie and lexical search against plain versions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import attention_lm as lm
from textloom.llm import lexical_search, prefix_trie
from textloom.llm.queries import LM_HELD_OUT

# --- lexical search ----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(d, Counter(split(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in texts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(split(text)) if t in c
            )
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


DOC, ITEM = "doc_id long, text string, item_id string, score double", "item_id long, text string, rank int"


@pytest.mark.parametrize("size,terms_each", [(7, 1000), (1000, 3), (64, 20)])
def test_search_is_brute_force(spark, size, terms_each):
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in range(40)] + ["Émile", "ÉMILE", "naïve", "x1y"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(int(i), text(int(rng.integers(1, 30)))) for i in range(200)]
    docs += [(3, "w1 w2"), (3, "w1 w2"), (500, docs[0][1]), (501, docs[0][1]), (None, docs[0][1]), (7, None), (8, ""), (9, "... --")]
    docs += [(502, "W39,w38;w37 " * 3000)]
    items = [(i, text(12)) for i in range(12)] + [(5, "w39 w38"), (5, "w39 w38"), (None, "émile x1y"), (90, None), (91, "unseen"), (92, "")]
    made = spark.createDataFrame([(*d, "a", 0.0) for d in docs], DOC).repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], ITEM)
    got = lexical_search.search(made, asked, 5, size, terms_each)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "x", 0.0)], DOC)
    items = spark.createDataFrame([(1, "a", 1)], ITEM)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(some, items.limit(0)).count() == 0


def test_pair_bound_skips_what_single_maxima_would_not():
    # two terms at their best in different documents: the pair can lift no document to 100, the sum of maxima would
    ids, docs = np.arange(3), np.array([0, 1, 2, 0, 1])
    tids, impacts = np.array([0, 0, 2, 1, 1]), np.array([60, 5, 100, 5, 60])
    s = lexical_search.Slice(ids, docs, tids, impacts, 3, np.array([[0, 1]]))
    assert s.joint[0][2] == 65 and s.most[0] + s.most[1] == 120
    touched = []
    whole = lexical_search.Slice.postings
    try:
        lexical_search.Slice.postings = lambda self, t: touched.append(int(t)) or whole(self, t)
        at, score = lexical_search.slice_best(s, np.array([2]), np.array([0]), np.array([[0, 1]]), 1, 100)
    finally:
        lexical_search.Slice.postings = whole
    assert list(at) == [2] and list(score) == [100] and touched == [2, 0, 1][: len(touched)] and touched[0] == 2


# --- trie --------------------------------------------------------------------------------


def plain_trie(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(p))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TURN = "conv_id long, turn long, role string, text string, depth int, size string"


@pytest.mark.parametrize("shard,sorted_each,seed", [(32768, 200000, 1), (40, 50, 2), (5, 9, 3)])
def test_trie_is_brute_force(spark, monkeypatch, shard, sorted_each, seed):
    monkeypatch.setattr(prefix_trie, "_SHARD", shard)
    monkeypatch.setattr(prefix_trie, "_SORTED", sorted_each)
    monkeypatch.setattr(prefix_trie, "_SUPER", 2)
    monkeypatch.setattr(prefix_trie, "_SEGMENT", 3)
    rng = np.random.default_rng(seed)
    texts = ["", "a", "bé", "ccc", None]
    rows = []
    for c in [*range(-5, 30), *range(95, 140), 300, 400, 401]:
        n = int(rng.integers(1, 7))
        for t in range(n):
            rows.append((c, t, ["user", "assistant", None][t % 2], texts[int(rng.integers(0, 5))]))
    rows += [(500, t, "user", "x" * (t % 3)) for t in range(75)] + [(501, t, "user", "x" * (t % 3)) for t in range(60)]
    rows += [(502, t, "user", "x" * (t % 3)) for t in range(16)] + [(503, t, "user", "x" * (t % 3)) for t in range(17)]
    rows += [(504, None, "user", "q"), (504, None, "user", "q"), (504, 1, None, None), (505, 1, "a", "b"), (505, 1, "a", "a"), (None, 1, "u", "v")]
    rows += [(c, 0, "system", "same") for c in range(600, 700)]
    made = spark.createDataFrame([(*r, 0, "") for r in rows], TURN).repartition(4)
    got = prefix_trie.conversation_trie(made)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0


# --- attention model ---------------------------------------------------------------------


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    flat = lm.initial(5)
    flat += rng.normal(0, 0.05, len(flat)).astype(np.float32)
    pairs = rng.integers(0, 5, (lm.ALPHABET + 1, lm.DIGIT)).astype(float)
    return flat, lm.Counts.of(pairs, rng.integers(0, 9, lm.ALPHABET).astype(float))


def test_gradient_is_that_of_the_loss(model):
    flat, counts = model
    rng = np.random.default_rng(0)
    runs = rng.integers(0, lm.ALPHABET, (3, lm.WINDOW + 1)).astype(np.uint16)
    runs[:, 0], runs[0, 20:] = lm.BEGIN, 65535
    g, _, n = lm.gradient(lm.views(flat), counts, runs)
    assert n == 19 + 2 * lm.WINDOW
    for a, b in zip(lm._CUTS, lm._CUTS[1:], strict=False):
        at = a + int(np.argmax(np.abs(g[a:b])))
        loss = []
        for step in (1e-2, -1e-2):
            moved = flat.copy()
            moved[at] += step
            loss.append(lm.gradient(lm.views(moved), counts, runs)[1] / n)
        assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.1, abs=2e-4)


def plain_chances(flat, counts, letters):
    """One letter at a time, attention over what comes before it in its window, in double precision."""
    p = {k: v.astype(float) for k, v in lm.views(flat).items()}
    soft = lambda x: x - np.log(np.exp(x).sum())
    seen = [lm.BEGIN, *letters[:-1]]
    out = []
    for t, y in enumerate(letters):
        start = 0 if t < lm.WINDOW else (t - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
        h0 = np.array([p["emb"][seen[start + i]] + p["pos"][i] for i in range(t - start + 1)])
        q, k, v = np.split(h0 @ p["qkv"], 3, axis=1)
        a = np.exp(soft(k @ q[-1] / math.sqrt(lm.WIDTH)))
        h = h0[-1] + (a @ v) @ p["o"]
        lo, hi = divmod(y, lm.DIGIT)
        first = soft(np.tanh(h @ p["mid"]) @ p["high"] + counts.first[seen[t]])
        second = soft(np.tanh(h @ p["mid"] + p["digit"][hi]) @ p["low"] + counts.second[hi])
        out.append(first[hi] + second[lo])
    return np.array(out)


def test_windows_score_each_letter_once(model):
    flat, counts = model
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, lm.ALPHABET, n).astype(np.uint16) for n in (1, 31, 32, 33, 57, 200)]
    got = lm.letter_chances(lm.views(flat), counts, docs)
    want = np.concatenate([plain_chances(flat, counts, d.tolist()) for d in docs])
    assert np.allclose(got, want, atol=2e-3)


def test_chances_sum_to_one(model):
    flat, counts = model
    head = np.array([5, 77, 300], np.uint16)
    every = [np.append(head, np.uint16(y)) for y in range(lm.ALPHABET)]
    last = lm.letter_chances(lm.views(flat), counts, every).reshape(-1, 4)[:, 3]
    assert np.exp(last.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_later_letters_do_not_change_earlier_ones(model):
    flat, counts = model
    rng = np.random.default_rng(2)
    a = rng.integers(0, lm.ALPHABET, 90).astype(np.uint16)
    b = np.append(a[:60], rng.integers(0, lm.ALPHABET, 50).astype(np.uint16))
    x, y = (lm.letter_chances(lm.views(flat), counts, [d])[:60] for d in (a, b))
    assert np.allclose(x, y, atol=1e-5)


def plain_base(docs):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if w] + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = split(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    return sorted(out)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "LETTERS", 20_000)
    monkeypatch.setattr(lm, "CHUNK", 4000)
    rng = np.random.default_rng(4)
    tongues = [["the", "and", "stone", "river", "winter"], ["le", "une", "pierre", "hiver", "été"]]
    docs = [(i, " ".join(rng.choice(tongues[i % 2], 60))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t "), (203, "  \x1f"), (None, "the stone"), (0, docs[0][1]), (0, docs[0][1])]
    docs += [(204, "Z" * 5000), (205, "été " * 3000), (206, "unseen ퟿ \U0001f600")]
    frame = spark.createDataFrame([(*d, True, "w") for d in docs], "doc_id long, text string, held boolean, word string").repartition(3)
    rows = lm.score(frame, LM_HELD_OUT).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == plain_base(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    clean = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 120]
    # a text tells its language, which shares of words alone don't know
    assert len(clean) > 10 and sum(r.score for r in clean) > 0.9 * sum(r.base_score for r in clean)


def test_scores_without_rows_to_learn_from(spark):
    kind = "doc_id long, text string"
    assert lm.score(spark.createDataFrame([], kind), LM_HELD_OUT).count() == 0
    rows = lm.score(spark.createDataFrame([(None, "a b")], kind), LM_HELD_OUT).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and math.isfinite(rows[0].score)


def test_rounds_deal_all_windows():
    letters = np.arange(3000, dtype=np.uint16)
    for mark in (0, 12345678901234567, 2**63 - 1):
        seen = [lm.training_windows(letters, mark, r, 1 / lm.ROUNDS) for r in range(lm.ROUNDS)]
        starts = sorted(x for s in seen for x in s[:, 1].tolist())
        assert starts == list(range(0, lm.STRIDE * int(lm.windows_of(len(letters))), lm.STRIDE))
        assert all(len(s) for s in seen) and len(lm.training_windows(letters, mark, 1, 1.0)) == len(starts)


def test_scores_for_each_weight():
    logs, share = np.array([-3.0, -800.0, -2.0, -0.5]), np.array([0.01, 0.2, 0.0, 1e-9])
    for w, got in zip(lm._WEIGHTS, lm._mixtures(logs, share), strict=True):
        want = np.log10(np.maximum((1 - w) * 10.0**logs + w * share, 1e-320))
        assert np.allclose(got, want)


class FirstTask:
    @staticmethod
    def get():
        return FirstTask

    @staticmethod
    def partitionId():  # noqa: N802
        return 0


def chunked(docs):
    kinds = (pa.int64(), pa.bool_(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*docs, strict=True), kinds, strict=True)]
    return list(lm._chunks([pa.RecordBatch.from_arrays(columns, names=["doc_id", "held", "data"])]))


def test_chunks_hold_all_words(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", FirstTask)
    blanks = [bytes([b]) for b in range(256)]
    texts = [None, b"", b" \n", b"Ab  aB\tab\x0b", "É é e x".encode(), b"\x00 \xff\xfe z", *(b"a" + b + b"b" for b in blanks), b"end"]
    docs, words = chunked([(i, i % 3 == 0, t) for i, t in enumerate(texts)])
    names = words["data"].to_pylist()
    for i, (t, data) in enumerate(zip(texts, docs["data"].to_pylist(), strict=True)):
        want = (t or b"").lower().split()
        assert [names[k] for k in np.frombuffer(data, np.int32)] == want and docs["n"][i].as_py() == len(want) + 1
    learned = Counter(w for i, t in enumerate(texts) if i % 3 for w in (t or b"").lower().split())
    assert dict(zip(names, words["n"].to_pylist(), strict=True)) == {w: learned[w] for w in names}


def test_chunk_counts_grow_with_its_words(monkeypatch):
    """Not with its documents times its different words."""
    monkeypatch.setattr(lm, "TaskContext", FirstTask)

    def seconds(n):
        docs, times = [(i, False, b"w%d" % i) for i in range(n)], []
        for _ in range(2):
            start = time.thread_time()
            assert [b.num_rows for b in chunked(docs)] == [n, n]
            times.append(time.thread_time() - start)
        return min(times)

    assert seconds(160_000) < 50 * seconds(10_000)


def test_dealt_windows_stay_in_their_document():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, lm.ALPHABET, n).astype(np.uint16) for n in (1, 8, 31, 32, 33, 56, 57, 400)]
    marks = rng.integers(0, 2**63 - 1, len(docs))
    got = lm.dealt_windows(np.concatenate(docs), np.array([len(d) for d in docs]), marks, 0, 1.0)
    want = []
    for d in docs:
        padded = [lm.BEGIN, *d.tolist(), *[65535] * lm.WINDOW]
        want += [padded[s : s + lm.WINDOW + 1] for s in range(0, lm.STRIDE * int(lm.windows_of(len(d))), lm.STRIDE)]
    assert got.tolist() == want
    for number in range(lm.ROUNDS):
        one = [lm.training_windows(d, int(m), number, 0.3) for d, m in zip(docs, marks, strict=True)]
        assert lm.dealt_windows(np.concatenate(docs), np.array([len(d) for d in docs]), marks, number, 0.3).tolist() == np.concatenate(one).tolist()


def test_training_equals_adam_over_all_parameters(model):
    """Rows of letters that a task has not met, or not met lately, move as plain Adam moves them."""
    flat, counts = model
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, top, (4, lm.WINDOW + 1)).astype(np.uint16) for top in (40, 900, 5, 300, 4000)]
    blocks[1][:, 0] = lm.BEGIN
    blocks[2][0, 3:] = 65535
    want, m, s = flat.astype(float), np.zeros(len(flat)), np.zeros(len(flat))
    for t, block in enumerate(blocks, 1):
        g = lm.gradient(lm.views(want.astype(np.float32)), counts, block)[0].astype(float)
        m, s = 0.9 * m + 0.1 * g, 0.98 * s + 0.02 * g * g
        want -= 1e-2 * math.sqrt(1 - 0.98**t) / (1 - 0.9**t) * m / (np.sqrt(s) + 1e-8)
        for name in ("high", "low"):
            w = lm.views(want)[name]
            np.clip(w, -lm._WEIGHT, lm._WEIGHT, out=w)
    got = lm.train(flat, counts, blocks, 1e-2)
    assert np.allclose(got[0], want, atol=2e-4) and got[2] == sum(int((b[:, 1:] != 65535).sum()) for b in blocks)


def test_ids_without_a_letter_are_spelled_in_bytes():
    path = lm.vocabulary_path()
    ids, byte_ids = lm._tokenizer(path)
    words = [b"stone", b"internationalisation", b"\xff\xfe", "été".encode(), b"z" * 700]
    made = next(lm._tokenized(path)([pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([1] * 5)], names=["word", "c"])]))
    assert [np.frombuffer(x, np.int32).tolist() for x in made["ids"].to_pylist()] == [ids(w) for w in words]
    counts = {i: 3 for i in ids(words[0])}
    of = lm.alphabet(counts, 5, byte_ids)[0]
    got = next(lm._spelled(path, SimpleNamespace(value=of))([made]))["letters"].to_pylist()
    plain = [ids(w) if all(i < len(of) and of[i] >= 0 for i in ids(w)) else byte_ids[np.frombuffer(b" " + w, np.uint8)] for w in words]
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [of[p].tolist() for p in plain]
    assert len(got[0]) == 2 * len(ids(words[0])) and len(got[1]) == 2 * (len(words[1]) + 1)

"""Quality ranking, HTML extraction, sampled pieces, top-k search and mixing."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import html_text as ht
from textloom.llm import mixing, pieces, quality, queries, topk

SF = "/root/testdata/sf0.01"


# quality


def test_ranker_orders_and_cuts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    label = (x[:, 0] - x[:, 3] + 0.1 * rng.normal(size=400) > -1).astype(int)
    r = quality.fit(x, label)
    s = r.scores(x)
    assert ((s >= quality.CUT) == label).mean() > 0.95 and s.min() >= 0 and s.max() <= 1
    one = quality.fit(x[:5], np.ones(5))
    assert (one.scores(x[:5]) >= quality.CUT).all() and quality.fit(x[:0], label[:0]).scores(x[:2]).shape == (2,)


def test_features_of_odd_texts():
    for t in (b"", b" \n", b"a", b"\xff", "ß€".encode() * 9, b"x" * 300_000, b"A A\nA A\n"):
        f = quality.features(t)
        assert f.shape == (quality.N_FEATURES,) and np.isfinite(f).all()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality"](spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.97
    assert sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "a b c", 0.5), (3, "w " * 60000, 0.5)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 0), (9, 5)], "doc_id long, quality int")
    got = quality.judged(docs, labels, queries.HELD_OUT).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


# HTML


def test_field_on_new_pages():
    field = ht.default_field()
    right = total = 0
    for page, labels in ht.labelled_pages(120, 77):
        found = ht.blocks(page)
        assert len(found) == len(labels)
        got = field.decode(ht.features(found))
        right += sum(bool(a) == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_best():
    field = ht.default_field()
    for page, _ in ht.labelled_pages(12, 5):
        f = ht.features(ht.blocks(page))[:9]
        s = field.scores(f)

        def total(path, s=s):
            return field.begin[path[0]] + sum(s[k, y] for k, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(total([n >> k & 1 for k in range(len(f))]) for n in range(1 << len(f)))
        assert math.isclose(total(field.decode(f)), best)


def test_blocks():
    text = lambda page: [b.text for b in ht.blocks(page)]
    assert text("<p>a &amp; b&nbsp;\n c<br>d<p>e<li>f<li>g") == ["a & b c d", "e", "f", "g"]
    assert text("x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z") == ["xyz"]
    assert text("<div>a<span>b</span><div>c</div>d</div>") == ["ab", "c", "d"]
    assert text("a < b &lt;p&gt; <a title='>'>c</a> <p") == ["a < b <p> c"]
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"] and text("") == [] and text("<p></p>") == []
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    deep = "<div>" * 30_000 + "deep" + "</div></p>" * 30_000 + "after"
    assert text(deep) == ["deep", "after"]
    assert text("<p>unclosed <!-- comment") == ["unclosed"] and text("</div></p>a") == ["a"]


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies to improve.</div><article><h1>Title</h1><p>First   paragraph &amp; more of it here.
<div class="ad">Buy now, it is cheap.</div><p>Second paragraph is here too.</p><ul><li>An item of a list</li></ul></article>
<div class="comments"><div class="comment"><p>I disagree with all of this, sir.</p></div></div>
<form><label>Your name please</label></form><aside><p>Related story about things.</p></aside><footer>&copy; me</footer></body></html>"""


def test_extract(spark):
    rows = [(1, "u", PAGE, "old"), (2, "u", None, "old"), (3, None, "", "old"), (3, None, PAGE, "old"), (4, "u", "<p>" + "long " * 90000, "old")]
    got = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.page_id for r in got] == [1, 2, 3, 3, 4] and "html" not in got[0].asDict()
    assert got[0].text == "Title\nFirst paragraph & more of it here.\nSecond paragraph is here too.\nAn item of a list" == got[3].text
    assert got[1].text == got[2].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert ht.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_article_pages(spark):
    """On the given pages the article's blocks are the main text."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = "\n".join(b.text for b in ht.blocks(r.html) if "article" in b.tags)
        assert ht.main_text(r.html, ht.default_field()) == want


# pieces

TEXTS = ["", " ", "a ▁ b", "\0 ▁\0▁ x", "hello  world\n\n é日本\U0001F600 ▁▁", "x" * 3000, "\n", "  lead and trail ", "▁", "The same words, the same words"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.model_path())


def test_lossless_and_reproducible(vocab):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    got = vocab.sample(TEXTS, keys)
    assert [vocab.decode(i.tolist()) for i in got] == TEXTS
    for k, t in enumerate(TEXTS):
        assert (vocab.sample([t], keys[k : k + 1])[0] == got[k]).all()
    again = vocab.sample(TEXTS[::-1], keys[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    assert any((a != b).any() if len(a) == len(b) else True for a, b in zip(got, vocab.sample(TEXTS, keys + np.uint64(99)), strict=True))


def test_sampled_segmentations_follow_the_weights(vocab):
    word = "▁thing"
    ways = defaultdict(float)

    def grow(at, ids, weight):
        if at == len(word):
            ways[tuple(ids)] += weight
        for e in range(at + 1, len(word) + 1):
            i = vocab.ids.get(word[at:e])
            if i is not None:
                grow(e, [*ids, i], weight * vocab.weight[i])

    grow(0, [], 1.0)
    whole, n = sum(ways.values()), 40_000
    got = Counter(tuple(i.tolist()) for i in vocab.sample(["thing"] * n, np.arange(n, dtype=np.uint64)))
    assert set(got) <= set(ways)
    for ids, w in ways.items():
        p = w / whole
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_encode_decode(spark):
    rows = [(i, t, [1]) for i, t in enumerate([*TEXTS, None])] + [(3, TEXTS[3], [1]), (None, "no key", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(3)
    got = pieces.decode(pieces.encode(df, chars=20)).collect()
    assert len(got) == len(rows) and all(r.decoded == r.text for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0


# top-k


@pytest.mark.parametrize("spread", [3, 1000])
def test_shard_best(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (5000, 24))
    x[100:140] = x[7]
    ids = np.arange(5000) * 3
    for q in (7, 120, 4999):
        got_i, got_s = topk.shard_best(x[q], ids[q], ids, np.ascontiguousarray(x.T), 10)
        want = sorted((-int(x[q] @ v), int(i)) for v, i in zip(x, ids, strict=True) if i != ids[q])[:10]
        assert [(-int(s), int(i)) for i, s in zip(got_i, got_s, strict=True)] == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    rows += [(300, None), (301, [None] + [0.5] * 5), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.0] * 6),
             (305, rows[5][1]), (306, rows[5][1]), (307, [1.0, 2.0]), (308, []), (400, [-0.0001] * 6), (None, rows[0][1]), (400, [-0.0001] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.integer_vector(F.col("e")).alias("x"))
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 10, shard=64, block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = [(i, [math.floor(v * 1024) for v in e]) for i, e in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    own = dict(fine)
    assert set(got) == {i for i in own if i % 50 == 0}
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(own[q], x, strict=True)), i) for i, x in fine if i != q and len(x) == len(own[q]))[:10]
        assert found == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.where("vec_id = 307")).count() == 0


# mixing


def plain_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("rows", [5, 40, 20_000])
def test_mix(spark, rows):
    rnd = random.Random(rows)
    docs = [(i, f"s{min(i % 11, 5)}" if i % 9 else None, " ".join(["w"] * rnd.randrange(0, 40))) for i in range(400)]
    docs += [(900, "tiny", "one two"), (901, "none", ""), (902, "none", None), (7, docs[7][1], docs[7][2]), (None, "s1", "a\tb \x0bc"), (903, "Äs", " x y ")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("taken", F.lit("x"))
    got = mixing.mix(df, group_rows=rows).collect()
    assert len(got) == len(docs)
    count = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, count(t)) for d, s, t in docs)
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += count(t)
    target = plain_targets(dict(sizes), (5, 2, 1), 3)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-9) for r in own)
        assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in own)
        least = min((r["size"] for r in own if r["size"]), default=1)
        assert abs(sum(r.taken for r in own) - target[s]) < 2 * least  # a document of the smallest class
        assert all(0 <= r.copies <= 3 for r in own)
    again = mixing.mix(df.repartition(7), group_rows=rows).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mixed(df, group_rows=rows)
    assert out.columns == df.columns
    want = Counter()
    for r in got:
        want[(r.doc_id, r.source, r["size"])] += r.copies
    assert Counter((r.doc_id, r.source, count(r.text)) for r in out.collect()) == +want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_large_documents_leave_the_target_to_small_ones(spark):
    """One document larger than its source's target, one of nearly that size, and a tree over thousands of rows."""
    rnd = random.Random(3)
    docs = [(0, "a", 4000)] + [(i, "a", rnd.randrange(50, 300)) for i in range(1, 15)]
    docs += [(100, "b", 2500)] + [(i, "b", rnd.randrange(1, 90)) for i in range(101, 160)]
    docs += [(i, "c", int(1.3 ** rnd.randrange(5, 34))) for i in range(1000, 2500)]
    docs += [(5000, "d", 700)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in docs], "doc_id long, source string, text string")
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target = plain_targets(dict(sizes), (5, 2, 1), 3)
    for seed in (1, 2):
        got = mixing.mix(df, seed=seed, group_rows=100).collect()
        for s in "abc":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - target[s]) < 2 * min(r["size"] for r in own)
            assert all(0 <= r.copies <= 3 for r in own)
        # most copies of a source of many documents are f rounded up or down
        f = float(target["c"] / sizes["c"])
        assert sum(math.floor(f) <= r.copies <= math.ceil(f) for r in got if r.source == "c") > 1400


def test_settling_against_all_choices():
    """Random small cases: the miss is below the largest of the smallest class wherever a plain search finds such copies."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = np.sort(rng.choice([1, 2, 3, 5, 9, 20, 70], rng.integers(1, 6)))[::-1].astype(float)
        kind = np.frexp(size)[1]
        missing = float(rng.uniform(0, 3) * size.sum())
        copies = mixing.settle(size, missing, 3.0, rng.random(len(size)), rng.random(len(size)))
        assert copies.min() >= 0 and copies.max() <= 3
        best = min(abs(missing - np.dot(c, size)) for c in itertools.product(range(4), repeat=len(size)))
        last = size[kind == kind.min()].max()
        miss = abs(missing - copies @ size)
        assert miss < max(best, size.max()) + last + 1e-6
        if (np.diff(kind) >= -1).all() and len(size) > 1:  # no gap between the classes
            assert miss < best + 2 * last + 1e-6


def test_pivotal_keeps_mass_and_chances():
    size, chance = np.array([3.0, 10, 7, 1, 5, 8]), np.array([0.5, 0.25, 0.7, 0.1, 0.9, 0.35])
    rng = np.random.default_rng(0)
    mean = np.zeros(6)
    for _ in range(4000):
        p, left = mixing.pivotal(size, chance, rng.random(6))
        assert math.isclose(p @ size, chance @ size) and sum(0 < x < 1 for x in p) <= 1 and (left < 0 or 0 < p[left] < 1)
        mean += p / 4000
    assert np.abs(mean - chance).max() < 0.04

"""The pipeline against a plain version of each stage's decisions."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from textloom.llm import mixing, pieces, quality, queries
from textloom.llm.store import written

from .test_dedup import plain_components, plain_removed

SF = "/root/testdata/sf0.001"


def small_docs(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randrange(20, 90))) + "." for _ in range(25)]
    passage = " ".join(rnd.choices(words, k=30))
    texts = base + base[:5] + [b + " " + passage for b in base[5:12]] + ["", None, "word " * 9000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[0], "en", "s1", len(base[0])), (77, passage, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def plain_shingles(text):
    """Five-word shingles of the lower-cased words; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_stages(spark):
    docs, rows = small_docs(spark)
    docs = docs.repartition(3)
    first = cp.quality_filter(spark, docs, SF)
    judged = quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.HELD_OUT)
    assert first.columns == list(cp.COLUMNS) and first.count() == judged.where("score >= 0.7").count()

    kept = sorted(map(tuple, cp.simhash_dedup(spark, docs, SF).collect()), key=repr)
    named = sorted({r[0]: r for r in rows if r[0] is not None}.values())
    sets = [plain_shingles(r[1]) for r in named]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(named)), 2)
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    root = plain_components(len(named), links)
    assert kept == sorted([r for i, r in enumerate(named) if root[i] == i] + [r for r in rows if r[0] is None], key=repr)

    got = Counter((r.doc_id, r.text, r.n_chars) for r in cp.repeated_passages(spark, docs, SF).collect())
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    want = Counter()
    for r, (_, b), gone in zip(rows, data, plain_removed(data, 50), strict=True):
        if not any(gone):
            want[(r[0], r[1], r[4]) if r[1] is not None else (r[0], "", r[4])] += 1
        elif not all(gone):
            left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
            want[(r[0], left, len(left))] += 1
    assert got == want

    mixed = cp.source_mix(spark, docs, SF)
    taken = mixing.mix(docs).collect()
    assert mixed.columns == list(cp.COLUMNS) and mixed.count() == sum(r.copies for r in taken)

    vocab = pieces.vocabulary(pieces.model_path())
    for r in cp.sampled_pieces(spark, docs, SF).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert (r.ids is None and text is None) or vocab.decode(r.ids) == text
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = written(stage(spark, empty, SF))
        assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    assert entry.queries()[name] is queries.QUERIES[name]
    assert (name in entry.oracle_sql()) == (name in queries.ORACLE_SQL)


def test_run_is_reproducible(spark):
    digest = lambda rows: sorted((r.doc_id, hashlib.md5(repr(r.ids).encode()).hexdigest()) for r in rows)
    one, two = (digest(entry.queries()["pipeline"](spark, SF).collect()) for _ in range(2))
    assert one and one == two


def test_rows_without_doc_id_are_deduplicated(spark):
    """Of copies and near copies without doc_id one row stays, and a chain goes through them."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    one, two = rnd.choices(words, k=100), rnd.choices(words, k=60)
    middle, far = one[10:] + ["x1", "x2"], one[18:] + ["x1", "x2"]
    sets = [plain_shingles(" ".join(t)) for t in (one, middle, far)]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    texts = [(1, one), (2, far), (None, middle), (None, two), (None, two), (None, [*two, "tail"]), (None, rnd.choices(words, k=30))]
    texts += [(3, rnd.choices(words, k=30))]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in texts] + [(None, None, "en", "s", 0), (None, "", "en", "s", 0), (None, " ", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(map(tuple, cp.simhash_dedup(spark, df, SF).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[6], rows[7], rows[8]], key=repr)

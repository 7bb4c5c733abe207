"""Near-duplicates of the pipeline against all pairs of shingle sets."""

import itertools
import random

import pytest

import corpus_pipeline as cp
from textloom.llm import shingle_dedup as sh
from textloom.llm import simhash

from .test_dedup import plain_components


def plain_set(text):
    words = bytes(text or "", "utf-8").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def near_texts(rnd):
    """Texts with copies of which 0 to 8 words are changed: similarities on both sides of 0.8."""
    words = [f"w{k}" for k in range(900)]
    common = rnd.choices(words, k=25)
    texts = [None, "", " \t", "one", "One", "one two three four", "a b c d e", "a b c d f"]
    for size in (12, 30, 80, 200, 400):
        for _ in range(6):
            base = common * rnd.randrange(2) + rnd.choices(words, k=size)
            for _ in range(6):
                copy = list(base)
                for _ in range(rnd.randrange(0, max(2, size // 25))):
                    copy[rnd.randrange(len(copy))] = rnd.choice(words)
                texts.append(" ".join(copy) + " tail" * rnd.randrange(2))
    rnd.shuffle(texts)
    return texts


def test_shingles():
    for t in near_texts(random.Random(1)):
        assert len(sh.shingles((t or "").encode())) == len(plain_set(t))
    assert (sh.shingles(b"A b\tC d e f") == sh.shingles(b"a B c  d e f ")).all() and len(sh.shingles(b"x " * 700)) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_from_eight_tenths_on(spark, seed):
    texts = near_texts(random.Random(seed))
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similar(sets[i], sets[j])]
    middle = [(i, j) for i, j in links if len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j])]
    assert len(middle) > 20
    root = plain_components(len(texts), links)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], ", ".join(
        ("doc_id long", "text string", "lang string", "source string", "n_chars long")))
    kept = sorted(r.doc_id for r in cp.simhash_dedup(spark, df.repartition(3), "").collect())
    assert kept == [i for i in range(len(texts)) if root[i] == i]


def test_many_texts_with_a_common_passage(spark):
    """A passage of all texts neither links them nor hides their copies."""
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(rnd.choices([f"w{k}" for k in range(5000)], k=rnd.randrange(5, 60))) for _ in range(150)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[:40]]
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similar(sets[i], sets[j])]
    root = plain_components(len(texts), links)
    rows = sh.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.doc_id)
    want = {}
    for i, k in enumerate(root):
        want.setdefault(k, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_simhash_proposes_pairs_in_the_pipeline(spark, monkeypatch):
    """Texts of near fingerprints are compared, through links of codes and through equal codes."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    base = rnd.choices(words, k=900)
    code = lambda t: simhash.fingerprint(t.encode())
    cuts = (" ".join(base[:-k]) for k in range(1, 90))
    near = next(t for t in cuts if 0 < (code(t) ^ code(" ".join(base))).bit_count() <= 4)
    texts = [" ".join(base), near, " ".join(rnd.choices(words, k=40)), ""]
    proposed = []
    monkeypatch.setattr(sh, "_near_coded", lambda *a, f=sh._near_coded: proposed.append(f(*a)) or proposed[-1])
    monkeypatch.setattr(sh, "_shared", lambda least: lambda batches: iter(()))  # no pairs from shingles
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[0]])], ", ".join(
        ("doc_id long", "text string", "lang string", "source string", "n_chars long")))
    kept = sorted(r.doc_id for r in cp.simhash_dedup(spark, df, "").collect())
    assert kept == [0, 2, 3] and len(proposed) == 1 and proposed[0].distinct().count() == 1

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import words as wd
from textloom.operators import encode, merges, unigram, vocab

tokenizers = pytest.importorskip("tokenizers")
from tokenizers import models, pre_tokenizers, trainers  # noqa: E402


def _texts(seed=3, n=120):
    rng = random.Random(seed)
    syll = ["th", "e", "an", "ing", "er", "ab", "ba", "aa", "é", "ß", "1", "22", "ka"]
    return [" ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(12)) + rng.choice([".", "!?", ""]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "doc_id int, text string").repartition(3).cache()


def _library(model, trainer, texts, pre=None):
    tok = tokenizers.Tokenizer(model)
    tok.pre_tokenizer = pre or pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainer)
    return tok


def test_bpe_equals_library(spark, corpus):
    tok = _library(models.BPE(unk_token="[UNK]"), trainers.BpeTrainer(
        special_tokens=list(wd.SPECIALS), vocab_size=70, min_frequency=2, show_progress=False), _texts())
    v, merges = vocab.train_bpe(vocab.word_counts(corpus), 70, 2, words_per_task=20, held=40, most=8, keep=10)
    assert {r.token: r.id for r in v.collect()} == tok.get_vocab()
    split = encode.bpe_splitter(v, merges)
    for r in corpus.select("text", split(wd.whitespace_words(F.col("text"))).alias("t")).collect():
        assert list(r.t) == tok.encode(r.text).tokens


def test_wordpiece_longest_match_equals_library(spark, corpus):
    v = vocab.train_wordpiece(vocab.word_counts(corpus), 60, 2, prefix="##", words_per_task=15, held=30)
    mine = {r.token: r.id for r in v.collect()}
    tok = tokenizers.Tokenizer(models.WordPiece(mine, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    split = encode.wordpiece_splitter(v, "##")
    extra = spark.createDataFrame([("zzz the aaing",), ("x" * 101 + " the",)], "text string")
    for r in corpus.select("text").union(extra).select("text", split(wd.whitespace_words(F.col("text"))).alias("t")).collect():
        assert list(r.t) == tok.encode(r.text).tokens


def test_wordlevel_equals_library(spark, corpus):
    tok = _library(models.WordLevel(unk_token="[UNK]"), trainers.WordLevelTrainer(
        special_tokens=list(wd.SPECIALS), vocab_size=50, min_frequency=2, show_progress=False), _texts())
    v = vocab.wordlevel_vocab(vocab.word_counts(corpus), 50, 2)
    assert {r.token: r.id for r in v.collect()} == tok.get_vocab()
    toks = corpus.select("doc_id", F.posexplode(wd.whitespace_words(F.col("text"))).alias("pos", "word"))
    ids = encode.encode_by_lookup(toks, v, ["doc_id"])
    want = {i: tok.encode(t).ids for i, t in enumerate(_texts())}
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == want
    back = encode.ids_to_tokens(ids, v, ["doc_id"]).collect()
    assert {r.doc_id: list(r.tokens) for r in back} == {i: tok.encode(t).tokens for i, t in enumerate(_texts())}


def test_byte_level_words_and_back(spark):
    texts = ["don't go 12a  x", " é ß\tq", "😀 1²3", "", "a\n\nb  "]
    pre = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.Digits(individual_digits=True)])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", wd.byte_level_words(F.col("t")))
    for r in df.withColumn("back", encode.join_tokens(F.col("w"), byte_level=True)).collect():
        assert list(r.w) == [p for p, _ in pre.pre_tokenize_str(r.t)]
        assert r.back in (r.t, " " + r.t)


def test_merging_words_reports_the_changes():
    """Runs of equal symbols and repeated pairs, against a recount."""
    rng = np.random.default_rng(1)
    symbols = [rng.integers(0, 3, int(rng.integers(2, 12))).astype(np.int32) for _ in range(60)]
    freq = rng.integers(1, 9, 60)
    w = merges.Words(symbols, freq)

    def recount():
        out = Counter()
        for x, f in zip(w.words(), freq, strict=True):
            for a, b in zip(x, x[1:], strict=False):
                out[int(a) << 32 | int(b)] += int(f)
        return out

    for made, (left, right) in enumerate([(0, 0), (1, 2), (3, 1), (4, 4), (3, 3), (0, 4)], 3):
        before = recount()
        codes, change = w.merge(left, right, made)
        after = recount()
        assert {p: n for p in before | after if (n := after[p] - before[p])} == dict(zip(codes.tolist(), change.tolist(), strict=True))
        assert left << 32 | right not in after


def test_replay_stops_at_the_first_pair_that_is_not_best():
    pair = lambda a, b: a << 32 | b
    start = {pair(0, 1): 9, pair(2, 3): 8, pair(1, 2): 7}
    proposed = list(start)
    of = merges.Learner(2)
    of.hold(list(start), list(start.values()), True)
    falls = {0: ([pair(0, 1), pair(1, 2), pair(4, 2)], [-9, -3, 3])}
    assert of.replay(proposed, falls | {1: ([pair(2, 3)], [-8])}, [True] * 3) == (3, True)
    of.hold(list(start), list(start.values()), True)
    assert of.replay(proposed, {0: ([pair(0, 1), pair(4, 2)], [-9, 9])}, [True] * 3) == (1, True)


def test_replay_of_a_merge_that_makes_an_old_symbol():
    """A pair that is not held may have had up to the last held count; it stops the round when it might be the best."""
    pair = lambda a, b: a << 32 | b
    start = {pair(0, 1): 9, pair(2, 3): 8, pair(1, 2): 7}
    of = merges.Learner(2)
    for raised, want in ((3, (3, True)), (5, (2, False)), (6, (1, False))):  # at most 5, 7 and 8 now
        of.hold(list(start), list(start.values()), True)
        steps = {0: ([pair(0, 1), pair(4, 2)], [-9, raised]), 1: ([pair(2, 3)], [-8])}
        assert of.replay(list(start), steps, [False, True, True]) == want
    of.hold(list(start), list(start.values()), False)  # others may have up to 7
    assert of.replay(list(start), {0: ([pair(0, 1), pair(4, 2)], [-9, 1])}, [False, True, True]) == (1, False)


def test_unigram(spark, corpus):
    counts = vocab.word_counts(corpus)
    v = unigram.train_unigram(counts, vocab_size=60, seed_size=200).cache()
    rows = v.where("kind = 'piece'").collect()
    assert v.count() <= 60 and len({r.token for r in rows}) == len(rows)
    assert {c for t in _texts() for c in t if c != " "} <= {r.token for r in rows}
    split = encode.unigram_splitter(v)
    scores = {r.token: r.score for r in rows}

    def brute(word):
        if not word:
            return 0.0
        return max((scores[word[:i]] + brute(word[i:]) for i in range(1, len(word) + 1) if word[:i] in scores), default=-math.inf)

    for r in counts.limit(40).select("word", split(F.array("word")).alias("t")).collect():
        assert "".join(r.t) == r.word and abs(sum(scores[p] for p in r.t) - brute(r.word)) < 1e-9


def test_expected_counts_sum_to_path_probability():
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -2.0}
    got = unigram._expected("aba", scores, 2)
    paths = [["a", "b", "a"], ["ab", "a"], ["a", "ba"]]
    w = [math.exp(sum(scores[p] for p in path)) for path in paths]
    for piece in scores:
        want = sum(x * path.count(piece) for x, path in zip(w, paths)) / sum(w)
        assert abs(got[piece] - want) < 1e-12


def test_frequencies(spark):
    enc = spark.createDataFrame([(["a", "b"], 3), (["a"], 2), (["c"], 1)], "tokens array<string>, freq long")
    freqs = vocab.token_frequencies(enc)
    assert [(r.token, r.freq) for r in vocab.top_tokens(freqs, 2).collect()] == [("a", 5), ("b", 3)]
    many = spark.createDataFrame([(str(i), 1000 - i) for i in range(40)], "token string, freq long")
    assert vocab.frequency_at_95(many).first().f95 == 1000 - 38
    morphs = spark.createDataFrame([("walked", ["walk", "ed"])], "word string, morphs array<string>")
    counts = spark.createDataFrame([("walked", 2), ("ed", 1)], "word string, freq long")
    assert {r.word: r.freq for r in vocab.segment_words(counts, morphs).collect()} == {"walk": 2, "ed": 3}


@pytest.mark.parametrize("words_per_task,held,head", [(10_000, 50_000, 100_000), (700, 300, 100_000), (700, 2000, 900)])
def test_thousands_of_merges_equal_library(spark, words_per_task, held, head):
    """4,000 entries from made words of several tasks: pairs counted anew when the held ones are used up; guesses that fail."""
    rng = np.random.default_rng(5)
    units = ["th", "e", "on", "re", "a", "nd", "ing", "st", "o", "le", "ou", "r", "aa", "é", "s", "i", "tt"]
    texts = [" ".join("".join(rng.choice(units, rng.integers(1, 6))) for _ in range(60)) for _ in range(120)]
    tok = _library(models.BPE(unk_token="[UNK]"), trainers.BpeTrainer(
        special_tokens=list(wd.SPECIALS), vocab_size=4000, min_frequency=1, show_progress=False), texts)
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    v, _ = vocab.train_bpe(vocab.word_counts(lines), 4000, 1, words_per_task=words_per_task, held=held, head=head)
    mine = {r.token: r.id for r in v.collect()}
    assert len(mine) == 4000 and mine == tok.get_vocab()


def test_merges_guessed_in_the_wrong_order_change_places():
    """Side by side in a word they are taken in the right order, with the counts that order gives; overlapping they are not."""
    pair = lambda a, b: a << 32 | b
    rng = np.random.default_rng(4)
    units = [[0, 1], [2, 3], [4]]
    symbols = [np.concatenate([units[u] for u in rng.integers(0, 3, rng.integers(1, 7))]).astype(np.int32) for _ in range(300)]
    freq = rng.integers(1, 9, 300)
    start = merges._pairs([merges.pa.RecordBatch.from_arrays(
        [merges.pa.array([x.tobytes() for x in symbols], merges.pa.binary()), merges.pa.array(freq)], names=["w", "freq"])])
    start = {p: n for b in start for p, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    first, second = sorted([(0, 1), (2, 3)], key=lambda m: (-start[pair(*m)], m))
    guessed, right = merges.Words(symbols, freq), merges.Words(symbols, freq)
    changes = {i: tuple(x.tolist() for x in guessed.merge(*m, 5 + i)) for i, m in enumerate((second, first))}
    of = merges.Learner(1)
    of.hold(list(start), list(start.values()), True)
    n, _ = of.replay([pair(*second), pair(*first)], changes, [True, True], [5, 6])
    assert n == 2 and of.taken == [1, 0]
    want = Counter(start)
    for i, m in enumerate((first, second)):
        want.update(dict(zip(*(x.tolist() for x in right.merge(*m, 5 + i)), strict=True)))
    assert of.counts == {p: n for p, n in want.items() if n}
    overlap = {0: ([pair(0, 1), pair(1, 2)], [-7, -3])}
    of.hold([pair(1, 2), pair(0, 1)], [9, 7], True)
    assert of.replay([pair(0, 1), pair(1, 2)], overlap, [True, True], [5, 6]) == (0, True)


def test_rounds_stay_few_when_most_words_are_not_held(spark, monkeypatch):
    """Held words' changes follow the order of the turns, so most of a round's guesses count: 39 rounds before, 14 now."""
    rng = np.random.default_rng(5)
    units = ["th", "e", "on", "re", "a", "nd", "ing", "st", "o", "le", "ou", "r", "aa", "é", "s", "i", "tt"]
    words = Counter("".join(rng.choice(units, rng.integers(1, 6))) for _ in range(7200))
    rounds = []
    replay = merges.Learner.replay
    monkeypatch.setattr(merges.Learner, "replay", lambda *a: rounds.append(replay(*a)) or rounds[-1])
    counts = spark.createDataFrame(sorted(words.items()), "word string, freq long")
    _, few = vocab.train_bpe(counts, 4000, 1, words_per_task=700, held=20_000, head=900)
    assert len(rounds) <= 20
    rounds.clear()
    _, all_ = vocab.train_bpe(counts, 4000, 1, held=20_000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect()))


def test_words_and_ids_stay_in_arrays(spark):
    """Splitting and decoding make no row of a token; null and empty arrays, repeated and null keys, unknown ids."""
    v = spark.createDataFrame([(t, i, 0.0, "piece") for i, t in enumerate(["a", "b", "ab", "c", "abc"], 7)], "token string, id int, score double, kind string")
    ranks = spark.createDataFrame([(0, "a", "b"), (1, "ab", "c")], "rank int, left string, right string")
    rows = [(1, ["abc", "ab?", "abab"]), (2, None), (3, []), (None, ["cab"]), (1, ["b", "b", "b", "b", "b", "b"]), (4, [""])]
    df = spark.createDataFrame(rows, "k int, w array<string>").coalesce(1)
    tokens = df.select("k", encode.bpe_splitter(v, ranks)(F.col("w")).alias("tokens"))
    want = [(1, ["abc", "ab", "[UNK]", "ab", "ab"]), (2, None), (3, []), (None, ["c", "ab"]), (1, ["b"] * 6), (4, [])]
    assert [(r.k, r.tokens) for r in tokens.collect()] == want
    ids = spark.createDataFrame([(1, [11, 9, 99]), (1, [8]), (None, [7]), (2, None), (3, [])], "k int, ids array<int>")
    back = encode.ids_to_tokens(ids, v, ["k"])
    assert {r.k: r.tokens for r in back.collect()} == {1: ["abc", "b", "ab", "[UNK]"], None: ["a"]}
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_words_are_split_in_as_many_tasks_as_they_need(spark):
    counts = spark.createDataFrame([(f"w{i}", 1) for i in range(50)], "word string, freq long").coalesce(1)
    split = encode.split_counts(counts, lambda w: w, words_per_task=10)
    assert split.rdd.getNumPartitions() == 5 and sorted(r.tokens[0] for r in split.collect()) == sorted(f"w{i}" for i in range(50))

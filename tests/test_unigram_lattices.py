"""Lattices of many words against the walk of one word at a time, in results and in cost."""

import math
import time
from collections import Counter

import numpy as np

from textloom.operators import unigram


def plain(word, scores, freq, longest):
    """Expected uses, and the best split: of equal ones the longest last parts."""
    n = len(word)
    edges = [(i, j, word[i:j]) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if word[i:j] in scores]
    ahead, behind, best, back = [1.0] + [0.0] * n, [0.0] * n + [1.0], [0.0] + [-math.inf] * n, {}
    for i, j, p in edges:
        ahead[j] += ahead[i] * math.exp(scores[p])
        if best[i] + scores[p] > best[j]:
            best[j], back[j] = best[i] + scores[p], i
    uses, split, at = Counter(), [], n
    for i, j, p in reversed(edges):
        behind[i] += math.exp(scores[p]) * behind[j]
    if ahead[n]:
        for i, j, p in edges:
            uses[p] += freq * ahead[i] * math.exp(scores[p]) * behind[j] / ahead[n]
        while at:
            split.append(word[back[at] : at])
            at = back[at]
    return uses, best[n], split


def made(n):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 13))) for _ in range(n)]
    words += ["ab" * 300, "xa", "x"]
    pieces = sorted({w[i : i + k] for w in words[:40] for i in range(len(w)) for k in (1, 2, 3, 5)} | set("abcéx"))
    scores = rng.normal(-4, 1, len(pieces))
    scores[::7] = np.round(scores[::7])  # equal scores
    return words, rng.integers(1, 9, len(words)).astype(float), pieces, scores


def test_uses_and_best_splits():
    words, freq, pieces, scores = made(300)
    index = {p: i for i, p in enumerate(pieces)}
    whole = unigram.Lattices.of(words, index, 5)
    for gone in ([], ["x", *(p for p in pieces if len(p) == 3)]):  # without x, some words have no split
        scores[[index[p] for p in gone]] = -np.inf
        alive = {p: s for p, s in zip(pieces, scores.tolist(), strict=True) if s > -math.inf}
        for lattice in (whole, whole.without(scores)):
            want = [plain(w, alive, f, 5) for w, f in zip(words, freq, strict=True)]
            uses = np.bincount(lattice.piece, lattice.expected(scores, freq), len(pieces))
            total = sum((u for u, *_ in want), Counter())
            assert np.allclose(uses, [total[p] for p in pieces])
            best, parts = lattice.best(scores)
            assert np.allclose(best, [b for _, b, _ in want])
            split = [[] for _ in words]
            for word, edge in parts:
                for w, p in zip(word.tolist(), lattice.piece[edge].tolist(), strict=True):
                    split[w].append(pieces[p])
            assert split == [s for *_, s in want]
    assert len(whole.without(scores).piece) < len(whole.piece)


def test_splits_without_the_piece_itself():
    index = {p: i for i, p in enumerate(["a", "ab", "abab", "b"])}
    lattice = unigram.Lattices.of(["ab", "abab"], index, 4, whole=False)
    best, parts = lattice.best(np.array([-3.0, -2.0, -9.0, -3.0]))
    assert best.tolist() == [-6.0, -4.0]
    assert [(w.tolist(), lattice.piece[e].tolist()) for w, e in parts] == [([0, 1], [3, 1]), ([0, 1], [0, 1])]


def test_a_pass_costs_little():
    """Passes over words that are looked up already, against walks that look up every substring each time."""
    words, freq, pieces, scores = made(4000)
    lattice = unigram.Lattices.of(words, {p: i for i, p in enumerate(pieces)}, 5)
    alive = dict(zip(pieces, scores.tolist(), strict=True))
    took = []
    for run in (lambda: (lattice.expected(scores, freq), list(lattice.best(scores)[1])), lambda: [plain(w, alive, 1.0, 5) for w in words]):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert 3 * took[0] < took[1], took

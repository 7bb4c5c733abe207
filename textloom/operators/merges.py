"""Byte pair merges learned in rounds of many, with the result of one merge at a time.

The distinct words are dealt to tasks as symbol arrays. The driver holds the most frequent pairs and a bounded number of the
most frequent words. In a round it guesses the next merges by trying them on those words; every task applies them one after
another to its own words, finding a pair's places by an index, and reports by how much each merge changes the counts of
pairs. The driver replays the round with these changes, which are of all words, and takes the best pair at each turn. A word's
changes don't depend on other words, so those of the words held are taken out of the sums and made anew in the order of the
turns, with merges that no other word has, guessed or not. Of all others, merges guessed in a wrong order change places unless a word holds them overlapping; tasks send such words
of merges that are guessed close to each other, which are held for the round. It stops at a best pair that was not guessed or
has to stay behind. So the words held decide only how many merges a round gives, not which.

Counts of pairs of old symbols only fall, and those of new symbols are all reported, so a pair that is not held can't be
best while there are held ones. A merge that makes an old symbol again can raise pairs that are not held; an upper bound of
their counts is kept, and all pairs are counted again when it reaches the best held pair, or when the held ones are used up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage

#: Pairs held at the driver, merges proposed in a round, merges before the words are written anew, words held for guesses.
HELD, BATCH, KEEP, HEAD = 200_000, 2048, 512, 400_000
#: Words with overlapping merges that tasks send in a round, and the share of its count that a later merge may be short of.
SENT, CLOSE = 120_000, 0.15
_END = 1 << 62


class Words:
    """Words of one task as linked symbols: merging closes the gap to the next symbol in place."""

    def __init__(self, symbols: list[np.ndarray], freq: np.ndarray):
        flat = np.concatenate(symbols) if len(symbols) else np.zeros(0, np.int32)
        self._link(flat, np.array([len(s) for s in symbols], np.int64), freq)

    @classmethod
    def of(cls, flat: np.ndarray, size: np.ndarray, freq: np.ndarray) -> Words:
        """From the words' symbols, one after another, and the words' sizes."""
        words = cls.__new__(cls)
        words._link(flat, size, freq)
        return words

    def _link(self, flat: np.ndarray, size: np.ndarray, freq: np.ndarray) -> None:
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.sym = flat.astype(np.int64)
        n = len(self.sym)
        self.word = np.repeat(np.arange(len(size)), size)
        self.freq = freq.astype(np.int64)
        self.next = np.arange(1, n + 1)
        self.next[self.end[size > 0] - 1] = -1
        self.alive = np.ones(n, bool)
        at = np.flatnonzero(self.next >= 0)
        codes = self.codes(at)
        order = np.argsort(codes, kind="stable")
        self.index_codes, self.index = codes[order], at[order]
        self.later: dict[int, list[np.ndarray]] = {}

    def codes(self, at: np.ndarray) -> np.ndarray:
        return self.sym[at] << 32 | self.sym[self.next[at]]

    def _links(self, words: np.ndarray) -> np.ndarray:
        """Places of the words that have a next symbol."""
        size = self.end[words] - self.start[words]
        at = np.repeat(self.start[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at[self.alive[at] & (self.next[at] >= 0)]

    def _places(self, code: int, later: list[np.ndarray]) -> np.ndarray:
        a, b = np.searchsorted(self.index_codes, [code, code + 1])
        at = np.concatenate([self.index[a:b], *later])
        at = at[self.alive[at] & (self.next[at] >= 0)]
        return np.unique(at[self.codes(at) == code])

    def count(self, code: int) -> int:
        """Occurrences of a pair."""
        return int(self.freq[self.word[self._places(code, self.later.get(code, []))]].sum())

    def merge(self, left: int, right: int, made: int, beside=None) -> tuple[np.ndarray, np.ndarray]:
        """(pair codes, changes of their counts) of one merge.

        ``beside`` is called with the codes of the pairs that overlap a merged one, and their words.
        """
        code = left << 32 | right
        at = self._places(code, self.later.pop(code, []))
        if left == right and len(at):  # of a run of equal symbols, every second pair from its start
            run = np.concatenate([[True], self.next[at[:-1]] != at[1:]])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.unique(self.word[at])
        links = self._links(words)
        old, old_freq = self.codes(links), self.freq[self.word[links]]
        gone = self.next[at]
        if beside is not None:
            place = np.searchsorted(at, self.next[links])
            over = np.concatenate([links[at[np.minimum(place, len(at) - 1)] == self.next[links]], gone[self.next[gone] >= 0]])
            beside(self.codes(over), self.word[over])
        self.sym[at], self.next[at] = made, self.next[gone]
        self.alive[gone] = False
        links = self._links(words)
        new = self.codes(links)
        fresh = links[(self.sym[links] == made) | (self.sym[self.next[links]] == made)]
        if len(fresh):
            codes = self.codes(fresh)
            order = np.argsort(codes, kind="stable")
            codes, fresh = codes[order], fresh[order]
            cuts = np.flatnonzero(np.diff(codes)) + 1
            for c, part in zip(codes[np.concatenate([[0], cuts])].tolist(), np.split(fresh, cuts), strict=True):
                self.later.setdefault(c, []).append(part)
        names, place = np.unique(np.concatenate([old, new]), return_inverse=True)
        change = np.zeros(len(names), np.int64)
        np.add.at(change, place, np.concatenate([-old_freq, self.freq[self.word[links]]]))
        return names[change != 0], change[change != 0]

    def copy(self) -> Words:
        """The same words, to try merges on."""
        other = Words.__new__(Words)
        other.__dict__ |= self.__dict__
        other.sym, other.next, other.alive = self.sym.copy(), self.next.copy(), self.alive.copy()
        other.later = {code: list(parts) for code, parts in self.later.items()}
        return other

    def words(self) -> list[np.ndarray]:
        return [self.sym[s:e][self.alive[s:e]] for s, e in zip(self.start, self.end, strict=True)]

    def flat(self, which: np.ndarray, sym: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, sizes and frequencies of those words that are marked in ``which``, as ``sym`` and ``alive`` have them."""
        at = np.flatnonzero(alive & which[self.word])
        return sym[at], np.bincount(self.word[at], minlength=len(which))[which], self.freq[which]

    def shorter(self) -> Words:
        """The words that still have pairs, indexed anew."""
        which = np.bincount(self.word[self.alive], minlength=len(self.freq)) > 1
        return Words.of(*self.flat(which, self.sym, self.alive))


def _read(batches: Iterable[pa.RecordBatch]) -> Words:
    flat, size, freq = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        flat.append(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32))
        size.append(np.asarray(pc.binary_length(b.column(0))).astype(np.int64) // 4)
        freq.append(b.column(1).to_numpy())
    return Words.of(*map(np.concatenate, (flat, size, freq)))


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """The symbols of each word as bytes."""
    ends = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(np.int32))])


_ROWS = 1 << 16
_CHANGES = "step int, pair long, w binary, change long"


class _Overlaps:
    """Words of at most ``above`` occurrences in which a merge overlaps one of its step's ``rivals``, ``most`` words."""

    def __init__(self, w: Words, rivals: list[np.ndarray], above: int, most: int):
        self.rivals, self.most = rivals, most
        self.rare, self.found, self.step = w.freq <= above, np.zeros(len(w.freq), bool), 0

    def __call__(self, codes: np.ndarray, words: np.ndarray) -> None:
        if self.most > 0 and len(self.rivals[self.step]):
            words = np.unique(words[np.isin(codes, self.rivals[self.step]) & self.rare[words]])
            words = words[~self.found[words]][: self.most]
            self.found[words] = True
            self.most -= len(words)


def _changes(shared):
    """Changes by step, and words that the driver shall hold, as step -1."""

    def batch(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        steps = np.repeat(np.array([p[0] for p in parts], np.int32), [len(p[1]) for p in parts])
        pairs, change = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        columns = [pa.array(steps), pa.array(pairs), pa.nulls(len(steps), pa.binary()), pa.array(change)]
        return pa.RecordBatch.from_arrays(columns, names=["step", "pair", "w", "change"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, proposed, rivals, above, most = shared.value
        w = _read(batches)
        for m in known:
            w.merge(*m)
        overlaps = _Overlaps(w, rivals, above, most)
        sym, alive = w.sym.copy(), w.alive.copy()
        parts, rows = [], 0
        for step, m in enumerate(proposed):
            overlaps.step = step
            codes, change = w.merge(*m, overlaps)
            if len(codes):
                parts.append((step, codes, change))
                rows += len(codes)
            if rows >= _ROWS:
                yield batch(parts)
                parts, rows = [], 0
        if parts:
            yield batch(parts)
        if overlaps.found.any():
            flat, size, freq = w.flat(overlaps.found, sym, alive)
            columns = [pa.array(np.full(len(size), -1, np.int32)), pa.array(np.zeros(len(size), np.int64)), _binary(flat, size), pa.array(freq)]
            yield pa.RecordBatch.from_arrays(columns, names=["step", "pair", "w", "change"])

    return run


def _merged(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _read(batches)
        for m in shared.value:
            w.merge(*m)
        which = np.bincount(w.word[w.alive], minlength=len(w.freq)) > 1
        flat, size, freq = w.flat(which, w.sym, w.alive)
        yield pa.RecordBatch.from_arrays([_binary(flat, size), pa.array(freq)], names=["w", "freq"])

    return run


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = _read(batches)
    at = np.flatnonzero(w.next >= 0)
    names, place = np.unique(w.codes(at), return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, place, w.freq[w.word[at]])
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["pair", "n"])


def _add(found: dict[int, int], codes: np.ndarray, change: np.ndarray) -> None:
    for p, c in zip(codes.tolist(), change.tolist(), strict=True):
        found[p] = found.get(p, 0) + c


class Learner:
    """The pairs held at the driver: those that rank up to ``last``, which come before all others.

    The count of a pair is set by the merge that makes the newer of its symbols and only falls later, so a pair beyond
    ``last`` can be forgotten, unless a merge makes an old symbol: then ``loose`` bounds the counts of such pairs from above.
    Ranks are (-count, pair): ties go to the smaller symbols.
    """

    def __init__(self, least: int):
        self.least = max(least, 1)
        self.counts: dict[int, int] = {}
        self.loose: dict[int, int] = {}
        self.last = (-self.least, _END)

    def hold(self, pairs: list[int], counts: list[int], all_of_them: bool) -> None:
        """Start anew from the first pairs in rank."""
        self.counts, self.loose = dict(zip(pairs, counts, strict=True)), {}
        self.last = (-self.least, _END) if all_of_them else (-counts[-1], pairs[-1])

    def heap(self) -> list[tuple[int, int]]:
        heap = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(heap)
        return heap

    def guess(self, words: Words, number: int, name, more: Iterable[Words] = ()) -> tuple[list[tuple[int, int, int]], list[bool]]:
        """Up to ``number`` merges (left, right, symbol) that are likely next, and whether each symbol is new.

        They are applied to ``words`` and ``more``, a part of all words; a pair's changes there stand for all in proportion.
        ``tried`` holds the merges' changes in ``words``, ``rivals`` for each the pairs that it may have to change places with:
        those of a count near its own. Pairs that lost such a count to it and were not guessed come last.
        """
        counts, heap = dict(self.counts), self.heap()
        steps, new = [], []
        self.tried: list[tuple[np.ndarray, np.ndarray]] = []
        at, lost = [], []

        def merge(pair: int) -> dict[int, int]:
            made, is_new = name(pair >> 32, pair & 0xFFFFFFFF)
            steps.append((pair >> 32, pair & 0xFFFFFFFF, made))
            new.append(is_new)
            self.tried.append(words.merge(*steps[-1]))
            found: dict[int, int] = {}
            _add(found, *self.tried[-1])
            for w in more:
                _add(found, *w.merge(*steps[-1]))
            return found

        while heap and len(steps) < number:
            n, pair = heapq.heappop(heap)
            if counts.get(pair, 0) != -n:
                continue
            found = merge(pair)
            at.append(-n)
            near = -n * (1 - CLOSE) - 2
            lost.append([p for p, c in found.items() if c < 0 and p != pair and counts.get(p, 0) >= near])
            here = -found.get(pair, 0)
            del counts[pair]
            if here <= 0:
                continue
            for p, c in zip(found, np.rint(np.array(list(found.values())) * (-n / here)).astype(np.int64).tolist(), strict=True):
                if p == pair or (c < 0 and p not in counts):
                    continue
                n_p = counts.get(p, 0) + c
                if (-n_p, p) <= self.last:
                    counts[p] = n_p
                    heapq.heappush(heap, (-n_p, p))
                else:
                    counts.pop(p, None)
        pairs = [a << 32 | b for a, b, _ in steps]
        below = np.array(at)
        upto = [int(np.flatnonzero(below[i:] >= x * (1 - CLOSE) - 2)[-1]) + i + 1 for i, x in enumerate(at)]
        self.rivals = [np.array([*pairs[i + 1 : k], *more_], np.int64) for i, (k, more_) in enumerate(zip(upto, lost, strict=True))]
        own = set(pairs)
        for pair in dict.fromkeys(chain.from_iterable(lost)):
            if pair not in own and len(steps) < 2 * number:
                merge(pair)
                self.rivals.append(np.zeros(0, np.int64))
        return steps, new

    def replay(
        self, proposed: list[int], changes: dict[int, tuple], new: list[bool], made: list[int] | None = None,
        words: Iterable[Words] = (), name=None, most: int | None = None,
    ) -> tuple[int, bool]:
        """How many of the proposed merges were each the first at their turn, and whether the next is known then.

        ``changes`` gives each step's (pairs, changes): all of them where the step makes an old symbol. The next is not known
        when pairs that are not held may have a count as high as the best. With ``made``, the steps' symbols, and all changes,
        a step may be taken before earlier ones that it can change places with. ``taken`` holds the steps in the order of
        their turns; new symbols are numbered in that order in the counts. ``words`` are merged in that order, too, and their
        changes come on top of ``changes``; a best pair that only they hold is merged without having been proposed.
        ``name(left, right)`` gives a merge's symbol, whether it is new, and the steps' symbol of the same token. ``merged`` holds
        all merges (left, right, symbol). It ends after ``most`` new symbols.
        """
        heap = self.heap()
        loose = max(self.loose.values(), default=0)
        self.taken: list[int] = []
        self.merged: list[tuple[int, int, int]] = []
        steps = _Steps(proposed, changes, new, made)
        while steps.open and most != 0:
            while heap and self.counts.get(heap[0][1], 0) != -heap[0][0]:
                heapq.heappop(heap)
            if heap and loose >= -heap[0][0]:
                return len(self.taken), False
            if not heap:
                return len(self.taken), True
            best = heap[0][1]
            step, found = steps.at.get(best), {}
            if step is not None:
                if not steps.first(step):
                    return len(self.taken), True
                self.taken.append(step)
            elif not words or sum(w.count(best) for w in words) != self.counts[best]:
                return len(self.taken), True
            if name is not None:
                symbol, is_new, same = name(best >> 32, best & 0xFFFFFFFF)
                self.merged.append((best >> 32, best & 0xFFFFFFFF, symbol))
                steps.name(same, symbol)
            else:
                is_new = new[step]
                steps.number(step)
            if most is not None:
                most -= is_new
            if step is not None:
                found = dict(steps.take(step))
            for w in words:
                _add(found, *w.merge(*self.merged[-1]))
            for p, change in found.items():
                if not change:
                    continue
                if p not in self.counts:
                    if change < 0:
                        continue
                    if not is_new:
                        self.loose[p] = self.loose.get(p, -self.last[0]) + change
                        loose = max(loose, self.loose[p])
                        continue
                n = self.counts.get(p, 0) + change
                if (-n, p) <= self.last:
                    self.counts[p] = n
                    heapq.heappush(heap, (-n, p))
                else:
                    self.counts.pop(p, None)
        return len(self.taken), True


class _Steps:
    """Proposed merges with their changes; a merge can change places with the one before where no word holds them overlapping.

    Where they only stand side by side, the later one met the earlier one's symbol x instead of its parts: its changes of pairs
    (x, .) and (., x) become those of x's right and left part, and the earlier one gets the difference, as both together
    change the same.
    """

    def __init__(self, proposed: list[int], changes: dict[int, tuple], new: list[bool], made: list[int] | None):
        self.proposed, self.new, self.made = proposed, new, made
        self.changes = {i: dict(zip(*c, strict=True)) for i, c in changes.items()}
        self.open = list(range(len(proposed)))
        fresh = {m: None for m, is_new in zip(made or (), new, strict=False) if is_new}
        self.next = min(fresh, default=0)
        self.names: dict[int, int | None] = fresh  # number of each new symbol, once its step is taken
        self.at: dict[int, int] = {}
        self.users: dict[int, list[int]] = {}
        for i, p in enumerate(proposed):
            parts = {s for s in (p >> 32, p & 0xFFFFFFFF) if s in fresh}
            for s in parts:
                self.users.setdefault(s, []).append(i)
            if not parts:
                self.at.setdefault(p, i)

    def first(self, step: int) -> bool:
        """Bring a step before all open ones; False if it has to stay behind one of them."""
        at = self.open.index(step)
        return at == 0 or (self.made is not None and all(self._swap(i, step) for i in reversed(self.open[:at])))

    def _swap(self, i: int, j: int) -> bool:
        a, b, x = self.proposed[i] >> 32, self.proposed[i] & 0xFFFFFFFF, self.made[i]
        c, d, y = self.proposed[j] >> 32, self.proposed[j] & 0xFFFFFFFF, self.made[j]
        before, after = self.changes.setdefault(i, {}), self.changes.setdefault(j, {})
        if not before:
            return True
        if x in (c, d, y) or before.get(self.proposed[j], 0):
            return False
        met = [((x, c), (b, c)), ((x, y), (b, y)), ((d, x), (d, a)), ((y, x), (y, a))]
        met = [(k[0] << 32 | k[1], to[0] << 32 | to[1]) for k, to in met]
        if not (self.new[i] and self.new[j]):
            return not any(after.get(k, 0) for k, _ in met)
        for k, to in met:
            if v := after.pop(k, 0):
                after[to] = after.get(to, 0) + v
                before[to] = before.get(to, 0) - v
                before[k] = before.get(k, 0) + v
        return True

    def number(self, step: int) -> None:
        """Number a step's symbol, if it is new, by the turns."""
        if self.made is not None and self.new[step]:
            self.name(self.made[step], self.next)
            self.next += 1

    def name(self, symbol: int | None, number: int) -> None:
        """Number a symbol of the steps, which makes its users known."""
        if self.names.get(symbol, number) is None:
            self.names[symbol] = number
            for i in self.users.get(symbol, ()):
                if None not in (self.names.get(s, s) for s in (self.proposed[i] >> 32, self.proposed[i] & 0xFFFFFFFF)):
                    self.at.setdefault(self._named(self.proposed[i]), i)

    def _named(self, pair: int) -> int:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        return self.names.get(left, left) << 32 | self.names.get(right, right)

    def take(self, step: int) -> list[tuple[int, int]]:
        """The step's (pairs, changes), its symbol being numbered."""
        self.open.remove(step)
        return [(self._named(p), change) for p, change in self.changes.pop(step, {}).items() if change]


def learn(
    state: DataFrame, wanted: int, least: int, name, held: int = HELD, most: int = BATCH, keep: int = KEEP, head: int = HEAD
) -> list[tuple[int, int]]:
    """The merges (left, right) in order, at most until ``name`` has given ``wanted`` new symbols.

    ``state`` has a row for each word: w (its symbols as 32-bit integers) and freq. ``name(left, right)`` gives the symbol
    that a merge makes and whether it is new; ``name.undo(n)`` takes back the last n new ones, ``name.tokens`` holds all. The driver holds ``held``
    pairs and the ``head`` most frequent words.
    """
    words, some, above = _most_frequent(state, head)
    learner, merges, known, batch, counted = Learner(least), [], [], min(256, most), False
    while wanted > 0:
        if not counted:
            state, known = _applied(state, known), []
            pairs = state.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            top = pairs.where(F.col("n") >= learner.least).orderBy(F.desc("n"), "pair").limit(held).toArrow()
            learner.hold(top["pair"].to_pylist(), top["n"].to_pylist(), len(top) < held)
            counted = True
            if not len(top):
                break
        steps, new = learner.guess(words.copy(), min(batch, wanted), name, [some.copy()])
        if not steps:
            counted = False
            if learner.last[1] == _END and not learner.loose:
                break
            continue
        each = -(-SENT // state.rdd.getNumPartitions())
        shared = state.sparkSession.sparkContext.broadcast((known, steps, learner.rivals, above, each))
        found = state.mapInArrow(_changes(shared), _CHANGES)
        found = found.groupBy("step", "pair", "w").agg(F.sum("change").alias("change"))
        found = found.where(F.col("change") != 0).toArrow()
        shared.destroy()
        sent = found.filter(pc.equal(found["step"], -1)).select(["w", "change"])
        held_now = _read(sent.to_batches())
        again = held_now.copy()
        step, pair, change = (found[c].to_numpy() for c in ("step", "pair", "change"))
        order = np.argsort(step, kind="stable")
        step, pair, change = step[order], pair[order], change[order]
        cuts = np.searchsorted(step, np.arange(len(steps) + 1))
        changes = {}
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rest = dict(zip(pair[a:b].tolist(), change[a:b].tolist(), strict=True))
            for codes, own in (learner.tried[i], again.merge(*steps[i])):
                _add(rest, codes, -own)
            rest = {p: c for p, c in rest.items() if c}
            changes[i] = (list(rest), list(rest.values()))
        fresh = {name.tokens[m]: m for (_, _, m), is_new in zip(steps, new, strict=True) if is_new}
        name.undo(sum(new))

        def final(left: int, right: int) -> tuple[int, bool, int | None]:
            made, is_new = name(left, right)
            return made, is_new, fresh.get(name.tokens[made])

        before = len(name.tokens)
        pairs, symbols = [a << 32 | b for a, b, _ in steps], [m for _, _, m in steps]
        _, counted = learner.replay(pairs, changes, new, symbols, (words, held_now), final, wanted)
        taken = learner.merged
        wanted -= len(name.tokens) - before
        merges += [s[:2] for s in taken]
        known += taken
        for s in taken:
            some.merge(*s)
        batch = min(most, max(256, 2 * len(taken)))
        if len(known) > keep and counted:
            state, known = _applied(state, known), []
            words, some = words.shorter(), some.shorter()
    return merges


def _most_frequent(state: DataFrame, head: int) -> tuple[Words, Words, int]:
    """At most ``head`` words: all of more than so many occurrences, some that have just as many, and that number."""
    top = state.orderBy(F.desc("freq"), "w").limit(head + 1).toArrow()
    above = pc.min(top["freq"]).as_py() if len(top) > head else 0
    more = pc.greater(top["freq"], above)
    return *(_read(top.filter(x).to_batches()) for x in (more, pc.invert(more))), above


def _applied(state: DataFrame, known: list[tuple[int, int, int]]) -> DataFrame:
    """The words after the merges, written."""
    if not known:
        return state
    shared = state.sparkSession.sparkContext.broadcast(known)
    now = cut_lineage(state.mapInArrow(_merged(shared), "w binary, freq long"))
    shared.destroy()
    return now

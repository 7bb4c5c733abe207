"""Expressions over id, score and mask arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, use) -> Column:
    """Name an intermediate value so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def indices(n: Column) -> Column:
    """0 .. n-1; empty when n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeat(value, n: Column) -> Column:
    return F.array_repeat(_int(value), F.greatest(n, F.lit(0)).cast("int"))


def head(ids: Column, n) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(_int(n), F.lit(0)).cast("int"))


def pad(ids: Column, length, value) -> Column:
    return F.concat(ids, repeat(value, _int(length) - F.size(ids)))


def frame(ids: Column, cls: int, sep: int) -> Column:
    return F.concat(F.array(F.lit(cls)), ids, F.array(F.lit(sep)))


def padding_mask(n_real: Column, length) -> Column:
    """True on padding."""
    return F.concat(repeat(False, n_real), repeat(True, _int(length) - n_real))


def _exponentials(scores: Column, use) -> Column:
    """exp(score - max), each intermediate computed once per array."""
    return let(F.array_max(scores), lambda top: let(F.transform(scores, lambda x: F.exp(x - top)), use))


def softmax(scores: Column) -> Column:
    return _exponentials(scores, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(scores: Column) -> Column:
    return F.array_max(scores) + _exponentials(scores, lambda e: F.log(total(e)))


def cross_entropy(scores: Column, target: Column) -> Column:
    return log_sum_exp(scores) - F.element_at(scores, (target + 1).cast("int"))


def argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def mixture(a: Column, b: Column) -> Column:
    """Mean of two softmaxes."""
    return F.zip_with(softmax(a), softmax(b), lambda x, y: 0.5 * x + 0.5 * y)


def first_classes_against_last(scores: Column, first: int = 2) -> Column:
    """Softmax, then the summed share of the first classes against the last one."""
    p = softmax(scores)
    return F.array(total(F.slice(p, 1, first)), F.element_at(p, -1))


def top_k(scores: Column, k: int) -> Column:
    """The k largest entries as struct(score, index), best first, ties by lower index."""
    ranked = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    best = F.slice(F.array_sort(ranked), 1, k)
    return F.transform(best, lambda s: F.struct((-s["neg"]).alias("score"), s["index"].alias("index")))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))


def sample_std(values: Column) -> Column:
    n = F.size(values)

    def spread(mean):
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))

    return F.sqrt(let(total(values) / n, spread) / (n - 1))


def span_mask(n: Column, start: Column, end: Column) -> Column:
    """False inside the inclusive span, True outside."""
    return F.transform(indices(n), lambda i: ~i.between(start, end))


def multi_hot(labels: Column, n_classes: int) -> Column:
    """How often each class id occurs in ``labels``."""
    classes = F.array(*[F.lit(v) for v in range(n_classes)])
    return F.transform(classes, lambda v: F.size(F.filter(labels, lambda x: x == v)))


def fair_lengths(lengths: Column, budget: Column) -> Column:
    """Shorten the longest first until the sum fits the budget.

    All lengths are cut to the highest common ceiling that fits; tokens left over go one each
    to the originally longest entries, earlier ones first on a tie.
    """
    def with_lengths(lengths):
        def used(c):
            return F.aggregate(lengths, F.lit(0), lambda acc, n: acc + F.least(n, c))

        def with_budget(room):
            ceilings = indices(F.least(F.array_max(lengths), room) + 1)
            cap = F.array_max(F.filter(ceilings, lambda c: used(c) <= room))
            return let(cap, lambda c: let(room - used(c), lambda spare: deal(c, spare)))

        def deal(cap, spare):
            ranked = F.transform(lengths, lambda m, j: F.struct(m.alias("m"), j.alias("j")))

            def one(n, i):
                ahead = F.size(F.filter(ranked, lambda s: (s["m"] > n) | ((s["m"] == n) & (s["j"] < i))))
                return F.when(n <= cap, n).otherwise(cap + F.when(ahead < spare, 1).otherwise(0))

            return F.transform(lengths, one)

        room = F.greatest(budget.cast("int"), F.lit(0))
        fits = F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n) <= room
        return F.when(fits, lengths).otherwise(let(room, with_budget))

    return let(lengths, with_lengths)


def cut_to(sentences: Column, lengths: Column) -> Column:
    return F.zip_with(sentences, lengths, lambda s, n: F.slice(s, F.lit(1), n))

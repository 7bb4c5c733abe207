"""URL rules answered by cascades of Bloom filters, without joins.

A rule is a host and the beginning of a path. It fits its host and all subdomains; of the rules that fit a URL the
longest wins. The keys of a URL are its host's last n labels followed by the first k characters of its path, for every
n and k that occurs among the rules, so a URL has as many keys as there are such pairs, however long it is.

For each verdict one cascade encodes which of the corpus's keys are listed. Level 1 holds the listed keys; level 2 holds
the other keys of the corpus that level 1 lets through; level 3 the listed keys that level 2 lets through, and so on until
nothing passes wrongly. A key is listed if the first level that rejects it is an even one. Over the corpus whose keys built
the cascade the answer is exact. Filters become literals of the query; their size follows the rules and the logarithm of
the corpus's keys, and is checked against ``max_bits``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``.

    Both are empty for null and for a URL without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(bare, "/", 1)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Array of structs (size, labels, key), one for each shape of rule that the URL is long enough for."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    have = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1

    def one(n: int, k: int) -> Column:
        key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))
        return F.when(
            (have >= n) & (F.length(path) >= k),
            F.struct(F.length(key).alias("size"), F.lit(n).alias("labels"), key.alias("key")),
        )

    return F.array_compact(F.array(*[one(n, k) for n, k in shapes]))


@dataclass(frozen=True)
class Bloom:
    """A filter as 64-bit words; ``salt`` tells the levels of a cascade apart."""

    words: tuple[int, ...]
    hashes: int
    salt: int

    @staticmethod
    def place(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
        one, two = (F.pmod(h, F.lit(bits)) for h in (F.xxhash64(F.lit(salt), key), F.xxhash64(key, F.lit(salt))))
        return [F.pmod(one + two * i, F.lit(bits)) for i in range(hashes)]

    def holds(self, key: Column) -> Column:
        """Whether the filter lets the key through."""
        words = F.lit(list(self.words))
        bits = 64 * len(self.words)
        found = F.lit(True)
        for at in self.place(key, bits, self.hashes, self.salt):
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            found = found & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found

    @classmethod
    def of(cls, keys: DataFrame, count: int, rate: float, salt: int, max_bits: int) -> Bloom:
        """The filter over column ``key``: set bits are combined by word, so the driver gets at most ``max_bits`` bits."""
        bits = 64 * max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
        if bits > max_bits:
            raise ValueError(f"{count} keys need {bits} bits; max_bits is {max_bits}")
        hashes = max(1, round(-math.log2(rate)))
        at = F.explode(F.array(*cls.place(F.col("key"), bits, hashes, salt)))
        words = (
            keys.select(at.alias("at"))
            .groupBy(F.floor(F.col("at") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        )
        out = [0] * (bits // 64)
        for w, b in words.collect():
            out[w] = b
        return cls(tuple(out), hashes, salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def lists(self, key: Column) -> Column:
        """Whether the key is listed: exact for every key the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)  # what the last level lets through
        for k, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.holds(key), answer).otherwise(k % 2 == 1)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 23) -> Cascade:
    """Cascade over two tables of column ``key``; ``universe`` may hold repeats and listed keys.

    Level 1 lets through about as many other keys as are listed, deeper levels half of theirs. Only the first two steps
    read the universe; what passes level 1 wrongly is written down and all later levels work on it.
    """
    inside = listed.select("key").where("key is not null").distinct()
    n = inside.count()
    if not n:
        return Cascade(())
    total = universe.count()
    levels = [Bloom.of(inside, n, min(0.5, max(n / max(total, 1), 1e-9)), 1, max_bits)]
    outside = universe.select("key").where(levels[0].holds(F.col("key"))).distinct()
    outside = written(outside.join(inside, "key", "left_anti"))
    sides, turn = [inside, outside], 1
    while (count := sides[turn].count()) > 0:
        level = Bloom.of(sides[turn], count, 0.5, len(levels) + 1, max_bits)
        levels.append(level)
        turn = 1 - turn
        sides[turn] = written(sides[turn].where(level.holds(F.col("key"))))
    return Cascade(tuple(levels))


def _listed_keys(keys: str, cascade: Cascade, verdict: str) -> Column:
    return F.transform(
        F.filter(keys, lambda k: cascade.lists(k["key"])),
        lambda k: F.struct(k["size"], k["labels"], k["key"], F.lit(verdict).alias("verdict")),
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_bits: int = 1 << 23
) -> DataFrame:
    """The rows with host, path, rule and verdict.

    Null URLs and URLs without ``://`` have empty host and path. A URL that no rule fits has a null rule and the verdict
    ``default``, because neither cascade lists any of its keys. Of two verdicts on one key the first given counts. Equally
    long rules: the one with more labels in its host wins. Columns named host, path, rule or verdict are replaced.
    """
    spark: SparkSession = pages.sparkSession
    own: dict[str, Rule] = {}
    for r in rules:
        own.setdefault(r.host.translate(str.maketrans(UPPER, LOWER)) + r.path, r)
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    if not own:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = url_keys(F.col("host"), F.col("path"), list(own.values()))
    seen = pages.select(host.alias("host"), path.alias("path")).select(F.explode(keys).alias("k")).select("k.key")
    fits = []
    for verdict in sorted({r.verdict for r in own.values()}):
        listed = spark.createDataFrame([(k,) for k, r in own.items() if r.verdict == verdict], "key string")
        cascade = build_cascade(listed, seen, max_bits)
        fits.append(_listed_keys("_keys", cascade, verdict))
    best = F.array_max(F.concat(*fits))
    return (
        judged.withColumn("_keys", keys)
        .withColumn("_best", best)
        .withColumns({"rule": F.col("_best.key"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
        .drop("_keys", "_best")
    )

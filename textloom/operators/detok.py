"""Tokens back to text by spacing classes and quote parity.

``spacing`` gives them for a token table, by windows; ``detokenize`` follows the same rules in one pass over the tokens of a
text, which travel as one array.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textloom.functions import text as tx

# Escapes of the token format, in the order they are undone.
TOKEN_ESCAPES = (
    ("&bar;", "|"), ("&#124;", "|"), ("&lt;", "<"), ("&gt;", ">"), ("&bra;", "["), ("&ket;", "]"),
    ("&quot;", '"'), ("&apos;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&"),
)
_CJK = r"[\x{1100}-\x{11ff}\x{2e80}-\x{a4cf}\x{a840}-\x{a87f}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff65}-\x{ffdc}\x{20000}-\x{2ffff}]"
_OPENER = r"^[\p{Sc}(\[{¿¡]+$"
_CLOSER = r"^[,.?!:;\\%}\])]+$"
_FRENCH_CLOSER = r"^[?!:;\\%]$"
_QUOTE = r"^['\"„“`]+$"
_ELISION = r"\p{L}'$"


def prepare_tokens(tokens: Column, unescape: bool = True) -> Column:
    """Undo hyphen splits and escapes, then split at blanks again."""
    t = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    t = F.replace(t, F.lit(" @-@ "), F.lit("-"))
    if unescape:
        for code, char in TOKEN_ESCAPES:
            t = F.replace(t, F.lit(code), F.lit(char))
    flat = tx.collapse_blanks(t)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def spacing(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", token: str = "token", lang: str = "lang") -> DataFrame:
    """Add ``gap``: what stands before each token once joined.

    A token has a class; some classes pull themselves to the left, some pull their follower.
    For quotes the class depends on how many quotes of the same kind came before; a plural
    possessive closes an open quote and otherwise changes nothing, which sets the parity to even.
    """
    w = Window.partitionBy(key).orderBy(pos)
    t, lg = F.col(token), F.col(lang)
    rows = tokens.withColumns({
        "_prev": F.lag(token).over(w),
        "_next": F.lead(token).over(w),
        "_next2": F.lead(token, 2).over(w),
        "_prev2": F.lag(token, 2).over(w),
    })
    prev, nxt = F.col("_prev"), F.col("_next")
    later = prev.isNotNull()
    english = lg == "en"
    dash_word = (
        (lg == "cs") & t.rlike(_ELISION) & F.coalesce(nxt.rlike(r"^[-–]$"), F.lit(False))
        & F.coalesce(F.col("_next2").rlike(r"(?i)^li$|^mail.*"), F.lit(False))
    )
    number = r"^[0-9]+$"
    cls = (
        F.when(t.rlike(f"^{_CJK}") & (lg != "ko"), F.when(prev.rlike(f"{_CJK}$"), "left").otherwise("plain"))
        .when(t.rlike(_OPENER), "opener")
        .when(t.rlike(_CLOSER), F.when((lg == "fr") & t.rlike(_FRENCH_CLOSER), "spaced").otherwise("left"))
        .when(english & later & t.rlike(r"^'\p{L}"), "left")
        .when((lg == "cs") & t.rlike(number) & prev.rlike(r"^[.,]$") & F.col("_prev2").rlike(number), "left")
        .when(lg.isin("fr", "it", "ga") & t.rlike(_ELISION) & nxt.rlike(r"^\p{L}"), "opener")
        .when(dash_word, "opener")
        .when(t.rlike(_QUOTE), "quote")
        .otherwise("plain")
    )
    rows = rows.withColumn("_cls", cls)
    single = english & (t == "'") & later
    plural = single & prev.endswith("s")
    ask = (
        F.when(F.col("_cls") != "quote", None)
        .when(plural & prev.rlike(r"^\p{Lu}"), "owner")
        .when(single & prev.rlike(r"\p{L}") & (nxt == "s"), "owner_s")
        .when(plural, "plural")
        .when((lg == "cs") & (t == "„"), "open")
        .when((lg == "cs") & (t == "“"), "close")
        .otherwise("turn")
    )
    kind = F.when(t.rlike("^[„“”]+$"), '"').otherwise(t)
    # Dashes that a word before has already taken are dropped.
    taken = F.coalesce(F.lag(dash_word).over(w), F.lit(False))
    rows = rows.withColumns({"_ask": ask, "_kind": F.when(F.col("_cls") == "quote", kind), "_taken": taken})
    same = Window.partitionBy(key, "_kind").orderBy(pos)
    before, upto = same.rowsBetween(Window.unboundedPreceding, -1), same.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("_ask") == "turn", 1).otherwise(0)
    rows = rows.withColumns({
        "_turns": F.coalesce(F.sum(turn).over(before), F.lit(0)),
        "_set": F.when(F.col("_ask").isin("plural", "close"), 0 - F.sum(turn).over(upto))
        .when(F.col("_ask") == "open", 1 - F.sum(turn).over(upto)),
    })
    parity = F.pmod(F.coalesce(F.last("_set", ignorenulls=True).over(before), F.lit(0)) + F.col("_turns"), F.lit(2))
    rows = rows.withColumn("_even", parity == 0)
    opens = (F.col("_ask") == "open") | ((F.col("_ask") == "turn") & F.col("_even"))
    final = (
        F.when(F.col("_cls") != "quote", F.col("_cls"))
        .when(F.col("_ask") == "owner_s", "both")
        .when(opens, "opener")
        .otherwise("left")
    )
    rows = rows.withColumn("_cls", final)
    glue = F.when(F.lag("_cls").over(w).isin("opener", "both"), "").otherwise(" ")
    after_dash = F.lag("_taken").over(w)
    gap = (
        F.when(F.col("_taken"), "")
        .when(F.col("_cls").isin("left", "both"), "")
        .when(F.col("_cls") == "spaced", " ")
        .when(F.coalesce(after_dash, F.lit(False)), "")
        .otherwise(glue)
    )
    scratch = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("gap", gap).drop(*scratch)


_LINE_END = re.compile("(?:\r\n|[\n\r\u0085\u2028\u2029])\\Z")
_CJK_CHAR = re.compile("[" + _CJK[1:-1].replace("\\x{20000}-\\x{2ffff}", "\U00020000-\U0002ffff").replace("\\x{", "\\u").replace("}", "") + "]")
_REMEMBERED = 1 << 18
_ROWS = 64  # texts whose tokens a task holds as Python values
# What the rules ask about a token.
(_CJK_FIRST, _CJK_LAST, _OPENS, _CLOSES, _FRENCH, _CLITIC, _NUMBER, _ELIDED, _QUOTES, _LETTER_FIRST, _LETTER, _UPPER_FIRST, _POINT, _DASH,
 _AFTER_DASH, _S_LAST) = (1 << i for i in range(16))
_CLASSED = _CJK_FIRST | _OPENS | _CLOSES | _CLITIC | _NUMBER | _ELIDED | _QUOTES  # others are plain in any language


def _traits(t: str) -> int:
    """Bits for a token; as in the patterns of ``spacing``, a line end may follow what ends it."""
    kind = unicodedata.category
    bare = _LINE_END.sub("", t)
    letters = [kind(c)[0] == "L" for c in t]
    tests = (
        bool(_CJK_CHAR.match(t)), bool(bare) and bool(_CJK_CHAR.match(bare[-1])),
        bare != "" and all(c in "([{¿¡" or kind(c) == "Sc" for c in bare), bare != "" and all(c in ",.?!:;\\%}])" for c in bare),
        len(bare) == 1 and bare in "?!:;\\%", t[:1] == "'" and letters[1:2] == [True], bare != "" and all("0" <= c <= "9" for c in bare),
        bare[-1:] == "'" and letters[len(bare) - 2 : len(bare) - 1] == [True], bare != "" and all(c in "'\"„“`" for c in bare),
        letters[:1] == [True], any(letters), t != "" and kind(t[0]) == "Lu", bare in (".", ","), bare in ("-", "–"),
        bare.lower() == "li" or t[:4].lower() == "mail", t.endswith("s"),
    )
    return sum(1 << i for i, found in enumerate(tests) if found)


def _gaps(tokens: list, langs: list, traits: list) -> Iterator[str]:
    """What stands before each token; see ``spacing``. A missing token has no traits."""
    n = len(tokens)
    at = lambda i: traits[i] if 0 <= i < n else 0
    turns, sets = {}, {}
    glued = taken = after_dash = False
    for i, (t, lang, f) in enumerate(zip(tokens, langs, traits, strict=True)):
        cls, dash = "plain", False
        if f & _CLASSED:
            before, after = at(i - 1), at(i + 1)
            later = i > 0 and tokens[i - 1] is not None
            dash = lang == "cs" and bool(f & _ELIDED and after & _DASH and at(i + 2) & _AFTER_DASH)
            if f & _CJK_FIRST and lang is not None and lang != "ko":
                cls = "left" if before & _CJK_LAST else "plain"
            elif f & _OPENS:
                cls = "opener"
            elif f & _CLOSES:
                cls = "spaced" if lang == "fr" and f & _FRENCH else "left"
            elif lang == "en" and later and f & _CLITIC or lang == "cs" and f & _NUMBER and before & _POINT and at(i - 2) & _NUMBER:
                cls = "left"
            elif lang in ("fr", "it", "ga") and f & _ELIDED and after & _LETTER_FIRST or dash:
                cls = "opener"
            elif f & _QUOTES:
                kind = '"' if not set(_LINE_END.sub("", t)) - set("„“”") else t
                single = lang == "en" and t == "'" and later
                plural = single and before & _S_LAST
                done = turns.get(kind, 0)
                cls = "left"
                if plural and before & _UPPER_FIRST:
                    pass
                elif single and before & _LETTER and i + 1 < n and tokens[i + 1] == "s":
                    cls = "both"
                elif plural or lang == "cs" and t == "“":
                    sets[kind] = -done
                elif lang == "cs" and t == "„":
                    sets[kind] = 1 - done
                    cls = "opener"
                else:
                    if (sets.get(kind, 0) + done) % 2 == 0:
                        cls = "opener"
                    turns[kind] = done + 1
        if taken or cls in ("left", "both"):
            yield ""
        elif cls == "spaced":
            yield " "
        else:
            yield "" if after_dash or glued else " "
        glued, taken, after_dash = cls in ("opener", "both"), dash, taken


def detokenize(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", token: str = "token", lang: str = "lang") -> DataFrame:
    """(key, text) from a token table, or from rows whose ``token`` is an array of tokens in order.

    Arrays of the same key are one text, their tokens taken by place.
    """
    arrays = isinstance(tokens.schema[token].dataType, ArrayType)
    if arrays:
        rows = tokens.select(key, F.col(lang).alias("lang"), F.col(token).alias("t")).repartition(key).sortWithinPartitions(key)
    else:
        item = F.struct(F.col(pos).alias("pos"), F.col(token).alias("t"), F.col(lang).alias("lang"))
        rows = tokens.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    schema = StructType([tokens.schema[key], StructField("text", StringType())])
    key_type = to_arrow_type(tokens.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {None: 0}

        def traits(t: str) -> int:
            if len(known) > _REMEMBERED:
                known.clear()
                known[None] = 0
            found = known[t] = _traits(t)
            return found

        def text(items: list) -> str:
            if not arrays:
                places, words, langs = ([x[c] for x in items] for c in ("pos", "t", "lang"))
            elif len(items) == 1:
                lang, words = items[0]
                places, langs = range(len(words)), [lang] * len(words)
            else:
                placed = sorted(((i, t, lang) for lang, ts in items for i, t in enumerate(ts)), key=lambda p: p[0])
                places, words, langs = zip(*placed, strict=True)
            bits = [known[t] if t in known else traits(t) for t in words]
            spaced = [None if t is None else g + t for g, t in zip(_gaps(words, langs, bits), words, strict=True)]
            if len(items) > 1:  # rows may share a place
                order = sorted((p is not None, p or 0, s is not None, s or "") for p, s in zip(places, spaced, strict=True))
                spaced = [s for *_, s in order]
            return re.sub(" {2,}", " ", "".join(s or "" for s in spaced)).strip(" ")

        def texts() -> Iterator[tuple]:
            last, held = None, []
            for b in batches:
                for start in range(0, b.num_rows, _ROWS):
                    part = b.slice(start, _ROWS)
                    if not arrays:
                        yield from zip(part.column(0).to_pylist(), map(text, part.column(1).to_pylist()), strict=True)
                        continue
                    for k, lang, words in zip(*[c.to_pylist() for c in part.columns], strict=True):
                        if not words:
                            continue
                        if held and k != last:
                            yield last, text(held)
                            held = []
                        last = k
                        held.append((lang, words))
            if held:
                yield last, text(held)

        for some in batched(texts(), _ROWS):
            keys, made = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(made, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, schema)


def detokenize_lists(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", lang: str = "lang", unescape: bool = True) -> DataFrame:
    """(key, text) from token arrays, with escapes undone first."""
    rows = df.select(key, F.col(lang).alias("lang"), prepare_tokens(F.col(tokens), unescape).alias("token"))
    return detokenize(rows, key)

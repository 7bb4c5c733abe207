import random

from pyspark.sql import functions as F

import spec
from textloom.functions import repair as rp
from textloom.functions import text as tx


def _apply(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def _random_texts(alphabet, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_space_punctuation_matches_sequential_reading(spark):
    texts = _random_texts("abAZÉ12  ..,;:?!…’‘()[]{}$£€%\n", 3000, 24, 1)
    assert _apply(spark, tx.space_punctuation, texts) == [spec.space_punctuation(t) for t in texts]


def test_pair_double_quotes_matches_sequential_reading(spark):
    texts = _random_texts('ab1  """.', 3000, 16, 2)
    assert _apply(spark, tx.pair_double_quotes, texts) == [spec.pair_double_quotes(t) for t in texts]


def test_clitics_go_one_spelling_after_another(spark):
    got = _apply(spark, tx.attach_clitics, ["I do n't , he 'll.", "a 's 's b", "x 's n't y", "We N'T, go"])
    assert got == ["I don't , he'll.", "a's 's b", "x 'sn't y", "WeN'T, go"]


def test_small_projections(spark):
    one = lambda fn, t: _apply(spark, fn, [t])[0]
    assert one(tx.collapse_blanks, " a\t b\x1cc \x85") == "a b c"
    assert one(tx.collapse_blanks_keep_newlines, " a  \n  b\tc ") == "a \n b c"
    assert one(tx.strip, " \x1c a b 　\n") == "a b"
    assert one(tx.capitalise_first, "ßa") == "SSa" and one(tx.capitalise_first, "iPod x") == "IPod x"
    assert _apply(spark, tx.strip_dash, ["- x", "-x", "-", "x"]) == ["x", "x", "", "x"]
    marked = ["a:", '"a', 'a"', "(a)", "[a]", "{a}", "(a", "a"]
    assert _apply(spark, tx.quote_unless_marked, marked) == ["a:", '"a', 'a"', "(a)", "[a]", "{a}", '"(a"', '"a"']
    assert one(tx.unescape_treebank, "-LRB- `` a '' -RSB- ``b''") == '( "a" ] "b"'
    assert _apply(spark, tx.mark_indent, ["    a  b", "   a", "\ta"]) == ["[TAB] a b", "a", "a"]
    assert one(tx.link_targets, "[[Cat|cats]] [[Dog]] [[a|b|c]]") == "Cat Dog a"
    assert one(tx.unwrap_headings, "= = = A b = = =") == "A b"
    assert one(tx.drop_citations, "a[12] b[x]") == "a b[x]"
    assert one(lambda t: tx.unescape_entities(t, 2), "&amp;lt;b&amp;gt;") == "<b>"
    assert one(tx.drop_tab_marks, " [TAB] a [TAB] b ") == "a b"


def test_predicates(spark):
    texts = ["12:", "a:", ".", "a &lt;b&gt;", "x -> y", "[[Category:a]]", "..."]
    assert _apply(spark, tx.not_bare_label, texts)[:2] == [False, True]
    assert _apply(spark, tx.not_lone_punctuation, texts)[2] is False
    assert _apply(spark, tx.no_angle_entity_pair, texts)[3] is False
    assert _apply(spark, tx.no_arrow, texts)[4] is False
    assert _apply(spark, tx.not_page_furniture, texts)[5] is False
    assert _apply(spark, tx.has_alphanumeric, texts)[6] is False
    stub = "is a city in" + "x" * 115
    assert _apply(spark, tx.is_stub, [stub, stub + "x"]) == [True, False]


def test_clean_chain(spark):
    df = spark.createDataFrame(
        [(0, "He said.Then , he 's here"), (1, "“q” ﬁx ＡＢ cafÃ© &eacute; don’t"), (2, "é <b>&amp;</b>"), (3, "a\x1b[31mb\x07 ｶﾞ")],
        "i int, text string",
    )
    full = [r.text for r in rp.clean(df).orderBy("i").collect()]
    minimal = [r.text for r in rp.clean(df, minimal=True).orderBy("i").collect()]
    assert full[0] == "He said. Then, he's here"
    assert minimal[1] == '"q" fix AB café é don\'t'
    assert full[1] == '"q" fix AB café é don\' t'
    assert minimal[2] == "é <b>&amp;</b>"
    assert minimal[3] == "ab ガ"


def test_cheap_looks_change_no_result(spark):
    """Places and texts that the rules skip at a first look are those that they would leave as they are."""
    rng = random.Random(8)
    signs = list("aB1 ..  ,;:?!…’()[]{}%$£€‘“”ʼ\t\n\r\x0b\x85 \xa0　\x1c\x1b\x07\x7fé") + ["\x1b[0m", "...", "x...", "1:2", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None]
    t = F.col("t")
    spaced = F.regexp_replace(tx.collapse_blanks_keep_newlines(t), f"(?s){tx._TIGHTEN}", tx.MARK)
    spaced = F.replace(F.regexp_replace(spaced, f"(?s){tx._LOOSEN}", " "), F.lit(tx.MARK), F.lit(""))
    marks = t
    for pattern, new in ((r"[ʼ‘-‛]", "'"), (r"[“-‟]", '"'), (r"\r\n|[\r  \x85]", "\n"), (r"\x1b\[[\p{Nd};]*[a-zA-Z]", ""),
                         (r"[\x00-\x08\x0b\x0e-\x1f\x7f⁪-⁯﻿￹-￼]", "")):
        marks = F.regexp_replace(marks, pattern, new)
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", tx.space_punctuation(t).alias("a"), spaced.alias("b"), rp._plain_marks(t).alias("c"), marks.alias("d"),
        tx.collapse_blanks(t).alias("e"), F.trim(F.regexp_replace(t, rf"{tx.BLANK}+", " ")).alias("f"))
    for r in df.collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), repr(r.t)
    assert tx._LOOSE and rp._SPECIAL_MARKS

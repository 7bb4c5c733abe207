import os
import random

import pytest
from pyspark.sql import functions as F

import spec
from textloom.functions import text as tx
from textloom.operators import lines as ln
from textloom.operators import segment
from textloom.operators.ordered import DOCUMENT_LINES, LineOrder, dense_index, scan
from textloom.plans import corpora
from textloom.plans import table_queries as tq

SMALL = "/root/testdata/sf0.001"

LAYOUTS = [(), (1, 3), (14, 38)]


def _lines(seed, n=160):
    rng = random.Random(seed)
    out = {}
    for key in ("x", "y"):
        at, rows = 0, []
        for _ in range(n):
            at += rng.choice([1, 1, 1, 9, 4000, 2**39])
            rows.append((at, rng.choice(["", "", "a", "a", "b", "c"])))
        out[key] = rows
    return out


def _frame(spark, data, parts):
    rows = [(k, i, t) for k, ls in data.items() for i, t in ls]
    random.Random(parts).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, text string").repartition(parts)


def _check(df, want):
    got = {k: sorted((r.i, r.text) for r in df.where(F.col("k") == k).collect()) for k in want}
    assert got == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("shifts", LAYOUTS)
def test_neighbour_rules_do_not_depend_on_layout(spark, shifts):
    data = _lines(7)
    order = LineOrder(("k",), "i", (), shifts)
    df = _frame(spark, data, 1 + len(shifts) * 3)
    each = lambda fn: {k: fn(v) for k, v in data.items()}
    _check(ln.drop_repeats(df, order), each(spec.repeats))
    _check(ln.drop_repeats_keep_blanks(df, order), each(lambda v: spec.repeats(v, blanks_reset=True)))
    _check(ln.drop_repeats_across_blanks(df, order), each(lambda v: spec.repeats(v, across_blanks=True)))
    _check(ln.keep_paragraph_gaps(df, order), each(spec.gaps))
    _check(ln.reflow_paragraphs(df, order), each(spec.reflow))
    stub = df.withColumn("is_stub", F.col("text") == "b")
    _check(ln.drop_stub_entries(stub, order), each(lambda v: spec.stubs([(i, t, t == "b") for i, t in v])))


def test_scan_values_and_unsorted_keys(spark):
    df = spark.createDataFrame([("k", 5, 1), ("k", 70, 2), (None, 3, 9), ("k", 2**50, 4)], "k string, i long, v int")
    out = scan(df, LineOrder(("k",), "i", (), (2, 10)), back=F.col("v"), depth=2, ahead=F.col("v"), carry=F.col("v"), add=F.col("v"))
    got = {(r.k, r.i): ([p.v for p in r.prev], r.next and r.next.v, r.carried, r.before, r.total) for r in out.collect()}
    assert got == {
        ("k", 5): ([], 2, None, 0, 7), ("k", 70): ([1], 4, 1, 1, 7), ("k", 2**50): ([2, 1], None, 2, 3, 7),
        (None, 3): ([], None, None, 0, 9),
    }


def test_dense_index_and_flush(spark):
    df = spark.createDataFrame([("k", i * 37, "t") for i in range(50)], "k string, i long, text string")
    out = dense_index(df, LineOrder(("k",), "i", (), (4,)))
    assert [r.line_no for r in out.orderBy("i").collect()] == list(range(50))
    kept = ln.reflow_paragraphs(df, LineOrder(("k",), "i", (), (4,)), flush_tail=True).collect()
    assert len(kept) == 1 and kept[0].text == " ".join(["t"] * 50)


def _corpus(spark, name, texts):
    return spark.createDataFrame([("train", name, i, t) for i, t in enumerate(texts)], "split string, corpus string, line_no long, text string")


def _run(spark, plan, texts):
    out = plan(_corpus(spark, "c", texts))
    keys = [c for c in ("line_no", "sub") if c in out.columns]
    return [r.text for r in out.orderBy(*keys).collect()]


def test_corpus_plans(spark):
    assert _run(spark, corpora.child_speech, ["hi .", "hi .", "", "you"]) == ['"Hi."', '"You"']
    assert _run(spark, corpora.spoken_dialogue, ["a", ".", "a", "", "a"]) == ['"A"', "", '"A"']
    assert _run(spark, corpora.treebank_stories, ["a -LRB- b -RRB-", "", ""]) == ["a (b)", "", ""]
    assert _run(spark, corpora.indented_stories, ["    a", "", "b", "c", "", ""]) == ["[TAB] a", "b", "c", ""]
    assert _run(spark, corpora.wrapped_books, ["a", "b", "", "", "c", "", "d"]) == ["a b", "", "c"]
    assert _run(spark, corpora.subtitles, ["- a", "a", "", "", "X:", "(b)"]) == ['"a"', "", "X:", "(b)"]
    caps = ["&lt;b&gt; <", "a &amp;lt; b", "x -> y", "12:", "Bob:", "- hi", "hi"]
    assert _run(spark, corpora.talk_captions, caps) == ['"a < b"', "Bob:", '"hi"']
    wiki = ["Title", "X is a city in Y", "", "Kept[3]", "text &amp;lt;", "", "tail"]
    assert _run(spark, corpora.simple_encyclopedia, wiki) == ["Kept", "text <", ""]
    assert _run(spark, corpora.phone_dialogue, ["a", "", "a", "b"]) == ['"a"', "", '"b"']
    pages = ["= = = A = = =", "[[Category:x]]", "see [[Cat|cats]] [1]", "= = = B = = =", ""]
    assert _run(spark, corpora.encyclopedia, pages) == ["A", "see Cat ", "", "B"]


def test_union_keeps_corpus_order(spark):
    df = _corpus(spark, "gutenberg", ["a", ""]).unionByName(_corpus(spark, "aochildes", ["b"]))
    rows = corpora.clean_all(df).orderBy("corpus_rank", "line_no", "sub").collect()
    assert [r.text for r in rows] == ['"B"', "a"]
    assert {r.corpus: r.blank_lines for r in corpora.blank_line_count(df).collect()} == {"gutenberg": 1, "aochildes": 0}


def test_sentences(spark):
    order = LineOrder(("k",), "i", (), (1, 3))
    texts = ["One two. Three", "", "four. and five? Six", "Seven.", "", "", "A. Smith came. Dr. X left."]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, i long, text string")
    got = [r.text for r in segment.segment_corpus(df, order, ["dr"]).orderBy("sentence_no").collect()]
    assert got == [
        "One two.[PAR]", "Three\n\nfour. and five?[PAR]", "Six\nSeven.[PAR]", "A. Smith came.[PAR]", "Dr. X left.[PAR]",
    ]
    lines = [r.text for r in segment.segment_lines(df, ["dr"]).orderBy("i", "sent").collect()]
    assert lines == ["One two.", "Three[PAR]", "", "four. and five?", "Six[PAR]", "Seven.[PAR]", "", "", "A. Smith came.", "Dr. X left.[PAR]"]


def test_abbreviations_are_learned(spark):
    text = "dr. Smith met dr. Jones . The word ends here . A word is here . " * 30
    scores = segment.abbreviation_scores(spark.createDataFrame([(text,)], "text string"))
    found = {r.type: r.score for r in scores.collect()}
    assert found["dr"] > 0.3
    assert "dr" in segment.abbreviations(scores)


def test_sentences_of_scripts_without_case(spark):
    rows = [("తెలుగు వాక్యం ఒకటి. రెండవ వాక్యం. మూడు", 3), ("पहला वाक्य। दूसरा वाक्य।", 2), ("一つ目。二つ目！「三つ目。」終わり", 4), ("one. two", 1)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, text string")
    got = {r.i: r["count"] for r in segment.segment_lines(df).groupBy("i").count().collect()}
    assert got == {i: n for i, (_, n) in enumerate(rows)}


def test_cuts_after_learned_abbreviations_are_taken_back(spark):
    """Abbreviations as a table longer than any list the patterns take; equal to the list form where both apply."""
    texts = [
        "We met Dr. Low. He left.", 'So "Dr. Low" and (prof. Ann) came. "Etc." Then 3 more. ', "No dr.", "", "  Dr. Dr. Dr. X. Y z.", "Ok. Dr.) Low",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "d long, i int, text string")
    many = [(f"w{'abcdefghij'[k % 10]}{k}", 1.0) for k in range(6000)] + [("dr", 0.4), ("prof", 0.31), ("low", 0.1)]
    scores = spark.createDataFrame(many, "type string, score double")
    got = {(r.i, r.sent): r.text for r in segment.segment_lines_learned(df, scores, ["d", "i"]).collect()}
    want = {(r.i, r.sent): r.text for r in segment.segment_lines(df, ["dr", "prof"]).collect()}
    assert got == want
    assert got[0, 0] == "We met Dr. Low." and got[0, 1] == "He left.[PAR]" and got[3, 0] == ""
    plain = segment.segment_lines_learned(df, scores.limit(0), ["d", "i"]).collect()
    assert {(r.i, r.sent): r.text for r in plain} == {(r.i, r.sent): r.text for r in segment.segment_lines(df).collect()}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_marked_queries_fire_their_rules(spark):
    """Each rule drops rows of the query that is registered for it."""
    t = F.col("text")
    arms = (F.concat(F.lit("&lt;i&gt; "), t), F.concat(t, F.lit(" -> x")), F.lit("12 :"))
    marked = tq._marked_page_lines(spark, SMALL, arms)
    dropped = {n: marked.where(~keep(t)).count() for n, keep in (("F2", tx.no_angle_entity_pair), ("F3", tx.no_arrow), ("F4", tx.not_bare_label))}
    left = tq.lines_captions_marked(spark, SMALL)
    assert left.where(~tx.no_arrow(t) | ~tx.not_bare_label(t) | F.contains(t, F.lit("<i>"))).count() == 0

    places = lambda df: df.select("page_id", "pos").distinct().count()
    dropped["F6"] = places(tq.wiki_markup(spark, SMALL)) - places(tq.wiki_markup_furnished(spark, SMALL))
    dropped["F10"] = tq.speaker_turns(spark, SMALL).count() - tq.speaker_turns_wordless(spark, SMALL).count()
    with_stubs = tq.stub_filter_phrases(spark, SMALL)
    dropped["F5"] = corpora.simple_encyclopedia(tq.corpus_lines(spark, SMALL), DOCUMENT_LINES).count() - with_stubs.count()
    assert with_stubs.where(tx.is_stub(t)).count() == 0
    assert min(dropped.values()) > 0, dropped

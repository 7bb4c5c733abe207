"""One cleaning plan per kind of corpus, and their union in a fixed order.

Every plan takes a line table (keys, order columns, raw ``text``) and returns the cleaned
lines with the same key and order columns; plans that add lines also return ``sub``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.repair import apply_steps, clean_steps
from textloom.operators import lines as ln
from textloom.operators.ordered import FILE_LINES, LineOrder


def _t():
    return F.col("text")


def _text(df: DataFrame, *steps) -> DataFrame:
    return apply_steps(df, list(steps))


def _unless_blank(fn):
    return lambda t: F.when(t == "", "").otherwise(fn(t))


def child_speech(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Transcribed child speech: capitalised, cleaned, quoted, repeats dropped; blank lines go."""
    df = _text(df, tx.strip).where(tx.not_blank(_t()))
    df = _text(df, tx.capitalise_first, *clean_steps(arrow=arrow), tx.quote)
    return ln.drop_repeats(df, order)


def spoken_dialogue(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Spoken conversation: lone punctuation goes, blanks stay and reset repeats."""
    df = _text(df, tx.strip).where(tx.not_lone_punctuation(_t())).withColumn("blank", _t() == "")
    df = _text(df, tx.capitalise_first, *clean_steps(arrow=arrow))
    df = df.withColumn("text", F.when(F.col("blank"), "").otherwise(tx.quote(_t()))).drop("blank")
    return ln.drop_repeats_keep_blanks(df, order)


def treebank_stories(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Treebank-escaped stories: brackets and quotes restored, no line is dropped."""
    return _text(df, tx.strip, tx.unescape_treebank, *clean_steps(arrow=arrow))


def indented_stories(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Stories with indented paragraphs: tab marks, blanks only after longer paragraphs."""
    marked = F.when(tx.strip(_t()) == "", "").otherwise(tx.mark_indent(_t()))
    df = _text(df.withColumn("text", marked), *clean_steps(True, arrow))
    return ln.keep_paragraph_gaps(df, order)


def wrapped_books(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True, flush_tail: bool = False) -> DataFrame:
    """Hard-wrapped books: paragraphs become one line each."""
    df = _text(df, tx.collapse_blanks, *clean_steps(True, arrow))
    return ln.reflow_paragraphs(df, order, flush_tail)


def subtitles(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Subtitles: dashes off after cleaning, lines quoted, repeats and blank runs dropped."""
    df = _text(df, tx.collapse_blanks, *clean_steps(True, arrow), tx.strip_dash, _unless_blank(tx.quote_unless_marked))
    return ln.drop_repeats(df, order)


def talk_captions(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Talk captions: dashes off before cleaning; escaped tags, arrows and bare labels go."""
    df = _text(df, tx.collapse_blanks, tx.strip_dash, *clean_steps(True, arrow))
    plain, no_tags = tx.entity_rounds(_t(), 3)
    df = df.withColumns({"text": plain, "tag_free": (_t() == "") | no_tags}).where("tag_free").drop("tag_free")
    df = df.where((_t() == "") | (tx.no_arrow(_t()) & tx.not_bare_label(_t())))
    return ln.drop_repeats(_text(df, _unless_blank(tx.quote_unless_marked)), order)


def simple_encyclopedia(
    df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True,
    stub_phrases=tx.STUB_PHRASES, flush_tail: bool = False,
) -> DataFrame:
    """Short encyclopedia: boilerplate entries go together with their titles."""
    df = _text(df, tx.collapse_blanks, tx.drop_citations, *clean_steps(True, arrow))
    df = df.withColumns({
        "is_stub": (_t() != "") & tx.is_stub(_t(), stub_phrases),
        "text": tx.unescape_entities(_t(), 2),
    })
    return ln.drop_stub_entries(df, order, "is_stub", flush_tail).drop("is_stub")


def phone_dialogue(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Telephone conversation: every text line quoted, repeats found across blanks."""
    df = _text(df, tx.collapse_blanks, tx.strip_dash, *clean_steps(True, arrow), _unless_blank(tx.quote))
    return ln.drop_repeats_across_blanks(df, order)


def encyclopedia(df: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True) -> DataFrame:
    """Encyclopedia markup: a blank before each heading, furniture off, links to targets."""
    df = df.withColumn("is_first", F.col(order.major) == 0)
    return ln.markup_lines(_text(df, tx.collapse_blanks, *clean_steps(True, arrow)))


# Corpus name -> plan, in the order of the combined corpus.
CORPUS_PLANS = {
    "aochildes": child_speech,
    "bnc_spoken": spoken_dialogue,
    "cbt": treebank_stories,
    "children_stories": indented_stories,
    "gutenberg": wrapped_books,
    "open_subtitles": subtitles,
    "qed": talk_captions,
    "simple_wikipedia": simple_encyclopedia,
    "switchboard": phone_dialogue,
    "wikipedia": encyclopedia,
}


def union_corpora(parts: list[DataFrame], names: list[str], order: LineOrder = FILE_LINES) -> DataFrame:
    """Concatenate cleaned corpora; (corpus_rank, order columns, sub) is the combined order."""
    ranked = []
    for rank, (part, name) in enumerate(zip(parts, names)):
        if "sub" not in part.columns:
            part = part.withColumn("sub", F.lit(0))
        cols = [*order.columns, "sub", "text"]
        ranked.append(part.select(F.lit(rank).alias("corpus_rank"), *cols))
    return reduce(DataFrame.unionByName, ranked)


def clean_all(lines: DataFrame, order: LineOrder = FILE_LINES, arrow: bool = True, plans=None) -> DataFrame:
    """Clean every corpus of a line table with its own plan and combine them."""
    plans = plans or CORPUS_PLANS
    parts = [fn(lines.where(F.col("corpus") == name), order, arrow) for name, fn in plans.items()]
    return union_corpora(parts, list(plans), order)


def blank_line_count(lines: DataFrame) -> DataFrame:
    """Blank input lines per corpus; ``child_speech`` drops them."""
    blank = tx.strip(F.col("text")) == ""
    return lines.groupBy("split", "corpus").agg(F.sum(blank.cast("bigint")).alias("blank_lines"))

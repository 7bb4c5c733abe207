"""Structured documents to text blocks: elements as rows, nesting as joins along the path.

A small Arrow function lists the elements of a document in document order; everything after
that (names, labels, prefixes from ancestors, runs of sentences, block order) is relational.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions import text as tx
from textloom.functions.hashing import uniform
from textloom.functions.repair import clean
from textloom.session import cut_lineage

#: Characters that markup may not hold; they count as blanks.
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_ELEMENT = T.ArrayType(T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("child_no", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
]))
# Tags a written or a spoken document may hold, and those that are passed over.
SKIPPED = ("note", "bibl", "pb", "gap")
WRITTEN = ("wtext", "div", "head", "p", "quote", "sp", "lg", "l", "list", "stage", "s", "speaker", "item", "label", *SKIPPED)
EVENTS = ("event", "pause", "shift", "trunc", "unclear", "vocal", "align", "gap")
SPOKEN = ("stext", "div", "u", "s", "head", "p", *EVENTS)


#: Documents whose elements are held at once.
_AT_ONCE = 64


def _elements_of(doc: str) -> list | None:
    """A document's elements in document order; None where it does not parse."""
    rows = []
    try:
        todo = [(ET.fromstring(_CONTROLS.sub(" ", doc)), None, [], 0)]
    except ET.ParseError:
        return None
    while todo:
        node, parent, path, child_no = todo.pop()
        if node is None:  # all below ``parent`` is done
            rows[parent]["last"] = len(rows) - 1
            continue
        idx = len(rows)
        here = [*path, idx]
        closed = node.tag in ("s", "head", "speaker", "label")
        text = "".join(node.itertext()) if closed or node.tag == "p" else None
        rows.append({
            "idx": idx, "parent": parent, "path": here, "child_no": child_no, "tag": node.tag, "attrs": list(node.attrib.items()),
            "text": text,
        })
        todo.append((None, idx, here, 0))
        # Inside a sentence there are only words.
        if not closed:
            todo.extend((child, idx, here, k) for k, child in reversed(list(enumerate(node))))
    return rows


@F.pandas_udf(T.BooleanType())
def _fails(xml: pd.Series) -> pd.Series:
    return xml.map(lambda doc: doc is None or _elements_of(doc) is None)


def elements(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """One row per element, in document order; documents that do not parse give no rows.

    A task holds the elements of a few documents at a time, however many a batch has.
    """
    schema = T.StructType([docs.schema[key], *_ELEMENT.elementType.fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                part = zip(*(c.to_pylist() for c in b.slice(at, _AT_ONCE).columns), strict=True)
                rows = [{key: k, **e} for k, doc in part if doc is not None for e in _elements_of(doc) or ()]
                yield pa.RecordBatch.from_pylist(rows, types)

    return docs.select(key, xml).mapInArrow(run, schema)


def unparsed(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    return docs.where(_fails(F.col(xml))).select(key)


def unknown_tags(els: DataFrame, known=WRITTEN, key: str = "doc_id") -> DataFrame:
    """Elements to quarantine: tags outside the known set."""
    return els.where(~F.col("tag").isin(*known)).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))


def is_caption(tag: Column, attrs: Column) -> Column:
    return (tag == "p") & F.coalesce(attrs["type"].startswith("caption:"), F.lit(False))


def _with_parent(els: DataFrame, key: str) -> DataFrame:
    up = els.select(key, F.col("idx").alias("parent"), F.col("tag").alias("up_tag"))
    return els.join(up, [key, "parent"], "left")


_HOLDERS = ("p", "quote", "lg", "l", "item", "stage", "u")


def _texts(els: DataFrame, key: str) -> DataFrame:
    """Every text that needs cleaning, cleaned once: titles, and sentence runs of paragraphs.

    (key, idx, kind, pos, text): ``idx`` is the title or the element that holds the run.
    """
    tag = F.col("tag")
    titles = els.where(tag.isin("head", "speaker", "label") | is_caption(tag, F.col("attrs"))).select(
        key, "idx", F.lit("title").alias("kind"), F.col("idx").alias("pos"), "text"
    )
    siblings = Window.partitionBy(key, "parent").orderBy("child_no").rowsBetween(Window.unboundedPreceding, 0)
    # Events inside an utterance do not end its run.
    breaks = F.sum(F.when((tag == "s") | (F.col("up_tag") == "u"), 0).otherwise(1)).over(siblings)
    runs = els.withColumn("run", breaks).where((tag == "s") & F.col("up_tag").isin(*_HOLDERS) & (F.length("text") > 0))
    runs = runs.groupBy(key, F.col("parent").alias("idx"), "run").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("ss")
    ).select(
        key, "idx", F.lit("run").alias("kind"), F.col("ss")[0]["idx"].alias("pos"),
        F.array_join(F.transform("ss", lambda s: s["text"]), "\n").alias("text"),
    )
    return clean(titles.unionByName(runs))


def chapter_names(els: DataFrame, texts: DataFrame, key: str = "doc_id", numbered_path: bool = True) -> DataFrame:
    """(key, idx, name) of each chapter: its heading, else its caption, else type and number."""
    divs = els.where("tag = 'div'")
    first = els.where("child_no = 0 and up_tag = 'div'").select(key, "idx", F.col("parent").alias("div"))
    first = first.join(texts.where("kind = 'title'").select(key, "idx", "text"), [key, "idx"]).select(
        key, F.col("div").alias("idx"), "text"
    )
    numbers = divs.select(key, F.col("idx").alias("up"), F.col("attrs")["n"].alias("n"))
    above = divs.select(key, "idx", F.explode("path").alias("up")).join(numbers, [key, "up"]).where("n is not null")
    if not numbered_path:
        above = above.where("up = idx")
    paths = above.groupBy(key, "idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("up", "n"))), lambda s: s["n"]), ".").alias("number")
    )
    kind = F.coalesce(F.col("attrs")["type"], F.lit(""))
    number = F.when(F.col("attrs")["n"].isNotNull(), F.concat(F.lit(" "), "number")).otherwise("")
    made = F.trim(F.concat(tx.capitalise_first(kind), number))
    named = divs.drop("text").join(first, [key, "idx"], "left").join(paths, [key, "idx"], "left")
    return named.select(key, "idx", F.coalesce("text", made).alias("name"))


def _own_marks(els: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """What an element adds to everything inside it: text in front, text behind the front, closing quotes, skip."""
    in_list = Window.partitionBy(key, "parent").orderBy("child_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("tag") == "label", F.struct(F.col("text").alias("label"))).when(
        F.col("tag") == "item", F.struct(F.lit(None).cast("string").alias("label"))
    )
    cleaned = texts.where("kind = 'title'").select(key, "idx", F.col("text").alias("clean_text"))
    rows = els.join(cleaned, [key, "idx"], "left").withColumn("text", F.coalesce("clean_text", "text"))
    speakers = els.where("tag = 'speaker'").join(cleaned, [key, "idx"]).select(key, "parent", F.col("clean_text").alias("speaker"))
    rows = rows.withColumn("label", F.last(state, ignorenulls=True).over(in_list)["label"])
    rows = rows.join(speakers, [key, "parent"], "left")
    tag, up = F.col("tag"), F.col("up_tag")
    front = F.when(tag == "quote", "> ").when(
        (tag == "item") & (up == "list"),
        F.concat(F.lit("- "), F.when(F.col("label") != "", F.concat("label", F.lit(" "))).otherwise("")),
    ).otherwise("")
    said = (up == "sp") & tag.isin("l", "p")
    behind = F.when(said, F.concat(F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), F.lit("'"))).when(
        (up == "sp") & (tag == "stage"), F.coalesce(F.concat("speaker", F.lit(": ")), F.lit(""))
    ).otherwise("")
    skip = (
        tag.isin(*SKIPPED, "head") | ((tag == "stage") & (up != "sp"))
        | (is_caption(tag, F.col("attrs")) & (F.col("child_no") == 0) & up.isin("wtext", "div"))
    )
    return rows.select(
        key, F.col("idx").alias("up"), front.alias("front"), behind.alias("behind"),
        F.when(said, "'").otherwise("").alias("closing"), F.coalesce(skip, F.lit(False)).alias("skip"),
    )


def _inherit(owners: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Prefix and suffix of each owner from all elements on its path; skipped branches vanish."""
    steps = owners.select(key, "idx", F.explode("path").alias("up")).join(marks, [key, "up"])
    sorted_steps = F.array_sort(F.collect_list(F.struct("up", "front", "behind", "closing")))

    def text(field, deepest_first):
        parts = F.transform(F.reverse("steps") if deepest_first else F.col("steps"), lambda s: s[field])
        return F.array_join(parts, "")

    grouped = steps.groupBy(key, "idx").agg(sorted_steps.alias("steps"), F.max("skip").alias("skip")).where(~F.col("skip"))
    return grouped.select(
        key, "idx", F.concat(text("front", True), text("behind", False)).alias("prefix"), text("closing", True).alias("suffix")
    )


def written_blocks(els: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, sub, text): headings, paragraphs, quotes, speeches, verses and lists of written documents.

    A run of sentences between two other children is one paragraph, its sentences on lines of
    their own. Chapters and the document end with an empty block. Elements and cleaned texts are
    checkpointed, because several joins read them.
    """
    els = cut_lineage(_with_parent(els, key))
    texts = cut_lineage(_texts(els, key))
    tag, up = F.col("tag"), F.col("up_tag")
    holders = [h for h in _HOLDERS if h != "u"]
    paragraphs = texts.where("kind = 'run' and text <> ''").withColumn("sub", F.lit(0))
    level = F.col("attrs")["level"].cast("int")
    heads = els.where("tag = 'div'").join(chapter_names(els, texts, key), [key, "idx"]).select(
        key, "idx", F.col("idx").alias("pos"),
        F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), "name").alias("text"), F.lit(0).alias("sub"),
    )
    titles = els.where((tag == "head") & (up == "list")).select(key, "idx", "parent").join(
        texts.where("kind = 'title'").select(key, "idx", "pos", "text"), [key, "idx"]
    ).select(key, F.col("parent").alias("idx"), "pos", F.concat("text", F.lit(": ")).alias("text"), F.lit(0).alias("sub"))
    ends = els.where("tag in ('wtext', 'div')").select(
        key, "idx", F.col("last").alias("pos"), F.lit("").alias("text"), (F.lit(1_000_000_000) - F.size("path")).alias("sub")
    )
    cols = [key, "idx", "pos", "sub", "text"]
    blocks = paragraphs.select(*cols).unionByName(heads.select(*cols)).unionByName(titles.select(*cols)).unionByName(ends.select(*cols))
    owners = els.where(tag.isin("wtext", "div", "list", *holders)).select(key, "idx", "path")
    out = blocks.join(_inherit(owners, _own_marks(els, texts, key), key), [key, "idx"])
    return out.select(key, "pos", "sub", F.concat("prefix", "text", "suffix").alias("text"))


def speaker_name(doc: Column, who: Column, names) -> Column:
    """A stable pseudonym per document and speaker code."""
    table = F.array(*[F.lit(n) for n in names])
    return F.element_at(table, (F.floor(uniform(doc, who) * len(names)) + 1).cast("int"))


def spoken_blocks(els: DataFrame, names, key: str = "doc_id") -> DataFrame:
    """(key, pos, sub, text): headings and ``Speaker: 'text'`` utterances of spoken documents."""
    els = cut_lineage(_with_parent(els, key))
    texts = cut_lineage(_texts(els, key))
    said = texts.where("kind = 'run'").where(tx.has_alphanumeric(F.col("text")))
    said = said.select(key, "idx", "text")
    who = els.where("tag = 'u'").select(key, "idx", F.col("attrs")["who"].alias("who"))
    turns = said.join(who, [key, "idx"]).select(
        key, F.col("idx").alias("pos"), F.lit(0).alias("sub"),
        F.concat(speaker_name(F.col(key), F.col("who"), names), F.lit(": '"), "text", F.lit("'")).alias("text"),
    )
    level = F.coalesce(F.col("attrs")["level"].cast("int"), F.lit(1))
    heads = els.where("tag = 'div'").join(chapter_names(els, texts, key, numbered_path=False), [key, "idx"]).select(
        key, F.col("idx").alias("pos"), F.lit(0).alias("sub"), F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), "name").alias("text")
    )
    ends = els.where("tag in ('stext', 'div')").select(
        key, F.col("last").alias("pos"), (F.lit(1_000_000_000) - F.size("path")).alias("sub"), F.lit("").alias("text")
    )
    return turns.unionByName(heads).unionByName(ends)


def blocks_to_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document, blocks separated by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sub", "text")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("text"))

"""Sentences: boundaries inside lines and across them, and the abbreviations that hide them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.ordered import LineOrder, scan

PARAGRAPH_MARK = "[PAR]"
_CUT = "\x01"
# A sentence starts with a capital, a digit or a letter of a script without case.
_END = r"[.!?…।॥؟۔][\"'’”)\]]{0,3}"
_START = r"[\"'“‘(\[]?[\p{Lu}\p{Lo}\p{N}]"
# Scripts written without blanks end a sentence by the mark alone.
_WIDE_END = r"[。！？][’”」』）]{0,3}"
_OPENERS = r"^[\"'“‘(\[]+"
MAX_ABBREVIATIONS = 4096


def _rejoin(t: Column, abbreviations) -> Column:
    """Take back cuts after single initials and after known abbreviations."""
    t = F.regexp_replace(t, r"\x01(?<=(?<![\p{L}\p{N}])\p{Lu}\.\x01)", "")  # cuts are rare, so they are looked for first
    if not abbreviations:
        return t
    if len(abbreviations) > MAX_ABBREVIATIONS:
        raise ValueError(f"more than {MAX_ABBREVIATIONS} abbreviations")
    known = "|".join(re.escape(a) for a in sorted(abbreviations, key=len, reverse=True))
    return F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}])((?:{known})\.)\x01", "$1")


def _mark(t: Column, abbreviations) -> Column:
    cut = F.regexp_replace(t, rf"({_END})(\s+)({_START})", f"$1{_CUT}$2$3")
    cut = F.regexp_replace(cut, rf"({_WIDE_END})(\s*[^\s’”」』）])", f"$1{_CUT}$2")
    return _rejoin(cut, abbreviations)


def sentences(t: Column, abbreviations=()) -> Column:
    """Sentences of one text as an array; blanks between them are dropped."""
    return F.transform(F.split(_mark(t, abbreviations), _CUT), tx.strip)


def segment_lines(df: DataFrame, abbreviations=(), position: str = "sent") -> DataFrame:
    """One sentence per row; a paragraph mark ends the last sentence of a line; blanks stay."""
    return _rows(df, sentences(tx.strip(F.col("text")), abbreviations), position)


def _rows(df: DataFrame, parts: Column, position: str) -> DataFrame:
    # The array is made in the generator: as a column it would be made again for every use and filter of it.
    def marked(found):
        return F.transform(found, lambda x, i: F.when((i == F.size(found) - 1) & (x != ""), F.concat(x, F.lit(PARAGRAPH_MARK))).otherwise(x))

    return df.select(*[c for c in df.columns if c != "text"], F.posexplode(_with(parts, marked)).alias(position, "text"))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def segment_lines_learned(df: DataFrame, scores: DataFrame, keys: list[str], threshold: float = 0.3, position: str = "sent") -> DataFrame:
    """``segment_lines`` with abbreviations from a table (type, score) of any size, see ``abbreviation_scores``.

    The words before cuts are rows that meet the table in a join; a cut after a word of at least ``threshold`` is taken back.
    ``keys`` tell lines apart and are not null. Lines are cut and exchanged once; the words before cuts are read from the
    same exchange, and the places of the cuts taken back are joined to it.
    """
    pieces = F.split(_mark(tx.strip(F.col("text")), ()), _CUT).alias("_pieces")
    # As in ``ordered``, a struct of keys keeps filters for their nulls from coming between the two uses of the exchange.
    others = [c for c in df.columns if c not in (*keys, "text")]
    cut = df.select(F.struct(*keys).alias("_line"), *others, pieces).repartition("_line")
    # A piece before a cut ends in the mark of the cut.
    word = F.regexp_extract("_piece", r"(?:^|\s)([^\s]+)\.$", 1)
    kind = F.lower(F.regexp_replace(word, _OPENERS, ""))
    before = F.posexplode(F.slice("_pieces", F.lit(1), F.greatest(F.size("_pieces") - 1, F.lit(0)))).alias("_at", "_piece")
    ended = cut.select("_line", before).where(F.endswith("_piece", F.lit(".")))
    places = ended.select("_line", "_at", F.explode(F.filter(F.array(kind), lambda k: k != "")).alias("type"))
    known = scores.where(F.col("score") >= threshold).select("type")
    undone = places.join(known, "type", "left_semi").groupBy("_line").agg(F.collect_set("_at").alias("_undone"))
    taken_back = lambda i: F.array_contains("_undone", i - 1)
    marked = F.transform("_pieces", lambda x, i: F.concat(F.when((i == 0) | taken_back(i), "").otherwise(_CUT), x))
    rejoined = F.split(F.array_join(marked, ""), _CUT)
    parts = F.transform(F.when(F.col("_undone").isNull(), F.col("_pieces")).otherwise(rejoined), tx.strip)
    joined = cut.join(undone.hint("shuffle_hash"), "_line", "left")
    out = _rows(joined, parts, position)
    return out.select(*[F.col(f"_line.{c}").alias(c) if c in keys else F.col(c) for c in df.columns if c != "text"], position, "text")


def segment_corpus(df: DataFrame, order: LineOrder, abbreviations=()) -> DataFrame:
    """Sentences of the whole line stream, which may run over line ends; each ends with a mark.

    A line end is a boundary when the line closes a sentence and the next text line can open
    one. Sentence numbers are running counts of boundaries, so no task reads a whole key.
    Line breaks inside a sentence stay; those between sentences go.
    """
    pos = [order.major, *order.minor]
    t = F.col("text")
    # A virtual capital after the line end asks the same rule and the same exceptions.
    asked = df.select(*order.columns, "text", tx.strip(t).alias("_bare"), _mark(F.concat(tx.strip(t), F.lit(" A")), abbreviations).alias("_asked"))
    ends = F.col("_asked").endswith(f"{_CUT} A")
    # A text without outer blanks has the cuts of that reading, but for the last.
    own = F.substr("_asked", F.lit(1), F.length("_asked") - F.when(ends, 3).otherwise(2))
    cut = asked.select(
        *order.columns, (F.col("_bare") == "").alias("blank"), t.rlike(rf"^\s*{_START}").alias("starts"), ends.alias("ends"),
        F.split(F.when(F.col("_bare") == t, own).otherwise(_mark(t, abbreviations)), _CUT).alias("parts"),
    )
    seen = scan(cut, order, add=F.col("blank").cast("int"), carry=F.when(~F.col("blank"), F.col("ends"))).where(~F.col("blank"))
    opens = (F.col("starts") & F.coalesce("carried", F.lit(False))).cast("int")
    lines = seen.select(*order.columns, F.col("before").alias("gaps"), opens.alias("opens"), "parts")
    counted = scan(lines, order, add=F.size("parts") - 1 + F.col("opens"))
    pieces = counted.select(
        *order.columns, "gaps", (F.col("before") + F.col("opens")).alias("first_no"), "opens", F.size("parts").alias("n"),
        F.posexplode("parts").alias("piece_no", "piece"),
    ).withColumn("sentence_no", F.col("first_no") + F.col("piece_no"))
    # Between two boundaries of one line a piece is a sentence; only the others are brought together.
    alone = (F.col("piece_no") < F.col("n") - 1) & ((F.col("piece_no") > 0) | (F.col("opens") == 1))
    whole = pieces.where(alone).select(*order.keys, "sentence_no", F.col("piece").alias("text"))
    grouped = pieces.where(~alone).groupBy(*order.keys, "sentence_no").agg(
        F.array_sort(F.collect_list(F.struct(*pos, "piece_no", "gaps", "piece"))).alias("p")
    )
    joined = F.aggregate(
        "p",
        F.struct(F.lit("").alias("text"), F.lit(-1).cast("bigint").alias("gaps")),
        lambda acc, x: F.struct(
            F.concat(
                acc["text"],
                F.when(acc["gaps"] < 0, "").otherwise(F.repeat(F.lit("\n"), (x["gaps"] - acc["gaps"] + 1).cast("int"))),
                x["piece"],
            ).alias("text"),
            x["gaps"].alias("gaps"),
        ),
        lambda acc: acc["text"],
    )
    sentences = whole.unionByName(grouped.select(*order.keys, "sentence_no", joined.alias("text")))
    return sentences.withColumn("text", F.concat(tx.strip(F.col("text")), F.lit(PARAGRAPH_MARK)))


def abbreviation_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """How likely each word type is an abbreviation, from its counts with and without a period.

    Log-likelihood of a period after the type, scaled by length, inner periods and the share of
    period-free uses (Kiss and Strunk 2006).
    """
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), 0)).alias("w"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # The rules look at distinct words. They stand in a generator, below which no filter by their outcome is moved.
    bare = F.regexp_replace("w", r"^[\"'“‘(\[]+|[\"'’”)\],;:]+$", "")
    words = words.select(F.explode(F.filter(F.array(bare), lambda w: w.rlike(r"\p{L}"))).alias("w"), "n")
    typed = words.select(
        F.explode(F.filter(F.array(F.regexp_replace("w", r"\.$", "")), lambda w: w.rlike(r"^[\p{L}.\-]+$"))).alias("type"),
        F.when(F.col("w").endswith("."), F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("dotted"), "n",
    )
    types = typed.groupBy("type").agg(F.sum("dotted").alias("with_period"), F.sum("n").alias("n"))
    share = types.agg((F.sum("with_period") / F.sum("n")).alias("share"))
    rows = types.where(F.col("with_period") > 0).withColumn("p", share.scalar())
    k, n = F.col("with_period").cast("double"), F.col("n").cast("double")
    p = F.col("p")

    def loglik(q):
        return k * F.log(q) + (n - k) * F.log(1.0 - q)

    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = -2.0 * (loglik(p) - loglik(F.lit(0.99))) * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k))
    return rows.select("type", "with_period", "n", score.alias("score"))


def abbreviations(scores: DataFrame, threshold: float = 0.3) -> list[str]:
    """Types above the threshold; refuses a list too long for the segmenter."""
    rows = scores.where(F.col("score") >= threshold).select("type").limit(MAX_ABBREVIATIONS + 1).collect()
    if len(rows) > MAX_ABBREVIATIONS:
        raise ValueError("too many abbreviations; raise the threshold")
    return sorted(r["type"] for r in rows)

"""Line-level text projections and predicates, all plain Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as a Unicode-aware splitter sees them; Java's \s alone is ASCII only.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
BLANK_BUT_NEWLINE = r"[ \t\x0b\f\r\p{Z}\x1c-\x1f\x85]"
# The same characters one by one.
BLANKS = "".join(
    chr(c) for c in range(0x3001)
    if chr(c) in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(chr(c)).startswith("Z")
)
# Scratch character for a two-step rewrite; private use, absent from natural text.
MARK = "\ue001"

# Order and spelling decide the result.
CLITICS = ("n't", "N'T", "'ll", "'LL", "'re", "'RE", "'ve", "'VE", "'m", "'M", "'s", "'S", "'d", "'D")
CLITIC_FOLLOWERS = (" ", ",", ".")
TREEBANK_CODES = (
    ("-LRB-", "("), ("-LCB-", "{"), ("-LSB-", "["),
    ("-RRB-", ")"), ("-RCB-", "}"), ("-RSB-", "]"),
    ("`` ", '"'), ("``", '"'), (" ''", '"'), ("''", '"'),
)
ENTITY_CODES = (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
STUB_PHRASES = (
    "is a commune. It is", "is a commune found", "is a city in",
    "is a village in", "is a municipality in", "is a town in",
)
TAB_MARK = "[TAB] "


def _replace_all(t: Column, pairs) -> Column:
    for old, new in pairs:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def strip(t: Column) -> Column:
    """Remove Unicode blanks at both ends; only the ends are looked at."""
    return F.btrim(t, F.lit(BLANKS))


def collapse_blanks(t: Column) -> Column:
    """Every run of blanks becomes one space; none remain at the ends."""
    uneven = t.rlike(rf"[{BLANK}&&[^ ]]|  ")  # single spaces stay as they are
    return F.trim(F.when(uneven, F.regexp_replace(t, rf"{BLANK}+", " ")).otherwise(t))


def collapse_blanks_keep_newlines(t: Column) -> Column:
    """As collapse_blanks, but newlines survive as part of the neighbouring words."""
    return F.trim(F.regexp_replace(t, rf"{BLANK_BUT_NEWLINE}+", " "))


_OPENERS = r"[‘(\[{]"
_ALNUM = r"[\p{L}\p{N}]"
_TIGHTEN = "|".join((
    r"(?<=[(\[{]) ",
    r"(?<!.\.\.\.) (?=[.;:?!…,’)\]}])",
    r"(?<=[$£€]) (?=\p{N})",
    r"(?<=\p{N}) (?=%)",
))
#: What stands before every place that _LOOSEN finds; most places need no further look.
_LOOSE = r"[.?!…’,;:)\]}%]"
_LOOSEN = "|".join((
    rf"(?<=\.)(?=\p{{Lu}}|{_OPENERS})",
    rf"(?<=[?!…’])(?={_ALNUM}|{_OPENERS})",
    r"(?<=.\.\.\.)(?=[^ ])",
    rf"(?<=,)(?=\p{{L}}|{_OPENERS})",
    rf"(?<=[;)\]}}%])(?={_ALNUM}|{_OPENERS})",
    rf"(?<=:)(?={_OPENERS}|\p{{L}})",
    r"(?<=:)(?<!\p{N}:)(?=\p{N})",
))


def space_punctuation(t: Column) -> Column:
    """Add missing and drop superfluous spaces around punctuation.

    Dropped spaces first become a mark, so a rule that looks at its left neighbour still
    sees that something stood there, as it would when the text is read from right to left.
    """
    t = collapse_blanks_keep_newlines(t)
    t = F.regexp_replace(t, f"(?s)(?= )(?:{_TIGHTEN})", MARK)
    t = F.regexp_replace(t, f"(?s)(?<={_LOOSE})(?:{_LOOSEN})", " ")
    return F.replace(t, F.lit(MARK), F.lit(""))


def attach_clitics(t: Column) -> Column:
    """Glue split English clitics to the word before, one spelling after another."""
    spellings = F.array(*[F.lit(c + after) for after in CLITIC_FOLLOWERS for c in CLITICS])
    glued = F.aggregate(spellings, t, lambda acc, s: F.replace(acc, F.concat(F.lit(" "), s), s))
    return F.when(F.contains(t, F.lit("'")), glued).otherwise(t)


def pair_double_quotes(t: Column) -> Column:
    """Space straight double quotes by their parity: out around a pair, tight inside it."""
    segs = F.split(t, '"', -1)
    n_quotes = F.size(segs) - 1

    def inner(s):
        return F.regexp_replace(s, r"(?s)^ (.*)\z", "$1")

    def inner_end(s):
        return F.regexp_replace(s, r" \z", "")

    def fix(s, k):
        last = n_quotes
        outer = F.concat(
            F.when((k > 0) & s.rlike(rf"^{_ALNUM}"), F.lit(" ")).otherwise(F.lit("")),
            s,
            F.when((k < last) & (s != "") & ~s.endswith(" "), F.lit(" ")).otherwise(F.lit("")),
        )
        return F.when(k % 2 == 1, inner_end(inner(s))).otherwise(outer)

    fixed = F.transform(segs, fix)
    changes = F.aggregate(
        F.zip_with(segs, fixed, lambda a, b: F.abs(F.length(b) - F.length(a))),
        F.lit(0),
        lambda acc, d: acc + d,
    )
    eligible = (
        F.contains(t, F.lit('"')) & (n_quotes % 2 == 0)
        & ~F.contains(t, F.lit('""')) & ~F.contains(t, F.lit('" "'))
    )
    gentle = ~((changes > 2) & (changes > n_quotes * 2 / 3))
    return F.when(eligible, F.when(gentle, F.array_join(fixed, '"')).otherwise(t)).otherwise(t)


def capitalise_first(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def quote(t: Column) -> Column:
    return F.concat(F.lit('"'), t, F.lit('"'))


def quote_unless_marked(t: Column) -> Column:
    """Quote a line unless it is a label, already quoted or fully bracketed."""
    marked = t.endswith(":") | t.startswith('"') | t.endswith('"')
    for opening, closing in ("()", "[]", "{}"):
        marked = marked | (t.startswith(opening) & t.endswith(closing))
    return F.when(marked, t).otherwise(quote(t))


def strip_dash(t: Column) -> Column:
    return F.regexp_replace(t, r"^- ?", "")


def unescape_treebank(t: Column) -> Column:
    return _replace_all(t, TREEBANK_CODES)


def mark_indent(raw: Column) -> Column:
    """Collapse blanks; lines indented by four spaces get a leading tab mark."""
    flat = collapse_blanks(raw)
    return F.when(raw.startswith("    "), F.concat(F.lit(TAB_MARK), flat)).otherwise(flat)


def unescape_entities(t: Column, rounds: int = 1) -> Column:
    for _ in range(rounds):
        t = _replace_all(t, ENTITY_CODES)
    return t


def drop_citations(t: Column) -> Column:
    return F.regexp_replace(t, r"\[\p{Nd}+\]", "")


def link_targets(t: Column) -> Column:
    return F.regexp_replace(t, r"\[\[([^|\]]*)\|*[^\]]*\]\]", "$1")


def unwrap_headings(t: Column) -> Column:
    return F.regexp_replace(t, r"= = = ([^=]*) = = =", "$1")


def drop_tab_marks(t: Column) -> Column:
    return strip(F.replace(strip(t), F.lit(TAB_MARK), F.lit("")))


def lower_case(t: Column) -> Column:
    return F.lower(t)


# --- predicates: True means keep -------------------------------------------------------


def not_lone_punctuation(t: Column) -> Column:
    return ~t.isin(".", "!", "?")


def no_angle_entity_pair(t: Column) -> Column:
    return ~(F.contains(t, F.lit("&lt")) & F.contains(t, F.lit("&gt")))


def no_arrow(t: Column) -> Column:
    return ~F.contains(t, F.lit("->"))


def not_bare_label(t: Column) -> Column:
    return ~(t.endswith(":") & ~t.rlike(r"\p{L}"))


def is_stub(t: Column, phrases=STUB_PHRASES, below: int = 128) -> Column:
    """Short lines holding one of the boilerplate phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(t, F.lit(p))
    return (F.length(t) < below) & found


def not_page_furniture(t: Column) -> Column:
    return ~(t.startswith("[[Category:") | t.startswith("[[File:"))


def not_blank(t: Column) -> Column:
    return F.length(t) > 0


def has_alphanumeric(t: Column) -> Column:
    return t.rlike(_ALNUM)


def subword_count_between(ids: Column, low: int = 1, high: int = 126) -> Column:
    return F.size(ids).between(low, high)


def labelled(label: Column) -> Column:
    return label >= 0


def entity_rounds(t: Column, rounds: int = 3) -> tuple[Column, Column]:
    """Repeated entity unescape; also whether no round ever showed an escaped tag pair."""
    keep = no_angle_entity_pair(t)
    for _ in range(rounds):
        t = unescape_entities(t)
        keep = keep & no_angle_entity_pair(t)
    return t, keep

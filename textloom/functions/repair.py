"""Punctuation normalisation and Unicode repair.

The rule lists follow two public descriptions: the Moses punctuation normaliser for English
and the documented fixes of a common Unicode repair tool. Everything that can be an
expression is one; only entity names, mis-decoded UTF-8 and canonical composition go to an
Arrow function, and only for rows that show a trigger.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as tx

# Fixed values: (pattern, replacement), applied in this order. Each group has a guard: texts
# without any of its characters skip the group.
PUNCTUATION_RULES = (
    (r"[\r()]| {2}", (
        (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "),
        (r"\) ([.!:?;,])", ")$1"), (r"\( ", "("), (r" \)", ")"),
    )),
    (r" [%:;]", ((r"(\p{Nd}) %", "$1%"), (r" :", ":"), (r" ;", ";"))),
    (r"[„“”–—´‘‚’…«»º\u00a0]", (
        (r"[„“”]", '"'), (r"–", "-"), (r"—", " - "), (r" +", " "), (r"[´‘‚’]", "'"),
        (r"''", '"'), (r"…", "..."), (r"\u00a0?«\u00a0?", '"'), (r"\u00a0?»\u00a0?", '"'),
        (r"\u00a0(?=[%:?!;])", ""), (r"nº\u00a0", "nº "), (r"\u00a0(?=ºC|cm)", " "),
        (r",\u00a0", ", "), (r" +", " "),
    )),
    (r"''", ((r"''", '"'),)),
    (r"\"[,.]", ((r'"([,.]+)', '$1"'),)),
    (r"\u00a0", ((r"(\p{Nd})\u00a0(\p{Nd})", "$1.$2"),)),
)


def punctuation_steps() -> list:
    """English punctuation normalisation without the treebank-only rules."""
    def group(guard, rules):
        def step(t: Column) -> Column:
            new = t
            for pattern, replacement in rules:
                new = F.regexp_replace(new, pattern, replacement)
            return F.when(t.rlike(guard), new).otherwise(t)

        return step

    return [*(group(g, r) for g, r in PUNCTUATION_RULES), tx.strip]


# Latin ligatures and digraphs with their spelled-out forms.
LIGATURES = (
    ("Ĳ", "IJ"), ("ĳ", "ij"), ("ŉ", "ʼn"), ("Ǳ", "DZ"), ("ǲ", "Dz"), ("ǳ", "dz"),
    ("Ǆ", "DŽ"), ("ǅ", "Dž"), ("ǆ", "dž"), ("Ǉ", "LJ"), ("ǈ", "Lj"), ("ǉ", "lj"),
    ("Ǌ", "NJ"), ("ǋ", "Nj"), ("ǌ", "nj"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ſt"), ("ﬆ", "st"),
)


def _width_tables() -> tuple[str, str]:
    """Full- and half-width forms with their ordinary counterparts, from the Unicode data."""
    src, dst = ["\u3000"], [" "]
    for cp in range(0xFF01, 0xFFF0):
        plain = unicodedata.normalize("NFKC", chr(cp))
        if plain != chr(cp) and len(plain) == 1:
            src.append(chr(cp))
            dst.append(plain)
    return "".join(src), "".join(dst)


def _c1_tables() -> tuple[str, str]:
    """C1 controls with the Windows-1252 character of the same byte, where one exists."""
    src, dst = [], []
    for byte in range(0x80, 0xA0):
        try:
            dst.append(bytes([byte]).decode("cp1252"))
            src.append(chr(byte))
        except UnicodeDecodeError:
            continue
    return "".join(src), "".join(dst)


_WIDTH = _width_tables()
_C1 = _c1_tables()
_CP1252_HIGH = {c: b for b in range(0x80, 0x100) for c in [bytes([b]).decode("cp1252", "ignore")] if c}
_CP1252_HIGH.update({chr(b): b for b in range(0x80, 0xA0)})

_ENTITY = r"&#?[0-9A-Za-z]{1,24};"
_TAIL = "".join(sorted(c for c, b in _CP1252_HIGH.items() if 0x80 <= b <= 0xBF))
# Two-, three- and four-byte UTF-8 forms read as Windows-1252, for the lead bytes that
# ordinary Western text does not put before such characters.
_MISREAD = rf"(?:[ÂÃÄÅÐÑ][{_TAIL}]|â[{_TAIL}]{{2}}|ðŸ[{_TAIL}]{{2}})+"
_COMPOSABLE = (
    r"[\p{M}\u1100-\u11ff\u0340-\u0387\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b"
    r"\u2329\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e]"
)


def _reread(match: re.Match) -> str:
    try:
        return bytes(_CP1252_HIGH[c] for c in match.group()).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return match.group()


@F.pandas_udf(StringType())
def _reread_text(s: pd.Series) -> pd.Series:
    entity, misread, kana = re.compile(_ENTITY), re.compile(_MISREAD), re.compile(r"[･-ﾟ]+")

    def one(t):
        if "<" not in t:
            t = entity.sub(lambda m: html.unescape(m.group()), t)
        t = misread.sub(_reread, t)
        # Half-width kana first, so that a voiced mark can join its letter.
        t = kana.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
        return unicodedata.normalize("NFC", t)

    return s.map(one, na_action="ignore")


def _only_where(trigger: Column, t: Column, fn) -> Column:
    """Send a row to an Arrow function only when it shows the trigger; others pass a null."""
    return F.coalesce(fn(F.when(trigger, t)), t)


def _modern_controls(t: Column) -> Column:
    return F.when(t.rlike(r"[\x80-\x9f]"), F.translate(t, *_C1)).otherwise(t)


def _spell_ligatures(t: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LIGATURES])
    spelled = F.aggregate(pairs, t, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    return F.when(t.rlike("[" + "".join(a for a, _ in LIGATURES) + "]"), spelled).otherwise(t)


def _ordinary_width(t: Column) -> Column:
    return F.when(t.rlike(r"[\u3000！-\uffef]"), F.translate(t, *_WIDTH)).otherwise(t)


_SPECIAL_MARKS = r"[ʼ‘-‟\r\u2028\u2029\x85\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]"


def _plain_marks(t: Column) -> Column:
    """Straight quotes, one kind of line break, no terminal codes, no control characters."""
    new = F.regexp_replace(t, r"[ʼ‘-‛]", "'")
    new = F.regexp_replace(new, r"[“-‟]", '"')
    new = F.regexp_replace(new, r"\r\n|[\r\u2028\u2029\x85]", "\n")
    new = F.regexp_replace(new, r"\x1b\[[\p{Nd};]*[a-zA-Z]", "")
    new = F.regexp_replace(new, r"[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]", "")
    return F.when(t.rlike(_SPECIAL_MARKS), new).otherwise(t)


def _reread_where_needed(t: Column) -> Column:
    return _only_where(t.rlike(rf"{_ENTITY}|{_MISREAD}|[･-ﾟ]|{_COMPOSABLE}"), t, _reread_text)


def repair_steps(arrow: bool = True) -> list:
    """Entities, mis-decoded UTF-8, composition, ligatures, width, quotes, line breaks, controls.

    ``arrow=False`` leaves out the first three, which need Python.
    """
    plain = [_modern_controls, _spell_ligatures, _ordinary_width, _plain_marks]
    return [_reread_where_needed, *plain] if arrow else plain


def clean_steps(minimal: bool = False, arrow: bool = True) -> list:
    """The cleaning chain of a corpus line; ``minimal`` only repairs characters."""
    spacing = [tx.space_punctuation, tx.attach_clitics, tx.pair_double_quotes, *punctuation_steps()]
    return [*([] if minimal else spacing), *repair_steps(arrow), tx.strip]


def apply_steps(df: DataFrame, steps: list, column: str = "text") -> DataFrame:
    """Run Column functions one after another, each as its own projection.

    A step mentions its input several times; chained inside one expression every mention would
    repeat all steps before it.
    """
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df


def clean(df: DataFrame, column: str = "text", minimal: bool = False, arrow: bool = True) -> DataFrame:
    return apply_steps(df, clean_steps(minimal, arrow), column)

"""Pre-tokenisation: text to words, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as tx

# Ids 0..6, in this order.
SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[PAR]", "[TAB]")
UNK, CLS, SEP, PAD, MASK, PAR, TAB = range(7)

WORD = r"(?U)\w+|[^\w\s]+"
# Public byte-level split: English clitics, letters, digits, other signs, blanks.
BYTE_LEVEL_SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> tuple[str, str]:
    """Bytes as Latin-1 characters, and the printable character that stands for each.

    Printable bytes stand for themselves, the others for code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    src, dst, extra = [], [], 256
    for b in range(256):
        src.append(chr(b))
        if b in printable:
            dst.append(chr(b))
        else:
            dst.append(chr(extra))
            extra += 1
    return "".join(src), "".join(dst)


_BYTES, _SHOWN = _byte_alphabet()
# translate() reads U+0000 in the source as any other character, so all 256 bytes map.


def whitespace_words(t: Column) -> Column:
    """Runs of word characters, or runs of other visible characters."""
    return F.regexp_extract_all(t, F.lit(WORD), 0)


def show_bytes(t: Column) -> Column:
    """Every UTF-8 byte as one visible character."""
    return F.translate(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), _BYTES, _SHOWN)


def hide_bytes(t: Column) -> Column:
    """The text behind a byte-level string."""
    return F.decode(F.encode(F.translate(t, _SHOWN, _BYTES), "ISO-8859-1"), "UTF-8")


def single_digits(word: Column) -> Column:
    """Cut a word so that each digit stands alone."""
    return F.regexp_extract_all(word, F.lit(r"\p{N}|[^\p{N}]+"), 0)


def byte_level_words(t: Column, digits: bool = True) -> Column:
    """Byte-level words with a leading space, digits apart."""
    spaced = F.when(t.rlike(rf"^{tx.BLANK}") | (t == ""), t).otherwise(F.concat(F.lit(" "), t))
    words = F.transform(F.regexp_extract_all(spaced, F.lit(BYTE_LEVEL_SPLIT), 0), show_bytes)
    return F.flatten(F.transform(words, single_digits)) if digits else words

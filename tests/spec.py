"""Plain sequential readings of the rules, written for the tests only."""

import re
import unicodedata


def space_punctuation(text):
    """Walk from right to left; ``right`` is the finished part after the current character."""
    text = re.sub(r"[^\S\n]+", " ", text).strip(" ")
    if not text:
        return text
    right = text[-1]
    opening = set("‘([{")

    def numeral(c):
        return unicodedata.category(c).startswith("N")

    for i in reversed(range(len(text) - 1)):
        here, before, nxt = text[i], text[:i], right[0]
        insert = delete_here = delete_next = False
        if here == "." and (nxt.isupper() or nxt in opening):
            insert = True
        elif here in "?!…’" and (nxt.isalnum() or nxt in opening):
            insert = True
        elif here == "." and before.endswith("..") and len(before) >= 3 and nxt != " ":
            insert = True
        elif here == "," and (nxt.isalpha() or nxt in opening):
            insert = True
        elif here in ";)]}%" and (nxt.isalnum() or nxt in opening):
            insert = True
        elif here == ":" and (nxt in opening or (nxt.isalnum() and not (numeral(nxt) and before and numeral(before[-1])))):
            insert = True
        elif here in "([{" and nxt == " ":
            delete_next = True
        elif here == " " and nxt in ".;:?!…,’)]}":
            delete_here = True
        elif here == " " and before and before[-1] in "$£€" and numeral(nxt):
            delete_here = True
        elif here == " " and before and numeral(before[-1]) and nxt == "%":
            delete_here = True
        if insert:
            right = here + " " + right
        elif delete_next:
            right = here + right[1:]
        elif not delete_here:
            right = here + right
    return right


def pair_double_quotes(text):
    """Edit the pieces between quotes one boundary at a time, counting edits."""
    pieces = text.split('"')
    n = len(pieces) - 1
    if n == 0 or n % 2 or '""' in text or '" "' in text:
        return text
    edits = 0
    for q in range(n):
        left, right = pieces[q], pieces[q + 1]
        if q % 2 == 0:
            if (left or q > 0) and not left.endswith(" "):
                left, edits = left + " ", edits + 1
            if right.startswith(" "):
                right, edits = right[1:], edits + 1
        else:
            if left.endswith(" "):
                left, edits = left[:-1], edits + 1
            if right[:1].isalnum():
                right, edits = " " + right, edits + 1
        pieces[q], pieces[q + 1] = left, right
    return text if edits > 2 and 3 * edits > 2 * n else '"'.join(pieces)


def repeats(lines, blanks_reset=False, across_blanks=False):
    out, last = [], None
    for i, t in lines:
        if t == "" and (blanks_reset or across_blanks):
            out.append((i, t))
            last = None if blanks_reset else last
        elif t != last:
            out.append((i, t))
            last = t
    return out


def gaps(lines):
    out, run = [], 0
    for i, t in lines:
        if t:
            run += 1
            out.append((i, t))
        else:
            if run > 1:
                out.append((i, t))
            run = 0
    return out


def reflow(lines):
    out, buffer, size, blanks = [], [], 0, 0
    for i, t in lines:
        if t:
            buffer.append(t)
            blanks = 0
            continue
        if buffer:
            out.append((i, " ".join(buffer)))
            size = len(buffer)
        blanks += 1
        if blanks == 2 and size > 1:
            out.append((i, ""))
        buffer = []
    return out


def stubs(lines):
    """lines: (i, text, is_stub)."""
    out, held = [], None
    for i, t, stub in lines:
        if t == "":
            if held is not None:
                out += [held, (i, "")]
            held = None
        elif stub:
            held = None
        else:
            if held is not None:
                out.append(held)
            held = (i, t)
    return out


def shorten(lengths, budget):
    """Take one token at a time from the longest; on a tie from the one that ranks last by original length."""
    now = list(lengths)
    rank = sorted(range(len(now)), key=lambda i: -lengths[i])
    while sum(now) > max(budget, 0):
        top = max(now)
        victim = [i for i in rank if now[i] == top][-1]
        now[victim] -= 1
    return now


CLITIC = re.compile(r"^'[^\W\d_]")


def detokenize(tokens, lang):
    """English and French spacing, token by token."""
    out, glue, counts = "", " ", {}
    for i, t in enumerate(tokens):
        prev = tokens[i - 1] if i else ""
        nxt = tokens[i + 1] if i + 1 < len(tokens) else ""
        if re.search(r"^[$£€(\[{¿¡]+$", t):
            out, glue = out + glue + t, ""
        elif re.search(r"^[,.?!:;\\%}\])]+$", t):
            out += " " if lang == "fr" and re.search(r"^[?!:;\\%]$", t) else ""
            out, glue = out + t, " "
        elif lang == "en" and i and CLITIC.search(t):
            out, glue = out + t, " "
        elif lang == "fr" and re.search(r"[^\W\d_]'$", t) and re.search(r"^[^\W\d_]", nxt):
            out, glue = out + glue + t, ""
        elif re.search(r"^['\"„“`]+$", t):
            kind = '"' if re.search("^[„“”]+$", t) else t
            seen = counts.get(kind, 0)
            owner = lang == "en" and t == "'" and i
            if owner and prev.endswith("s") and prev[0].isupper():
                out, glue = out + t, " "
            elif owner and nxt == "s" and re.search(r"[^\W\d_]", prev):
                out, glue = out + t, ""
            elif seen % 2 == 0 and owner and prev.endswith("s"):
                out, glue = out + t, " "
            elif seen % 2 == 0:
                out, glue, counts[kind] = out + glue + t, "", seen + 1
            else:
                out, glue, counts[kind] = out + t, " ", seen + 1
        else:
            out, glue = out + glue + t, " "
    return re.sub(" {2,}", " ", out).strip(" ")

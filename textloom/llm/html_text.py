"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each has features of its ancestors (tags, words of
class and id) and of its text. The field scores label sequences (main text or not) by features and by neighbouring labels;
it is trained on labelled pages by maximum likelihood, and Viterbi gives a page's best sequence.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody"
    " td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select button xmp".split())
#: The start of an element of the key closes the nearest open element of the value.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[a-z]+")
_END_MARK = re.compile(r"[.!?…。！？]['\")\]»”’]*$")


#: Words of class, id and role that tell of furniture or of the article (fixed values).
_FURNITURE = (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " credits disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification"
    " pager pagination popup privacy promo promoted promotion related reply replies respond share sharing sidebar signup skip"
    " social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget"
).split()
_ARTICLE = "article blog body content entry main post prose story text".split()
_LANDMARKS = "nav header footer aside form article main section figure figcaption table ul ol dl li p h1 h2 h3 h4 blockquote pre".split()
_FURNITURE_SET, _ARTICLE_SET, _LANDMARK_SET = frozenset(_FURNITURE), frozenset(_ARTICLE), frozenset(_LANDMARKS)
_KNOWN = _FURNITURE_SET | _ARTICLE_SET


@dataclass(frozen=True)
class Block:
    text: str
    own: str  # tag of the innermost ancestor
    tags: frozenset[str]  # of all ancestors
    words: frozenset[str]  # known words in the ancestors' class, id and role
    link: float  # share of the characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order.

    Character references are decoded and white space is one blank. Comments, scripts, styles and the like hold no text;
    tags that aren't closed are closed where their parent ends.
    """
    out: list[Block] = []
    nothing: frozenset[str] = frozenset()
    stack = [("none", nothing, nothing)]  # open elements: tag, tags and known words down to it
    is_open: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                inside = sum(len(t) for t, a in held if a)
                out.append(Block(text, *stack[-1], inside / max(sum(len(t) for t, _ in held), 1)))
            held.clear()

    def close(to: int) -> None:
        is_open.subtract(s[0] for s in stack[to:])
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            held.append((page[at:], links > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK:
                flush()
                if is_open[name] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if name in _RAW:
            end = None if m[3].endswith("/") else re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (n if name in ("script", "style") else at)
            if name in _BLOCK:
                flush()
            continue
        if name == "br":
            held.append((" ", links > 0))
        elif name == "a":
            links += 1
        elif name == "hr":
            flush()
        if name not in _BLOCK or name in _VOID:
            continue
        flush()
        links = 0
        if name in _ENDS and any(is_open[x] > 0 for x in _ENDS[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _ENDS[name]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if stack[-1][0] == "p":  # a paragraph holds no blocks
            close(len(stack) - 1)
        _, tags, words = stack[-1]
        if name not in tags:
            tags = tags | {name}
        if m[3]:
            found = {w for g in _NAMES.findall(m[3]) for w in _SPLIT.findall("".join(g).lower())} & _KNOWN
            words = words | found if found - words else words
        stack.append((name, tags, words))
        is_open[name] += 1
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features that hold for each block."""
    out = []
    for k, b in enumerate(page):
        tags, words = b.tags, b.words
        bad = words & _FURNITURE_SET
        f = ["bias", "own=" + b.own, *(f"in={t}" for t in tags & _LANDMARK_SET)]
        f += [f"word={w}" for w in bad] + (["furniture"] if bad else [])
        if words & _ARTICLE_SET:
            f.append("article word")
        if not tags & {"nav", "header", "footer", "aside", "form"} and not bad:
            f.append("plain path")
            if "article" in tags or "main" in tags:
                f.append("plain in article")
        count = b.text.count(" ") + 1
        f.append("words=" + ("1" if count == 1 else "2-4" if count < 5 else "5-14" if count < 15 else "15-49" if count < 50 else "50+"))
        f.append("link=" + ("0" if b.link == 0 else "low" if b.link < 0.4 else "high"))
        if _END_MARK.search(b.text[-8:]):
            f.append("ends as a sentence")
        if "©" in b.text[:40] or "|" in b.text:
            f.append("mark")
        f.append("at=" + ("first" if k == 0 else "last" if k == len(page) - 1 else "middle"))
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights by feature and label, by pair of neighbouring labels, and by the first label."""

    names: dict[str, int]
    unary: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def scores(self, page: list[list[str]]) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(page), 2))
        for k, f in enumerate(page):
            ids = [i for i in map(get, f) if i is not None]
            if ids:
                out[k] = self.unary[ids].sum(0)
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi: the best label sequence."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0][0] + float(self.begin[0]), s[0][1] + float(self.begin[1])
        back = []
        for x, y in s[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = x + max(a + m00, b + m10), y + max(a + m01, b + m11)
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, penalty: float = 1e-3, rate: float = 0.5) -> Field:
    """Maximum likelihood over labelled pages (features, labels) by gradient steps of adaptive size.

    Expected counts come from forward and backward sums over each page's chain.
    """
    names: dict[str, int] = {}
    for page, _ in pages:
        for f in page:
            for x in f:
                names.setdefault(x, len(names))
    rows = [[[names[x] for x in f] for f in page] for page, _ in pages]
    x = np.zeros((sum(map(len, rows)), len(names)))
    for k, f in enumerate(f for page in rows for f in page):
        x[k, f] = 1
    cuts = np.cumsum([0] + [len(p) for p in rows])
    gold = np.array([y for _, ys in pages for y in ys])
    unary, move, begin = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.zeros_like(v) + 1e-8 for v in (unary, move, begin)]
    n = max(len(pages), 1)
    for _ in range(rounds):
        s = x @ unary
        want, moves, starts = np.zeros_like(s), np.zeros((2, 2)), np.zeros(2)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            e = s[a:b]
            f, g = np.empty_like(e), np.zeros_like(e)
            f[0] = e[0] + begin
            for k in range(1, b - a):
                f[k] = e[k] + np.logaddexp(f[k - 1, 0] + move[0], f[k - 1, 1] + move[1])
            for k in range(b - a - 2, -1, -1):
                v = e[k + 1] + g[k + 1]
                g[k] = np.logaddexp(move[:, 0] + v[0], move[:, 1] + v[1])
            z = np.logaddexp(*f[-1])
            p = np.exp(f + g - z)
            want[a:b] = -p
            want[np.arange(a, b), gold[a:b]] += 1
            starts += want[a]
            pair = np.exp(f[:-1, :, None] + move + (e[1:] + g[1:])[:, None, :] - z).sum(0)
            moves -= pair
            np.add.at(moves, (gold[a : b - 1], gold[a + 1 : b]), 1)
        for v, grad, total in zip((unary, move, begin), (x.T @ want, moves, starts), sums, strict=True):
            grad = grad / n - penalty * v
            total += grad**2
            v += rate * grad / np.sqrt(total)
    return Field(names, unary, move, begin)


def labelled_pages(count: int = 160, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Labelled pages made by rule: HTML and, for each leaf block, whether it is main text.

    They vary in layout (article, main, plain div containers), in furniture before, between and after the text (menus,
    headers, sidebars, notices, adverts, forms, comments, footers), in its words for class and id, and in unclosed tags.
    """
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(draw.choice("aeiourstnlmd") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + draw.choice("...!?")

    def links(n: int) -> list[str]:
        return [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(n)]

    made = []
    for _ in range(count):
        parts: list[tuple[str, bool | None]] = []

        def add(text: str, label: bool | None = None, parts=parts) -> None:
            parts.append((text, label))

        def items(n: int) -> None:
            for x in links(n):
                add(f"<li>{x}</li>", False)

        def furniture(kind: str) -> None:
            name = draw.choice([kind, f"{kind}-box", f"site {kind}", f"main-{kind}"])
            attr = draw.choice([f'class="{name}"', f"id='{name}'", f'class="x {name}" id="b{draw.randint(1, 9)}"'])
            if kind in ("nav", "menu", "breadcrumbs", "pagination"):
                tag = "nav" if draw.random() < 0.5 else "div"
                add(f"<{tag} {attr if tag == 'div' or draw.random() < 0.5 else ''}><ul>")
                items(draw.randint(2, 7))
                add(f"</ul></{tag}>")
            elif kind == "header":
                add(draw.choice(["<header>", f"<div {attr}>"]))
                add(f"<{(h := draw.choice(['h1', 'h2', 'p', 'div']))}>{words(1, 5)}</{h}>", False)
                add("</header>" if parts[-2][0] == "<header>" else "</div>")
            elif kind == "footer":
                tag = "footer" if draw.random() < 0.6 else "div"
                add(f"<{tag} {attr if tag == 'div' else ''}>")
                for _ in range(draw.randint(1, 3)):
                    add(f"<p>{draw.choice(['&copy; ', ''])}{sentence(3, 12)}</p>", False)
                add(f"</{tag}>")
            elif kind in ("sidebar", "related", "widget", "promo"):
                tag = "aside" if draw.random() < 0.5 else "div"
                add(f"<{tag} {attr if tag == 'div' or draw.random() < 0.5 else ''}>")
                add(f"<h3>{words(1, 3)}</h3>", False)
                if draw.random() < 0.5:
                    add("<ul>")
                    items(draw.randint(1, 5))
                    add("</ul>")
                else:
                    add(f"<p>{sentence(5, 40)}</p>", False)
                add(f"</{tag}>")
            elif kind in ("comments", "comment", "replies"):
                tag = draw.choice(["section", "div", "ol"])
                add(f"<{tag} {attr}>")
                for _ in range(draw.randint(1, 4)):
                    item = "li" if tag == "ol" else draw.choice(["div", "article", "div"])
                    add(f'<{item} class="comment">')
                    for _ in range(draw.randint(1, 2)):
                        add(f"<p>{sentence(3, 60)}</p>", False)
                    add(f"</{item}>")
                add(f"</{tag}>")
            elif kind in ("form", "newsletter", "subscribe", "login"):
                inner = draw.random() < 0.7
                add(f"<form {attr}>" if inner else f"<div {attr}>")
                add(f"<label>{sentence(2, 10)}</label><input name=q>", False)
                add("</form>" if inner else "</div>")
            else:
                add(f"<div {attr}>")
                add(draw.choice(["{}", "<p>{}</p>"]).format(sentence(2, 30)), False)
                add("</div>")

        def paragraph(open_ended: bool) -> None:
            kind = draw.random()
            text = sentence(2, 90) if kind < 0.9 else words(1, 8)
            if draw.random() < 0.15:
                text = f'{text} <a href="/x">{words(1, 4)}</a> {sentence(1, 20)}'
            if draw.random() < 0.2:
                text = f"<b>{text}" + ("<br>" if open_ended else "</b>")
            add(f"<p>{text}" + ("" if open_ended else "</p>"), True)

        for kind in draw.sample(["header", "nav", "menu", "cookie-notice", "notice", "banner", "breadcrumbs", "ad", "login"], draw.randint(1, 4)):
            furniture(kind)
        wrap = draw.choice([("<article>", "</article>")] * 4 + [
            ("<main><article class='post'>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
            ('<div id="main-content"><div class="article-body">', "</div></div>"), ('<div class="post entry">', "</div>"),
            ("<section>", "</section>"), ("<div>", "</div>"),
        ])
        open_ended = draw.random() < 0.3
        add(wrap[0])
        if draw.random() < 0.8:
            add(f"<h1>{words(1, 12)}{draw.choice(['', '.'])}</h1>", True)
        for _ in range(draw.choice([0, 1, 2, 3, 5, 8])):
            kind = draw.random()
            if kind < 0.72:
                paragraph(open_ended and draw.random() < 0.6)
            elif kind < 0.78:
                add(f"<h2>{words(1, 6)}</h2>", True)
            elif kind < 0.86:
                tag = draw.choice(["ul", "ol"])
                add(f"<{tag}>")
                for _ in range(draw.randint(1, 5)):
                    add(f"<li>{draw.choice([words, sentence])(1, 20)}</li>", True)
                add(f"</{tag}>")
            elif kind < 0.89:
                add(f"<blockquote>{sentence(4, 40)}</blockquote>", True)
            elif kind < 0.92:
                add(f"<pre>{words(2, 20)}</pre>", True)
            elif kind < 0.94:
                add("<table>")
                for _ in range(draw.randint(1, 3)):
                    add("<tr>")
                    add(f"<td>{words(1, 4)}</td>", True)
                    add(f"<td>{words(1, 4)}</td>", True)
                    add("</tr>")
                add("</table>")
            else:
                furniture(draw.choice(["ad", "advert", "promo", "related", "newsletter", "share", "notice"]))
        if draw.random() < 0.1:
            furniture("comments")
        add(wrap[1])
        for kind in draw.sample(["footer", "sidebar", "related", "comments", "replies", "form", "newsletter", "pagination", "ad", "social", "subscribe"], draw.randint(1, 4)):
            furniture(kind)
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(t for t, _ in parts) + "</body></html>"
        made.append((page, [x for _, x in parts if x is not None]))
    return made


@lru_cache(maxsize=2)
def default_field(count: int = 160, seed: int = 5) -> Field:
    """The field trained on the pages made by rule."""
    pages = []
    for page, labels in labelled_pages(count, seed):
        found = blocks(page)
        if len(found) == len(labels):
            pages.append((features(found), [int(x) for x in labels]))
    return train(pages)


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, field.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, page: str = "html", field: Field | None = None) -> DataFrame:
    """The rows with ``text`` (main text, blocks joined by one line feed) and ``n_chars`` (its code points) for the HTML column.

    Null HTML counts as empty; a page without main text has an empty text. The HTML column goes; columns named text or
    n_chars are replaced. Whole pages are read and nothing is cut.
    """
    field = field or default_field()
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    rows = pages.select(*others, F.col(page).alias("_html"))
    schema = StructType([*rows.drop("_html").schema.fields, StructField("text", StringType()), StructField("n_chars", IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, field) if x else "" for x in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*others, "text", "n_chars"])

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.col("n_chars").cast("long"))

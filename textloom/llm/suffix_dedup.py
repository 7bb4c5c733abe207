"""Removal of passages that an earlier document holds, by a distributed merge sort of suffixes.

A byte goes if a ``length``-byte string over it also starts in a document with a smaller doc_id. Suffixes are sorted at
anchors: in every window of ``length`` bytes the ``GRAM``-byte string with the smallest hash (the leftmost of equals). Equal
windows have their anchors at the same offset, so what follows and what comes before an anchor decides all of its windows.

1. Documents give the hashes of their anchors as sorted runs of deltas; hash buckets tell which occur in two documents. The
   others can't repeat, and their suffixes are left out.
2. The remaining suffixes (the text after the anchor, then the text before it, backwards, each as far as its windows go) are
   sorted in runs. Equal ones of a run become one, with the smallest and largest doc_id. Runs are front-coded and exchanged
   by ranges of the first bytes.
3. Each range merges its runs with a loser tree that keeps common prefixes: longer ones decide, equal ones are compared
   from there on, and no known prefix is compared again. Common prefixes of neighbours then give, for each offset of a
   window, the classes of equal windows and their smallest doc_id.
4. These go back to their runs, where each occurrence gets its removed windows, and from there to the documents.

A passage in any number of documents is at most one suffix for each run and anchor; no task gets its documents together.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from textloom.llm.store import parts, release, written

LENGTH, GRAM = 50, 20
RUN_ANCHORS = 1 << 19  # hashes in a run of step 1
RUN_SUFFIXES = 1 << 18  # suffixes in a run of step 2
SLICE = 1 << 16  # suffixes whose windows step 3 looks at together
RANGE_BYTES = 1 << 23  # text for each bucket of hashes and each range of suffixes
_SAMPLE = 64  # one in so many documents, by hash, helps to place the ranges


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every ``gram``-byte string: polynomials of doubled widths, put together and mixed."""
    part, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.full(1, 0x100000001B3, np.uint64)
    n = len(data) - gram + 1
    out, at, left = np.zeros(n, np.uint64), 0, gram
    while left:
        if left & 1:
            out *= base
            out += part[at : at + n]
            at += width
        left >>= 1
        if left:
            part = part[:-width] * base + part[width:]
            base = base * base
            width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    part, width = h, 1
    while width * 2 <= span:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    n = len(h) - span + 1
    return np.minimum(part[:n], part[span - width : span - width + n])


def _packed(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _deltas(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as deltas, byte planes together."""
    return _packed(np.diff(x, prepend=x.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_deltas(x: bytes) -> np.ndarray:
    planes = _unpacked(x, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _batch(schema: StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary() if isinstance(f.dataType, BinaryType) else pa.int64() for f in schema.fields]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def _schema(**columns) -> StructType:
    return StructType([StructField(n, t()) for n, t in columns.items()])


_HASHES = _schema(bucket=LongType, hashes=BinaryType, docs=BinaryType, owner=BinaryType)


def bucket_edges(buckets: int, span: int) -> np.ndarray:
    """Hashes that cut the smallest ones of windows of ``span`` hashes into buckets of about the same number of them.

    A hash at u of the way is the smallest of a window if, around it, ``span`` - 1 in a row are larger; so of all
    smallest hashes the share 1 - (span + 1) / 2 * q ** span + (span - 1) / 2 * q ** (span + 1), q = 1 - u, lies below it.
    """
    want = np.arange(1, buckets) / buckets
    low, high = np.zeros(len(want)), np.ones(len(want))
    for _ in range(52):
        u = (low + high) / 2
        q = 1 - u
        below = 1 - (span + 1) / 2 * q**span + (span - 1) / 2 * q ** (span + 1) < want
        low, high = np.where(below, u, low), np.where(below, high, u)
    return (low * 2.0**63).astype(np.uint64) * np.uint64(2)


def _hash_runs(buckets: int, length: int, gram: int):
    """Step 1: rows (doc_id, data) to sorted runs of (hash, document) by bucket."""
    edges = bucket_edges(buckets, length - gram + 1)

    def flush(hashes: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(h) for h in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h)
        h, owner, ids = h[order], owner[order], np.array(docs, np.int64)
        cut = [0, *np.searchsorted(h, edges).tolist(), len(h)]
        rows = []
        for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if e > s:
                own, at = np.unique(owner[s:e], return_inverse=True)
                rows.append((b, _deltas(h[s:e]), _packed(ids[own]), _packed(at.astype(np.uint32))))
        return _batch(_HASHES, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, total = [], [], 0
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                low = _minima(np.frombuffer(data.as_buffer(), np.uint8), length, gram)[1]
                hashes.append(low)
                docs.append(doc)
                total += len(low)
                if total >= RUN_ANCHORS:
                    yield flush(hashes, docs)
                    hashes, docs, total = [], [], 0
        if docs:
            yield flush(hashes, docs)

    return run


def _minima(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram, and the different hashes that are smallest in a window."""
    h = gram_hashes(text, gram)
    low = window_minima(h, length - gram + 1)
    return h, np.unique(low[np.flatnonzero(np.diff(low, prepend=~low[:1]))])


def _prefixes(length: int, gram: int):
    """The first eight bytes after the anchors of rows (data), as longs in the bytes' order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                text = np.frombuffer(data.as_buffer(), np.uint8)
                h, low = _minima(text, length, gram)
                top = _prefix(text[np.flatnonzero(np.isin(h, low))[:, None] + np.arange(8)]) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(top.view(np.int64))], names=["p"])

    return run


def _prefix(rows: np.ndarray) -> np.ndarray:
    """The first eight bytes of each row as a number in the rows' order."""
    return np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)


_BLOCKS = _schema(block=LongType, docs=BinaryType, sizes=BinaryType, hashes=BinaryType)
_SHARED = _schema(doc_id=LongType, shared=BinaryType)


def _by_document(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their numbers of hashes, and the hashes one document after another."""
    order = np.argsort(doc, kind="stable")
    ids, sizes = np.unique(doc, return_counts=True)
    return ids, sizes, h[order]


def _shared(blocks: int):
    """Step 1, one bucket: the hashes that occur in two documents or more, in blocks of documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([_unpacked(d, np.int64)[_unpacked(o, np.uint32)] for d, o in zip(rows["docs"], rows["owner"], strict=True)])
        h = np.concatenate([_from_deltas(x) for x in rows["hashes"]])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        again = h[1:] == h[:-1]
        many = np.append(again, False) | np.append(False, again)
        h, doc = h[many], doc[many]
        block = mixed_block(doc, blocks)
        out = []
        for k in np.unique(block).tolist():
            own = block == k
            out.append((k, *map(_packed, _by_document(doc[own], h[own]))))
        return pd.DataFrame(out, columns=_BLOCKS.names)

    return run


def mixed_block(doc: np.ndarray, blocks: int) -> np.ndarray:
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(blocks)


def _shared_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 1, one block of documents: each one's shared hashes from all buckets."""
    doc = np.concatenate([np.repeat(_unpacked(d, np.int64), _unpacked(n, np.int64)) for d, n in zip(rows["docs"], rows["sizes"], strict=True)])
    ids, sizes, h = _by_document(doc, np.concatenate([_unpacked(x, np.uint64) for x in rows["hashes"]]))
    cut = [0, *np.cumsum(sizes).tolist()]
    return pd.DataFrame({"doc_id": ids, "shared": [h[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)]})


def anchors(text: np.ndarray, shared: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors whose hash is shared: place, first and last start of the windows that have it."""
    h = gram_hashes(text, gram)
    low = window_minima(h, length - gram + 1)
    shared = np.unique(shared)
    window = np.flatnonzero(np.isin(low, shared))
    if not len(window):  # another row of the document has them
        return window, window, window
    place = np.flatnonzero(np.isin(h, shared))
    n = len(h) + 1
    key = np.searchsorted(shared, h[place]) * n + place
    order = np.sort(key)
    at = order[np.searchsorted(order, np.searchsorted(shared, low[window]) * n + window)] % n
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    return at[new], window[new], window[last]


def _keys(text: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows of bytes: the text after each anchor, the text before it backwards, both filled with zeros, and their sizes."""
    back = length - gram
    after, before = last + length - at, at - first
    out = np.zeros((len(at), length + back + 2), np.uint8)
    padded = np.concatenate([np.zeros(back, np.uint8), text, np.zeros(length, np.uint8)])
    right, left = np.arange(length), np.arange(back)
    out[:, :length] = padded[back + at[:, None] + right] * (right < after[:, None])
    out[:, length:-2] = padded[back - 1 + at[:, None] - left] * (left < before[:, None])
    out[:, -2], out[:, -1] = after, before + 1  # the last byte is never zero, which numpy's byte strings would drop
    return out


_RUNS = _schema(bucket=LongType, run=LongType, n=LongType, lcp=BinaryType, tails=BinaryType, least=BinaryType, most=BinaryType,
                doc=BinaryType, hash=BinaryType, key=BinaryType, place=BinaryType)


def _suffix_runs(splits: list[int], length: int, gram: int):
    """Step 2: rows (doc_id, hash, data, shared) to front-coded runs by range, and (bucket -1) the run's occurrences."""
    edges = np.array(splits, np.uint64)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([k for *_, k in held])
        doc = np.repeat(np.array([d for d, *_ in held], np.int64), [len(k) for *_, k in held])
        text = np.repeat(np.array([t for _, t, *_ in held], np.int64), [len(k) for *_, k in held])
        place = np.concatenate([p for _, _, p, _ in held])
        order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
        keys, doc, text, place = keys[order], doc[order], text[order], place[order]
        differ = keys[1:] != keys[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
        new = np.flatnonzero(np.concatenate([[True], lcp < keys.shape[1]]))
        least, most = np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new)
        lcp = np.concatenate([[0], lcp])[new].astype(np.uint8)
        own = keys[new]
        run = int.from_bytes(os.urandom(8), "little", signed=True)
        number = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(new, append=len(keys)))
        rows = [(-1, run, len(new), *[None] * 4, *map(_packed, (doc, text, number, place)))]
        cut = [0, *np.searchsorted(_prefix(own), edges, "right").tolist(), len(new)]
        for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if e > s:
                part = lcp[s:e].copy()
                part[0] = 0
                tails = own[s:e][np.arange(own.shape[1]) >= part[:, None]]
                least_most = map(_packed, (least[s:e], most[s:e]))
                rows.append((b, run, s, _packed(part), _packed(tails, 6), *least_most, *[None] * 4))
        return _batch(_RUNS, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            for doc, text, data, shared in zip(
                b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True
            ):
                data = np.frombuffer(data.as_buffer(), np.uint8)
                at, first, last = anchors(data, np.frombuffer(shared, np.uint64), length, gram)
                for s in range(0, len(at), RUN_SUFFIXES):
                    part = slice(s, s + RUN_SUFFIXES)
                    keys = _keys(data, at[part], first[part], last[part], length, gram)
                    held.append((doc, text, at[part].astype(np.int32), keys))
                    total += len(keys)
                    if total >= RUN_SUFFIXES:
                        yield flush(held)
                        held, total = [], 0
        if total:
            yield flush(held)

    return run


def front_decoded(lcp: np.ndarray, tails: np.ndarray, width: int) -> np.ndarray:
    """The rows of a front-coded run."""
    fresh = np.arange(width) >= lcp[:, None]
    out = np.zeros(fresh.shape, np.uint8)
    out[fresh] = tails
    source = np.maximum.accumulate(np.where(fresh, np.arange(len(lcp))[:, None], 0), 0)
    return np.take_along_axis(out, source, 0)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, common prefix with the string before) by a loser tree.

    Gives, in merged order, the run that each string comes from and its common prefix with the string before it. A node
    holds the run that lost there and its common prefix with the winner. A string that shares more with the last winner
    is smaller; only when two share as much are their bytes compared, from that place on.
    """
    if len(runs) == 1:
        return [0] * len(runs[0][0]), list(runs[0][1])
    size = 1 << (len(runs) - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (size - len(runs))
    counts = [len(s) for s in strings]
    at = [0] * size
    head: list[bytes | None] = [s[0] if s else None for s in strings]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix) of two runs' heads, given their prefixes with the last winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, la, b, 0
        if x is None:
            return b, lb, a, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = x[la:], y[la:]
        if x == y:
            return a, la, b, la + len(x)
        diff = int.from_bytes(x) ^ int.from_bytes(y)
        same = la + len(x) - (diff.bit_length() + 7) // 8
        return (a, la, b, same) if x < y else (b, la, a, same)

    loser, prefix = [0] * size, [0] * size

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        a, la, loser[node], prefix[node] = play(a, la, b, lb)
        return a, la

    win, shared = build(1)
    order, lcps = [], []
    while head[win] is not None:
        order.append(win)
        lcps.append(shared)
        k = at[win] = at[win] + 1
        head[win], shared = (strings[win][k], prefixes[win][k]) if k < counts[win] else (None, 0)
        node = (win + size) >> 1
        while node:
            other, lo = loser[node], prefix[node]
            if shared > lo and head[win] is not None:
                pass
            elif shared < lo and head[other] is not None:
                loser[node], prefix[node], win, shared = win, shared, other, lo
            else:
                win, shared, loser[node], prefix[node] = play(win, shared, other, lo)
            node >>= 1
    return order, lcps


def _smallest(keys: np.ndarray, lcp: np.ndarray, least: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Smallest doc_id with the window of each suffix (rows, in merged order) and offset; -1 << 63 where it has none."""
    back = length - gram
    after, before = keys[:, -2].astype(int), keys[:, -1].astype(int) - 1
    left = np.ascontiguousarray(np.concatenate([keys[:, length:-2], np.ones((len(keys), 1), np.uint8)], 1))
    order = np.argsort(left.view(f"S{back + 1}").ravel(), kind="stable")
    differ = left[order][1:] != left[order][:-1]
    left_lcp = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), back)])
    out = np.full((len(keys), back + 1), -(1 << 63), np.int64)
    for o in range(back + 1):
        rows = np.flatnonzero((after >= length - o) & (before >= o))
        if not len(rows):
            continue
        right_class = np.cumsum(lcp < length - o)
        left_class = np.empty(len(keys), np.int64)
        left_class[order] = np.cumsum(left_lcp < o)
        key = right_class[rows] * (len(keys) + 1) + left_class[rows]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[by], prepend=-1))
        low = np.minimum.reduceat(least[rows][by], new)
        out[rows[by], o] = np.repeat(low, np.diff(new, append=len(by)))
    return out


def _classes(lcp: np.ndarray, gram: int) -> list[slice]:
    """Slices of about ``SLICE`` suffixes that part no two with the same anchor string."""
    starts = np.flatnonzero(lcp < gram)
    cut = starts[np.searchsorted(starts, np.arange(SLICE, len(lcp), SLICE), "right") - 1]
    bounds = [*np.unique(np.concatenate([[0], cut])).tolist(), len(lcp)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def _covered(keys, lcp, least, most, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix, first and last offset, and smallest doc_id, where that is below the suffix's largest one."""
    low = _smallest(keys, lcp, least, length, gram)
    hit = (low > -(1 << 63)) & (low < most[:, None])
    same = hit[:, 1:] & hit[:, :-1] & (low[:, 1:] == low[:, :-1])
    edge = np.zeros((len(hit), 1), bool)
    who, lo = np.nonzero(hit & ~np.concatenate([edge, same], 1))
    hi = np.nonzero(hit & ~np.concatenate([same, edge], 1))[1]
    return who, lo, hi, low[who, lo]


_FOUND = _schema(run=LongType, key=BinaryType, lo=BinaryType, hi=BinaryType, least=BinaryType)


def _merged(length: int, gram: int):
    """Step 3, one range: for each run the offsets whose windows an earlier document has."""
    width = 2 * length - gram + 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lcps = [_unpacked(x, np.uint8) for x in rows["lcp"]]
        tables = [front_decoded(c, _unpacked(t, np.uint8), width) for c, t in zip(lcps, rows["tails"], strict=True)]
        runs = []
        for t, c in zip(tables, lcps, strict=True):
            data = t.tobytes()
            runs.append(([data[i : i + width] for i in range(0, len(data), width)], c.tolist()))
        order, lcp = (np.array(x, np.int64) for x in merge(runs))
        base = np.cumsum([0] + [len(t) for t in tables])
        place = np.empty(len(order), np.int64)  # of the merged strings in the runs, one after another
        place[:] = base[:-1][order]
        by = np.argsort(order, kind="stable")
        place[by] += np.arange(len(order)) - base[:-1][order[by]]
        keys = np.concatenate(tables)[place]
        least = np.concatenate([_unpacked(x, np.int64) for x in rows["least"]])[place]
        most = np.concatenate([_unpacked(x, np.int64) for x in rows["most"]])[place]
        found = [_covered(keys[x], lcp[x], least[x], most[x], length, gram) for x in _classes(lcp, gram)]
        who, lo, hi, doc = (np.concatenate(c) for c in zip(*found, strict=True))
        who += np.repeat([x.start for x in _classes(lcp, gram)], [len(f[0]) for f in found])
        source = order[who]
        number = place[who] - base[source] + rows["n"].to_numpy()[source]
        out = []
        for k, ident in enumerate(rows["run"].tolist()):
            own = source == k
            if own.any():
                columns = (number[own].astype(np.int32), lo[own].astype(np.uint8), hi[own].astype(np.uint8), doc[own])
                out.append((ident, *map(_packed, columns)))
        return pd.DataFrame(out, columns=_FOUND.names)

    return run


_SPANS = _schema(doc_id=LongType, hash=LongType, starts=BinaryType, ends=BinaryType)


def _spans(length: int):
    """Step 4, one run: the removed runs of bytes of each of its documents."""

    def run(_, found: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(runs):
            row = runs.iloc[0]
            doc, text = _unpacked(row["doc"], np.int64), _unpacked(row["hash"], np.int64)
            key, place = _unpacked(row["key"], np.int32), _unpacked(row["place"], np.int32).astype(np.int64)
            number = np.concatenate([_unpacked(x, np.int32) for x in found["key"]])
            lo, hi = (np.concatenate([_unpacked(x, np.uint8) for x in found[c]]).astype(np.int64) for c in ("lo", "hi"))
            least = np.concatenate([_unpacked(x, np.int64) for x in found["least"]])
            # occurrences are in order of their suffix's number
            first, last = np.searchsorted(key, number, "left"), np.searchsorted(key, number, "right")
            count = last - first
            which = np.repeat(np.arange(len(number)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
            later = doc[at] > least[which]
            at, which = at[later], which[later]
            start, end = place[at] - hi[which], place[at] - lo[which] + length
            order = np.lexsort([end, start, text[at], doc[at]])
            doc, text, start, end = doc[at][order], text[at][order], start[order], end[order]
            new = np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1
            bounds = [0, *new.tolist(), len(doc)] if len(doc) else []
            for s, e in zip(bounds, bounds[1:], strict=False):
                a, b = joined(start[s:e], end[s:e])
                out.append((int(doc[s]), int(text[s]), a.tobytes(), b.tobytes()))
        return pd.DataFrame(out, columns=_SPANS.names)

    return run


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch; ``start`` ascends."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, hash, starts, ends) of the documents that lose bytes; ``hash`` is the text's, spans are 64-bit numbers.

    Rows come from one or several runs; spans of different rows of a document may touch.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and octet_length(text) >= %d" % length).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")
    )
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges = parts(spark, size, RANGE_BYTES)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLE)) == 0).select("data").mapInArrow(_prefixes(length, gram), "p long")
    cuts = sample.agg(F.percentile_approx("p", [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    splits = [(x + (1 << 63)) % (1 << 64) for x in sorted(set(cuts))]
    hashes = rows.mapInArrow(_hash_runs(ranges, length, gram), _HASHES)
    shared = hashes.groupBy("bucket").applyInPandas(_shared(ranges), _BLOCKS)
    shared = shared.groupBy("block").applyInPandas(_shared_of_block, _SHARED)
    found = rows.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", F.xxhash64("data").alias("hash"), "data", "shared")
    runs = written(found.mapInArrow(_suffix_runs(splits, length, gram), _RUNS))
    release(spark)
    sorted_runs = runs.where("bucket >= 0").select("bucket", "run", "n", "lcp", "tails", "least", "most")
    removed = sorted_runs.groupBy("bucket").applyInPandas(_merged(length, gram), _FOUND)
    occurrences = runs.where("bucket < 0").select("run", "doc", "hash", "key", "place")
    spans = written(removed.groupBy("run").cogroup(occurrences.groupBy("run")).applyInPandas(_spans(length), _SPANS))
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: str | None = "bytes") -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans, kept_sha256 and, for the text, what is left.

    ``kept`` says what becomes of ``text``: "bytes" gives the remaining bytes as ``kept`` beside it; "text" puts the remaining
    text in its place, without the characters that a cut leaves incomplete; None drops it.

    Texts are UTF-8 bytes, null is empty. Texts shorter than ``length`` and rows without doc_id lose nothing, and the latter
    count as no earlier document. Rows of one doc_id are judged each against smaller doc_ids only; repeated rows come back
    repeated. Columns with the new names are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *{"bytes": ["kept"], "text": ["text"], None: []}[kept]]
    spans = repeated_spans(docs, length, gram).groupBy(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).agg(
        F.collect_list(F.struct("starts", "ends")).alias("_spans")
    )
    others = [c for c in docs.columns if c not in new and not (kept is None and c == "text")]
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(*others, data.alias("_data")).withColumn("_hash", F.xxhash64("_data"))
    rows = rows.join(
        spans.hint("shuffle_hash"), (rows["doc_id"].cast("long") == spans["_doc"]) & (rows["_hash"] == spans["_hash"]), "left"
    ).select(*others, "_data", "_spans")
    kinds = [LongType, LongType, LongType, StringType, BinaryType if kept == "bytes" else StringType]
    schema = StructType([*docs.select(*others).schema.fields, *[StructField(n, t()) for n, t in zip(new, kinds, strict=False)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                start, end = (
                    np.frombuffer(b"".join(x[c] for x in spans or []), np.int64) for c in ("starts", "ends")
                )
                order = np.argsort(start, kind="stable")
                start, end = joined(start[order], end[order])
                left, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    left.append(data[at:s])
                    at = e
                left = b"".join([*left, data[at:]])
                rest = left.decode("utf-8", "ignore") if kept == "text" else left
                out.append((len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrow = [pa.int64()] * 3 + [pa.string(), pa.string() if kept == "text" else pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns[: len(new)], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], names=[*others, *new])

    return rows.mapInArrow(run, schema)

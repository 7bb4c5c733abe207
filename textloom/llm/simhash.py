"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most ``distance`` bits agree on at least one of distance + 1 bit blocks. For each block the
code is turned so that the block comes first, and codes are sorted by Gray rank: codes with the same block lie together,
and neighbours differ in few bits. The top nodes of the index are the blocks' values. Below them, every run of codes is a
node with a mask of the bits on which all its codes agree and their pattern there; runs of runs are nodes again. A search
goes down pairs of nodes, adds up the differences on newly shared bits, and drops a pair of groups as soon as they exceed
the distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components, star
from textloom.llm.store import parts, written

WIDTH, SEED = 4, 42
TILE = 1024
_FAN = 16
_CHUNK = 1 << 16
_EDGE, _TILE_ROW = 0, 1


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """64-bit fingerprint of a text in UTF-8: a bit is 1 if over half of the shingles' XXH64 have it.

    A-Z are lower-cased, words are runs of other bytes than ASCII white space, shingles are ``width`` words joined by a
    space and count as often as they occur. A shorter text is one shingle; no words give 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(len(words) - width + 1, 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter(
            (digest(line[s:e], seed) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)),
            np.uint64, min(_CHUNK, n - at),
        )
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = np.array([fingerprint(x or b"") for x in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code): the fingerprint's 64 bits as a long; null and blank texts have 0."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_data"))
    return rows.mapInArrow(_fingerprint_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, as a long whose signed order is that of the place."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(count: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of each of ``count`` blocks of 64 bits."""
    cut = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _turned(code: Column, offset: int) -> Column:
    return F.shiftleft(code, offset).bitwiseOR(F.shiftrightunsigned(code, 64 - offset)) if offset else code


class Node:
    """Codes in Gray order and the levels of nodes over them; each level has masks and patterns, the last is one node."""

    def __init__(self, codes: np.ndarray):
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), _FAN)
            both, one = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            agreed = np.bitwise_and.reduceat(mask, at) & ~(both ^ one)
            self.levels.append((agreed, both & agreed))


def search(a: Node, b: Node, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes of ``a`` and ``b`` at most ``distance`` bits apart; ``same``: b is a, each pair once."""
    top = max(len(a.levels), len(b.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    shared, differ = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        (ma, pa_), (mb, pb) = (x.levels[min(level, len(x.levels) - 1)] for x in (a, b))
        if level < top:  # go down to all pairs of children
            step = np.arange(_FAN)
            down_a, down_b = level < len(a.levels) - 1, level < len(b.levels) - 1
            ci = (i[:, None] * _FAN + step) if down_a else i[:, None]
            cj = (j[:, None] * _FAN + step) if down_b else j[:, None]
            shape = (len(i), ci.shape[1], cj.shape[1])
            owner = np.broadcast_to(np.arange(len(i))[:, None, None], shape).ravel()
            i, j = np.broadcast_to(ci[:, :, None], shape).ravel(), np.broadcast_to(cj[:, None, :], shape).ravel()
            ok = (i < len(ma)) & (j < len(mb)) & ((i <= j) if same else True)
            i, j, owner = i[ok], j[ok], owner[ok]
            shared, differ = shared[owner], differ[owner]
        both = ma[i] & mb[j]
        differ = differ + np.bitwise_count((pa_[i] ^ pb[j]) & both & ~shared)
        ok = differ <= distance
        i, j, shared, differ = i[ok], j[ok], both[ok], differ[ok]
    if same:
        ok = i < j
        i, j = i[ok], j[ok]
    return i, j


def _links(codes: list[np.ndarray], ids: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links inside one tile, or between two."""
    nodes = [Node(c) for c in codes]
    i, j = search(nodes[0], nodes[-1], distance, len(codes) == 1)
    return star(ids[0][i], ids[-1][j])


_TILES = (
    "kind int, u long, v long, turn int, block long, first long, mask long, pattern long, codes binary, ids binary"
)


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    kinds = {"kind": pa.int32(), "turn": pa.int32(), "codes": pa.binary(), "ids": pa.binary()}
    names = [f.split()[0] for f in _TILES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), kinds.get(c, pa.int64())) for c in names], names=names
    )


def _tiles(distance: int, tile: int):
    """Over rows (turn, block, rank, code, id) in order: links inside tiles, and the tiles that may have partners elsewhere.

    A run of one block becomes tiles of ``tile`` codes. The first and last run of a partition may go on in the next one.
    """

    def emit(run: list[np.ndarray], more: bool) -> Iterator[pa.RecordBatch]:
        turn, block, rank, code, ident = run
        code = code.view(np.uint64)
        for at in range(0, len(code), tile):
            c, k = code[at : at + tile], ident[at : at + tile]
            u, v = _links([c], [k], distance)
            if len(u):
                yield _rows(kind=np.zeros(len(u), np.int32), u=u, v=v)
            if more or len(code) > tile:
                mask, pattern = Node(c).levels[-1]
                yield _rows(
                    kind=[_TILE_ROW], turn=turn[:1], block=block[:1], first=rank[at : at + 1], mask=mask.view(np.int64),
                    pattern=pattern.view(np.int64), codes=[c.tobytes()], ids=[k.tobytes()],
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            turn, block = cols[0], cols[1]
            cut = np.flatnonzero((turn[1:] != turn[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *cut.tolist()]
            for s, e in zip(bounds, bounds[1:], strict=False):
                yield from emit([c[s:e] for c in cols], first)
                first = False
            held = [c[bounds[-1] :] for c in cols]
            whole = (len(held[0]) - 1) // tile * tile  # a long run leaves in whole tiles
            if whole:
                yield from emit([c[:whole] for c in held], True)
                held, first = [c[whole:] for c in held], True
        if held is not None:
            yield from emit(held, True)

    return run


def _across(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ca, ia, cb, ib = (np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64) * 2, strict=True))
                u, v = _links([ca, cb], [ia, ib], distance)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def near_codes(codes: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect exactly the codes linked at ``distance`` or fewer bits; from a table (code, id).

    ``codes`` holds every code once. Only the edges that are needed to connect a tile's links are kept.
    """
    turns = []
    for k, (offset, width) in enumerate(blocks(distance + 1)):
        code = _turned(F.col("code"), offset)
        turns.append(F.struct(
            F.lit(k).alias("turn"), F.shiftrightunsigned(code, 64 - width).alias("block"),
            gray_rank(code).alias("rank"), F.col("code").alias("code"), F.col("id").alias("id"),
        ))
    spark = codes.sparkSession
    n = parts(spark, codes.count() * len(turns), 200_000)
    rows = codes.select(F.explode(F.array(*turns)).alias("t")).select("t.*")
    rows = rows.repartitionByRange(n, "turn", "rank").sortWithinPartitions("turn", "rank")
    out = written(rows.mapInArrow(_tiles(distance, tile), _TILES))
    tiles = out.where(F.col("kind") == _TILE_ROW)
    heads = tiles.select("turn", "block", "first", "mask", "pattern")
    a, b = heads.alias("a"), heads.alias("b")
    differ = F.bit_count(
        F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask"))
    )
    pairs = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.block") == F.col("b.block"))
                   & (F.col("a.first") < F.col("b.first")) & (differ <= distance))
    pairs = pairs.select("a.turn", F.col("a.first").alias("one"), F.col("b.first").alias("two"))
    one = tiles.select("turn", F.col("first").alias("one"), F.col("codes").alias("c1"), F.col("ids").alias("i1"))
    two = tiles.select("turn", F.col("first").alias("two"), F.col("codes").alias("c2"), F.col("ids").alias("i2"))
    met = pairs.join(one, ["turn", "one"]).join(two, ["turn", "two"]).select("c1", "i1", "c2", "i2")
    inside = out.where(F.col("kind") == _EDGE).select("u", "v")
    return inside.unionByName(met.mapInArrow(_across(distance), "u long, v long"))


def near_duplicates(docs: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, code, fingerprint, component_id) for each row of ``docs``.

    Documents with equal fingerprints are linked, those with 0 too. ``component_id`` is the smallest doc_id reachable.
    Null texts count as empty; rows without doc_id are linked but never give the component's name (null, if they are
    alone with it). Repeated rows come back repeated. Other columns are ignored.
    """
    marks = written(fingerprints(docs))
    codes = written(marks.groupBy("code").agg(F.min(F.col("doc_id").cast("long")).alias("id")))
    # a code is its own id in the links, so codes that only rows without doc_id hold take part too
    groups = components(near_codes(codes.select("code", F.col("code").alias("id")), distance, tile))
    classes = codes.join(groups, codes["code"] == groups["node"], "left").select(
        "code", "id", F.coalesce("component", "code").alias("_class")
    )
    names = classes.groupBy("_class").agg(F.min("id").alias("component_id"))
    codes = classes.join(names, "_class").select("code", "component_id")
    kind = dict(docs.dtypes)["doc_id"]
    return marks.join(codes, "code").select(
        "doc_id", "code", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.col("component_id").cast(kind).alias("component_id"),
    )

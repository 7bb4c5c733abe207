"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is cut into bands of ``WIDTH`` turns, so that one of any length is many small rows. A band is named by a
128-bit digest of the turns before it and holds the digests of its own turns. Bands are dealt to range shards by name, turns
and conversation. In a shard the digests become small integers, a matrix with a row for each band, padded with zeros; a
lexicographic sort brings equal prefixes together, the changes from row to row, OR-accumulated over the columns, mark where
the nodes of every depth start, and ``reduceat`` over these starts gives each node's numbers.

Nodes that a shard's first or last row belongs to may go on in another shard, and nodes at the border of bands go on in the
next band: these are open. Their partial numbers are recombined by the node's digest. Three passes over the shards:

1. the smallest member and the greatest length of open nodes;
2. what each conversation owns: the nodes whose smallest member it is, which are its last ones, and whether it ends in a leaf;
3. the nodes. What a subtree saves is the sum, over its members but the smallest, of the text from the node on less the text
   of nodes they own; its leaves are the leaves its members own. So sums over members give sums over subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.store import parts, written

WIDTH = 16
_SORTED, _SHARD = 200_000, 32_768
_SUPER = 4096
_SEGMENT = 4096  # ids of one piece of a long list of ends
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, digest, chars) of turns in order and (conv_id, part, first, before, n) of conversations by part.

    A turn's place in its conversation is at - first + before + 1, the conversation has n turns. The rows are sorted over
    all tasks, so that a conversation of any length is spread like the others.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("salt")
    )
    n = parts(rows.sparkSession, rows.count(), _SORTED)
    keys = ("conv_id", "turn", "role", "text")
    turns = turns.repartitionByRange(n, *keys, "salt").sortWithinPartitions(*keys)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = written(turns.select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        digest.alias("digest"), F.length("text").cast("long").alias("chars"),
    ))
    groups = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, groups.select(
        "conv_id", "part", "first", F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n")
    )


def shared_heads(turns: DataFrame, groups: DataFrame, every: int, most: int, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first ``head`` turns replaced by those of conversation conv_id - conv_id % every.

    ``head`` is an expression of conv_id and at most ``most``. Gives (conv_id, size) and (conv_id, size, depth, digest, chars).
    """
    groups = written(groups)
    convs = groups.select("conv_id", "n").distinct().select(
        "conv_id", "n", head.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    )
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")
    )
    convs = written(convs)
    place = F.col("at") - F.col("first") + F.col("before") + 1
    own = turns.join(groups.join(convs, "conv_id").drop("n", "base"), ["conv_id", "part"]).where(place > F.col("h"))
    own = own.select("conv_id", "size", (F.col("m") + place - F.col("h")).alias("depth"), "digest", "chars")
    heads = turns.join(groups.where(F.col("conv_id") % every == 0), ["conv_id", "part"]).where(place <= most)
    heads = heads.select(F.col("conv_id").alias("base"), place.alias("depth"), "digest", "chars")
    lent = convs.where("m > 0").join(heads, "base").where("depth <= m")
    return convs.select("conv_id", "size"), own.unionByName(lent.select("conv_id", "size", "depth", "digest", "chars"))


def _bands(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, size, band, s1, s2, e1, e2, before, total, ids, chars): s names a band, e the one that would follow.

    ``before`` and ``total`` count the text before the band and in the whole conversation.
    """
    band = F.floor((F.col("depth") - 1) / WIDTH).cast("long")
    listed = turns.groupBy("conv_id", band.alias("band")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("t")
    )
    listed = listed.select(
        "conv_id", "band", "size", F.transform("t", lambda t: t["digest"]).alias("ids"), F.transform("t", lambda t: t["chars"]).alias("chars")
    )
    none = convs.where("size = 0").select(
        "conv_id", F.lit(0).cast("long").alias("band"), "size", F.array().cast("array<binary>").alias("ids"),
        F.array().cast("array<bigint>").alias("chars"),
    )
    listed = written(listed.unionByName(none).withColumns({
        "h1": F.xxhash64(F.lit(1), "band", "ids"), "h2": F.xxhash64(F.lit(2), "ids", "band"),
        "own": F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c),
    }))
    zero = F.lit(0).cast("long")
    short = listed.where(F.col("size") <= WIDTH).withColumns({"s1": zero, "s2": zero, "before": zero, "total": F.col("own")})
    long = listed.where(F.col("size") > WIDTH).withColumn("far", F.floor(F.col("band") / _SUPER).cast("long"))
    sums = long.groupBy("conv_id", "far").agg(F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"), F.sum("own").alias("fc"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "far", F.coalesce(F.bit_xor("f1").over(earlier), zero).alias("f1"),
        F.coalesce(F.bit_xor("f2").over(earlier), zero).alias("f2"), F.coalesce(F.sum("fc").over(earlier), zero).alias("fc"),
        F.sum("fc").over(whole).alias("total"),
    )
    near = Window.partitionBy("conv_id", "far").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumns({
        "n1": F.coalesce(F.bit_xor("h1").over(near), zero), "n2": F.coalesce(F.bit_xor("h2").over(near), zero),
        "nc": F.coalesce(F.sum("own").over(near), zero),
    }).join(sums, ["conv_id", "far"]).withColumns({
        "s1": F.col("n1").bitwiseXOR(F.col("f1")), "s2": F.col("n2").bitwiseXOR(F.col("f2")), "before": F.col("nc") + F.col("fc"),
    })
    names = ("conv_id", "size", "band", "s1", "s2", "h1", "h2", "before", "total", "ids", "chars")
    both = short.select(*names).unionByName(long.select(*names))
    return both.withColumns({"e1": F.col("s1").bitwiseXOR(F.col("h1")), "e2": F.col("s2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")


class Shard:
    """A shard's bands as a sorted padded matrix, and the starts of nodes in each column.

    Column 0 is the node that a band hangs on, column j the nodes of its first j turns.
    """

    def __init__(self, table: pa.Table):
        t = table.combine_chunks()
        col = {c: t[c].to_numpy() for c in ("conv_id", "size", "band", "s1", "s2", "e1", "e2", "before", "total")}
        ids, chars = t["ids"].combine_chunks(), t["chars"].combine_chunks()
        n, count = len(t), np.asarray(ids.value_lengths()).astype(np.int64)
        flat = ids.flatten()
        raw = np.frombuffer(b"".join(flat.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        by = np.lexsort((raw[:, 1], raw[:, 0]))
        dense = np.zeros(len(raw), np.int32)
        if len(raw):
            dense[by] = np.cumsum(np.concatenate([[True], (raw[by][1:] != raw[by][:-1]).any(1)]))
        row, place = np.repeat(np.arange(n), count), np.arange(len(raw)) - np.repeat(np.cumsum(count) - count, count)
        m, c = np.zeros((n, WIDTH), np.int32), np.zeros((n, WIDTH), np.int64)
        m[row, place], c[row, place] = dense, chars.flatten().to_numpy()
        order = np.lexsort((col["conv_id"], *(m[:, j] for j in reversed(range(WIDTH))), col["s2"], col["s1"], col["band"]))
        for name, x in col.items():
            setattr(self, name, x[order])
        self.n, self.count, self.m, self.chars = n, count[order], m[order], c[order]
        first = np.cumsum(count) - count
        self.digests = [flat.slice(first[i], count[i]) for i in order]
        change = np.ones((n, WIDTH + 1), bool)
        change[1:, 0] = (self.band[1:] != self.band[:-1]) | (self.s1[1:] != self.s1[:-1]) | (self.s2[1:] != self.s2[:-1])
        change[1:, 1:] = self.m[1:] != self.m[:-1]
        self.fresh = np.logical_or.accumulate(change, axis=1)

    def nodes(self, j: int):
        """(starts, valid, open) of column j: first rows, whether it is a node and not padding, whether it may go on elsewhere."""
        start = np.flatnonzero(self.fresh[:, j])
        valid = np.ones(len(start), bool) if j == 0 else self.m[start, j - 1] > 0
        going = np.zeros(len(start), bool)
        going[[0, -1]] = True
        if j == 0:
            going |= self.band[start] > 0
        if j == WIDTH:
            going |= np.maximum.reduceat(self.size, start) > self.depth(start, j)
        return start, valid, valid & going

    def depth(self, row: np.ndarray, j: int) -> np.ndarray:
        return self.band[row] * WIDTH + j

    def key(self, i: int, j: int) -> tuple[int, int]:
        """128 bits for the node of row i in column j; a band's last column and the next band's column 0 agree."""
        if j == 0:
            return int(self.s1[i]), int(self.s2[i])
        if j == WIDTH:
            return int(self.e1[i]), int(self.e2[i])
        head = int(self.s1[i]).to_bytes(8, "big", signed=True) + int(self.s2[i]).to_bytes(8, "big", signed=True)
        d = xxhash.xxh3_128_digest(head + b"".join(self.digests[i][:j].to_pylist()))
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


_KEY = "depth long, k1 long, k2 long"


def _open_nodes(key: tuple, table: pa.Table) -> pa.Table:
    s = Shard(table)
    out = []
    for j in range(WIDTH + 1):
        start, _, going = s.nodes(j)
        least, longest = np.minimum.reduceat(s.conv_id, start), np.maximum.reduceat(s.size, start)
        depth = s.depth(start, j)
        out += [(key[0].as_py(), depth[i], *s.key(start[i], j), least[i], longest[i]) for i in np.flatnonzero(going)]
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(np.array(c, np.int64)) for c in cols], names=["shard", "depth", "k1", "k2", "least", "longest"])


class Known:
    """A shard with the true smallest member and greatest length of all its nodes: each row's ``least`` and ``longest``."""

    def __init__(self, table: pa.Table, back: pa.Table):
        self.shard = s = Shard(table)
        cols = [back[c].to_pylist() for c in ("kind", "depth", "k1", "k2", "least", "longest")]
        found = {r[1:4]: r[4:] for r in zip(*cols, strict=True) if r[0] == 0}
        self.owned = {r[4]: (r[2], r[3]) for r in zip(*cols, strict=True) if r[0] == 1}
        self.columns = []
        shape = (s.n, WIDTH + 1)
        self.least, self.longest = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for j in range(WIDTH + 1):
            start, valid, going = s.nodes(j)
            least, longest = np.minimum.reduceat(s.conv_id, start), np.maximum.reduceat(s.size, start)
            depth = s.depth(start, j)
            keys = {}
            for i in np.flatnonzero(going):
                keys[i] = (int(depth[i]), *s.key(start[i], j))
                least[i], longest[i] = found[keys[i]]
            length = np.diff(np.concatenate([start, [s.n]]))
            self.least[:, j], self.longest[:, j] = np.repeat(least, length), np.repeat(longest, length)
            self.columns.append((start, valid, going, keys, length))
        last = s.depth(np.arange(s.n), 0) + s.count == s.size
        end = np.arange(s.n), s.count
        self.ends = last
        self.leaf = last & (self.least[end] == s.conv_id) & (self.longest[end] == s.size)
        self.own_chars = (s.chars * (self.least[:, 1:] == s.conv_id[:, None])).sum(1)


def _owned(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
    """What conversations of several bands own in one; the others' are known where they are needed."""
    names = ["shard", "conv_id", "own", "leaf"]
    if not len(table):
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    k = Known(table, back)
    at = np.flatnonzero(k.shard.size > WIDTH)
    cols = (np.full(len(at), key[0].as_py()), k.shard.conv_id[at], k.own_chars[at], k.leaf[at].astype(np.int64))
    return pa.table([pa.array(c) for c in cols], names=names)


_NODE = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
    "ends_sha256 string, k1 long, k2 long, p1 long, p2 long, x long, segment string"
)
_NAMES = [f.split()[0] for f in _NODE.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in _NODE.split(", ")]


def _rows(**cols) -> pa.Table:
    n = len(next(iter(cols.values())))
    return pa.table(
        [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES
    )


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _nodes(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
    """Kind 0: whole nodes; 1: partial numbers of open ones; 2: pieces of open nodes' ends."""
    if not len(table):
        return _rows(kind=np.zeros(0, np.int32))
    k = Known(table, back)
    s = k.shard
    own, leaf = k.own_chars.copy(), k.leaf.astype(np.int64)
    for i in np.flatnonzero(s.size > WIDTH):
        own[i], leaf[i] = k.owned[int(s.conv_id[i])]
    later = (s.total - s.before)[:, None] - np.concatenate([np.zeros((s.n, 1), np.int64), np.cumsum(s.chars, 1)], 1)
    out = []
    for j in range(WIDTH + 1):
        start, valid, going, keys, length = k.columns[j]
        if not valid.any():
            break
        x = later[:, max(j - 1, 0)] - own  # text from the node on, less the text of own nodes
        local = np.repeat(np.minimum.reduceat(s.conv_id, start), length)
        least_row = np.flatnonzero(s.conv_id == local)  # one row for each node: its smallest member here
        total, leaves = np.add.reduceat(x, start), np.add.reduceat(leaf, start)
        if j < WIDTH:
            begins, held, open_, _, _ = k.columns[j + 1]
            counted = np.zeros(s.n, np.int64)
            counted[begins[held]] = 1
            children = np.add.reduceat(counted, start)
            counted[begins[open_]] = 0
            closed_children = np.add.reduceat(counted, start)
        else:
            children = closed_children = np.zeros(len(start), np.int64)
        depth = s.depth(start, j)
        ended = k.ends & (s.count == j)
        n_ends = np.add.reduceat(ended.astype(np.int64), start)
        parent = k.least[start, j - 1] if j else np.zeros(len(start), np.int64)
        whole = np.flatnonzero(valid & ~going)
        if len(whole):
            sha = np.full(len(whole), _NO_ENDS, object)
            for w in np.flatnonzero(n_ends[whole]):
                a = start[whole[w]]
                part = slice(a, a + length[whole[w]])
                sha[w] = hashlib.sha256(_joined(s.conv_id[part][ended[part]]).encode()).hexdigest()
            out.append(_rows(
                kind=np.zeros(len(whole), np.int32), conv_id=k.least[start, j][whole], depth=depth[whole], parent_conv_id=parent[whole],
                n_convs=length[whole], n_children=children[whole], n_leaves=leaves[whole],
                saved=(total - x[least_row])[whole], ends_sha256=sha,
            ))
        opened = np.flatnonzero(going)
        if len(opened):
            real = ~((j == 0) & (s.band[start[opened]] > 0))  # column 0 of a later band only knows of children
            up = [None] * len(opened)
            if j:
                above, _, above_open, above_keys, _ = k.columns[j - 1]
                at = np.searchsorted(above, start[opened], "right") - 1
                up = [above_keys[a][1:] if above_open[a] else None for a in at]
            own_keys = [keys[i] for i in opened]
            zero = lambda v: np.where(real, v[opened], 0)
            out.append(_rows(
                kind=np.ones(len(opened), np.int32), conv_id=pa.array(s.conv_id[least_row][opened], mask=~real), depth=depth[opened],
                parent_conv_id=pa.array(parent[opened], mask=~(real & (j > 0))), n_convs=zero(length), n_children=closed_children[opened],
                n_leaves=zero(leaves), saved=zero(total), k1=[q[1] for q in own_keys], k2=[q[2] for q in own_keys],
                p1=[u and u[0] for u in up], p2=[u and u[1] for u in up], x=zero(x[least_row]),
            ))
            for i, q in zip(opened, own_keys, strict=True):
                part = slice(start[i], start[i] + length[i])
                ids = s.conv_id[part][ended[part]]
                cut = [ids[a : a + _SEGMENT] for a in range(0, len(ids), _SEGMENT)]
                if cut:
                    out.append(_rows(
                        kind=np.full(len(cut), 2, np.int32), conv_id=[int(c[0]) for c in cut], depth=[q[0]] * len(cut),
                        k1=[q[1]] * len(cut), k2=[q[2]] * len(cut), segment=[_joined(c) for c in cut],
                    ))
    return pa.concat_tables(out)


def _end_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined pieces; rows are in order of node and first id and are read as a stream."""
    now, digest = None, None

    def row():
        cols = [[v] for v in (*now, digest.hexdigest())]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names=["depth", "k1", "k2", "ends_sha256"]
        )

    for b in batches:
        for d, k1, k2, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (d, k1, k2) != now:
                if now is not None:
                    yield row()
                now, digest = (d, k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if now is not None:
        yield row()


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, size) with turns (conv_id, size, depth from 1, digest, chars): a row for each node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    bands = written(_bands(convs, turns))
    n = parts(spark, bands.count(), _SHARD)
    dealt = bands.repartitionByRange(n, "band", "s1", "s2", "ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    bands = written(dealt)
    node = ["depth", "k1", "k2"]
    opened = written(bands.groupBy("shard").applyInArrow(_open_nodes, f"shard long, {_KEY}, least long, longest long"))
    true = opened.groupBy(*node).agg(F.min("least").alias("least"), F.max("longest").alias("longest"))
    back = opened.select("shard", *node).join(true, node).withColumn("kind", F.lit(0))
    back = written(back)
    owned = bands.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_owned, "shard long, conv_id long, own long, leaf long")
    owned = written(owned)
    sums = owned.groupBy("conv_id").agg(F.sum("own").alias("k1"), F.max("leaf").alias("k2"))
    more = owned.select("shard", "conv_id").distinct().join(sums, "conv_id").select(
        "shard", F.lit(0).cast("long").alias("depth"), "k1", "k2", F.col("conv_id").alias("least"),
        F.lit(0).cast("long").alias("longest"), F.lit(1).alias("kind"),
    )
    back = back.unionByName(more)
    rows = written(bands.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_nodes, _NODE))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    partial = rows.where("kind = 1").groupBy(*node).agg(
        F.min(F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "x"))).alias("at"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        *(F.max(c).alias(c) for c in ("parent_conv_id", "p1", "p2")),
    )
    partial = written(partial)
    kids = partial.where("p1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = kids.agg(F.count("*").alias("kids"))
    pieces = rows.where("kind = 2").repartition(*node).sortWithinPartitions(*node, "conv_id").select(*node, "segment")
    ends = pieces.mapInArrow(_end_digests, f"{_KEY}, ends_sha256 string")
    joined = partial.join(kids, node, "left").join(ends, node, "left").select(
        F.col("at.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        (F.col("n_children") + F.coalesce("kids", F.lit(0))).alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("at.x")).alias("saved"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    whole = rows.where("kind = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return whole.select(*out).unionByName(joined).withColumnRenamed("saved", "saved_tokens")


def conversation_trie(rows: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of conversations whose first turns are shared by neighbours (``trie``).

    ``rows`` has conv_id, turn, role, text. Turns go by turn, null first, then by role and text; null roles and texts are empty;
    repeated rows are turns each. Conversation c starts with the first crc32(c) % ``heads`` turns of conversation c - c % every,
    if that is there, in place of as many of its own. Rows without conv_id belong to no conversation and take no part.
    No rows give no nodes, not even a root. Other columns are ignored.
    """
    turns, groups = numbered_turns(rows.select("conv_id", "turn", "role", "text"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    return trie(*shared_heads(turns, groups, every, heads - 1, head))

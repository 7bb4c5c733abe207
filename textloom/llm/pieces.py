"""SentencePiece encoding and decoding with sampled segmentations.

The lattice over a text has an edge for each piece of the vocabulary. Forward filtering sums the weights of all paths to
each place; backward sampling draws the edge into each place, from the end, in proportion to the weight of the paths it ends.
No piece of the vocabulary crosses the border before a run of blanks, so the lattice falls into chunks that are
filtered once in each slice of texts and sampled wherever they occur. Draws come from the row key and the place in the text alone.

Merge vocabularies carry ranks instead of log-probabilities; piece r has the weight (r + shift) ** -power. Characters
without a piece, and the blank mark itself, are spelled in byte pieces, so decoding gives back every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
POWER, SHIFT = 1.0, 100.0


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Trie:
    """The pieces' characters as a hash table from (node, character) to node, looked up for many places at once."""

    def __init__(self, pieces: dict[str, int]):
        step: dict[tuple[int, int], int] = {}
        ends = [-1]
        for piece, ident in pieces.items():
            node = 0
            for c in map(ord, piece):
                node = step.setdefault((node, c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = ident
        self.ends = np.array(ends, np.int32)
        self.bits = max(4, len(step).bit_length() + 2)
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for (node, c), to in step.items():
            key = node << 21 | c
            at = self.slots(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.next[at] = key, to

    def slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def down(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node; -1: none."""
        keys = node.astype(np.int64) << 21 | char
        at = self.slots(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.next[at[hit]]
            on = (held >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


@dataclass(frozen=True)
class Filtered:
    """Filtered chunks: last place of each chunk; a place's rank r has the edges first[r]:first[r + 1].

    An edge has its chance, the place it starts after, and a piece id, or -2 - character for one spelled in bytes.
    """

    end: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    chance: np.ndarray
    start: np.ndarray
    ident: np.ndarray


class Vocabulary:
    """Pieces, byte pieces and weights of a SentencePiece model file."""

    def __init__(self, path: str, power: float = POWER, shift: float = SHIFT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        own = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(own, key=lambda i: (-model.get_score(i), i)))}
        self.ids = {self.pieces[i]: i for i in own}
        self.weight = np.zeros(n)
        self.weight[own] = (np.array([rank[i] for i in own]) + shift) ** -power
        self.byte_weight = (len(own) + shift) ** -power
        self.lift = shift ** (power / 2)
        self.longest = max(map(len, self.ids), default=1)
        self.trie = Trie(self.ids)
        letters = {c for p in self.ids for c in p}
        self.crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self.single_lines = "\n" not in letters
        self.text_of = [bytes([int(p[3:5], 16)]) if i in set(self.bytes.values()) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(self.pieces)]
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def chunks(self, text: str) -> list[str]:
        """The text with a blank mark in front, cut where no piece can cross. An empty chunk is a literal mark."""
        out: list[str] = []
        for k, part in enumerate((" " + text).split(BLANK)):
            if k:
                out.append("")
            part = part.replace(" ", BLANK)
            if self.crossing:
                out += [part] if part else []
            else:
                for line in re.split("(\n)", part) if self.single_lines else [part]:
                    out += self.cut.findall(line)
        return out

    def lattice(self, chunks: list[str]) -> Filtered:
        """Forward filtering of many chunks at once, place after place.

        Places count the characters of all chunks. Weights are scaled by character and each chunk's sums anew every
        ``span`` characters, which changes no chance and keeps them in range.
        """
        codes = np.frombuffer("".join(c or BLANK for c in chunks).encode("utf-32-le", "surrogatepass"), np.int32)
        sizes = np.array([len(c) or 1 for c in chunks])
        end = np.cumsum(sizes)
        n, first_char = len(codes), np.repeat(end - sizes, sizes)
        level = np.arange(n) - first_char
        left = np.repeat(end, sizes) - np.arange(n)
        literal = (end - 1)[[not c for c in chunks]]
        node, at = np.zeros(n, np.int32), np.arange(n)
        at = np.delete(at, literal) if len(literal) else at
        node = node[at]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(self.longest):
            inside = left[at] > k
            at, node = at[inside], node[inside]
            node = self.trie.down(node, codes[at + k])
            inside = node >= 0
            at, node = at[inside], node[inside]
            if not len(at):
                break
            ident = self.trie.ends[node]
            found.append((at[ident >= 0] + k, ident[ident >= 0]))
        span = max(len(found), 1)
        alone = np.ones(n, bool)
        if found:
            alone[found[0][0]] = False
        spelled = np.flatnonzero(alone)  # a character that is no piece is spelled in bytes
        c = codes[spelled]
        cost = self.byte_weight ** (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * self.lift
        edges = [(to, i, self.weight[i] * self.lift ** (k + 1), k) for k, (to, i) in enumerate(found)]
        edges.append((spelled, -2 - c, cost, 0))
        order = np.argsort(level.astype(np.int32), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        count = np.zeros(n, np.int64)
        for to, *_ in edges:
            count[rank[to]] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        cursor = first[:-1].copy()
        weight, start, ident = np.empty(first[-1]), np.empty(first[-1], np.int64), np.empty(first[-1], np.int32)
        for to, i, w, k in reversed(edges):  # a place's longest piece first
            at = cursor[rank[to]]
            cursor[rank[to]] += 1
            weight[at], start[at], ident[at] = w, to - k - 1, i
        total = np.ones(n + 1)  # by place; the last stands for the place before a chunk
        begins = start < first_char[np.repeat(order, count)]
        source = np.where(begins, n, start)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(level))]).tolist()
        for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            part = slice(first[s], first[e])
            paths = weight[part] * total[source[part]]
            sums = np.add.reduceat(paths, first[s:e] - first[s])
            weight[part] = paths / np.repeat(sums, count[s:e])
            here = order[s:e]
            total[here] = sums
            if k and k % span == 0:
                total[here[:, None] - np.arange(span)] /= sums[:, None]
        return Filtered(end - 1, rank, first, weight, start, ident)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """A sampled segmentation (piece ids) of each text, drawn by its 64-bit key."""
        index: dict[str, int] = {}
        per_text = [[index.setdefault(c, len(index)) for c in self.chunks(t)] for t in texts]
        net = self.lattice(list(index))
        begin = np.concatenate([[-1], net.end[:-1]])
        sizes = np.array([len(c) for c in per_text])
        word = np.concatenate([np.asarray(c, np.int64) for c in per_text])
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = mixed(keys[row] + mixed(place.astype(np.uint64)))
        at, root, active = net.end[word], begin[word], np.arange(len(word))
        length = np.zeros(len(word), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            here = net.rank[at[active]]
            edge, last = net.first[here], net.first[here + 1] - 1
            many = np.flatnonzero(edge < last)
            draw = mixed(seed[active[many]] + np.uint64(len(steps)))
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 - net.chance[edge[many]]
            while len(many):  # on to the first edge whose cumulative chance exceeds the draw
                on = (u >= 0) & (edge[many] < last[many])
                many, u = many[on], u[on]
                edge[many] += 1
                u -= net.chance[edge[many]]
            steps.append((active, net.ident[edge]))
            length[active] += 1
            at[active] = net.start[edge]
            active = active[at[active] != root[active]]
        stop = np.cumsum(length)
        out = np.empty(stop[-1], np.int32)
        for k, (who, ids) in enumerate(steps):
            out[stop[who] - 1 - k] = ids
        cut = stop[np.cumsum(sizes) - 1]
        if (out < 0).any():
            out, cut = self.spell(out, cut)
        return np.split(out, cut[:-1])

    def spell(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of the characters -2 - id; ``cut`` follows."""
        where = np.flatnonzero(ids < 0)
        spelled = [[self.bytes[b] for b in chr(-2 - i).encode()] for i in ids[where].tolist()]
        width = np.ones(len(ids), np.int64)
        width[where] = [len(x) for x in spelled]
        stop = np.cumsum(width)
        out = np.repeat(ids, width)
        flat = np.repeat(ids < 0, width)
        out[flat] = [i for x in spelled for i in x]
        return out, stop[cut - 1]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids: bytes together, marks as blanks, without the one mark that encoding put in front."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step: counters in, independent-looking words out."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def vocabulary(path: str, power: float = POWER, shift: float = SHIFT) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path, power, shift)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each."""
    at = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, path: str | None = None,
    power: float = POWER, shift: float = SHIFT, chars: int = 500_000,
) -> DataFrame:
    """The rows with ``ids``: piece ids of one segmentation sampled from the lattice of the text.

    The draw depends on the seed, the key and the text only: repeated rows have the same ids, and reruns agree. Null texts
    have null ids; an empty text has the ids of the blank mark in front. A null key is a key like another. A column named
    ids is replaced. Texts go through in slices of about ``chars`` characters, a longer text on its own.
    """
    path = path or model_path()
    rows = docs.drop("ids").withColumn("_key", F.xxhash64(F.lit(seed), F.col(key)))
    schema = StructType([*rows.drop("_key").schema.fields, StructField("ids", ArrayType(IntegerType()))])
    at_text = rows.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, power, shift)
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for s, e in _slices([len(t or "") for t in texts], chars):
                ids = vocab.sample([t or "" for t in texts[s:e]], keys[s:e])
                ids = pa.array([None if t is None else i for t, i in zip(texts[s:e], ids, strict=True)], pa.list_(pa.int32()))
                part = batch.slice(s, e - s)
                names = [*batch.schema.names[:-1], "ids"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with ``decoded``: the text of the piece ids; null for null. A column named decoded is replaced."""
    path = path or model_path()
    rows = rows.drop("decoded")
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(x.as_py()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)

"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Unit vectors x are quantised to x = s q + e with int8 q. Then x . y = s_x s_y (q_x . q_y) + s_x q_x . e_y + e_x . y, and the
last two terms are at most (1 + |e_x|) |e_y| + |e_x|. Tile products of q are exact integers; pairs whose product plus bound
stays below the threshold can't be links, the others are computed again from the full vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components, star
from textloom.llm.store import written

TILE = 2048
_SLACK = 1e-9  # over the rounding of the double operations in the bound
_EXACT = (1 << 24) // 127**2  # dimensions whose int8 products add up exactly in 32-bit floats


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the rows of ``x``, taken as unit vectors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1)


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; in slices of dimensions that cannot overflow a float's 24 bits."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT):
        out += a[:, at : at + _EXACT].astype(np.float32) @ b[:, at : at + _EXACT].astype(np.float32).T
    return out


def tile_links(one: dict, two: dict, threshold: float, same: bool, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold between the vectors of two tiles; ``same``: each pair once."""
    left, right = [], []
    for at in range(0, len(one["x"]), rows):
        part = slice(at, at + rows)
        near = int_products(one["q"][part], two["q"]) * one["scale"][part, None] * two["scale"]
        bound = one["error"][part, None] + (1 + one["error"][part, None]) * two["error"]
        i, j = np.nonzero(near + bound + _SLACK >= threshold)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            cos = np.einsum("nd,nd->n", one["x"][part][a], two["x"][b]) / (one["norm"][part][a] * two["norm"][b])
            keep = cos >= threshold
            left.append(a[keep] + at)
            right.append(b[keep])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _packed(rows: pd.DataFrame) -> dict:
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # exact, so that squares neither overflow nor vanish
    q, scale, error = quantise(x)
    return {
        "id": rows["id"].to_numpy(np.int64).tobytes(), "n": rows["n"].to_numpy(np.int64).tobytes(), "x": x.tobytes(),
        "q": q.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(),
    }


def _unpacked(row) -> dict:
    ids = np.frombuffer(row["id"], np.int64)
    x = np.frombuffer(row["x"]).reshape(len(ids), -1)
    return {
        "id": ids, "n": np.frombuffer(row["n"], np.int64), "x": x, "norm": np.sqrt(np.einsum("nd,nd->n", x, x)),
        "q": np.frombuffer(row["q"], np.int8).reshape(x.shape), "scale": np.frombuffer(row["scale"]),
        "error": np.frombuffer(row["error"]),
    }


def _pair(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile")
        one, two = _unpacked(rows.iloc[0]), _unpacked(rows.iloc[-1])
        same = len(rows) == 1
        i, j = tile_links(one, two, threshold, same)
        count = [np.bincount(i, two["n"][j], len(one["id"])), np.bincount(j, one["n"][i], len(two["id"]))]
        ids, counts = np.concatenate([one["id"], two["id"]]), np.concatenate(count)
        u, v = star(one["id"][i], two["id"][j])
        some = counts > 0
        return pd.concat([
            pd.DataFrame({"u": ids[some], "v": -1, "links": counts[some].astype(np.int64)}),
            pd.DataFrame({"u": u, "v": v, "links": 0}),
        ])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and they have the same number of components. Null,
    zero and empty vectors and those with null or non-finite components link with nothing. Equal vectors of a label are
    one class: they are links of each other, and only the class meets the others. Repeated rows count as that many vectors.
    Other vectors under one vec_id share that id's links and component. Rows without vec_id link with nothing.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("_x", lambda v: v != 0)
    )
    all_rows = vectors.select("vec_id", "label", "embedding", x.alias("_x")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    # adding zero makes -0.0 and 0.0 one vector
    all_rows = all_rows.withColumn("v", F.when(F.col("ok"), F.transform("_x", lambda v: v + F.lit(0.0))))
    all_rows = written(all_rows.select("vec_id", "label", "ok", "v"))
    good = all_rows.where("ok")
    classes = good.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("d", F.size("v")))
    wide = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    tiled = classes.join(wide, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")))
    kind = dict(classes.dtypes)["label"]
    head = f"label {kind}, d int, tile long, tiles long"
    body = "id binary, n binary, x binary, q binary, scale binary, error binary"

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        label, d, at, tiles = key
        return pd.DataFrame([{"label": label, "d": d, "tile": at, "tiles": tiles, **_packed(rows)}])

    packed = written(
        tiled.select("label", "d", "tile", "tiles", "id", "n", "v")
        .groupBy("label", "d", "tile", "tiles").applyInPandas(pack, f"{head}, {body}")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    meet = packed.withColumn("other", other).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    found = written(meet.groupBy("label", "d", "lo", "hi").applyInPandas(_pair(threshold), "u long, v long, links long"))
    groups = components(found.where("links = 0").select("u", "v"))
    links = found.where("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.join(links, classes["id"] == links["u"], "left").drop("u")
    named = named.join(groups, named["id"] == groups["node"], "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    joined = all_rows.join(named, ["label", "v"], "left")
    group = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
        F.coalesce(group == F.col("vec_id"), F.lit(False)).alias("kept"),
    )

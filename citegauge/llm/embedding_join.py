"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c have squared distance 2 - 2c, which a rotation keeps. Over blocks of the rotated coordinates the
squared distances add up, so at least one block has its share of the budget, in proportion to its coordinates. Each
block is range-joined: the signs of its first coordinates name a cell, and two vectors within the budget that lie in
different cells have crossed zero in some of those coordinates. There the distance is |x| + |y|, so one of the two has
at most half the budget in the squares of the crossed coordinates: each vector is also a guest of every cell that it can
reach so. Found pairs are verified with the whole vectors in double precision, and counted once, in the first block that
has its share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import linked_rows
from .tiles import by_tile, fixed, least_labels, own_part, tiled

COSINE, BLOCKS, SEED = 0.9, 4, 29
#: Rows at home in a cell, about, and in a tile of 64 dimensions. Each bit of a cell has less to compare and more guests to send
#: (36 rows a vector at 4 bits, 240 at 8), so cells are as large as a task holds.
CELL_ROWS, TILE_ROWS, MOST_BITS = 131_072, 131_072, 16
#: Guests of a tile that are compared at once.
GUESTS = 16_384


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def edges(d: int, blocks: int = BLOCKS) -> list[int]:
    m = max(1, min(blocks, d))
    return [d * k // m for k in range(m + 1)]


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes_of(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, node, dim, payload): payload the components as doubles, node a digest of them; null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            node, dim, payload = [], [], []
            for v in batch.column("embedding"):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raw = None if x is None else (x + 0.0).tobytes()
                node.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
                dim.append(None if x is None else len(x))
                payload.append(raw and _narrow(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(node, pa.binary()), pa.array(dim, pa.int32()), pa.array(payload, pa.binary())], names=["vec_id", "node", "dim", "payload"])

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, node binary, dim int, payload binary")


def _narrow(x: np.ndarray) -> bytes:
    """Components that are exact as 32-bit floats are kept so; the length tells which."""
    small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def vectors(payload, dim: int) -> np.ndarray:
    """Rows as doubles, each scaled by a power of two to components below 1: cosines keep every bit and nothing over- or underflows."""
    width = pa.compute.unique(pa.compute.binary_length(payload)).to_pylist()
    if len(width) == 1:
        x = fixed(payload, np.float32 if width[0] == 4 * dim else np.float64, dim).astype(np.float64)
    else:
        x = np.array([np.frombuffer(p, np.float32 if len(p) == 4 * dim else np.float64) for p in payload.to_pylist()], np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def cell_bits(n: int) -> int:
    """Bits of a cell for n vectors."""
    return int(min(MOST_BITS, max(0, np.ceil(np.log2(max(n, 1) / CELL_ROWS)))))


def cells(nodes: DataFrame, bits: int, cosine: float, blocks: int = BLOCKS) -> DataFrame:
    """nodes + block, cell, home, guest: a row for the cell of each block and for each cell that can be reached."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                for at in range(0, own.num_rows, 512):
                    part = own.slice(at, 512)
                    y = units(vectors(part.column("payload"), d)) @ rotation(d)
                    cut = edges(d, blocks)
                    for b in range(len(cut) - 1):
                        q = min(bits, cut[b + 1] - cut[b])
                        head = y[:, cut[b] : cut[b] + q]
                        home = ((head > 0) << np.arange(q)).sum(axis=1).astype(np.int64)
                        subset = (np.arange(1 << q)[:, None] >> np.arange(q)) & 1
                        half = (1 - cosine) * (cut[b + 1] - cut[b]) / d  # half of this block's share of 2 - 2 cosine
                        row, s = np.nonzero((head * head) @ subset.T <= half * (1 + 1e-9) + 1e-12)
                        take = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.full(len(row), b, np.int32)), pa.array(home[row] ^ s), pa.array(home[row]), pa.array(s > 0)], names=[*take.schema.names, "block", "cell", "home", "guest"])

    return nodes.select("node", "weight", "dim", "payload").mapInArrow(run, "node binary, weight long, dim int, payload binary, block int, cell long, home long, guest boolean")


def joined(placed: DataFrame, bits: int, cosine: float, blocks: int = BLOCKS) -> DataFrame:
    """(node, other, links) of the pairs that each tile of a cell holds and that count there."""

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        cols = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "dim", "block", "cell", "home", "guest", "part", "left", "right", "parts")}
        own = own_part(cols["part"], cols["left"], cols["right"], cols["parts"])
        other, links = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64)
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if z - a < 2:
                continue
            c = {k: v[a:z] for k, v in cols.items()}
            i, j = _pairs(t.column("payload").slice(a, z - a), c, own[a:z], bits, cosine, blocks)
            np.add.at(links, a + i, c["weight"][j])
            np.add.at(links, a + j, c["weight"][i])
            other[a:z] = a + least_labels(z - a, i, j)
        some = np.flatnonzero(links)
        node = t.column("node").combine_chunks()
        return pa.table({"node": node.take(pa.array(some)), "other": node.take(pa.array(other[some])), "links": pa.array(links[some])})

    homes = written(placed.where("not guest").groupBy("dim", "block", "cell").agg(F.count("*").alias("homes")), "cells")  # few, so the rows stay where they are
    known = placed.join(homes, ["dim", "block", "cell"])  # a cell without homes has no pair that counts
    rows = tiled(known, ["dim", "block", "cell"], "node", F.greatest(F.lit(1024), F.lit(TILE_ROWS * 64) / F.col("dim")), n="homes", guest="guest")
    return by_tile(rows.drop("homes"), run, "node binary, other binary, links long")


def _pairs(payload: pa.ChunkedArray, c: dict, own: np.ndarray, bits: int, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the linked pairs that count in this tile; i is at home in the cell. Guests are taken some at a time."""
    d, b = int(c["dim"][0]), int(c["block"][0])
    cut = edges(d, blocks)
    widths = np.diff(cut)
    budget = (2 - 2 * cosine) * widths / d
    turn = rotation(d)
    q = min(bits, int(widths[b]))

    def side(at: np.ndarray) -> tuple:
        raw = vectors(payload.take(pa.array(at)), d)
        y = units(raw) @ turn
        mine = y[:, cut[b] : cut[b + 1]].astype(np.float32)
        half = -0.5 * (mine * mine).sum(axis=1, keepdims=True)
        return raw, np.sqrt((raw * raw).sum(axis=1)), y, mine, half

    hosts, guests = np.flatnonzero(~c["guest"]), np.flatnonzero(c["guest"])
    if not len(hosts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, norms, y, mine, half = side(hosts)
    left = np.hstack([mine, half, np.ones_like(half)])
    got_i, got_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in (-1, *range(0, len(guests), GUESTS)):
        # first the hosts among themselves, then with guests
        at = hosts if n < 0 else guests[n : n + GUESTS]
        raw_j, norms_j, y_j, mine_j, half_j = (raw, norms, y, mine, half) if n < 0 else side(at)
        right = np.hstack([mine_j, np.ones_like(half_j), half_j]).T.copy()
        for k in range(0, len(hosts), 256):
            start = k if n < 0 else 0  # of hosts the later ones
            near = np.flatnonzero((left[k : k + 256] @ right[:, start:]) >= -0.5 * budget[b] - 2e-6)
            if not len(near):
                continue
            row, jj = np.divmod(near, len(at) - start)
            ii, jj = k + row, start + jj
            i, j = hosts[ii], at[jj]
            # which pairs this tile has: guests meet the parts at home here, other pairs once
            keep = own[i] if n >= 0 else (i < j) & np.where(c["part"][i] == c["part"][j], own[i], True)
            ii, jj = ii[keep], jj[keep]
            for m in range(0, len(ii), 50_000):
                u, v = ii[m : m + 50_000], jj[m : m + 50_000]
                ok = (raw[u] * raw_j[v]).sum(axis=1) / (norms[u] * norms_j[v]) >= cosine
                u, v = u[ok], v[ok]
                i, j = hosts[u], at[v]
                gap = (y[u] - y_j[v]) ** 2
                share = np.stack([gap[:, cut[w] : cut[w + 1]].sum(axis=1) - budget[w] for w in range(len(widths))], axis=1)
                first = np.where((share <= 0).any(axis=1), (share <= 0).argmax(axis=1), share.argmin(axis=1))
                head, head_j = y[u, cut[b] : cut[b] + q], y_j[v, cut[b] : cut[b] + q]
                crossed = (head > 0) != (head_j > 0)
                reach = (head**2 * crossed).sum(axis=1) <= 0.5 * budget[b] * (1 + 1e-9) + 1e-12
                count = (first == b) & (~c["guest"][j] | ~reach | (c["cell"][i] < c["home"][j]))
                got_i.append(i[count])
                got_j.append(j[count])
    return np.concatenate(got_i), np.concatenate(got_j)


def embedding_join(rows: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, class_id, n_links, component_id, kept.

    Links are pairs with cosine >= `cosine` in double precision among vectors of one dimension. Null, empty and zero
    vectors and those with null or non-finite components link with nothing. Equal vectors are one class, joined once
    and counted in full, so a vector of any frequency is a single node. Repeated ids stay rows of their own; component_id
    is the smallest vec_id reachable. Other columns are ignored.
    """
    made = written(nodes_of(rows, vec_id, embedding), "vectors")
    classes = written(made.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("payload").alias("payload")), "classes")
    bits = cell_bits(classes.count())
    found = joined(cells(classes, bits, cosine, blocks), bits, cosine, blocks)
    out = linked_rows(made.select("vec_id", "node"), classes, found, "vec_id")
    return out.select("vec_id", "class_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
pairs AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT a, b FROM pairs UNION SELECT reach.x, pairs.b FROM reach JOIN pairs ON reach.y = pairs.a),
c AS (SELECT x, least(min(x), min(y)) AS component_id FROM reach GROUP BY x),
k AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

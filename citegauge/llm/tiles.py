"""All pairs within groups of any size, cut into tiles: no task holds more than two parts of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, text_bytes


def tiled(rows: DataFrame, group: list[str], node: str, most: int, n: str | None = None, guest: str | None = None, total: int | None = None) -> DataFrame:
    """rows + part, left, right, parts, tile: a group of more than `most` rows is dealt into parts by a hash of `node`,
    and every two parts meet in one tile. A row goes to parts - 1 tiles. Guests (rows where `guest` is true) don't count
    and meet each part in the tile where that part also meets itself. `n` names a column with the group's rows, if known;
    `total` is the count of rows, if known: very large groups are then told their count by broadcast.
    """
    if n is None:
        host = F.lit(True) if guest is None else ~F.col(guest)
        n = "__n__"
        counts = rows.where(host).groupBy(*group).agg(F.count("*").alias(n))
        rows = rows.join(counts, group) if total is None else spread_join(rows, counts, group, n, total)
    parts = F.ceil(F.col(n) / most).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("left"), F.greatest(a, b).alias("right"))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")), lambda j: pair(F.col("part"), j))
    own = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: pair(j, (j + 1) % F.col("parts"))))
    spread = others if guest is None else F.when(F.col(guest), own).otherwise(others)
    at = F.when(F.col("parts") == 1, F.array(pair(F.lit(0), F.lit(0)))).otherwise(spread)
    out = rows.withColumn("at", F.explode(at)).withColumn("left", F.col("at.left")).withColumn("right", F.col("at.right")).drop("at")
    return out.withColumn("tile", F.xxhash64(*group, "left", "right"))


def own_part(part: np.ndarray, left: np.ndarray, right: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Whether the tile is the one where the row's part meets itself."""
    return (parts == 1) | ((part == left) & ((left + 1) % parts == right)) | ((part == right) & ((right + 1) % parts == left))


def by_tile(rows: DataFrame, fn, schema: str, most: int = 4096) -> DataFrame:
    """fn(table, starts) over whole tiles, several at once: starts are the first rows of each, and the count of rows."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("tile").to_numpy()
            last = int(np.searchsorted(key, key[-1], side="left"))  # sorted: the last tile may go on
            if last:
                yield from done(t.slice(0, last))
            rest = t.slice(last)
            held, size = rest.to_batches(), 0 if last else size
            size = rest.num_rows if last == 0 else 0
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    def done(t: pa.Table):
        key = t.column("tile").to_numpy()
        starts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        yield from fn(t, starts).to_batches()

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def fixed(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """A binary column whose values all have `width` items of `kind`, as rows."""
    data, _ = text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, width)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row hangs together with by pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new

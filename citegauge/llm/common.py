"""Helpers shared by the training-data operators: tables, shared storage, blocks of texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcasts go ahead only below this many rows, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
# Keys with more than the MOST_HOT-th part of all rows, and HOT_ROWS at least, are joined apart from the others.
MOST_HOT, HOT_ROWS = 10_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and the master is local (tests) a local one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="citegauge-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts `right` only if its counted rows are few; else both sides shuffle."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], many: str, n: int, how: str = "inner") -> DataFrame:
    """rows joined with per_key, which has one row per key and in `many` the rows of that key; n is the count of rows.

    Hot keys are joined by broadcast: fewer than MOST_HOT keys can have more than n / MOST_HOT rows, whatever the data.
    The other keys shuffle, and none of them is more than that part of all rows.
    """
    bar = max(HOT_ROWS, n // MOST_HOT)
    if n <= bar:
        return rows.join(per_key, on, how)
    hot = F.broadcast(per_key.where(F.col(many) > bar))
    cold = rows.join(hot, on, "left_anti").join(per_key.where(F.col(many) <= bar), on, how)
    return rows.join(hot, on).unionByName(cold)


def spare(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def learn_row(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32(doc_id as text) mod 3 is not 1; the rest is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def fresh(df: DataFrame, *names: str) -> None:
    """Refuses input columns that clash with columns an operator adds beside them."""
    clash = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if clash:
        raise ValueError(f"input already has columns {clash}; choose other output names")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """The batch cut between rows into pieces of about `most` bytes of `column` and 4096 rows at most."""
    col = batch.column(column)
    sizes = np.cumsum(np.diff(text_bytes(col)[1])) if len(col) else np.zeros(0, np.int64)
    at = 0
    while at < len(col):
        before = sizes[at - 1] if at else 0
        end = int(np.searchsorted(sizes, before + most, side="right"))
        end = min(max(end, at + 1), at + 4096, len(col))
        yield batch.slice(at, end - at)
        at = end


def table_of(bytes_in) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(bytes(bytes_in), np.uint8)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = table_of([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, start, end) of each word [0-9a-z or >= U+0080]+ of lower-cased (A-Z) texts."""
    low = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IN_WORD[low]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    # a text ends the word before it
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    opens[cut] = inside[cut]
    closes = inside[:-1] & (~inside[1:] | opens[1:])
    starts, ends = np.flatnonzero(opens[:-1]), np.flatnonzero(closes) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, doc, starts, ends

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import fresh, learn_row, slices, sized_join, table, text_bytes, words

TRAIN_ROWS = 8_000  # labelled rows drawn at most (about), the bound of the fit
WORD_BITS, RANK, BINS = 14, 8, 16
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 900, 128, 0.15, 1e-5  # as many epochs as give STEPS batches, EPOCHS at least
SEED = 17

#: Classes of bytes whose shares in a text are its structure.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"()-", b"#$%&*+<=>@[\\]^_`{|}~/", b"!", bytes(range(128, 256))]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_chars, np.uint8)] = _k
STATS = len(CLASSES) + 4


def statistics(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """texts x STATS: shares of the byte classes, log length, mean word length, words a line, share of distinct words."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = len(CLASSES) + 1
    of = np.repeat(np.arange(n, dtype=np.int32) * kinds, size)
    counts = np.bincount(of + CLASS_OF[data], minlength=n * kinds).reshape(n, kinds)
    some = np.maximum(size, 1)
    n_words = np.bincount(doc, minlength=n)
    out = np.empty((n, STATS), np.float32)
    out[:, : kinds - 1] = counts[:, : kinds - 1] / some[:, None]
    out[:, kinds - 1] = np.log1p(size)
    out[:, kinds] = np.bincount(doc, ends - starts, n) / np.maximum(n_words, 1)
    out[:, kinds + 1] = n_words / (counts[:, 3] + 1)
    out[:, kinds + 2] = distinct / np.maximum(n_words, 1)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the hashed words, sorted by text, values of length 1 per text; and the statistics."""
    hashes, doc, starts, ends = words(data, offsets)
    n = len(offsets) - 1
    key = (doc.astype(np.int64) << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(key)]).astype(np.float32)
    row, bucket = (key[first] >> WORD_BITS).astype(np.int64), (key[first] & ((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = (value / np.maximum(norm, 1e-9)[row]).astype(np.float32)
    return row, bucket, value, statistics(data, offsets, doc, starts, ends, np.bincount(row, minlength=n))


class Machine:
    """score = logistic(w0 + sum w_i x_i + (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2): linear in the features of a text."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # numbers x (BINS - 1): where a statistic or metadata column goes to the next bin
        self.words = 1 << WORD_BITS
        size = self.words + edges.shape[0] * BINS
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (size, RANK)).astype(np.float32)

    def with_numbers(self, n: int, row, bucket, value, numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features as (row, feature, value) sorted by row: the words and one bin of each number."""
        cols = numbers.shape[1]
        bins = np.stack([np.searchsorted(self.edges[c], numbers[:, c], side="right") for c in range(cols)], axis=1) if cols else np.zeros((n, 0), int)
        more = self.words + np.arange(cols)[None, :] * BINS + bins
        rows = np.concatenate([row, np.repeat(np.arange(n), cols)])
        order = np.argsort(rows, kind="stable")
        values = np.concatenate([value, np.full(n * cols, 0.5, np.float32)])
        return rows[order], np.concatenate([bucket, more.ravel()])[order], values[order]

    def raw(self, n: int, rows, feature, value):
        """(logit, sum of v x): the sum-of-squares identity."""
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.v[feature] * value[:, None]
        if len(rows):
            s = np.add.reduceat(np.r_[vx, np.zeros((1, RANK), np.float32)], starts, axis=0)
            s[np.bincount(rows, minlength=n) == 0] = 0
        else:
            s = np.zeros((n, RANK), np.float32)
        squares = np.bincount(rows, (vx * vx).sum(axis=1), n)
        return self.w0 + np.bincount(rows, self.w[feature] * value, n) + 0.5 * ((s * s).sum(axis=1) - squares), s, vx

    def score(self, n: int, row, bucket, value, numbers) -> np.ndarray:
        logit = self.raw(n, *self.with_numbers(n, row, bucket, value, numbers))[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def fit(self, rows, feature, value, labels: np.ndarray) -> None:
        """AdaGrad on the logistic loss, in an order drawn from a fixed seed."""
        n = len(labels)
        at = np.searchsorted(rows, np.arange(n + 1))
        rng = np.random.default_rng(SEED)
        g0, gw, gv = 1.0, np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32)
        self.w0 = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(n, 1)) if n > BATCH else EPOCHS * 10)):
            order = rng.permutation(n)
            for k in range(0, n, BATCH):
                some = order[k : k + BATCH]
                sizes = at[some + 1] - at[some]
                take = np.repeat(at[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                r, f, x = np.repeat(np.arange(len(some)), sizes), feature[take], value[take]
                logit, s, vx = self.raw(len(some), r, f, x)
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) / len(some)
                used, back = np.unique(f, return_inverse=True)
                dx = (d[r] * x).astype(np.float32)
                dw = np.bincount(back, dx, len(used)).astype(np.float32) + DECAY * self.w[used]
                each = dx[:, None] * (s[r] - vx)
                order_f = np.argsort(back, kind="stable")
                dv = np.add.reduceat(each[order_f], np.searchsorted(back[order_f], np.arange(len(used))), axis=0) + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(d.sum()) ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.w0 -= RATE * float(d.sum()) / np.sqrt(g0)


def _numbers(batch: pa.RecordBatch, stats: np.ndarray, metadata: list[str]) -> np.ndarray:
    """Statistics beside the metadata columns as log(1 + x); nulls and negatives are 0."""
    more = [np.log1p(np.maximum(np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)), 0)) for c in metadata]
    return np.column_stack([stats, *more]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, metadata: tuple[str, ...] = ("n_chars",), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Learns from at most about `most` labelled learnable rows, drawn by a hash of the id among all of them.

    Features are made on the executors; the driver gets those of the drawn rows and the count of labelled rows.
    Labels that are null are ignored; a document labelled twice is learnt twice.
    """
    marked = labels.where(learn_row(F.col(doc_id)) & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id__"), F.col(label).cast("int").alias("__label__"))
    n = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64(F.col("__id__"), F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1))) + 1)
    meta = list(metadata)
    rows = sized_join(docs.select(F.col(doc_id).alias("__id__"), F.coalesce(text, F.lit("")).alias("text"), *meta), drawn, "__id__")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                row, bucket, value, stats = features(*text_bytes(part.column("text")))
                numbers = _numbers(part, stats, meta)
                at = np.searchsorted(row, np.arange(n + 1))
                blob = lambda a, t: pa.array([a[at[k] : at[k + 1]].astype(t).tobytes() for k in range(n)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id__").cast(pa.int64()), part.column("__label__"), blob(bucket, "<u2"), blob(value, "<f4"), pa.array([x.tobytes() for x in numbers], pa.binary())], names=["id", "label", "bucket", "value", "numbers"]
                )

    got = rows.mapInArrow(run, "id long, label int, bucket binary, value binary, numbers binary").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda k: (got["id"][k], got["label"][k], got["bucket"][k]))
    cols = STATS + len(meta)
    numbers = np.array([np.frombuffer(got["numbers"][k], np.float32) for k in order], np.float32).reshape(-1, cols)
    edges = np.quantile(numbers, np.arange(1, BINS) / BINS, axis=0).T.copy() if len(order) else np.zeros((cols, BINS - 1))
    machine = Machine(edges.astype(np.float32))
    if order:
        sizes = [len(got["bucket"][k]) // 2 for k in order]
        words_of = np.concatenate([np.frombuffer(got["bucket"][k], "<u2") for k in order]).astype(np.int64)
        values = np.concatenate([np.frombuffer(got["value"][k], "<f4") for k in order])
        made = machine.with_numbers(len(order), np.repeat(np.arange(len(order)), sizes), words_of, values, numbers)
        machine.fit(*made, np.array([got["label"][k] for k in order], np.float32))
    return machine


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ("n_chars",), text: str = "text", score_out: str = "score", predicted_out: str = "predicted") -> DataFrame:
    """docs + score (0 to 1), predicted (1 from 0.5 on): whole texts, one narrow pass without shuffle.

    Null texts are empty, empty ones get the score of their statistics, as any text does; null metadata is 0. Rows and
    other columns stay as they are. Without labels every score is 0.5 or near it.
    """
    fresh(docs, score_out, predicted_out)
    names, meta = docs.columns, list(metadata)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by WORD_BITS and RANK
    schema = StructType([*docs.schema.fields, StructField(score_out, DoubleType()), StructField(predicted_out, IntegerType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                row, bucket, value, stats = features(*text_bytes(part.column(text)))
                s = held.value.score(part.num_rows, row, bucket, value, _numbers(part, stats, meta))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*names, score_out, predicted_out])

    return docs.mapInArrow(run, schema)


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text", "n_chars"), machine)
    return out.select("doc_id", (~learn_row(F.col("doc_id"))).alias("held_out"), "score", "predicted")

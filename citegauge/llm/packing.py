"""Best-fit packing of documents into sequences of tokens by large-item matching, planned on the histogram of lengths.

Pieces longer than a third of a sequence go two to a sequence at most: each takes the longest partner that still
fits. Shorter ones, longest first, go where they leave the least room. Lengths are whole numbers up to the capacity,
so the plan is made on how many pieces have each length: it is the same for a thousand and for a billion pieces, has
at most some thousand runs, and each piece finds its place in it by its rank among those of its length.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, slices, table, written

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"
RANK_ROWS = 256  # pieces of one length are ranked in groups of so many or, if there are more groups than that, the root of their count


def encoder(vocabulary: str = VOCABULARY):
    """text -> uint32 ids of the byte-level BPE file, as its library gives them without a post-processor's tokens.

    The ranks file holds the vocabulary of the JSON file; its library gives the same ids in a fraction of the time.
    The JSON file's added tokens, where a text spells them, are one id each.
    """
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(encoding.encode(text, allowed_special="all"), np.uint32)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than a sequence are cut; the first piece is the shorter one.

    Null texts are empty: their only token is the end id. Repeated rows and null ids give pieces each.
    """

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, out = part.column("doc_id"), ([], [], [], [], [])
                for k, t in enumerate(part.column("text").to_pylist()):
                    tokens = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                    first = len(tokens) % capacity or capacity
                    cuts = [0, *range(first, len(tokens) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (k, n, a, b - a, zlib.crc32(tokens[a:b].tobytes())), strict=True):
                            column.append(value)
                columns = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, sequences). A run (length, first rank, last rank + 1, sequence, offset, each) puts the pieces of a length with
    those ranks, `each` to a sequence, side by side from offset, into consecutive sequences from that one."""
    left = {n: c for n, c in sorted(counts.items()) if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, how many)]
    sequences = 0

    def place(n: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        runs.append((n, used[n], used[n] + count, sequence, offset, each))
        used[n] += count
        left[n] -= count

    large = [n for n in left if 3 * n > capacity]
    # greedy matching, longest first: the longest other large piece that fits, if any
    for n in sorted(large, reverse=True):
        while left[n]:
            mate = next((m for m in reversed(large) if left[m] and m <= capacity - n and (m != n or left[n] > 1)), None)
            if mate is None:
                count = left[n]
                place(n, count, sequences, 0)
                room = capacity - n
            elif mate == n:
                count = left[n] // 2
                place(n, count, sequences, 0)
                place(n, count, sequences, n)
                room = capacity - 2 * n
            else:
                count = min(left[n], left[mate])
                place(n, count, sequences, 0)
                place(mate, count, sequences, n)
                room = capacity - n - mate
            rooms.setdefault(room, []).append((sequences, count))
            sequences += count
    # best fit, longest first
    heap: list[int] = []
    for n in sorted((n for n in left if left[n]), reverse=True):
        heap = sorted(r for r, parts in rooms.items() if r >= n and parts)
        while left[n]:
            if not heap:
                each = min(capacity // n, left[n])
                count = left[n] // each
                rooms.setdefault(capacity, []).append((sequences, count))
                sequences += count
                heappush(heap, capacity)
                continue
            room = heap[0]
            if not rooms.get(room):
                heappop(heap)
                continue
            first, many = rooms[room].pop()
            each = min(room // n, left[n])
            count = min(many, left[n] // each)
            place(n, count * each, first, capacity - room, each)
            if many > count:
                rooms[room].append((first + count, many - count))
            rest = room - each * n
            if rest:
                rooms.setdefault(rest, []).append((first, count))
                if rest >= n:
                    heappush(heap, rest)
    return runs, sequences


def ranked(cut: DataFrame, counts: dict[int, int], rows: int = RANK_ROWS) -> DataFrame:
    """cut + rank, from 0 among the pieces of its length, ranked in as many buckets as its count asks for: no length is one group."""
    many = cut.sparkSession.createDataFrame([(n, -(-c // max(rows, math.isqrt(c)))) for n, c in counts.items()], "length long, __buckets__ long")
    salted = cut.join(F.broadcast(many), "length")  # one row per length
    salted = salted.withColumn("__bucket__", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__buckets__")))
    counted = salted.groupBy("length", "__bucket__").count()
    before = W.partitionBy("length").orderBy("__bucket__").rowsBetween(W.unboundedPreceding, -1)
    base = counted.select("length", "__bucket__", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base__"))
    at = F.row_number().over(W.partitionBy("length", "__bucket__").orderBy("doc_id", "piece", "ids_crc32"))
    placed = salted.withColumn("__at__", at).join(base, ["length", "__bucket__"]).withColumn("__rank__", F.col("__base__") + F.col("__at__") - 1)
    # equal rows may swap ranks when a task is run again; written out, each keeps its own
    return written(placed.select(*cut.columns, "__rank__"), "ranked")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with a length of 1 to capacity) + sequence_id, offset. Empty tables stay empty.

    Pieces of one length are alike to the plan; among them the smaller doc_id and piece come first within a bucket, and
    equal rows in any order. Other columns go along. The driver holds one count per length and the plan's runs; both are
    bounded by the capacity.
    """
    fresh(cut, "sequence_id", "offset", "__rank__", "__bucket__", "__buckets__", "__base__", "__at__")
    cut = written(cut, "pieces")  # read twice: the texts are tokenised once
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    rows = ranked(cut, counts)
    runs, _ = plan(counts, capacity)
    runs.sort()
    made = np.array(runs, np.int64).reshape(-1, 6)
    held = rows.sparkSession.sparkContext.broadcast(made)
    names = [c for c in rows.columns if c != "__rank__"]
    schema = rows.drop("__rank__").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        made = held.value
        keys = made[:, 0] * (1 << 44) + made[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank__"))
            at = made[np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            sequence, offset = at[:, 3] + k // at[:, 5], at[:, 4] + k % at[:, 5] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))

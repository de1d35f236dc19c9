"""Alignment of two tokenizers over the same bytes.

Each Arrow batch is tokenised both ways and its tokens become two interval tables of an in-memory DuckDB: ASOF joins find the
first and the last token of the other side that a token overlaps, a range join gives all between, and a window sum numbers the
groups, which end where tokens of both sides end. Documents lie one behind the other on one axis of bytes, so intervals of
different documents never meet. Counts of linked pairs are made per document there and merged over the corpus by Spark.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, slices, spread_join, table, written

A, B = "byte_bpe_50k", "piece_bpe_32k"
SLICE = 1 << 20  # bytes of text that are aligned at once; a longer text is a slice of its own

#: Tables a and b: doc, k (place), id, s, e (first byte, byte after the last). All rise together.
#: Ends of links differ: a link ends where the first of its two tokens does. Where both do, so does a group.
LINKS = """CREATE OR REPLACE TEMP TABLE links AS
WITH spans AS (SELECT a.doc, a.k, a.id, a.e, x.k AS first, y.k AS last FROM a ASOF JOIN b x ON a.s < x.e ASOF JOIN b y ON a.e > y.s),
ranges AS (SELECT doc, k AS ak, id AS aid, e, first AS at FROM spans
  UNION ALL SELECT doc, k, id, e, unnest(range(first + 1, last + 1)) FROM spans WHERE last > first),
met AS (SELECT r.doc, ak, aid, b.k AS bk, b.id AS bid, r.e = b.e AS ends, least(r.e, b.e) AS e FROM ranges r JOIN b ON b.k = r.at)
SELECT doc, ak, aid, bk, bid, ends, sum(ends::INT) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - ends::INT AS part FROM met"""
PARTS = "SELECT ak, bk, part::BIGINT AS part FROM links"
TOTALS = "SELECT doc::BIGINT AS doc, count(*)::BIGINT AS n_links, sum(ends::INT)::BIGINT AS n_groups FROM links GROUP BY doc ORDER BY doc"
PAIRS = "SELECT doc::BIGINT AS doc, aid, bid, count(*)::BIGINT AS n FROM links GROUP BY doc, aid, bid ORDER BY doc, aid, bid"


def byte_tokens(vocabulary: str = A):
    """(text -> ids, ids -> bytes, bytes of each id) of a byte-level BPE: the ranks file gives the ids of the JSON file in less time; no added tokens."""
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        known[k] = token
    return lambda text: encoding.encode_ordinary(" " + text), encoding.decode_bytes, known


def piece_tokens(vocabulary: str = B):
    """(text -> ids, ids -> bytes, bytes of each id) of a piece model, which adds the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
    size = model.get_piece_size()
    pieces = map(model.id_to_piece, range(size))
    known = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    return model.encode, lambda ids: b"".join(map(known.__getitem__, ids)), known


class Aligner:
    """Both tokenizers and a database of one thread; one of it a worker process, see `aligner`."""

    def __init__(self) -> None:
        import duckdb

        self.sides = byte_tokens(), piece_tokens()
        self.sizes = [np.array([len(t) for t in known], np.int64) for *_, known in self.sides]
        self.wide = max(map(len, self.sizes))
        self.words = np.array([f"{k}{mark}" for mark in ",|;" for k in range(self.wide)], "S")
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})

    def tokens(self, text: str | None) -> list[list[int]]:
        """Ids of both sides; none if the text has none or its bytes don't come back."""
        if not text:
            return [[], []]
        want, out = (" " + text).encode(), []
        for encode, decode, _ in self.sides:
            ids = encode(text)
            if decode(ids) != want:
                return [[], []]
            out.append(ids)
        return out

    def intervals(self, side: int, ids: list[list[int]]) -> pa.Table:
        many = [len(x) for x in ids]
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(many))
        size = self.sizes[side][flat]
        end = np.cumsum(size)
        columns = {"doc": np.repeat(np.arange(len(ids)), many), "k": np.arange(len(flat)), "id": flat, "s": end - size, "e": end}
        return pa.table({name: c.astype(np.int32) for name, c in columns.items()})  # a text has less than 2^31 bytes

    def written_out(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The groups of each text, `a1,a2|b1;a3|b2,b3`: of each group first the tokens of A, then those of B."""
        ak, bk, part = self.fetch(PARTS)
        of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        of_a[ak], of_b[bk] = part, part  # all links of a token are in one group
        before_a, before_b = (np.append(0, np.cumsum(np.bincount(x))) for x in (of_a, of_b))  # tokens of the groups before each
        at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + before_a[of_b + 1]
        mark_a, mark_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
        word = np.empty(len(a) + len(b), np.int64)
        word[at_a], word[at_b] = a + self.wide * mark_a, b + 2 * self.wide * mark_b
        spelt = self.words[word]
        return [spelt[x:y].tobytes().translate(None, b"\0")[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]

    def fetch(self, sql: str) -> list[np.ndarray]:
        got = self.db.sql(sql).to_arrow_table()
        return [got.column(k).to_numpy() for k in range(got.num_columns)]

    def align(self, texts: list[str | None]) -> dict[str, pa.Array | list | np.ndarray]:
        """Columns n_a, n_b, n_groups, n_links, alignment (`a1,a2|b1;a3|b2,b3`), pairs (id of A, id of B, links) of texts."""
        ids = [self.tokens(t) for t in texts]
        flat, many = [], []
        for side, name in enumerate("ab"):
            at = self.intervals(side, [x[side] for x in ids])
            self.db.register("arrived", at)
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrived")
            self.db.unregister("arrived")
            flat.append(at.column("id").to_numpy().astype(np.int64))
            many.append(np.array([len(x[side]) for x in ids], np.int64))
        self.db.execute(LINKS)
        alignment = self.written_out(*flat, np.append(0, np.cumsum(many[0] + many[1])))
        n_links, n_groups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        doc, links, groups = self.fetch(TOTALS)
        n_links[doc], n_groups[doc] = links, groups
        doc, x, y, n = self.fetch(PAIRS)
        offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])
        return {"n_a": many[0], "n_b": many[1], "n_groups": n_groups, "n_links": n_links, "alignment": alignment, "pairs": pa.ListArray.from_arrays(offsets, pairs)}


@cache
def aligner() -> Aligner:
    return Aligner()


def align(docs: DataFrame, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, alignment, pairs), a row for each of docs; other columns are left behind.

    alignment holds the groups, `a1,a2|b1;a3|b2,b3`, or with `digest` their SHA-256 in hex; it is empty without tokens. Null and
    empty texts, and those of which a tokenizer doesn't give the bytes back, have no tokens: zeros. Repeated rows, null ids and
    empty tables need no care. A text is tokenised whole: memory grows with the longest one, some 60 bytes a byte.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = aligner().align(part.column("text").to_pylist())
                out["alignment"] = [hashlib.sha256(x).hexdigest() if x and digest else x.decode() for x in out["alignment"]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()]], names=["doc_id", *out])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, alignment string, pairs array<struct<a: int, b: int, n: long>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, docs, best): links of each pair of ids over all rows, rows that have it, whether no other A id has more with that B id.

    One row per pair that occurs; the highest counts are one row per id of B, so they are joined by broadcast whatever the corpus.
    """
    counts = written(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("docs")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most the vocabulary of B
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", "docs", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """aligned + n_best, count_sum: links whose pair is the commonest of its B id, ties too, and the sum of the counts of all links.

    Pairs in very many rows are joined by broadcast where the pairs as a whole are too many for it.
    """
    aligned = written(aligned.withColumn("__row__", F.monotonically_increasing_id()), "aligned")  # numbered once, read twice
    counts = written(pair_counts(aligned), "pairs")
    met = aligned.select("__row__", F.inline("pairs"))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = met.join(F.broadcast(counts), ["a", "b"])
    else:
        met = spread_join(met, counts, ["a", "b"], "docs", met.count())
    sums = met.groupBy("__row__").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = aligned.drop("pairs").join(sums, "__row__", "left").drop("__row__")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_counts(align(table(spark, sf_dir, "documents"), digest=True))
    return out.withColumnRenamed("alignment", "groups_sha256").select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed word 5-grams; equal sets are one class. A set's sketch holds the token of least hash under each of
TOKENS seeded permutations: sampled tokens, shared by two sets with the probability of their Jaccard similarity. Each run
splits the sets by one sampled token; buckets of more than SMALL sets are split again by another one, drawn by the path so
far, down to DEPTH or until a split keeps four fifths of a bucket together, as near copies stay; what is left is compared by
brute force over the sketches, large buckets tile by tile. RUNS independent
runs give the target recall. The candidates that hang together are then compared exactly over their whole sets, each two of
a group, so the result has no estimate in it and a pair missed by all runs is still found if other pairs tie its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, sized_join, slices, spread_join, table, text_bytes, words, written
from .components import components, linked_rows
from .tiles import by_tile, fixed, least_labels, own_part, tiled

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # five words, similarity of 4/5 or more
TOKENS, DEPTH, SMALL, TILE_ROWS, EXACT_ROWS = 128, 6, 256, 1024, 256
RECALL = 0.99
#: A pair at the threshold stays together down the longest path with probability 0.8 ** DEPTH in one run.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - (NUMERATOR / DENOMINATOR) ** DEPTH))
#: Sketch coordinates that must agree for an exact comparison: four standard deviations below the threshold.
AGREE = math.floor(TOKENS * NUMERATOR / DENOMINATOR - 4 * math.sqrt(TOKENS * 0.16))
_RNG = np.random.default_rng(41)
FACTORS = (_RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
TERMS = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, 52-bit hash) of the distinct k-grams of words, sorted. A text of fewer than k words, but some, has one: all of them."""
    h, doc, _, _ = words(data, offsets)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    row, made = [], []
    for size in range(1, k + 1):
        if size < k:
            at = first[n_words == size]
        else:
            at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
        if not len(at):
            continue
        g = np.full(len(at), size, np.uint64)
        for j in range(size):
            g = g * np.uint64(0x100000001B3) + h[at + j]
        row.append(doc[at])
        made.append(mix(g))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = (np.concatenate(row).astype(np.uint64) << np.uint64(52)) | (np.concatenate(made) >> np.uint64(12))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def set_digests(row: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(16 bytes as two words, size) of each set, whatever the order of its tokens."""
    size = np.bincount(row, minlength=n)
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        starts = np.searchsorted(row, some)
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            out[some, k] = mix(np.add.reduceat(mix(token * np.uint64(seed) + np.uint64(k + 1)), starts) + size[some].astype(np.uint64))
    return out, size


def sketches(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """texts x TOKENS: least hash under each permutation (0 for empty sets)."""
    out = np.zeros((n, TOKENS), np.uint32)
    some = np.unique(row)
    if len(some):
        starts = np.searchsorted(row, some)
        x = mix(token).astype(np.uint32)
        buffer = np.empty_like(x)
        for k in range(TOKENS):
            np.multiply(x, FACTORS[k], out=buffer)
            buffer += TERMS[k]
            buffer ^= buffer >> np.uint32(15)
            out[some, k] = np.minimum.reduceat(buffer, starts)
    return out


def step(path: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The next node of each path: the path draws a coordinate, the set's token there names the branch."""
    at = (mix(path) % np.uint64(TOKENS)).astype(np.int64)
    return mix(path * np.uint64(31) + sketch[np.arange(len(path)), at].astype(np.uint64) + np.uint64(7))


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32).tobytes()) if width else None, data])


def sketched(docs: DataFrame, doc_id: str, text: str, with_sketch: bool = True) -> DataFrame:
    """(doc_id, text_key, node, size, paths, sketch) of each row. node is null for texts without words.

    paths: the first node of every run; sketch: a byte of each token, for splits and comparisons further down.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                row, token = shingle_sets(*text_bytes(part.column("text")))
                digest, size = set_digests(row, token, n)
                node = pa.compute.if_else(pa.array(size > 0), _binary(digest), pa.scalar(None, pa.binary()))
                cols = [part.column("doc_id"), part.column("text_key"), node, pa.array(size.astype(np.int32))]
                if with_sketch:
                    s = sketches(row, token, n)
                    heads = np.stack([step(np.full(n, r + 1, np.uint64), s) for r in range(RUNS)], axis=1)
                    cols += [_binary(heads), _binary(s.astype(np.uint8))]
                else:
                    at = np.searchsorted(row, np.arange(n + 1))
                    cols.append(pa.array([token[at[k] : at[k + 1]].tobytes() for k in range(n)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f[0] for f in fields])

    fields = [("doc_id", "long"), ("text_key", "long"), ("node", "binary"), ("size", "int"), *([("paths", "binary"), ("sketch", "binary")] if with_sketch else [("tokens", "binary")])]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in fields))


def _heads(classes: DataFrame) -> DataFrame:
    """(path, node): each class at the first node of each run."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                path = fixed(batch.column("paths"), np.int64, RUNS)
                yield pa.RecordBatch.from_arrays([pa.array(path.ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), RUNS)))], names=["path", "node"])

    return classes.select("paths", "node").mapInArrow(run, "path long, node binary")


def _deeper(rows: DataFrame) -> DataFrame:
    """rows with their path one sampled token longer; before: the sets at the node that they leave."""
    rows = rows.withColumnRenamed("n", "before")
    names = ["path", "node", "size", "sketch", "before"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                path = step(batch.column("path").to_numpy().view(np.uint64), fixed(batch.column("sketch"), np.uint8, TOKENS))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(c) for c in names[1:]]], names=names)

    return rows.select(*names).mapInArrow(run, "path long, node binary, size int, sketch binary, before long")


def _counted(rows: DataFrame, total: int) -> DataFrame:
    """rows + n, the sets at their node of the tree; those that are alone there go. A very common token's node is counted by broadcast."""
    n = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    return spread_join(rows, n, ["path"], "n", total)


def candidates(classes: DataFrame) -> DataFrame:
    """(node, other): pairs of sets whose sketches agree, as many of them as tie each bucket's groups together."""
    together = _counted(_heads(classes), classes.count() * RUNS)
    level = written(together.join(classes.select("node", "size", "sketch"), "node"), "paths")
    buckets = level.where(F.col("n") <= SMALL)
    large = level.where(F.col("n") > SMALL)
    for depth in range(2, DEPTH + 1):
        many = large.count()
        if not many:
            break
        level = written(_counted(written(_deeper(large), "deeper"), many), "paths")
        last = F.lit(True) if depth == DEPTH else (F.col("n") <= SMALL) | (DENOMINATOR * F.col("n") >= NUMERATOR * F.col("before"))
        buckets = buckets.unionByName(level.where(last).drop("before"))
        large = level.where(~last).drop("before")
    rows = tiled(buckets.select("path", "node", "size", "sketch", "n"), ["path"], "node", TILE_ROWS, n="n")
    return by_tile(rows.select("tile", "node", "size", "sketch"), _alike, "node binary, other binary").distinct()


def _alike(t: pa.Table, starts: np.ndarray) -> pa.Table:
    sketch, size = fixed(t.column("sketch"), np.uint8, TOKENS), t.column("size").to_numpy().astype(np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    many = np.diff(starts)
    todo: list[tuple[np.ndarray, np.ndarray]] = []
    for m in np.unique(many).tolist():  # groups of one size at a time, all their pairs at once
        if m < 2:
            continue
        i, j = np.triu_indices(m, 1)
        first = starts[:-1][many == m]
        each = max(1, 200_000 // len(i))
        for k in range(0, len(first), each):
            f = first[k : k + each, None]
            todo.append(((f + i).ravel(), (f + j).ravel()))
    for i, j in todo:
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            like = DENOMINATOR * np.minimum(size[p], size[q]) >= NUMERATOR * np.maximum(size[p], size[q])
            p, q = p[like], q[like]
            ok = (sketch[p] == sketch[q]).sum(axis=1) >= AGREE
            a.append(p[ok])
            b.append(q[ok])
    label = least_labels(t.num_rows, np.concatenate(a), np.concatenate(b))
    some = np.flatnonzero(label != np.arange(t.num_rows))
    node = t.column("node").combine_chunks()
    return pa.table({"node": node.take(pa.array(some)), "other": node.take(pa.array(label[some]))})


def _exact(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """Links of each tile by whole sets: shared tokens counted by a product of incidence matrices."""
    cols = {c: t.column(c).to_numpy() for c in ("weight", "part", "left", "right", "parts")}
    own = own_part(cols["part"], cols["left"], cols["right"], cols["parts"])
    data, offsets = text_bytes(t.column("tokens").combine_chunks())
    tokens = np.frombuffer(data.tobytes(), np.uint64)
    offsets = offsets // 8
    other, links = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64)
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        n = z - a
        if n < 2:
            continue
        size = np.diff(offsets[a : z + 1])
        shared = shared_counts(tokens[offsets[a] : offsets[z]], size)
        like = (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (size[:, None] + size[None, :])  # shared >= 4/5 of the union
        part = cols["part"][a:z]
        like &= (part[:, None] != part[None, :]) | own[a:z, None]
        np.fill_diagonal(like, False)
        links[a:z] = like @ cols["weight"][a:z]
        i, j = np.nonzero(np.triu(like))
        other[a:z] = a + least_labels(n, i, j)
    some = np.flatnonzero(links)
    node = t.column("node").combine_chunks()
    return pa.table({"node": node.take(pa.array(some)), "other": node.take(pa.array(other[some])), "links": pa.array(links[some])})


def shared_counts(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sets x sets: tokens that both have."""
    n = len(size)
    of = np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    token, of = tokens[order], of[order]
    new = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    times = np.bincount(column) if len(column) else np.zeros(0, int)
    keep = times[column] > 1
    of, column = of[keep], column[keep]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((n, n), np.float32)
    width = max(1, 4_000_000 // max(n, 1))
    for k in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (k, k + width))
        m = np.zeros((n, width), np.float32)
        m[of[a:z], column[a:z] - k] = 1
        out += m @ m.T
    return out.astype(np.int64)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, text_key, class_id, n_links, component_id, kept.

    Links are pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. class_id is the
    smallest doc_id with an equal set; n_links counts the documents linked directly, those of its own class too;
    component_id is the smallest doc_id reachable over links; kept marks the rows with that id. Null texts and texts
    without a word link with nothing. Repeated rows are documents of their own. Other columns are ignored.
    """
    out = _linked(docs, doc_id, text)
    return out.select("doc_id", "text_key", "class_id", "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, node of each row with its links, component_id and root."""
    made = written(sketched(docs, doc_id, text), "sketches")
    some = made.where("node is not null")
    classes = written(
        some.groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "classes"
    )
    tied = candidates(classes).select(F.col("node").alias("a"), F.col("other").alias("b"))
    members = written(components(tied).join(classes.select("node", "weight", "least"), "node"), "members")
    # the whole sets of the members only, from their texts
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = sized_join(wanted.where("doc_id is not null"), members.select(F.col("least").alias("doc_id")).distinct(), "doc_id").unionByName(wanted.where("doc_id is null"))
    sets = sketched(wanted, "doc_id", "text", with_sketch=False).select("node", "tokens")
    sets = sets.join(members.select("node", "root", "weight"), "node").dropDuplicates(["node"])
    sets = written(sets, "sets")
    rows = tiled(sets, ["root"], "node", EXACT_ROWS, total=sets.count())
    found = by_tile(rows.select("tile", "node", "tokens", "weight", "part", "left", "right", "parts"), _exact, "node binary, other binary, links long", most=512)
    return linked_rows(made.select("doc_id", "text_key", "node"), classes, found, "doc_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest id; texts without words all stay.

    Null ids come last, and of texts under one id that with the smallest hash stays. Where a row is repeated with its id,
    one of the rows stays. Columns keep their names and order, whatever the names are; an empty table stays empty.
    """
    key = lambda d, k: [F.coalesce(d, F.lit(0)).alias("__doc__"), d.isNull().alias("__none__"), k.alias("__key__")]
    on = ["__doc__", "__none__", "__key__"]
    rows = docs.select(F.struct("*").alias("row"), *key(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))))
    joined = _linked(docs, doc_id, text).select(*key(F.col("doc_id"), F.col("text_key")), "root")
    joined = written(joined.groupBy(*on, "root").agg(F.count("*").alias("n")), "keys")
    this = F.struct("__none__", "__doc__", "__key__")  # null ids last
    first = joined.where("root is not null").groupBy("root").agg(F.min(this).alias("first"), F.sum("n").alias("many")).where("many > 1")
    grouped = sized_join(joined, written(first, "survivors"), "root").select(*on, (this == F.col("first")).alias("kept"), "n")
    alone = joined.where("root is null and not __none__").select(*on, F.lit(True).alias("kept"), "n")
    seen = written(grouped.unionByName(alone).where("not kept or n > 1").drop("n"), "dropped")
    if seen.where("kept").limit(1).count():  # repeated rows with their ids
        once = rows.join(seen.where("kept"), on, "left_semi").dropDuplicates(on)
        rows = sized_join(rows, seen.select(*on), on, "left_anti", 300_000).unionByName(once)
    else:
        rows = sized_join(rows, seen.select(*on), on, "left_anti", 300_000)
    return rows.select("row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
classes AS (SELECT s, min(doc_id) AS class_id, count(*) AS weight, len(s) AS n FROM s GROUP BY s),
t AS MATERIALIZED (SELECT class_id, n, unnest(s) AS t FROM classes),
shared AS (SELECT x.class_id AS a, y.class_id AS b, x.n AS p, y.n AS q, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.class_id <> y.class_id
  AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM shared WHERE 9 * c >= 4 * (p + q)),
reach(x, y) AS (SELECT class_id, class_id FROM classes UNION SELECT reach.x, pairs.b FROM reach JOIN pairs ON reach.y = pairs.a),
roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT a, sum(weight) AS n FROM pairs JOIN classes ON class_id = b GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, CAST(coalesce(weight - 1, 0) + coalesce(links.n, 0) AS BIGINT) AS n_links,
  coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN classes USING (s) LEFT JOIN roots ON x = class_id LEFT JOIN links ON a = class_id
"""

"""Lines that stand in several documents stay in the first of them only.

Lines are exploded and hashed, the distinct documents of each hash are counted, and the lines of documents but the smallest
that hold a hash over the threshold are dropped by position. Only hashes are dealt out by key; texts move once, to meet the
positions that they lose.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import let
from .common import BROADCAST_ROWS, spare, spread_join, table, written

LEAST_CHARS, LEAST_DOCS = 10, 2
OUTER = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without outer white space, A-Z in lower case. Lines of ASCII alone take the built-in, which is faster."""
    bare = F.btrim(line, F.lit(OUTER))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _without(lines: Column, gone: Column) -> Column:
    """lines without the positions in `gone`, which rise: the runs between them, each copied once."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` cut to the lines that stay, + n_lines (before), n_dropped.

    A line of least_chars code points or more (without outer white space, A-Z in lower case) that stands in least_docs documents
    or more stays only in the document of the smallest id that holds it, there as often as it stands. Null texts are empty: one
    empty line. Rows of one id are one document; null ids are one, after all others. Equal rows get equal results. Empty
    tables stay empty. If the table has columns called n_lines or n_dropped, those added are called n_lines_, n_dropped_.
    Hashes are 128 bits wide. A line of a third of all rows is counted in parts and joined by broadcast.
    """
    own, row, gone, pos, key, least = (spare(docs, f"__{c}__") for c in ("own", "row", "gone", "pos", "key", "least"))
    whole = docs.withColumn(text, F.coalesce(text, F.lit(""))).withColumn(row, F.xxhash64(text))
    lines = whole.select(F.col(doc_id).alias(own), row, F.posexplode(F.split(text, "\n")).alias(pos, key)).withColumn(key, line_key(F.col(key)))
    lines = lines.where(F.char_length(key) >= least_chars).withColumn(key, F.unhex(F.md5(key)))
    of_docs = lines.groupBy(key, own).agg(F.count("*").alias("n"))
    keys = of_docs.groupBy(key).agg(F.min(own).alias(least), F.count("*").alias("docs"), F.sum("n").alias("many"))
    keys = written(keys.where(F.col("docs") >= least_docs).drop("docs"), "lines")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(keys), key)
    else:
        met = spread_join(lines, keys, [key], "many", lines.count())
    lost = met.where(~F.col(own).eqNullSafe(F.col(least))).groupBy(own, row).agg(F.sort_array(F.collect_set(pos)).alias(gone)).withColumnRenamed(row, key)
    both = whole.join(lost, whole[doc_id].eqNullSafe(lost[own]) & (whole[row] == lost[key]), "left")
    split = F.split(F.col(text), "\n")
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(split, lambda v: F.array_join(_without(v, F.col(gone)), "\n")))
    counts = {spare(docs, "n_lines"): F.size(split).cast("long"), spare(docs, "n_dropped"): F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return both.select(*[F.col(c) if c != text else kept.alias(text) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS v FROM documents),
l AS (SELECT doc_id, i, v[i] AS line FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (least <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (least IS NULL OR least = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""

"""Benchmark decontamination by a positional inverted index of the documents' words. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, sized_join, table, written

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, LONGEST = 10, 62  # a phrase's words are the bits of a long
KEY = ["doc_key", "text_key"]


def word_array(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), BETWEEN), lambda w: w != "")


def windows_of(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window_id, words): each run of `size` words of an item, or the whole item if it has fewer but some.

    Sizes are 1 to LONGEST; others raise.
    """
    if not 1 <= size <= LONGEST:
        raise ValueError(f"windows have 1 to {LONGEST} words, not {size}")
    w = items.select(F.col(item_id).alias("item_id"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    out = w.select("item_id", F.explode(runs).alias("words"))
    return out.select("item_id", F.unhex(F.md5(F.array_join("words", " "))).alias("window_id"), "words").distinct()


def keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Null or repeated ids stay apart unless id and text are both equal."""
    t = F.coalesce(text, F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(t)).alias("doc_key"), F.hash(t).alias("text_key")]


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_key, text_key, doc, term, pos) of the words that occur in `terms` (term, word), written out.

    One pass over the texts. Words that no test item holds can't be in a phrase of one and get no posting. Each
    document row also leaves one row with a null term whose pos is its count of words.
    """
    # The empty string is never a word: it carries the document itself, at the place after its last word.
    end = terms.sparkSession.createDataFrame([(None, "")], terms.schema)
    rows = docs.select(*keyed(docs, doc_id, text), F.col(doc_id).alias("doc"), F.concat(word_array(F.col(text)), F.array(F.lit(""))).alias("words"))
    rows = rows.select(*KEY, "doc", F.posexplode("words").alias("pos", "word"))  # after the keys: else they are computed per word
    return written(sized_join(rows, terms.union(end), "word").select(*KEY, "doc", "term", "pos"), "postings")


def find_phrases(postings: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact occurrences (doc_key, text_key, start, length, window_id) of phrases (window_id, words of 62 at most).

    The lists of each phrase's two rarest terms, shifted by their offsets, are intersected first; the rest of the
    terms is only looked up in documents that are left. Nothing pairs documents with documents, and what is sent
    on is in proportion to the postings of rare terms and to the matches.
    """
    frequency = postings.where("term is not null").groupBy("term").count()
    at = phrases.select("window_id", F.size("words").alias("length"), F.posexplode("words").alias("off", "word")).join(terms, "word").select("window_id", "length", "off", "term")
    ranked = sized_join(at, frequency, "term").withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("count", "off")))
    # a phrase with a term that no document holds has fewer rows here than words
    whole = ranked.withColumn("found", F.count("*").over(W.partitionBy("window_id"))).where("found = length")
    ranked = written(whole.select("window_id", "length", "off", "term", "rank"), "phrases")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))
    rare = ranked.where("rank <= 2")
    starts = sized_join(postings.where("term is not null").select(*KEY, "term", "pos"), rare, "term").where("pos >= off")
    starts = starts.groupBy(*KEY, "window_id", "length", (F.col("pos") - F.col("off")).alias("start")).agg(F.bit_or(bit).alias("bits"))
    starts = written(starts.where(F.bit_count("bits") == F.least(F.lit(2), F.col("length"))).select(*KEY, "window_id", "length", "start"), "candidates")
    short = starts.where("length <= 2")
    rest = starts.where("length > 2")
    wanted = sized_join(rest, ranked.select("window_id", "off", "term"), "window_id").withColumn("pos", F.col("start") + F.col("off"))
    there = sized_join(postings.where("term is not null").select(*KEY, "term", "pos"), rest.select(*KEY).distinct(), KEY, "left_semi", 300_000)
    got = wanted.join(there, [*KEY, "pos", "term"]).groupBy(*KEY, "window_id", "length", "start").agg(F.bit_or(bit).alias("bits"))
    got = got.where(F.bit_count("bits") == F.col("length")).select(*KEY, "start", "length", "window_id")
    return short.select(*KEY, "start", "length", "window_id").union(got)


def find_near(postings: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Proximity matches (doc_key, text_key, term_a, pos_a, term_b, pos_b): term_b 1 to `within` words after term_a, for pairs (term_a, term_b).

    Positions are bucketed by `within`, so a join key holds at most 2 * within positions of a document.
    """
    p = postings.where("term is not null").select(*KEY, "term", "pos")
    a = sized_join(p.withColumnsRenamed({"term": "term_a", "pos": "pos_a"}), pairs, "term_a").withColumn("bucket", F.explode(F.array((F.col("pos_a") / within).cast("int"), (F.col("pos_a") / within).cast("int") + 1)))
    b = p.withColumnsRenamed({"term": "term_b", "pos": "pos_b"}).withColumn("bucket", (F.col("pos_b") / within).cast("int"))
    return a.join(b, [*KEY, "term_b", "bucket"]).where(f"pos_b > pos_a and pos_b <= pos_a + {int(within)}").select(*KEY, "term_a", "pos_a", "term_b", "pos_b").distinct()


def terms_of(windows: DataFrame) -> DataFrame:
    """(term, word): a number for each word of the windows; numbers that collide raise."""
    word = windows.select(F.explode("words").alias("word")).distinct()
    out = written(word.select(F.xxhash64("word").alias("term"), "word"), "terms")
    if out.groupBy("term").count().where("count > 1").limit(1).count():
        raise ValueError("two words have one number")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: doc_key, text_key, doc, n_words, n_hit, items (sorted array of strings).

    A document word inside any occurrence of any window of an item is hit. Null and empty texts have no words and
    no hits; items without words are ignored, null item ids hit without being named; repeated items count once
    and repeated documents get equal rows. Other columns are ignored.
    """
    windows = written(windows_of(items, size, item_id, item_text), "windows")
    phrases = windows.select("window_id", "words").distinct()
    terms = terms_of(phrases)
    postings = build_index(docs, terms, doc_id, text)
    found = written(find_phrases(postings, phrases, terms), "found")
    # covered words: union of [start, start + length) by the furthest end before each start
    spans = found.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.coalesce(F.max("end").over(W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    named = sized_join(found.select(*KEY, "window_id").distinct(), windows.select("window_id", F.col("item_id").cast("string").alias("item")), "window_id")
    named = named.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = hit.join(named, KEY, "left")
    rows = postings.where("term is null").select(*KEY, "doc", F.col("pos").cast("long").alias("n_words"))
    return sized_join(rows, hits, KEY, "left", 300_000).select(*KEY, "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those of which more than the share `most` of words is hit. Columns and other rows stay as they are."""
    fresh(docs, *KEY)
    bad = decontaminate(docs, items, size, doc_id, text).where((F.col("n_hit") > 0) & (F.col("n_hit") > most * F.col("n_words"))).select(*KEY).distinct()
    return sized_join(docs.select("*", *keyed(docs, doc_id, text)), bad, KEY, "left_anti", 300_000).drop(*KEY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + UPPER + "', '" + SMALL + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + {WINDOW - 1}] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(x) AS n FROM win),
runs AS (SELECT doc_id, s, n, w[s:s + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM runs JOIN win USING (x)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

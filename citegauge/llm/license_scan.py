"""Licence scan: canonical digests of whole texts and of notice lines, looked up among known ones.

Spark expressions only. The known digests are constants (a few dozen); a caller's own are counted before they are broadcast.
Documents are neither shuffled nor sorted then.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sized_join, table
from .license_texts import DIGESTS, MARKS, NOTICES, SPELLINGS, TEXTS

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAD = r"[\t\r #*/;%-]*"
_REST = r"[^\n]*(?:\n|$)"
# A line that opens with a copyright mark and says whose or since when, not a sentence that goes on with the word; or says only
# that rights are reserved.
COPYRIGHT = (
    rf"(?m)^{_LEAD}copyright[\t :]*(?:\(c\)|©|&copy;|[<{{\[]|[0-9]{{4}}){_REST}"
    rf"|^{_LEAD}(?:\(c\)|©)[\t ]*(?:copyright|[0-9]{{4}}|[<{{\[]|by ){_REST}"
    rf"|^{_LEAD}copyright[^\n]*(?:[^0-9](?:19|20)[0-9]{{2}}|all rights reserved[. ]*$){_REST}"
    rf"|^{_LEAD}all rights reserved[. \t\r]*(?:\n|$)"
)
# A list's mark: a number, with a point or in brackets, between spaces.
MARK = r"(^|[ \t\r\n])\(?[0-9]{1,2}[.)][ \t\r\n]"
# Some spelling's letters stand there, where a word begins; by first letters, so most places are passed by at once.
_BY_LETTER = {w[0]: [x[1:].replace(" ", "[^a-z]+") for x, _ in SPELLINGS if x[0] == w[0]] for w, _ in SPELLINGS}
SPELT = "(?<![a-z])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in _BY_LETTER.items()) + ")"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no list marks, one spelling of whole words, one space for other characters.

    Where lines are broken makes no difference.
    """
    return _let(F.translate(text, UPPER, SMALL), lambda t: _let(_without_notices(t), _words))


def _let(value: Column, fn) -> Column:
    """fn(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _without_notices(t: Column) -> Column:
    t = F.when(t.rlike("copyright|\\(c\\)|©|all rights"), F.regexp_replace(t, COPYRIGHT, "\n")).otherwise(t)
    for mark, stands in MARKS:
        t = F.replace(t, F.lit(mark), F.lit(stands))
    return t


def _words(t: Column) -> Column:
    def spelt(t: Column) -> Column:
        wide = F.concat(F.lit(" "), F.regexp_replace(t, OTHER, "  "), F.lit(" "))  # two spaces: each word has its own on both sides
        for spelling, stands in SPELLINGS:
            wide = F.replace(wide, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {stands.replace(' ', '  ')} "))
        # few texts have any of the spellings
        return F.trim(F.when(t.rlike(SPELT), F.regexp_replace(wide, " +", " ")).otherwise(F.regexp_replace(t, OTHER, " ")))

    return _let(F.when(t.rlike("[0-9][.)]"), F.regexp_replace(t, MARK, " ")).otherwise(t), spelt)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts) -> DataFrame:
    """(license_id, license_digest), one row per digest."""
    rows = spark.createDataFrame(list(texts), "license_id string, license_text string")
    return rows.groupBy(digest(F.col("license_text")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def whole_texts(spark: SparkSession, texts=None) -> DataFrame:
    """(license_id, license_digest) of the texts given, or of all licences known here."""
    if texts is not None:
        return known(spark, texts)
    more = spark.createDataFrame(DIGESTS, "license_id string, license_digest string")
    return known(spark, TEXTS).unionByName(more).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def _prefilter(notices: list[str]) -> str | None:
    """A pattern that each line with one of these canonical notices matches: of each the longest word that no spelling or mark can
    stand for, or a character that may part a word. None where some notice has no such word: then all lines are looked at."""
    made = {w for _, stands in SPELLINGS for w in stands.split()} | {w for _, stands in MARKS for w in re.findall("[a-z]+", stands)}
    words = set()
    for notice in notices:
        safe = [w for w in notice.split(" ") if w.isalpha() and w not in made]
        if not safe:
            return None
        words.add(max(safe, key=lambda w: (len(w), w)))
    parting = [mark for mark, stands in MARKS if not stands]
    return "(?i)" + "|".join([*sorted(words), *parting])


def license_scan(docs: DataFrame, texts=None, notices=None, text: str = "text") -> DataFrame:
    """docs + text_digest, license_id, notice_ids.

    text_digest is null for null texts, license_id null unless the whole canonical text is a known one;
    notice_ids are the sorted distinct licences named by lines that are known notices (empty if none).
    An empty text has the digest of the empty string. Rows are kept as they are, repeated ones too.
    """
    fresh(docs, "text_digest", "license_id", "notice_ids")
    spark = docs.sparkSession
    given = list(NOTICES if notices is None else notices)  # a constant list
    notice = known(spark, given).collect()
    spoken = [r[0] for r in spark.createDataFrame(given, "i string, t string").select(canonical(F.col("t"))).collect()]
    lines, some = F.split(F.col(text), "\n"), _prefilter(spoken)
    lines = F.filter(lines, lambda x: x.rlike(some)) if some else lines
    if notice:
        lookup = F.create_map(*[F.lit(v) for r in notice for v in (r.license_digest, r.license_id)])
        ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: lookup[digest(x)]))))
    else:
        ids = F.array().cast("array<string>")
    out = docs.select("*", digest(F.col(text)).alias("text_digest"), F.coalesce(ids, F.array().cast("array<string>")).alias("notice_ids"))
    got = whole_texts(spark, texts).withColumnRenamed("license_digest", "text_digest")
    return sized_join(out, got, "text_digest", "left").select(*docs.columns, "text_digest", "license_id", "notice_ids")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_digest", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(expr: str) -> str:
    t = f"regexp_replace(translate({expr}, '{UPPER}', '{SMALL}'), {_sql_text(COPYRIGHT)}, chr(10), 'g')"
    for mark, stands in MARKS:
        t = f"replace({t}, {_sql_text(mark)}, {_sql_text(stands)})"
    t = f"' ' || regexp_replace(regexp_replace({t}, '{MARK}', ' ', 'g'), '{OTHER}', '  ', 'g') || ' '"
    for spelling, stands in SPELLINGS:
        t = f"replace({t}, ' {spelling.replace(' ', '  ')} ', ' {stands.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def _values(rows) -> str:
    return ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in rows)


ORACLE = f"""
WITH known AS (SELECT d, min(i) AS license_id FROM (SELECT sha256({_sql_canonical("t")}) AS d, i FROM (VALUES {_values(TEXTS)}) v(i, t)
  UNION ALL SELECT d, i FROM (VALUES {_values(DIGESTS)}) v(i, d)) GROUP BY 1),
notices AS (SELECT sha256({_sql_canonical("t")}) AS d, min(i) AS notice_id FROM (VALUES {_values(NOTICES)}) v(i, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
said AS (SELECT doc_id, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids
         FROM lines JOIN notices ON sha256({_sql_canonical("line")}) = d GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS text_digest FROM documents)
SELECT doc_id, text_digest, license_id, coalesce(notice_ids, '') AS notice_ids
FROM texts LEFT JOIN known ON text_digest = d LEFT JOIN said USING (doc_id)
"""

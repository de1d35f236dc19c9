"""Queries over TEI documents and pages of results, both written from the derived bibliography, twenty rows a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import eprint as E
from ..functions import text as T
from ..sources.preprint_pages import plain_results, preprint_results
from ..sources.tei import document_references, tei_references, two_passes
from .queries import BASE, _repairs_sql, _tables, query

_S = T.SPACE


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_S}+|{_S}+$', '', 'g')"


def _escaped(c: Column) -> Column:
    """A text as XML has it; control characters have no place there."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def _joined(rows: DataFrame, key: str, line: Column, head: str, foot: str) -> DataFrame:
    """(doc, xml): the lines of twenty rows, in order, between head and foot; a row stays with its neighbours."""
    doc = F.floor(F.col(key) / 20).cast("long").alias("doc")
    lines = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return rows.groupBy(doc).agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit(foot)).alias("xml"))


def _tei(rows: DataFrame, key: str = "ref_id") -> DataFrame:
    name = lambda n: F.concat(F.lit("<author><persName><forename>"), F.substring_index(n, " ", 1), F.lit("</forename><surname>"), F.regexp_replace(n, "^[^ ]+ ", ""), F.lit("</surname></persName></author>"))
    line = F.concat(
        F.lit('<biblStruct><analytic><title level="a">'), _escaped(F.col("title")), F.lit("</title>"), F.array_join(F.transform("authors", name), ""),
        F.when(F.col("doi") != "", F.concat(F.lit("<idno>"), "doi", F.lit("</idno>"))).otherwise(""), F.lit('</analytic><monogr><title level="j">'), _escaped(F.col("venue")),
        F.lit('</title><imprint><date type="published" when="'), F.col("year").cast("string"), F.lit('-01"/></imprint></monogr></biblStruct>'),
    )
    return _joined(rows, key, line, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl>', "</listBibl></TEI>")


_TITLE = _repairs_sql("regexp_replace(title, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")


@query(f"""{BASE} SELECT CAST(floor(ref_id / 20) AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY floor(ref_id / 20) ORDER BY ref_id) - 1 AS BIGINT) AS pos, {_TITLE} AS title,
array_to_string(authors, '; ') AS authors, venue, year, CASE WHEN contains(doi, 'doi') THEN doi ELSE '' END AS doi FROM refs""")
def tei_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _ = _tables(spark, sf_dir)
    rows = tei_references(_tei(refs))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), "title", F.array_join("authors", "; ").alias("authors"), "venue", "year", "doi")


@query(f"""{BASE}, x AS (SELECT r.ref_id, r.authors AS a, p.authors AS b FROM refs r JOIN papers p ON p.paper_id = r.ref_id)
SELECT CAST(floor(ref_id / 20) AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY floor(ref_id / 20) ORDER BY ref_id) - 1 AS BIGINT) AS pos, array_to_string(a, '; ') AS authors,
CASE WHEN a <> b THEN array_to_string(b, '; ') END AS consolidated FROM x""")
def claimed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References read twice, as they claim to be and as the catalogue has them: the claimed authors stay."""
    refs, papers = _tables(spark, sf_dir)
    rows = two_passes(tei_references(_tei(refs)), tei_references(_tei(papers, "paper_id")), ["doc", "pos"])
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), F.array_join("authors", "; ").alias("authors"), F.array_join("consolidated_authors", "; ").alias("consolidated"))


@query(f"""{BASE} SELECT CAST(floor(ref_id / 20) AS BIGINT) AS doc, CASE WHEN floor(ref_id / 20) % 3 = 0 THEN 'text' ELSE 'tei' END AS extractor, count(*) AS many FROM refs GROUP BY ALL""")
def extractor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references each document gives, and from what: each third one has no TEI and is read as text."""
    refs, _ = _tables(spark, sf_dir)
    entry = F.concat(F.lit("\n["), (F.col("ref_id") % 20 + 1).cast("string"), F.lit("] "), F.array_join("authors", " and "), F.lit(". A title of its own. In "), "venue", F.lit(", "), F.col("year").cast("string"))
    texts = _joined(refs, "ref_id", entry, "Body\nReferences\n", "\n").withColumnRenamed("xml", "text")
    docs = _tei(refs).join(texts, "doc").withColumn("xml", F.when(F.col("doc") % 3 > 0, F.col("xml")))
    return document_references(docs).groupBy("doc", "extractor").agg(F.count("*").alias("many"))


def _pages(papers: DataFrame) -> DataFrame:
    number = F.concat(F.col("year").cast("string"), F.lit("/"), F.lpad(F.col("paper_id").cast("string"), 9, "0"))
    line = F.concat(
        F.lit('<a href="/'), number, F.lit('">'), number, F.lit('</a>\n(<a href="/'), number, F.lit('.pdf">PDF</a>)\nLast updated: 2020-02-03\n\n'), _escaped(F.col("title")), F.lit("\n"),
        F.array_join("authors", ", "), F.lit("\n\n"), F.element_at(F.array(*map(F.lit, E.CATEGORIES)), (F.col("paper_id") % 9 + 1).cast("int")), F.lit("\n\nAbstract.\n"),
    )
    return _joined(papers, "paper_id", line, '<html><div class="results">', "</div></html>").select(F.col("doc").alias("page_id"), F.col("xml").alias("html"))


_KEPT = _strip("regexp_replace(title, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")


@query(f"""{BASE}, t AS (SELECT *, {_KEPT} AS t, CAST(year AS VARCHAR) || '/' || lpad(CAST(paper_id AS VARCHAR), 9, '0') AS number FROM papers),
u AS (SELECT * REPLACE (CASE WHEN t = '' THEN array_to_string(authors, ', ') ELSE t END AS t), t = '' AS bare FROM t)
SELECT CAST(floor(paper_id / 20) AS BIGINT) AS page_id, number AS paper_id, t AS title, CASE WHEN bare THEN '' ELSE array_to_string(authors, '; ') END AS authors, year,
['{"', '".join(E.CATEGORIES)}'][CAST(paper_id % 9 + 1 AS INT)] AS category, '{E.ARCHIVE}/' || number AS url FROM u WHERE length(t) > 5""")
def preprint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that pages of results name, with authors and categories told by how lines look."""
    _, papers = _tables(spark, sf_dir)
    rows = preprint_results(_pages(papers))
    return rows.select("page_id", "paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "category", "url")


@query(f"""{BASE} SELECT CAST(floor(paper_id / 20) AS BIGINT) AS page_id, CAST(year AS VARCHAR) || '/' || lpad(CAST(paper_id AS VARCHAR), 9, '0') AS paper_id, 'Paper number ' || CAST(paper_id AS VARCHAR) AS title, year FROM papers""")
def preprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that pages of links alone name, by patterns."""
    _, papers = _tables(spark, sf_dir)
    number = F.concat(F.col("year").cast("string"), F.lit("/"), F.lpad(F.col("paper_id").cast("string"), 9, "0"))
    line = F.concat(F.lit("<li><a class='x' href='/"), number, F.lit("/'>PDF Paper number "), F.col("paper_id").cast("string"), F.lit(" 2020-01-02.</a></li>\n"))
    pages = _joined(papers, "paper_id", line, "<ul>", "</ul>").select(F.col("doc").alias("page_id"), F.col("xml").alias("html"))
    return plain_results(pages).select("page_id", "paper_id", "title", "year")

"""Command line: `verify FILE` or `cite TEXT` against a table of papers in Parquet."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.citations import parse_citation, parse_references
from .functions.text import normalise_text, token_jaccard
from .operators.context import BONUS, book_signs, boosted, search_rank
from .operators.link import RIGOR, Rigor, adaptive_top, distinct_titles, faults, summary
from .operators.report import full_report, gate, header, plain_citation, summary_lines
from .operators.verify import verify
from .sources.bibliography import assemble
from .sources.storage import scratch, written
from .sources.tei import tei_references

#: What opens an entry of a list: a number or a bullet.
MARK = r"^(?:[0-9]+[.)]?|[-*•])[ \t]+"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """References of text files and of TEI documents (.xml, .tei): ref_id, file, pos, raw_text, fields, and error where one can't be read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    is_tei = F.lower("file").rlike(r"[.](?:tei|xml)$")
    names = ["raw_text", "title", "authors", "venue", "year", "pages", "doi", "url"]
    plain = assemble(files.where(~is_tei)).select("file", "pos", "raw_text", parse_citation(F.regexp_replace("raw_text", MARK, "")).alias("p"))
    plain = plain.select("file", "pos", "raw_text", "p.*").withColumn("venue", F.lit(""))
    marked = parse_references(tei_references(files.where(is_tei), "file", "text"), keep_all=True)
    rows = gate(plain.select("file", "pos", *names).unionByName(marked.select("file", "pos", *names)))
    return rows.withColumn("ref_id", F.xxhash64("file", "pos"))


def one_reference(spark: SparkSession, text: str) -> DataFrame:
    """A single reference, as of `read_references`."""
    raw = spark.createDataFrame([("", 0, text)], "file string, pos int, raw_text string")
    parsed = raw.select("file", "pos", "raw_text", parse_citation(F.regexp_replace("raw_text", MARK, "")).alias("p"))
    return gate(parsed.select("file", "pos", "raw_text", "p.*").withColumn("venue", F.lit(""))).withColumn("ref_id", F.xxhash64("file", "pos"))


def verified(refs: DataFrame, papers: DataFrame, *args, **named) -> DataFrame:
    """rows of `verify` for all of `read_references`, with file, pos, raw_text and error; those that can't be read are inconclusive."""
    refs = written(refs, "references")  # read at many places of the plan
    rows = verify(refs.where("error is null").select("ref_id", "title", "authors", "year", "venue", "doi"), papers, *args, **named)
    unread = refs.where("error is not null").select("ref_id", "title", "authors", "venue", "year", "doi", F.lit("inconclusive").alias("class"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("score"))
    place = refs.select("ref_id", "file", "pos", "raw_text", "error")
    return place.join(rows.unionByName(unread, allowMissingColumns=True), "ref_id")


def cite(papers: DataFrame, query: str, context: str = "general") -> DataFrame:
    """At most three papers for a query. The best three are found by a distributed top-k before the last choice."""
    rows = boosted(distinct_titles(papers, [F.col("paper_id")]), context)
    ranked = search_rank(rows, token_jaccard(F.lower(normalise_text(F.col("title"))), F.lower(F.lit(query))), context)
    return adaptive_top(ranked.orderBy(F.desc("score"), "paper_id").limit(3).withColumn("ref_id", F.lit(0)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="citegauge")
    p.add_argument("task", choices=["verify", "cite"])
    p.add_argument("what", help="text files or TEI documents of references, the text of a query, or with --text of a reference")
    p.add_argument("--text", action="store_true", help="verify one reference, given as text")
    p.add_argument("--papers", required=True, help="Parquet of paper_id, source, title, authors, year, venue, doi, citations")
    p.add_argument("--rigor", choices=sorted(RIGOR), default="balanced")
    p.add_argument("--threshold", type=float, help="likeness from which a reference is authentic, in place of the rigor's")
    p.add_argument("--fraud", type=float, help="likeness of titles from which other authors are a manipulation, in place of the rigor's")
    p.add_argument("--multi-database", action="store_true", help="hold it against a reference if one catalogue alone has it")
    p.add_argument("--searched", action="store_true", help="take what the sources' searches of the whole catalogue bring, too")
    p.add_argument("--context", choices=["general", *BONUS], default="general")
    p.add_argument("--words", action="store_true", help="score by shared words and surnames, in place of characters and whole author lists")
    for name, what in (("registry", "a DOI registry"), ("notices", "retraction notices"), ("hits", "hits of a scholar search"), ("registered", "registered authors")):
        p.add_argument(f"--{name}", help=f"Parquet of {what}")
    p.add_argument("--raw-labels", action="store_true", help="take no catalogue for a major one")
    p.add_argument("--format", choices=["json", "txt"], help="else by the end of --out, else json")
    p.add_argument("--out", required=True, help="folder to write")
    a = p.parse_args(argv)
    a.format = a.format or ("txt" if a.out.lower().endswith(".txt") else "json")
    given = {"similarity": a.threshold, "manipulation": a.fraud, "multi_database": a.multi_database or None}
    rigor = replace(RIGOR[a.rigor], **{k: v for k, v in given.items() if v is not None})
    if found := faults(rigor):
        p.error("; ".join(found))
    spark = SparkSession.builder.appName("citegauge").getOrCreate()
    with scratch(spark):
        run(spark, a, rigor)


def run(spark: SparkSession, a: argparse.Namespace, rigor: Rigor) -> None:
    papers = spark.read.parquet(a.papers)
    if a.task == "cite":
        found = cite(papers, a.what, a.context)
        if a.format == "json":
            found.write.mode("errorifexists").json(a.out)
        else:
            found.select(plain_citation(*[F.col(c) for c in ("title", "authors", "venue", "year")])).write.text(a.out)
        return
    tables = [spark.read.parquet(path) if path else None for path in (a.registry, a.notices, a.hits, a.registered)]
    is_book = F.size(book_signs(F.col("title"), F.col("venue"), F.col("year"), F.lit(""), F.col("authors"))) > 0
    refs = one_reference(spark, a.what) if a.text else read_references(spark, a.what)
    rows = written(verified(refs, papers, rigor, "words" if a.words else "exact", *tables, is_book, a.raw_labels, searched=a.searched), "verdicts").orderBy("file", "pos")
    if a.format == "json":
        rows.write.mode("errorifexists").json(a.out)
    else:
        head = header(summary(rows)).select(F.lit(0).alias("part"), F.lit("").alias("file"), F.col("ord").alias("pos"), "line")
        blocks = full_report(rows, is_book=F.col("is_book")).select(F.lit(1).alias("part"), "file", F.col("pos").cast("int").alias("pos"), F.col("block").alias("line"))
        head.union(blocks).orderBy("part", "file", "pos").select("line").write.text(a.out)
    for r in summary_lines(summary(rows)).orderBy("ord").collect():  # six rows
        print(r.line)


if __name__ == "__main__":
    main()

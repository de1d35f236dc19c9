"""Records of XML dumps: a file is cut at the records' closing tags, so many tasks read one file and none reads it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import let
from .tei import FIELDS, _read


def _bound(record: Column, tag: str) -> Column:
    """The record with each prefix that it uses but doesn't declare bound to itself: the file's root, which did so, is elsewhere."""
    used = F.array_distinct(F.regexp_extract_all(record, F.lit(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]"), F.lit(1)))
    own = F.array_distinct(F.regexp_extract_all(record, F.lit(r"xmlns:([A-Za-z_][\w.-]*)\s*="), F.lit(1)))
    missing = F.array_except(F.array_except(used, own), F.array(F.lit("xml"), F.lit("xmlns")))
    names = F.array_join(F.transform(missing, lambda p: F.concat(F.lit(" xmlns:"), p, F.lit('="'), p, F.lit('"'))), "")
    return let(names, lambda n: F.when(n == "", record).otherwise(F.concat(F.lit(f"<{tag}"), n, F.substr(record, F.lit(len(tag) + 2)))))


def xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(record, error): each element `tag` of the files at path, from its opening to its closing tag.

    The files are split as any text is, with the closing tag as the end of a line: a record belongs to the task in whose part it
    ends. What stands between records goes. An opening without its closing tag is a row with the error `unclosed`: a record that
    another one opens in, and the last of a file that breaks off. Elements may not be nested in their like; comments and
    CDATA that hold the tag are taken for records. Names without a namespace's declaration in the record are bound to themselves.
    """
    # lines end before the slash of a closing tag, so a line that a closing tag ended has its bracket; the rest of a file has none
    chunks = spark.read.option("lineSep", f"/{tag}>").text(path).select(F.endswith("value", F.lit("<")).alias("closed"), F.regexp_replace("value", "<$", "").alias("value"))
    # closing tags with white space inside end records, too
    parts = F.split("value", rf"</{tag}\s+>")
    pieces = chunks.select(F.posexplode(parts).alias("k", "piece"), F.size(parts).alias("many"), "closed").withColumn("closed", F.col("closed") | (F.col("k") < F.col("many") - 1))
    openings = F.split("piece", rf"(?=<{tag}[\s/>])")
    opened = pieces.select(F.posexplode(openings).alias("at", "piece"), F.size(openings).alias("of"), "closed").where(F.col("piece").rlike(rf"^<{tag}[\s/>]"))
    alone = rf"^<{tag}(?:\s[^>]*)?/>"
    ended = F.col("closed") & (F.col("at") == F.col("of") - 1)
    said = lambda record, error: F.struct(record.alias("record"), F.lit(error).cast("string").alias("error"))
    row = F.when(F.col("piece").rlike(alone), said(F.regexp_extract("piece", alone, 0), None)).when(ended, said(F.concat("piece", F.lit(f"</{tag}>")), None)).otherwise(said(F.col("piece"), "unclosed"))
    return opened.select(row.alias("r")).select(_bound(F.col("r.record"), tag).alias("record"), "r.error")


def tei_records(spark: SparkSession, path: str, tag: str = "biblStruct") -> DataFrame:
    """(id, authors, year, the extractor's fields, error): references of dumps of any size, record by record.

    id is the record's xml:id, empty if it has none. A record that can't be read, or holds no reference, has its text as raw_text and an error.
    """
    records = xml_records(spark, path, tag)
    key = F.struct(F.regexp_extract("record", rf'^<{tag}[^>]*?\sxml:id="([^"]*)"', 1).alias("id"), "error")
    docs = records.select(F.to_json(key).alias("key"), F.when(F.col("error").isNull(), F.col("record")).alias("xml"), F.col("record").alias("text"))
    rows = _read(docs, "key", "xml", "text")
    of = F.from_json("doc", "id string, error string")
    bad = F.col("pos") < 0
    fields = [F.when(bad, F.col("rest") if f == "raw_text" else F.lit("")).otherwise(F.col(f)).alias(f) for f in FIELDS]
    return rows.select(of["id"].alias("id"), "authors", "year", *fields, F.when(bad, F.coalesce(of["error"], F.lit("no reference"))).alias("error"))

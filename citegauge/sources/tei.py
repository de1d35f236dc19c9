"""References of TEI documents: every biblStruct of a document is a row.

A document is parsed once, in Arrow batches: an XPath expression of the engine would parse it again for each field and
fails on a document that isn't well-formed; here such a document has no references. Fields are then cleaned in the JVM.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import entries, parse_citation, section
from ..functions.repair import repair_title

FIELDS = ["raw_text", "title", "venue", "volume", "issue", "pages", "doi", "isbn", "url"]
_KIND = pa.struct([("pos", pa.int32()), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("sure", pa.float64()), *[(f, pa.string()) for f in FIELDS]])
SCHEMA = "pos int, authors array<string>, year int, sure double, " + ", ".join(f"{f} string" for f in FIELDS)
#: Documents whose references are held as objects at once, whatever the batch.
READ_AT_ONCE = 256
#: Title and venue by attribute, best first.
TITLES, VENUES = [("level", "a"), ("type", "main")], [("level", "j"), ("level", "m"), ("type", "j")]


def _said(e: ET.Element | None) -> str:
    return (e.text or "").strip() if e is not None else ""


class _Entry:
    """Descendants of a biblStruct by their local name, in document order."""

    def __init__(self, top: ET.Element):
        self.by_name: dict[str, list[ET.Element]] = {}
        for e in top.iter():
            if e is not top and isinstance(e.tag, str):
                self.by_name.setdefault(e.tag.rpartition("}")[2], []).append(e)

    def all(self, name: str, **at: str) -> list[ET.Element]:
        return [e for e in self.by_name.get(name, []) if all(e.get(k) == v for k, v in at.items())]

    def first(self, name: str, **at: str) -> ET.Element | None:
        return next(iter(self.all(name, **at)), None)


def _title(entry: _Entry) -> ET.Element | None:
    ranked = [entry.first("title", **{k: v}) for k, v in TITLES]
    ranked += [e for e in entry.all("title") if "j" not in (e.get("level"), e.get("type"))]
    return next((e for e in ranked if _said(e)), None)


def _name(person: ET.Element) -> str:
    """The first forename and surname, else what the element itself says."""
    parts: dict[str, str] = {}
    for e in person:
        parts.setdefault(e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "", _said(e))
    return " ".join(filter(None, (parts.get("forename"), parts.get("surname")))) or _said(person)


def _year(entry: _Entry) -> int | None:
    """Of the date of publication if its value opens with a number, else of the first date with such a value or a year in its text."""
    for e in entry.all("date", type="published")[:1]:
        if (value := re.match(r"\d{1,4}", e.get("when") or "")):
            return int(value.group())
    for e in entry.all("date"):
        value = re.match(r"\d{1,4}", e.get("when")) if e.get("when") else re.search(r"\b(?:19|20)\d\d\b", e.text or "")
        if value:
            return int(value.group())
    return None


def _pages(e: ET.Element | None) -> str:
    if e is None:
        return ""
    ends = [e.get("from") or "", e.get("to") or ""]
    return "-".join(filter(None, ends)) if ends[0] else _said(e)


def read_entry(top: ET.Element) -> dict | None:
    """Fields of one biblStruct; None without a title, a raw text, or authors with a venue."""
    entry = _Entry(top)
    title = _title(entry)
    venue = next((e for e in (entry.first("title", **{k: v}) for k, v in VENUES) if e is not None and e.text), None)
    doi = _said(entry.first("idno", type="DOI")) or next((_said(e) for e in entry.all("idno") if "doi" in (e.text or "").lower()), "")
    persons = [p for a in entry.all("author") for p in a if isinstance(p.tag, str) and p.tag.rpartition("}")[2] == "persName"]
    sure = title.get("confidence") if title is not None else None
    pointer = entry.first("ptr")
    out = {
        "raw_text": _said(entry.first("note", type="raw_reference")),
        "title": "".join(title.itertext()).strip() if title is not None else "",
        "authors": [n for n in map(_name, persons) if n],
        "venue": _said(venue),
        "year": _year(entry),
        "volume": _said(entry.first("biblScope", unit="volume")),
        "issue": _said(entry.first("biblScope", unit="issue")),
        "pages": _pages(entry.first("biblScope", unit="page")),
        "doi": doi,
        "isbn": _said(entry.first("idno", type="ISBN")),
        "url": (pointer.get("target") or "") if pointer is not None else "",
        "sure": float(sure) if sure and re.fullmatch(r"[0-9]*\.?[0-9]+", sure) else None,
    }
    return out if out["title"] or out["raw_text"] or (out["authors"] and out["venue"]) else None


def read_document(xml: str | None) -> list[dict]:
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return []
    tops = [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "biblStruct"]
    found = [r for r in map(read_entry, tops) if r]
    return [{"pos": k, **r} for k, r in enumerate(found)]


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The references of documents (doc, xml, rest), a few documents at a time: what is held doesn't grow with the batch."""
    for batch in (b.slice(at, READ_AT_ONCE) for b in batches for at in range(0, b.num_rows, READ_AT_ONCE)):
        found = [read_document(x) for x in batch.column("xml").to_pylist()]
        of = pa.array([i for i, many in enumerate(found) for _ in many or [None]], pa.int64())
        fields = pa.array([r for many in found for r in many or [{"pos": -1}]], _KIND)
        empty = pa.compute.equal(fields.field("pos"), -1)
        rest = pa.compute.if_else(empty, batch.column("rest").take(of), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(of), rest, *fields.flatten()], names=["doc", "rest", *[f.name for f in _KIND]])


def _read(docs: DataFrame, doc: str, xml: str, text: str | None) -> DataFrame:
    """doc, rest and the fields of each reference; a document without references is one row of pos -1 with its text as rest."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(xml).cast("string").alias("xml"), (F.col(text) if text else F.lit(None)).cast("string").alias("rest"))

    out = rows.mapInArrow(_read_batches, f"doc {rows.schema['doc'].dataType.simpleString()}, rest string, {SCHEMA}")
    return out.withColumn("title", repair_title(F.col("title")))


def tei_references(docs: DataFrame, doc: str = "doc", xml: str = "xml") -> DataFrame:
    """(doc, pos, fields): every reference of every document, in order, with mark-up taken out of titles.

    Null, empty and malformed documents give no rows; rows of repeated documents stay. Missing fields are empty, a missing
    year is null; `sure` is the extractor's confidence in the title. Other columns are ignored.
    """
    return _read(docs, doc, xml, None).where("pos >= 0").drop("rest").withColumnRenamed("doc", doc)


def two_passes(claimed: DataFrame, consolidated: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the consolidated pass with the authors that the citation claims, and consolidated_authors where those differ.

    A row without a title and without authors is no reference, in either pass.
    """
    some = (F.col("title") != "") | (F.size("authors") > 0)
    before = claimed.where(some).select(*key, F.col("authors").alias("__claimed__"))
    rows = consolidated.where(some).join(before, key, "left")
    differs = (F.size("__claimed__") > 0) & (F.col("__claimed__") != F.col("authors"))
    rows = rows.withColumn("consolidated_authors", F.when(differs, F.col("authors")))
    return rows.withColumn("authors", F.when(differs, F.col("__claimed__")).otherwise(F.col("authors"))).drop("__claimed__")


def document_references(docs: DataFrame, doc: str = "doc", xml: str = "xml", text: str = "text") -> DataFrame:
    """(doc, pos, extractor, fields): references of the TEI, and of the plain text of documents whose TEI gives none.

    Each document is read once and stays in its partition. Documents without either give no rows.
    """
    names = ["raw_text", "title", "authors", "venue", "year", "volume", "issue", "pages", "doi", "url"]
    read = _read(docs, doc, xml, text)
    marked = F.array(F.struct("pos", F.lit("tei").alias("extractor"), *names))
    empty = F.lit("")

    def plain(raw: Column, k: Column) -> Column:
        p = parse_citation(raw)
        of = {"raw_text": raw, "venue": empty, "volume": empty, "issue": empty}
        return F.struct(k.cast("int").alias("pos"), F.lit("text").alias("extractor"), *[(of[n] if n in of else p[n]).alias(n) for n in names])

    found = F.transform(entries(section(F.col("rest"))), plain)
    return read.select(F.col("doc").alias(doc), F.explode(F.when(F.col("pos") >= 0, marked).otherwise(found)).alias("r")).select(doc, "r.*")

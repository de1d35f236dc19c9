"""Free citations as column expressions: the reference section of a text, its entries, their fields, and the cleaning of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, normalise_text, present, strip_latex, year_in

S = SPACE
#: Fixed values, in order: headings of the section, what ends it, what opens an entry, what follows a title, patterns of venues in a citation.
HEADINGS = [r"\bReferences\b", r"\bBibliography\b", rf"\bWorks{S}+Cited\b", rf"\bLiterature{S}+Cited\b", rf"\bCited{S}+References\b"]
ENDINGS = [rf"\n{S}*(?:Appendix|Acknowledgment|Supplementary)", rf"\n{S}*A\.{S}+[A-Z]"]
ENTRY = rf"\n{S}*(?:[\[(][0-9]+[\])]|[0-9]+\.){S}+"
AFTER_TITLE = [" In ", " Proc", " IEEE", " ACM", " Springer", " pages", ", vol"]
DOI = r"10\.[0-9]{4,}/[^ \t\r\n\]>]+"
ARXIV = rf"(?i)arXiv(?::|{S})*([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?)"
YEAR = r"\b(19[0-9][0-9]|20[0-2][0-9]|2030)\b"
PAGES = rf"(?i)(?:pages?|pp\.?){S}*([0-9]+[-–][0-9]+)"
RAW_VENUES = [
    (rf"(?i)In:{S}*([^,]+(?:Conference|Workshop|Symposium|Congress)[^,]*)", 1),
    (rf"(?i)Selected{S}+Areas{S}+in{S}+Cryptography[^,]*", 0),
    (rf"(?i)([A-Z][^,]*(?:Conference|Workshop|Symposium|Congress)[^,]*),{S}*[0-9]{{4}}", 1),
    (rf"(?i)\b([A-Z]{{3,8}}){S}+(?:19|20)[0-9]{{2}}\b", 1),
    (rf"(?i)Advances{S}+in{S}+Cryptology{S}*[-–—]{S}*[A-Z]+", 0),
    (rf"(?i)Journal{S}+of{S}+[^,]+", 0),
    (rf"(?i)IEEE{S}+[^,]+", 0),
    (rf"(?i)ACM{S}+[^,]+", 0),
]
GENERIC_VENUES = ["lecture notes in computer science", "proceedings", "acm", "ieee", "springer"]
MEETINGS = ["conference", "workshop", "symposium", "congress"]
SERIES_MEETINGS = ["sac", "asiacrypt", "crypto", "eurocrypt", "conference", "workshop", "symposium"]
CITATION = "struct<title:string,authors:array<string>,year:int,pages:string,doi:string,url:string>"


def _first(options: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{S}+|{S}+$", "")


def section(text: Column) -> Column:
    """What follows the first of the headings that the text holds, up to an ending; null without a heading."""
    out = F.lit(None).cast("string")
    for heading in reversed(HEADINGS):
        out = F.when(text.rlike(f"(?i){heading}"), F.regexp_extract(text, f"(?is){heading}(.*)", 1)).otherwise(out)
    first, second = (F.regexp_replace(out, f"(?is){e}.*", "") for e in ENDINGS)
    return strip(F.when(out.rlike(f"(?i){ENDINGS[0]}"), first).otherwise(second))


def entries(part: Column) -> Column:
    """The entries of a section: those of twenty characters or more, on one line each."""
    rows = F.transform(F.split(part, ENTRY), lambda e: F.regexp_replace(strip(e), f"{S}+", " "))
    return F.filter(rows, lambda e: F.char_length(e) >= 20)


def _title(raw: Column) -> Column:
    quoted = F.regexp_extract(raw, '"([^"]{20,})"', 1)
    second = F.split_part(raw, F.lit("."), F.lit(2))
    rest = strip(F.regexp_replace(raw, r"^[^.]+\.", ""))
    cut = [F.when(F.instr(rest, mark) > 16, F.regexp_replace(strip(F.substr(rest, F.lit(1), F.instr(rest, mark) - 1)), r"\.+$", "")) for mark in AFTER_TITLE]
    start = F.when(F.char_length(rest) > 15, strip(F.substring(rest, 1, 200)))
    named = F.when(quoted != "", strip(quoted)).when(F.char_length(second) > 15, strip(second))
    return _first([named, F.coalesce(*cut), start])


def _authors(raw: Column) -> Column:
    head = F.when(raw.contains("."), F.split_part(raw, F.lit("."), F.lit(1))).otherwise(F.substring(raw, 1, 100))
    names = F.transform(F.split(head, rf",{S}*|{S}+and{S}+"), strip)
    kept = F.filter(names, lambda n: F.char_length(n).between(3, 49) & n.rlike("[A-Z]"))
    return F.when(head.contains(" and "), kept).otherwise(F.array().cast("array<string>"))


def parse_citation(raw: Column) -> Column:
    """struct title, authors, year, pages, doi, url of a citation; null under fifteen characters. It never gives a venue."""
    arxiv = F.regexp_extract(raw, ARXIV, 1)
    out = F.struct(
        _title(raw).alias("title"), _authors(raw).alias("authors"), F.regexp_extract(raw, YEAR, 1).try_cast("int").alias("year"), F.regexp_extract(raw, PAGES, 1).alias("pages"),
        F.regexp_replace(F.regexp_extract(raw, DOI, 0), "[.,;]+$", "").alias("doi"), F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise("").alias("url"),
    )
    return F.when(F.char_length(raw) >= 15, out.cast(CITATION))


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(c, r"[{}|<>]", "")


def clean_title(c: Column) -> Column:
    return F.coalesce(strip(_unmarked(F.regexp_replace(normalise_text(strip_latex(c)), r"[.,:;]+$", ""))), F.lit(""))


def clean_authors(names: Column) -> Column:
    """Cleaned names of two characters or more with a letter; at the first `et al` that mark ends the list."""
    plain = F.transform(F.filter(names, present), lambda n: _unmarked(strip_latex(n)))
    rows = F.transform(F.split(normalise_text(F.array_join(plain, "|")), r"\|"), strip)
    at = F.array_position(F.transform(rows, lambda n: F.lower(n).contains("et al")), True)
    good = lambda a: F.filter(a, lambda n: (F.char_length(n) >= 2) & n.rlike(r"\p{L}"))
    out = F.when(at > 0, F.concat(good(F.slice(rows, F.lit(1), (at - 1).cast("int"))), F.array(F.lit("et al.")))).otherwise(good(rows))
    return F.coalesce(out, F.array().cast("array<string>"))


def _holds(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike("|".join(words))


def clean_venue(c: Column) -> Column:
    """Of a list of parts the meeting's name stands for the series around it; no leading `in`, no mark at the end."""
    v = normalise_text(c)
    parts = F.transform(F.split(v, rf",{S}*"), strip)
    named = F.filter(parts, lambda p: _holds(p, SERIES_MEETINGS) | (p.rlike(r"\b(20[0-9]{2}|19[0-9]{2})\b") & (F.char_length(p) > 10)))
    one = (
        F.when(F.lower(v) == GENERIC_VENUES[0], v)
        .when((F.size(parts) > 1) & _holds(parts[0], MEETINGS), parts[0])
        .when((F.size(parts) > 1) & F.lower(v).contains("lecture notes"), F.coalesce(F.try_element_at(named, F.lit(1)), v))
        .otherwise(v)
    )
    return F.coalesce(strip(_unmarked(F.regexp_replace(F.regexp_replace(one, rf"(?i)^(in{S}+|proceedings{S}+of{S}+)", ""), r"[.,:;]+$", ""))), F.lit(""))


def venue_in(raw: Column) -> Column:
    """The first pattern of a venue whose first match in the citation is longer than three characters."""
    found = [strip(F.regexp_extract(raw, pattern, group)) for pattern, group in RAW_VENUES]
    return F.coalesce(*[F.when(F.char_length(f) > 3, f) for f in found], F.lit(""))


def best_venue(venue: Column, raw: Column) -> Column:
    clean = clean_venue(venue)
    generic = clean.isNotNull() & _holds(clean, GENERIC_VENUES) & present(raw)
    return F.when(generic, _first([venue_in(raw), clean])).otherwise(clean)


def clean_pages(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(normalise_text(c), rf"(?i)pp?\.{S}*", ""), rf"(?i)pages?{S}*", "")
    return F.coalesce(strip(F.regexp_replace(p, "[-–—]+", "-")), F.lit(""))


def clean_doi(c: Column) -> Column:
    d = F.regexp_replace(strip(c), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.when(d.rlike(r"^10\.[0-9]+/."), d).otherwise("")


def clean_url(c: Column) -> Column:
    return F.when(strip(c).rlike("^https?://."), strip(c)).otherwise("")


def completeness(title: Column, authors: Column, venue: Column, year: Column, doi: Column, pages: Column) -> Column:
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    s = part(present(title), 0.4) + part(F.char_length(title) > 10, 0.1) + part(F.size(authors) > 0, 0.3) + part(F.size(authors) > 1, 0.1)
    s = s + part(present(venue), 0.2) + part(year.isNotNull(), 0.2) + part(present(doi), 0.1) + part(present(pages), 0.05)
    return F.round(F.least(F.lit(1.0), s), 6)


def parse_references(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """rows (raw_text, title, authors, venue, year, pages, doi, url; other columns stay) with cleaned fields, completeness, notes and valid.

    Rows without a title, or with neither authors nor venue, go unless keep_all; null fields become empty ones.
    """
    year = F.col("year").try_cast("int") if dict(rows.dtypes)["year"] == "string" else F.col("year").cast("int")
    years = [F.when(year.between(1900, 2030), year), *[year_in(F.col(c)) for c in ("title", "venue", "raw_text")]]
    out = rows.withColumns(
        {
            "title": clean_title(F.col("title")), "authors": clean_authors(F.col("authors")), "venue": best_venue(F.col("venue"), F.col("raw_text")), "year": F.coalesce(*years),
            "pages": clean_pages(F.col("pages")), "doi": clean_doi(F.col("doi")), "url": clean_url(F.col("url")),
        }
    )
    missing = [(~present(F.col("title")), "no title"), (F.size("authors") == 0, "no authors"), (F.col("year").isNull(), "no year")]
    out = out.withColumns(
        {
            "completeness": completeness(*[F.col(c) for c in ("title", "authors", "venue", "year", "doi", "pages")]),
            "notes": F.array_compact(F.array(*[F.when(c, note) for c, note in missing])),
            "valid": present(F.col("title")) & ((F.size("authors") > 0) | present(F.col("venue"))),
        }
    )
    return out if keep_all else out.where("valid")

"""Result pages of the preprint archive: HTML in, papers out.

Python only takes a page apart, in Arrow batches: for each result it hands over the link and the strings found at the places
where titles, authors, categories and abstracts stand. What those strings are is decided by column expressions (functions/eprint.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import eprint as E

#: The archive, its links, elements without an end, and where things stand, best first ("." class, "~" part of a class).
BASE = "https://eprint.iacr.org"
PAPER, PAPER_END = re.compile(r"/(\d{4}/\d+)"), re.compile(r"/(\d{4}/\d+)/?$")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
RESULTS = ["div.search-result", "div.paper-item", "div.eprint-item", "div~result", "div~paper", "div~entry", "li.search-result", "tr.paper-row"]
PLACES = {
    "titles": [".title", ".paper-title", ".entry-title", "h1", "h2", "h3", "h4", ".name", ".heading"],
    "author_texts": [".authors", ".author", ".by-author", "~author", "~by"],
    "categories": [".category", ".subject", ".classification", "~category", "~subject"],
    "descriptions": [".abstract", ".description", ".summary", "~abstract", "~description"],
}
MOST_RESULTS, CONTEXT_CHARS = 100, 1000
_LISTS = ["context", "titles", "author_texts", "italics", "categories", "descriptions", "lines"]
SCHEMA = "pos int, href string, link_text string, whole string, fallback boolean, " + ", ".join(f"{n} array<string>" for n in _LISTS)
_KIND = pa.struct([("pos", pa.int32()), ("href", pa.string()), ("link_text", pa.string()), ("whole", pa.string()), ("fallback", pa.bool_()), *[(n, pa.list_(pa.string())) for n in _LISTS]])


class Element:
    def __init__(self, name: str, at: dict[str, str], parent: Element | None):
        self.name, self.at, self.parent, self.inside = name, at, parent, []
        self.classes = at.get("class", "").split()

    def all(self, test: Callable[[Element], bool]) -> Iterator[Element]:
        """Elements inside this one that pass the test, in document order."""
        todo = [e for e in reversed(self.inside) if isinstance(e, Element)]
        while todo:
            e = todo.pop()
            if test(e):
                yield e
            todo += [x for x in reversed(e.inside) if isinstance(x, Element)]

    def strings(self, without: frozenset[int] | set[int] = frozenset()) -> Iterator[str]:
        todo: list[Element | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x is self or (x.name not in SILENT and id(x) not in without):
                todo += reversed(x.inside)

    def text(self, between: str = "") -> str:
        """The strings inside, stripped."""
        return between.join(filter(None, (s.strip() for s in self.strings())))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.top = self.here = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.inside.append(e)
        if tag not in VOID:
            self.here = e

    def handle_startendtag(self, tag, attrs):
        self.here.inside.append(Element(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        e = self.here
        while e.parent is not None and e.name != tag:
            e = e.parent
        if e.parent is not None:  # an end without a start means nothing
            self.here = e.parent

    def handle_data(self, data):
        self.here.inside.append(data)


def parse(html: str | None) -> Element:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.top


def selected(rule: str) -> Callable[[Element], bool]:
    name, kind, rest = re.fullmatch(r"(\w*)([.~]?)([\w-]*)", rule).groups()

    def test(e: Element) -> bool:
        named = not name or e.name == name
        return named and (not kind or (rest in e.classes if kind == "." else rest in " ".join(e.classes)))

    return test


def _context(text: str, number: str) -> list[str] | None:
    """The lines of a result: from its number up to the line that is the next one's; of the last, its first characters."""
    at = text.find(number)
    if at < 0:
        return None
    mine = text[at:]
    following = re.search(r"\n\d{4}/\d+\n", mine[1:])
    return (mine[: following.start() + 1] if following else mine[:CONTEXT_CHARS]).split("\n")


def _row(box: Element, link: Element, context: list[str] | None = None) -> dict:
    places = {n: [e.text() for rule in rules for e in box.all(selected(rule))] for n, rules in PLACES.items()}
    for n in ("categories", "descriptions"):  # the first element of each rule
        places[n] = [e.text() for rule in PLACES[n] for e in list(box.all(selected(rule)))[:1]]
    places["titles"] = [e.text() for rule in PLACES["titles"] for e in list(box.all(selected(rule)))[:1]]
    italics = [e.text() for e in box.all(lambda e: e.name in ("i", "em"))]
    return {"href": link.at["href"], "link_text": link.text(), "whole": box.text(" "), "lines": box.text("\n").split("\n"), "italics": italics, "context": context, "fallback": False, **places}


def read_page(html: str | None) -> list[dict]:
    """Results of a page, at most a hundred of them, then the links that serve where none of those is a paper."""
    top = parse(html)
    links = lambda e, rule: [a for a in e.all(lambda x: x.name == "a" and rule.search(x.at.get("href", "")) is not None)]
    rows = []
    results = next(top.all(selected("div.results")), None)
    taken: set[int] = set()
    for link in links(results, PAPER) if results else []:
        if link.at["href"].endswith(".pdf"):
            continue
        context = _context("".join(results.strings(taken)), PAPER.search(link.at["href"]).group(1))
        if context is not None:  # a link that served is no part of the text from then on
            taken.add(id(link))
            box = Element("div", {}, None)
            box.inside.append(link)
            rows.append((box, link, context))
    if not rows:
        boxes = next(filter(None, (list(top.all(selected(rule))) for rule in RESULTS)), [])
        rows = [(box, next(iter(links(box, PAPER_END)), None), None) for box in boxes]
    found = [_row(*r) for r in rows[:MOST_RESULTS] if r[1] is not None and PAPER_END.search(r[1].at["href"])]
    plain = [{"href": a.at["href"], "link_text": a.text(), "fallback": True} for a in links(top, PAPER_END)]
    return [{"pos": k, **r} for k, r in enumerate(found + plain)]


def preprint_results(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, pos, paper_id, title, authors, venue, year, url, category, description, source): the papers that a page of results names.

    Links alone, without authors, serve where no result is a paper. Null and empty pages give no rows; a paper named twice
    stays twice, as its page has it. A page is read in one task and stays in its row until its papers are taken out.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = pa.array([read_page(x) for x in part.column("html").to_pylist()], pa.list_(_KIND))
                yield pa.RecordBatch.from_arrays([part.column("page"), found], names=["page", "found"])

    kind = rows.schema["page"].dataType.simpleString()
    struct = "array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in re.split(r", (?=\w+ )", SCHEMA)) + ">>"
    read = rows.mapInArrow(run, f"page {kind}, found {struct}")
    papers = F.filter(F.transform("found", E.paper_of), E.is_paper)
    full, plain = F.filter(papers, lambda p: ~p["fallback"]), F.filter(papers, lambda p: p["fallback"])
    out = read.select(F.col("page").alias(page), F.posexplode(F.when(F.size(full) > 0, full).otherwise(plain)).alias("pos", "p"))
    return out.select(page, "pos", "p.*").drop("fallback")


def plain_results(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """The same columns from link patterns alone, in the JVM: no authors, category or description."""
    link = r"""(?is)href=["']([^"']*?/(?:[0-9]{4}/[0-9]+)/?)["'][^>]*>([^<]+)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("title"))
    rows = pages.select(page, F.posexplode(both).alias("pos", "m")).select(page, "pos", E.plain_paper(F.col("m.href"), F.col("m.title")).alias("p"))
    return rows.where((F.char_length("p.title") > 5) & (F.col("p.paper_id") != "")).select(page, "pos", "p.*").drop("fallback")

"""TEI documents, title repair and pages of results."""

import pyarrow as pa
from pyspark.sql import functions as F

from citegauge.__main__ import main
from citegauge.functions import eprint as E
from citegauge.functions.repair import repair_title
from citegauge.sources.preprint_pages import plain_results, preprint_results
from citegauge.sources.tei import READ_AT_ONCE, _read_batches, document_references, tei_references, two_passes

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><listBibl>
<biblStruct><analytic><title level="a" type="main" confidence="0.9">SPHINCS <hi>sup+/sup</hi> signatures &amp;amp; more</title>
<author><persName><forename type="first">Ada</forename><forename type="middle">B</forename><surname>Lovelace</surname></persName></author>
<author><persName>Plato</persName></author><author><orgName>None</orgName></author>
<idno type="DOI">10.1/a</idno></analytic><monogr><title level="j">Journal J</title><imprint><date type="published" when="2001-05"/>
<biblScope unit="volume">7</biblScope><biblScope unit="issue">2</biblScope><biblScope unit="page" from="1" to="9"/></imprint><idno type="ISBN">978</idno></monogr>
<ptr target="https://x.org/p"/><note type="raw_reference"> Lovelace. SPHINCS. </note></biblStruct>
<biblStruct><monogr><title level="j"/><title level="m">A book</title><imprint><date>in 1999 or so</date><biblScope unit="page">12</biblScope></imprint></monogr><idno>https://doi.org/10.2/b</idno></biblStruct>
<biblStruct><monogr><imprint><date when="n.d."/></imprint></monogr></biblStruct>
<biblStruct><note type="raw_reference">Only raw.</note><date type="published" when="soon"/><date when="1987"/></biblStruct>
</listBibl></text></TEI>"""


def test_tei_documents(spark):
    docs = spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None), (4, ""), (1, TEI)], "doc int, xml string").withColumn("title", F.lit("clash"))
    got = tei_references(docs).orderBy("doc", "pos").collect()
    assert [(r.doc, r.pos) for r in got] == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (1, 2)]
    a, b, c = got[0], got[2], got[4]
    assert a.title == "SPHINCS+ signatures & more" and a.authors == ["Ada Lovelace", "Plato"] and (a.venue, a.year, a.sure) == ("Journal J", 2001, 0.9)
    assert (a.volume, a.issue, a.pages, a.doi, a.isbn, a.url, a.raw_text) == ("7", "2", "1-9", "10.1/a", "978", "https://x.org/p", "Lovelace. SPHINCS.")
    assert (b.title, b.venue, b.year, b.pages, b.doi, b.authors) == ("A book", "A book", 1999, "12", "https://doi.org/10.2/b", [])
    assert (c.title, c.raw_text, c.year) == ("", "Only raw.", 1987)


def test_few_documents_are_read_at_once():
    n = 2 * READ_AT_ONCE + 5
    docs = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([TEI] * n), pa.array([None] * n, pa.string())], names=["doc", "xml", "rest"])
    got = list(_read_batches(iter([docs])))
    assert [b.column("doc").unique().to_pylist() for b in got] == [list(range(a, min(a + READ_AT_ONCE, n))) for a in range(0, n, READ_AT_ONCE)]
    assert sum(b.num_rows for b in got) == 3 * n


def test_text_stands_in_for_tei(spark):
    text = "Body.\nReferences\n[1] A. Lovelace and B. Hopper. A long enough title of a paper. In Proc. of X, 1999.\n[2] too short\n"
    docs = spark.createDataFrame([(1, TEI, text), (2, "<TEI/>", text), (3, None, None), (4, "x", "no such part")], "doc int, xml string, text string")
    got = document_references(docs).orderBy("doc", "pos").collect()
    assert [(r.doc, r.extractor) for r in got] == [(1, "tei")] * 3 + [(2, "text")]
    assert got[3].title == "Lovelace and B" or got[3].year == 1999


def test_two_passes(spark):
    kind = "ref_id int, title string, authors array<string>"
    first = spark.createDataFrame([(1, "T", ["Eve Forger"]), (2, "T", []), (3, "T", ["Ada"]), (5, "", [])], kind)
    second = spark.createDataFrame([(1, "Title", ["Ada"]), (2, "Title", ["Ada"]), (3, "Title", ["Ada"]), (4, "", []), (5, "Title", ["Ada"])], kind)
    got = {r.ref_id: (r.title, r.authors, r.consolidated_authors) for r in two_passes(first, second, ["ref_id"]).collect()}
    assert got == {1: ("Title", ["Eve Forger"], ["Ada"]), 2: ("Title", ["Ada"], None), 3: ("Title", ["Ada"], None), 5: ("Title", ["Ada"], None)}


def test_title_repair(spark):
    cases = [
        ("SPHINCS <sup>+</sup> x", "SPHINCS+ x"), ("SPHINCS sup+/sup x", "SPHINCS+ x"), ("SPHINCS <>+<> x", "SPHINCS+ x"), ("A &amp; B &eacute;", "A & B é"), ("a<br/>b <u>c</u>", "ab c"),
        ("<i>In</i>  a <em>box</em> ", "In a box"), ("", ""), (None, None),
    ]
    got = spark.createDataFrame(cases, "t string, want string").select(repair_title(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_closed_entities(spark, tmp_path):
    """Titles cut within an entity: the query decodes what a semicolon ends, as its SQL does; the operator also takes old names without one."""
    from oracle import TABLES, assert_same

    from citegauge.plans import QUERIES, SQL

    rows = [(k, f"<title>{t}</title>") for k, t in enumerate(["a &amp;&amp", "b &amp", "c &ampx", "d &#233", "e &lt;&gt", "f &amp;amp;", "g &", "h &quot;x"])]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    for t in TABLES:
        (pages if t == "pages" else spark.range(0)).toPandas().to_parquet(f"{tmp_path}/{t}.parquet")
    got = assert_same(spark, QUERIES["title_repair_html"], SQL["title_repair_html"], str(tmp_path))
    assert "a &&amp" in {t.split("+")[0] for t in got["title"]}
    assert pages.where("page_id = 1").select(repair_title(F.lit("b &amp")).alias("t")).first().t == "b &"


RESULTS = """<html><div class="results">
<div><a href="/2020/123">2020/123</a>
<span>(<a href="/2020/123.pdf">PDF</a>)</span>
Last updated: 2020-02-03

A new construction of lattices
<span>Ada Lovelace, Grace Hopper</span>

Public-key cryptography

We show things.
<a href="/2019/7">2019/7</a>
(PDF)
Last updated: 2019-02-03

On hashes
Foundations
Bob Smith and Eve Jones
</div></div></html>"""
BOXES = """<div class="paper-item"><a href="https://eprint.iacr.org/2018/55/">2018/55</a><h3>Another title of note PDF</h3><p class="authors">by Ada Lovelace (X) and Grace Hopper</p>
<p class="subject">Protocols</p><p class="abstract">%s</p></div><div class="paper-item"><a href="/x">no paper</a></div>""" % ("abc " * 200)
LINKS = '<script>var a="<a href=/2001/1>not a link at all</a>"</script><ul><li><a href="/2017/9">2017/9 A linked title 2017-01-02.</a></li><li><a href="/2017/8">x</a></li></ul>'


def test_pages_of_results(spark):
    pages = spark.createDataFrame([(1, RESULTS), (2, BOXES), (3, LINKS), (4, None), (5, ""), (6, "<p>nothing")], "page_id int, html string")
    got = {(r.page_id, r.pos): r for r in preprint_results(pages).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a.paper_id, a.title, a.authors, a.year, a.category, a.url) == ("2020/123", "A new construction of lattices", ["Ada Lovelace", "Grace Hopper"], 2020, "Public-key cryptography", "https://eprint.iacr.org/2020/123")
    assert (b.paper_id, b.title, b.authors, b.category) == ("2019/7", "On hashes", [], "Foundations")
    assert (c.paper_id, c.title, c.authors, c.category, len(c.description)) == ("2018/55", "Another title of note", ["Ada Lovelace", "Grace Hopper"], "Protocols", 500)
    assert (d.paper_id, d.title, d.authors, d.venue, d.source) == ("2017/9", "A linked title", [], E.VENUE, "IACR")
    plain = {(r.page_id, r.paper_id, r.title) for r in plain_results(pages).collect()}
    assert plain == {(3, "2017/9", "A linked title")}


def test_strings_of_results(spark):
    def one(fn, *texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn(F.col("t"))).collect()]

    assert one(E.looks_like_author_line, "Ada Lovelace", "Ada", "Ada, b", "Hash Functions and More", "x" * 101) == [True, False, True, False, False]
    assert one(E.looks_like_title, "A new title", "Ada Lovelace", "ALL CAPS", "abc") == [True, False, False, False]
    assert one(E.looks_like_author_text, "Ada Lovelace", "We Show it", "no names", "A b " * 20) == [True, False, False, False]
    assert one(E.split_authors, "by Ada L. {x} and Bob, C", "Ada, 12, Bob", "One two three four five six seven", "Ada (UK)", "", None) == [["Ada L.", "Bob, C"], ["Ada", "Bob"], [], ["Ada"], [], []]
    assert one(E.authors_in_mixed_text, "Ada LovelaceFoundations abstract") == [["Ada Lovelace"]]
    assert one(E.clean_preprint_title, "PDF 2020/1  A title 2020-01-02 .. ", "Download") == ["A title", ""]
    got = one(E.title_and_authors, "On the hash of things. Ada Lovelace Foundations", "on the hash of Ada Lovelace", "short")
    assert [(g.title, g.authors) for g in got] == [("On the hash of things", ["Ada Lovelace"]), ("on the hash of", ["Ada Lovelace"]), ("short", [])]


def test_files_of_both_kinds(spark, tmp_path):
    paper = "paper_id int, source string, citations int, title string, authors array<string>, venue string, year int, doi string"
    spark.createDataFrame([(7, "dblp", 3, "SPHINCS+ signatures & more", ["Ada Lovelace"], "Journal J", 2001, "10.1/a")], paper).write.parquet(str(tmp_path / "papers"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tei").write_text(TEI)
    (tmp_path / "in" / "b.txt").write_text("1. ???\n2. Zed Nobody and Eva Li. A title that nobody has written. 1999.\n")
    for kind in ("json", "txt"):
        main(["verify", str(tmp_path / "in"), "--papers", str(tmp_path / "papers"), "--format", kind, "--out", str(tmp_path / kind)])
    got = [(r.file[-5:], r.pos, r["class"], r.error) for r in spark.read.json(str(tmp_path / "json")).orderBy("file", "pos").collect()]
    unread = "Failed to parse reference"
    assert [g[:2] for g in got] == [("a.tei", 0), ("a.tei", 1), ("a.tei", 2), ("b.txt", 0), ("b.txt", 1)]
    assert [g[3] for g in got] == [None, None, unread, unread, None] and got[2][2] == got[3][2] == "inconclusive"
    lines = "".join(f.read_text() for f in sorted((tmp_path / "txt").glob("part-*")))
    assert lines.index("SPHINCS+ signatures & more") < lines.index("Only raw.") < lines.index("1. ???") < lines.index("A title that nobody")

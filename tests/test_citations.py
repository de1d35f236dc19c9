import itertools

import pytest
from pyspark.sql import functions as F

from citegauge.__main__ import cite, main
from citegauge.functions import citations as C
from citegauge.operators import context as X
from citegauge.operators import link as L
from citegauge.operators import report as R
from citegauge.operators.consensus import consensus
from citegauge.operators.verify import verify

PAPER = "paper_id long, source string, title string, authors array<string>, year int, venue string, doi string, citations long"
REF = "ref_id long, title string, authors array<string>, year int, venue string, doi string"
PAPERS = [
    (1, "dblp", "A distributed graph algorithm for sorting", ["Ada Lovelace", "Grace Hopper"], 2001, "VLDB", "10.1000/a", 4),
    (2, "pubmed", "Cancer therapy in clinical trials", ["Eva Li"], 2010, "Nature", "10.1000/b", 9),
]
REFS = [(1, "A distributed graph algorithm for sorting", ["Ada Lovelace", "Grace Hopper"], 2001, "VLDB", ""), (2, "Nothing like it", ["Zed Nobody"], None, "", None), (3, None, None, None, None, None), (4, "Nothing", [], 1999, "", "")]


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "title", "authors", "year", "pages", "doi"),
    [
        ('Ada Lovelace and Grace Hopper. "On the sorting of long tables". In VLDB, 2001, pp. 1-9. doi:10.1000/ab.', "On the sorting of long tables", ["Ada Lovelace", "Grace Hopper"], 2001, "1-9", "10.1000/ab"),
        ("Ada Lovelace, Grace Hopper and Eva Li. A title that is long enough. 1850, 1999.", "A title that is long enough", ["Ada Lovelace", "Grace Hopper", "Eva Li"], 1999, "", ""),
        ("Li. Short. A name of some length In Proceedings, 2040", "Short. A name of some length", [], None, "", ""),
        ("no dots at all and No Title here either", "no dots at all and No Title here either", ["No Title here either"], None, "", ""),
    ],
)
def test_parse(spark, raw, title, authors, year, pages, doi):
    r = one(spark, raw, C.parse_citation)
    assert (r.title, r.authors, r.year, r.pages, r.doi) == (title, authors, year, pages, doi)


def test_parse_edges(spark):
    assert one(spark, "too short", C.parse_citation) is None
    assert one(spark, None, C.parse_citation) is None
    assert one(spark, "A paper of note, arXiv: 2101.01234v2, by us", C.parse_citation).url == "https://arxiv.org/abs/2101.01234v2"
    assert one(spark, "x" * 200_000, C.parse_citation).title == "x" * 200


def test_sections(spark):
    text = "Intro.\nReferences\n[1] Ada Lovelace. A first long title\n goes on.\n[2] short\n(3) Grace Hopper. A second long title.\n4. Eva Li. A third long title here.\nA. Proofs\nrest"
    got = one(spark, text, lambda c: C.entries(C.section(c)))
    assert got == ["[1] Ada Lovelace. A first long title goes on.", "Grace Hopper. A second long title.", "Eva Li. A third long title here."]
    assert one(spark, "no heading", C.section) is None and one(spark, "", C.section) is None and one(spark, None, C.section) is None
    # the order of the headings counts, not that in the text
    assert one(spark, "Bibliography\nfirst\nReferences\nsecond", C.section) == "second"


def test_cleaning(spark):
    assert one(spark, "  {A} \\emph{new} title.;", C.clean_title) == "A new title"
    assert one(spark, ["Ada {L}", "", None, "x", "B et al.", "Eva Li"], C.clean_authors, "array<string>") == ["Ada L", "et al."]
    assert one(spark, [], C.clean_authors, "array<string>") == [] and one(spark, None, C.clean_authors, "array<string>") == []
    assert one(spark, "International Conference on Things, ACM, 2001", C.clean_venue) == "International Conference on Things"
    assert one(spark, "Lecture Notes in Computer Science, CRYPTO 2001, Springer", C.clean_venue) == "CRYPTO 2001"
    assert one(spark, "Proceedings of Things.", C.clean_venue) == "Things"
    assert one(spark, "pp. 1--9", C.clean_pages) == "1-9"
    assert one(spark, "https://dx.doi.org/10.1/x", C.clean_doi) == "10.1/x" and one(spark, "none", C.clean_doi) == ""
    assert one(spark, "ftp://x", C.clean_url) == ""
    assert one(spark, "Ada. T. In: Workshop on Sorting, 2001", C.venue_in) == "Workshop on Sorting"


def test_parse_references(spark):
    kind = "raw_text string, title string, authors array<string>, venue string, year int, pages string, doi string, url string"
    rows = [("r 2003", "A title of note", ["Ada L"], "VLDB", None, None, None, None), (None, None, None, None, None, None, None, None)]
    got = C.parse_references(spark.createDataFrame(rows, kind), keep_all=True).collect()
    assert [r.valid for r in got] == [True, False]
    assert got[0].year == 2003 and got[0].completeness == 1.0 and got[0].notes == []
    assert got[1].notes == ["no title", "no authors", "no year"] and got[1].completeness == 0
    assert C.parse_references(spark.createDataFrame(rows, kind)).count() == 1
    assert C.parse_references(spark.createDataFrame([], kind)).count() == 0


def test_publishers(spark):
    cases = {"Springer-Verlag": "Springer", "The Elsevier Ltd group": "Elsevier", "Acme Books, Inc.": "Acme Books", "Foo GmbH": "Foo", "": "", None: None, "Foo Ltd., Inc": "Foo", "Foo GmbH AG": "Foo GmbH", "Foo AG GmbH": "Foo"}
    for name, want in cases.items():
        assert one(spark, name, X.publisher_name) == want, name


def test_books(spark):
    rows = [("Handbook of Sorting", "", 2001, "Handbook of Sorting. 2nd edition. ISBN 0123456789. chapter 3"), ("A paper", "VLDB", 2001, "A paper, VLDB"), (None, None, None, None)]
    got = spark.createDataFrame(rows, "t string, v string, y int, r string").select(X.book_signs(*[F.col(c) for c in "tvyr"]).alias("s")).collect()
    assert [r.s for r in got] == [["isbn", "edition", "title", "no venue", "chapter"], [], []]


def test_context(spark):
    papers = spark.createDataFrame(PAPERS, PAPER)
    rank = lambda *context: X.search_rank(X.boosted(papers, *context), F.lit(0.5), *context)
    got = {r.paper_id: r for r in rank("computer-science").collect()}
    # dblp 1.8; algorithm, distributed, graph, sorting
    assert set(got) == {1} and got[1].boost == pytest.approx(1.8 + 4 * 0.15) and got[1].score == 1.0
    assert {r.paper_id for r in rank("biomedical").collect()} == {2}
    assert rank().count() == 2
    assert [r.paper_id for r in cite(papers, "a distributed graph algorithm").collect()][0] == 1


def plain_consensus(kind, conf, ai, ac, good, red, said):
    n, m = len(good), len(red)
    db = conf
    if kind == "authentic":
        db += 0.1 if conf > 0.8 else 0.05 if conf > 0.6 else 0
    elif kind in ("suspicious", "fabricated") and conf < 0.6:
        db *= 0.8
    db = min(1.0, db)
    ev = ac + {0: 0, 1: 0.05, 2: 0.1}.get(n, 0.15)
    if ai:
        ev -= {0: 0, 1: 0.05}.get(m, 0.1)
    ev = max(0.0, min(1.0, ev * (0.95 if ac > 0.9 else 1)))
    flags = " ".join(red)
    says = "authentic" if ai else "author_manipulation" if "author" in flags else "fabricated" if "fabricat" in flags else "suspicious"
    w = 0.15 if db > 0.8 else 0.25 if db > 0.6 else 0.30 if db > 0.4 else 0.35
    if kind == says:
        if kind != "authentic":
            return kind, min(0.95, conf + min(0.08, (db + ev) * 0.06))
        most, part = (0.15, 0.12) if db > 0.8 else (0.10, 0.08) if db > 0.6 else (0.05, 0.05)
        return kind, min(0.99, conf + min(most, (db + ev) * part))
    if says == "authentic":
        need, ceiling, up = {"fabricated": (0.95, 0.4, "suspicious"), "author_manipulation": (0.90, 0.5, "suspicious")}.get(kind, (0.80, 0.6, "authentic"))
        bad = [db > ceiling, n < 4 if ac > 0.8 else n < 3 if ac > 0.7 else False, m > 0, ev < 0.95 if conf < 0.3 else conf < 0.6 and ev < 0.9, 0 < said < 100, ac - conf < 0.5, not any("dblp" in g or "openalex" in g for g in good)]
        if any(bad):
            return kind, conf * 0.85
        if ev < need:
            return kind, conf * 0.9
        part = min(0.4, ev * 0.6)
        return up, (1 - part) * conf * (0.8 if db > 0.3 else 0.7) + part * ac
    if kind == "authentic":
        if db < 0.5:
            if ev > 0.85 * 0.8 and m >= 2:
                return "author_manipulation" if "author" in red[0] else "fabricated" if "fabricat" in red[0] else "suspicious", 0.6 + (ev - 0.85) * 0.5
            return "suspicious", conf * (0.7 if ev > 0.85 * 0.9 and m else 0.8)
        if db >= 0.8:
            if ev > 0.85 * 1.1 and m >= 3:
                return "suspicious", conf * 0.75
            return ("suspicious", conf * 0.85) if ev > 0.85 and m >= 2 else (kind, conf * 0.95)
        if ev > 0.85 and m >= 2:
            return "suspicious", conf * 0.75
        return ("suspicious", conf * 0.85) if ev > 0.85 * 0.8 and m else (kind, conf * 0.9)
    if db > ev + 0.15:
        return kind, (1 - w) * conf + w * ac * 0.5
    if ev > db + 0.3:
        return says, (1 - w) * conf * 0.6 + w * ac
    return "suspicious" if "suspicious" in (kind, says) else kind, (1 - w) * conf + w * ac * 0.6


def test_consensus(spark):
    good, red = ["in dblp", "a", "b", "openalex entry"], ["author mismatch", "fabricated venue", "odd"]
    options = itertools.product(["authentic", "suspicious", "fabricated", "author_manipulation", "inconclusive"], [0.11, 0.37, 0.47, 0.57, 0.72, 0.91], [True, False], [0.31, 0.73, 0.86, 0.97], [0, 1, 3, 4], [0, 1, 2, 3], [0, 50, 150])
    cases = [(k, *c[:4], good[: c[4]], red[: c[5]], "x" * c[6]) for k, c in enumerate(options)]
    rows = spark.createDataFrame([(c[0], c[1], c[2]) for c in cases], "ref_id long, class string, confidence double")
    verdicts = spark.createDataFrame([(c[0], *c[3:]) for c in cases], "ref_id long, authentic boolean, ai_confidence double, good array<string>, red array<string>, reasoning string")
    got = {r.ref_id: r for r in consensus(rows, verdicts).collect()}
    wrong = []
    for c in cases:
        kind, value = plain_consensus(*c[1:5], c[5], c[6], len(c[7]))
        r = got[c[0]]
        if r.final_class != kind or abs(r.final_confidence - value) > 2e-6:
            wrong.append((c, kind, value, r.final_class, r.final_confidence))
    assert not wrong, (len(wrong), wrong[:3])
    alone = consensus(rows.limit(3), verdicts.where("false")).collect()
    assert all((r.final_class, r.final_confidence) == (r["class"], r.confidence) for r in alone) and len(alone) == 3
    nulls = spark.createDataFrame([(0, None, None, None, None, None)], verdicts.schema)
    assert consensus(rows.where("ref_id = 0"), nulls).first().final_class == "suspicious"


def test_verify_and_report(spark):
    papers, refs = spark.createDataFrame(PAPERS, PAPER), spark.createDataFrame(REFS, REF)
    for method in ("words", "exact"):
        rows = verify(refs, papers, method=method)
        assert {r.ref_id: r["class"] for r in rows.collect()} == {1: "authentic", 2: "inconclusive", 3: "inconclusive", 4: "inconclusive"}
    blocks = {r.ref_id: r.block for r in R.report(verify(refs, papers)).collect()}
    assert "[VERIFIED] AUTHENTIC" in blocks[1] and "Add the DOI: 10.1000/a" in blocks[1] and "Best match (dblp)" in blocks[1] and "Similarity: 100.0%" in blocks[1]
    assert "[INCONCLUSIVE]" in blocks[2] and "Add the venue." in blocks[2] and "Best match" not in blocks[2]
    assert verify(spark.createDataFrame([], REF), papers).count() == 0
    assert verify(refs, spark.createDataFrame([], PAPER)).where("class = 'inconclusive'").count() == 4


def test_verify_with_verdicts(spark):
    schema = "title string, authors array<string>, venue string, year int, doi string"
    refs = spark.createDataFrame([(1, "A plain title of a paper", ["Ada Lovelace"], "VLDB", 2000, ""), (2, "Nothing like it", ["Bob Other"], "ICML", 1999, "")], "ref_id int, " + schema)
    papers = spark.createDataFrame([(10, "dblp", 3, "A plain title of a paper", ["Ada Lovelace"], "VLDB", 2000, "")], "paper_id int, source string, citations int, " + schema)
    verdicts = spark.createDataFrame([(1, False, 0.95, [], ["fabricated venue", "odd year", "author mismatch"], "because " * 20)], "ref_id int, authentic boolean, ai_confidence double, good array<string>, red array<string>, reasoning string")
    plain = {r.ref_id: r for r in verify(refs, papers).collect()}
    told = {r.ref_id: r for r in verify(refs, papers, verdicts=verdicts).collect()}
    assert [(told[k].catalogue_class, told[k].catalogue_confidence) for k in (1, 2)] == [(plain[k]["class"], plain[k].confidence) for k in (1, 2)]
    assert plain[1]["class"] == "authentic" and told[1].confidence < plain[1].confidence and told[2]["class"] == plain[2]["class"]


def test_plain_citation(spark):
    rows = [("T", ["A"], "V", 2001), ("T", ["A", "B", "C"], None, None), ("T", ["A", "B", "C", "D"], "", 1999), ("T", [], "V", 1)]
    got = spark.createDataFrame(rows, "t string, a array<string>, v string, y int").select(R.plain_citation(*[F.col(c) for c in "tavy"]).alias("c")).collect()
    assert [r.c for r in got] == ["A. T. V. 2001", "A, B and C. T", "A et al.. T. 1999", "T. V. 1"]


def test_full_report(spark):
    papers = spark.createDataFrame(PAPERS, PAPER)
    refs = papers.limit(1).select(F.lit(1).alias("ref_id"), "title", "authors", "year", "venue", "doi")
    pairs = refs.select("ref_id").crossJoin(papers.select("paper_id")).withColumn("rank", F.lit(3))
    verdicts = spark.createDataFrame([(1, False, 0.75, "x" * 300, ["odd year"])], "ref_id int, authentic boolean, ai_confidence double, reasoning string, red array<string>")
    rows = verify(refs, papers).withColumn("raw_text", F.lit("as it came"))
    block = R.full_report(rows, L.score(pairs, refs, papers), verdicts).first().block
    assert "Issue: " in block and "Found " in block and "  1. " in block and "SUSPICIOUS/FAKE (75.0% confidence)" in block and "x" * 200 + "..." in block and "Red flags: odd year" in block and block.endswith("as it came")
    lines = [r.line for r in R.header(L.summary(rows)).orderBy("ord").collect()]
    assert lines[1] == "Verification of references" and lines[3] == "References: 1" and len(lines) == 10


def test_rigor_is_checked():
    assert L.rigor_of("Strict") == L.RIGOR["strict"] and L.rigor_of(L.Rigor(similarity=0.6)).similarity == 0.6
    assert L.faults(L.Rigor(similarity=1.5)) and L.faults(L.Rigor(), {"title": 0.9, "author": 0.3}) and not L.faults(L.Rigor())
    for wrong in ("harsh", L.Rigor(manipulation=-1)):
        with pytest.raises(ValueError):
            L.rigor_of(wrong)


def test_command_line_of_one_reference(spark, tmp_path, capsys):
    spark.createDataFrame(PAPERS, PAPER).write.parquet(str(tmp_path / "papers"))
    text = "1. Ada Lovelace and Grace Hopper. A distributed graph algorithm for sorting. In VLDB, 2001."
    main(["verify", text, "--text", "--papers", str(tmp_path / "papers"), "--threshold", "0.3", "--fraud", "0.9", "--multi-database", "--searched", "--out", str(tmp_path / "out.txt")])
    said = "".join(f.read_text() for f in sorted((tmp_path / "out.txt").glob("part-*")))
    assert said.index("Verification of references") < said.index("Classification: ") and "distributed graph" in said and "As printed:" in said and capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["verify", text, "--text", "--papers", "x", "--threshold", "3", "--out", "y"])


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(PAPERS, PAPER).write.parquet(str(tmp_path / "papers"))
    (tmp_path / "refs.txt").write_text("1. Ada Lovelace and Grace Hopper. A distributed graph algorithm for sorting. In VLDB, 2001.\n2. Zed Nobody and Eva Li. A title that nobody has written. 1999.\n")
    main(["verify", str(tmp_path / "refs.txt"), "--papers", str(tmp_path / "papers"), "--format", "txt", "--out", str(tmp_path / "out")])
    assert capsys.readouterr().out.count("\n") >= 6
    assert "distributed graph" in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    main(["cite", "cancer therapy", "--papers", str(tmp_path / "papers"), "--context", "biomedical", "--out", str(tmp_path / "cited")])
    assert spark.read.json(str(tmp_path / "cited")).first().paper_id == 2

import difflib
import inspect

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from citegauge.functions import names as N
from citegauge.functions import text as T
from citegauge.operators import link as L
from citegauge.operators.verify import verify
from citegauge.plans import QUERIES, SQL
from citegauge.sources import bibliography as B

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "verify" in e.queries()


def test_sequence_ratio_is_the_library_matcher(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("same", "same"), ("", "x"), (None, "x"), ("ab" * 150, "ba" * 150)]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.sequence_ratio(F.col("a"), F.col("b"))).collect()
    want = [0.0 if not a or not b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [r[0] for r in got] == pytest.approx(want)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Ada Lovelace", "Ada Lovelace", 1.0),
        ("A. Lovelace", "Ada Lovelace", 0.85),
        ("Lovelace, Ada", "Ada Lovelace", 1.0),
        ("Ada Lovelace 0001", "Ada Lovelace", 1.0),
        ("Lovelace", "Ada Lovelace", 0.6),
        ("Bob Lovelace", "Ada Lovelace", 0.4),
        ("Ada Byron", "Ada Lovelace", 0.0),
        ("Sergey van der Berg", "Sergei van der Berg", 0.95),
    ],
)
def test_names(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(N.compare_names(F.col("a"), F.col("b"))).first()[0]
    assert got == want


def test_author_lists(spark):
    rows = [(["Ada Lovelace", "Grace Hopper", "Eve Intruder"], ["Ada Lovelace", "G. Hopper"]), ([], ["Ada Lovelace"]), (["Ada Lovelace"], ["Ada Lovelace", "Grace Hopper"])]
    got = spark.createDataFrame(rows, "r array<string>, p array<string>").select(N.compare_lists(F.col("r"), F.col("p")).alias("c")).select("c.*").collect()
    assert got[0].overall == pytest.approx((1 + 0.85) / 3 - 0.1) and got[0].injection and not got[0].removal
    assert got[1].overall == 0 and got[1].matched == 0
    assert got[2].overall == pytest.approx(0.5 - 0.05) and got[2].removal


def test_text_functions(spark):
    df = spark.createDataFrame([("A \\emph{new} $x$ title, doi: 10.1/Ab see 1999", "https://ieeexplore.ieee.org/x")], "t string, u string")
    r = df.select(T.strip_latex(F.col("t")).alias("l"), T.doi_in(F.col("t")).alias("d"), T.year_in(F.col("t")).alias("y"), T.publisher_of(F.col("u")).alias("p"), T.truncate(F.col("t"), 8).alias("s")).first()
    assert r.l.startswith("A new x title") and r.d == "10.1/Ab" and r.y == 1999 and r.p == "IEEE" and r.s == "A \\em..."
    assert spark.createDataFrame([("Ã¼́–x\n",)], "t string").select(T.normalise_text(F.col("t"))).first()[0] is not None


def test_assembly(spark):
    got = B.assemble(spark.createDataFrame([("f", "\n1. one\n goes on\n- two\n"), ("g", "no marks\nat all"), ("h", "")], "file string, text string")).orderBy("file", "pos").collect()
    assert [(r.file, r.pos, r.raw_text) for r in got] == [("f", 0, "1. one goes on"), ("f", 1, "- two"), ("g", 0, "no marks at all")]


def test_normalisers(spark):
    rows = [
        (B.from_openalex, '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/a","title":"T","publication_year":2001,"cited_by_count":3,"authorships":[{"author":{"display_name":"Ada L"}}]}'),
        (B.from_crossref, '{"DOI":"10.1/a","title":["T"],"author":[{"given":"Ada","family":"L"}],"created":{"date-parts":[[2001,2]]}}'),
        (B.from_dblp, '{"key":"k","title":"T.","year":"2001","authors":{"author":{"text":"Ada L"}}}'),
        (B.from_semantic_scholar, '{"paperId":"p","title":"T","year":2001,"authors":[{"name":"Ada L"}]}'),
        (B.from_arxiv, '<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/1</id><title>T</title><author><name>Ada L</name></author><published>2001-01-01</published></entry>'),
    ]
    for fn, raw in rows:
        r = spark.createDataFrame([(raw,)], "raw string").select(fn(F.col("raw")).alias("p")).select("p.*").first()
        assert (r.title, r.authors, r.year) == ("T", ["Ada L"], 2001), fn
    tei = '<biblStruct xmlns="http://www.tei-c.org/ns/1.0"><analytic><title level="a">T</title><author><persName><forename>Ada</forename><surname>L</surname></persName></author></analytic><monogr><title level="j">J</title><imprint><date when="2001-05"/><biblScope unit="page" from="1" to="9"/></imprint></monogr></biblStruct>'
    r = spark.createDataFrame([(tei,)], "raw string").select(B.from_tei(F.col("raw")).alias("p")).select("p.*").first()
    assert (r.title, r.authors, r.venue, r.year, r.pages) == ("T", ["Ada L"], "J", 2001, "1-9")


def test_greedy_dedupe(spark):
    rows = [(1, 1, "a", "x", 1), (1, 2, "A ", "y", 1), (1, 3, "b", "x", 1), (1, 4, "c", "y", 2), (2, 1, "a", "x", 1)]
    got = L.distinct_keys(spark.createDataFrame(rows, "ref_id int, paper_id int, p_title string, p_doi string, rank int")).collect()
    assert sorted((r.ref_id, r.paper_id) for r in got) == [(1, 1), (1, 4), (2, 1)]


def test_all_candidates_are_scored(spark):
    schema = "title string, authors array<string>, venue string, year int, doi string"
    refs = spark.createDataFrame([(1, "A hot title", ["Ada Lovelace"], "VLDB", 2000, "")], "ref_id int, " + schema)
    rows = [(k, "dblp", 0, "a hot title", ["Ada Lovelace" if k == 30 else f"Bob Other{k}"], "VLDB", 2000 if k == 30 else 1990, "") for k in range(1, 31)]
    papers = spark.createDataFrame(rows, "paper_id int, source string, citations int, " + schema)
    assert L.block(refs, papers).count() == 30
    for method in ("words", "exact"):
        assert verify(refs, papers, method=method).first().paper_id == 30


def test_blocking_has_no_bound():
    assert list(inspect.signature(L.block).parameters) == ["refs", "papers"]

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from citegauge.functions import eprint as E
from citegauge.functions import names as N
from citegauge.functions import verdicts as V
from citegauge.operators import evidence as O
from citegauge.operators import link as L
from citegauge.operators.context import book_signs
from citegauge.operators.merge import merge_similar, similar_groups
from citegauge.operators.report import report
from citegauge.operators.verify import verify
from citegauge.sources import bibliography as B

REF = "ref_id long, title string, authors array<string>, year int, venue string, doi string"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_names_and_venues(spark):
    for a, b, want in [("José Müller", "Jose Muller", 1.0), ("Dr. Ada Lovelace", "Ada Lovelace", 1.0), ("Hossein Wang", "Hosein Wong", 0.95), ("Zoë Nguyễn", "Zoe Nguyen", 1.0)]:
        assert spark.createDataFrame([(a, b)], "a string, b string").select(N.compare_names(F.col("a"), F.col("b"))).first()[0] == want
    for v, norm, canon in [("Proceedings of the 10th Fast Software Encryption, 2003", "fast software encryption", "fse"), ("IEEE S&P", "ieee s&p", "sp"), ("2019", "", "crypto"), ("Some Place", "some place", "some place")]:
        assert (one(spark, v, N.normalise_venue), one(spark, v, N.canonical_venue)) == (norm, canon)
    pairs = [("FSE 2003", "Fast Software Encryption", 0.95), ("", "x", 0.0), (None, "x", 0.0), ("Journal of Odd Widgets", "Widgets and Odd Journal", 0.9), ("abcd", "abxd", 0.75)]
    got = spark.createDataFrame(pairs, "a string, b string, w double").select(N.venue_similarity(F.col("a"), F.col("b"), exact=True), "w").collect()
    assert [r[0] for r in got] == pytest.approx([r[1] for r in got])


def test_reordered_lists(spark):
    rows = [(["Ada Li", "Bo Wu"], ["Bo Wu", "Ada Li"]), (["Ada Li"], ["Ada Li"]), (["Zed No"], ["Ada Li"]), (["Ada Li"], []), (None, None)]
    got = spark.createDataFrame(rows, "r array<string>, p array<string>").select(N.compare_lists(F.col("r"), F.col("p")).alias("c")).select("c.*").collect()
    assert [bool(r.reordered) for r in got] == [True, False, False, False, False]
    assert [bool(r.first_off) for r in got] == [True, False, True, False, False] and got[3].injection


def test_doi_metadata_and_statistics(spark):
    refs = spark.createDataFrame([(1, "A long title", ["Ada Li"], 2001, "VLDB", "10.1/a"), (2, "Another", ["Eva No"], 2001, "", "10.1/a"), (3, "A long title", ["Ada Li"], 2005, "VLDB", "10.1/a"), (4, "x", [], None, "", "10.9/z"), (5, None, None, None, None, None)], REF)
    registry = spark.createDataFrame([("https://doi.org/10.1/a", "A long title", ["Li, Ada"], 2001, "VLDB"), (None, "t", [], 1, "")], "doi string, title string, authors array<string>, year int, venue string")
    got = {r.ref_id: (r.resolves, r.matches, r.boost) for r in O.doi_metadata(refs, registry, exact=True).collect()}
    assert got == {1: (True, True, 0.2), 2: (True, False, -0.1), 3: (True, False, -0.1), 4: (False, False, 0.0), 5: (False, False, 0.0)}
    notices = spark.createDataFrame([("10.1/A", "A long title", "Retraction", "10.1/n", None, "update-to"), ("10.1/A", "t", "erratum", "10.1/m", None, "update-to")], "doi string, title string, type string, notice_doi string, notice_date string, via string")
    r = O.doi_statistics(refs, registry, notices).first()
    assert (r.total, r.with_doi, r.valid, r.invalid, r.retracted) == (5, 4, 3, 1, 3)
    assert O.doi_metadata(refs.limit(0), registry).count() == 0


def test_retractions(spark):
    title = "On the certain growth of uncertain things"
    refs = spark.createDataFrame([(1, "t", [], 1, "", "doi:10.1/a"), (2, title, [], 1, "", ""), (3, title.replace("growth", "growths"), [], 1, "", None), (4, "On the certain", [], 1, "", ""), (5, title, [], 1, "", "10.5/other"), (6, title + " and much more of them besides", [], 1, "", "")], REF)
    notices = [("10.1/a", "x", "concern", "10.1/c", None, "concern"), ("10.1/a", "x", "removal", "10.1/r", "2001", "update-to"), ("10.2/b", title, "", "10.2/r", None, "is-retracted-by"), ("10.5/other", "y", "correction", "n", None, "update-to"), (None, None, None, None, None, None)]
    n = spark.createDataFrame(notices, "doi string, title string, type string, notice_doi string, notice_date string, via string")
    got = {r.ref_id: (r.kind, r.notice_doi, r.by) for r in O.retractions(refs, n).collect()}
    assert got == {1: ("Removal", "10.1/r", "doi"), 2: ("Retraction", "10.2/r", "title"), 3: ("Retraction", "10.2/r", "title")}
    assert O.retractions(refs, n.limit(0)).count() == 0


HIT = "ref_id long, hit_rank int, title string, authors array<string>, status string"


def test_scholar(spark):
    rows = spark.createDataFrame([(k, "A paper of some note", ["Ada Li", "Bo Wu"], ["Eva No"]) for k in range(1, 9)], "ref_id long, title string, authors array<string>, p_authors array<string>")
    same, near = "a paper of some note", "a paper of some notes on it"
    hits = [(1, 1, same, ["A Li", "B Wu"], "ok"), (2, 1, same, ["Eva No"], "ok"), (3, 1, near, ["Ada Li", "Bo Wu"], "ok"), (4, 1, "quite another", ["x"], "ok"), (6, 1, None, None, "blocked"), (7, 1, same, ["Eva No"], "ok"), (7, 2, same, ["Ada Li", "Bo Wu"], "ok"), (8, 1, same, [], "ok"), (8, 2, same, ["Eva No"], "ok")]
    h = spark.createDataFrame(hits, HIT)
    got = {r.ref_id: (r.validated, r.conclusion) for r in O.fabrication_evidence(rows, h).collect()}
    other = (None, "possible_author_manipulation")
    assert got == {1: (False, "paper_exists"), 2: other, 3: (True, "related_paper_only"), 4: (True, "likely_fabrication"), 5: (True, "confirmed_fabrication"), 6: (None, "unknown"), 7: (False, "paper_exists"), 8: other}
    got = {r.ref_id: (r.validated, r.evidence_confidence) for r in O.manipulation_evidence(rows, h).collect()}
    assert got == {1: (None, 0.3), 2: (True, 0.9), 3: (None, 0.3), 4: (None, 0.3), 5: (None, 0.3), 6: (None, 0.3), 7: (False, 0.8), 8: (True, 0.85)}


def test_registry(spark):
    pairs = spark.createDataFrame([(1, 1, ["N. Smart", "Zed No"], ["Nigel Smart"], "CRYPTO 2001", 0.1), (2, 1, ["N. Smart"], ["Nigel Smart"], "VLDB", 0.1), (3, 1, [], None, "CHES", 0.0)], "ref_id long, paper_id long, authors array<string>, p_authors array<string>, p_venue string, author_sim double")
    registry = spark.createDataFrame([("1", "Nigel Smart"), ("2", "Nigel Paul Smart")], "author_id string, canonical_name string")
    got = {r.ref_id: r.author_sim for r in O.registry_similarity(pairs, registry).collect()}
    assert got == pytest.approx({1: 0.7 * 0.5 + 0.03, 2: 0.1, 3: 0.0})


ROW = "score double, title_sim double, author_sim double, n_sources int, sources array<string>, fraud_author double, p_citations long, p_doi string, is_book boolean, scholar_differs boolean, scholar_asked boolean, scholar_absent boolean, doi_resolves boolean, doi_matches boolean, doi_boost double"


@pytest.mark.parametrize(
    ("row", "kind", "conf"),
    [
        ((None, None, None, 0, None, None, None, None, True, None, None, None, None, None, None), "inconclusive", 0.4),
        ((None, None, None, 0, None, None, None, None, False, None, None, None, None, None, None), "inconclusive", 0.5),
        ((0.6, 0.9, 0.1, 1, ["dblp"], 0.1, 0, "", None, None, None, None, None, None, None), "author_manipulation", 0.8),
        ((0.6, 0.9, 0.4, 1, ["dblp"], 0.1, 0, "", None, False, None, None, None, None, None), "authentic", 0.65),
        ((0.3, 0.5, 0.4, 1, ["odd"], None, 0, "", None, None, True, True, None, None, None), "suspicious", 0.65),
        ((0.3, 0.5, 0.4, 1, ["odd"], None, 0, "", None, None, None, None, None, None, None), "inconclusive", 0.55),
        ((0.3, 0.5, 0.4, 1, ["odd"], None, 0, "", None, None, True, False, None, None, None), "suspicious", 0.175),
        ((0.3, 0.5, 0.4, 1, ["dblp"], None, 0, "", None, None, None, None, True, True, 0.2), "authentic", 0.65),
        ((0.45, 0.5, 0.4, 1, ["dblp"], None, 0, "", None, None, None, None, True, True, 0.2), "authentic", 0.65),
        ((0.55, 0.5, 0.4, 1, ["dblp"], None, 0, "", None, None, None, None, True, False, -0.1), "suspicious", 0.75 * 0.45 - 0.05 + 0.05),
        ((0.90, 0.9, 0.9, 2, ["dblp", "arxiv"], None, 3, "x", None, None, None, None, True, True, 0.2), "authentic", 0.99),
    ],
)
def test_classes_with_evidence(spark, row, kind, conf):
    r = L.classify(spark.createDataFrame([row], ROW)).first()
    assert (r["class"], r.confidence) == (kind, pytest.approx(conf))


def test_merge(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for k in range(40):
        title = " ".join(rng.choices(words, k=4)) if k % 3 == 0 else rows[rng.randrange(len(rows))][2][: rng.choice([None, -1, -2])]
        rows.append((k % 2, k, title, rng.choice([["Ada Li"], ["Ada Li", "Bo Wu"], []]), rng.choice(["", "VLDB"]), rng.choice([2001, None]), rng.choice(["", "10.1/a"]), "", "", "", rng.choice([0.5, 0.9])))
    rows.append((3, 0, None, None, None, None, None, None, None, None, None))
    kind = "list_id long, pos int, title string, authors array<string>, venue string, year int, doi string, pages string, volume string, issue string, completeness double"
    refs = spark.createDataFrame(rows, kind)

    def alike(a, b):
        t = difflib.SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio()
        if t < 0.6:
            return 0.0
        n = difflib.SequenceMatcher(None, " ".join(a[3]).lower(), " ".join(b[3]).lower()).ratio() if a[3] and b[3] else 0.0
        return t * 0.7 + n * 0.2 + (0.1 if a[5] == b[5] else 0.0)

    want = {(3, 0): 0}
    for _, group in itertools.groupby(sorted(rows[:-1]), key=lambda r: r[0]):
        left = list(group)
        while left:
            seed, rest = left[0], []
            want[seed[0], seed[1]] = seed[1]
            for r in left[1:]:
                if alike(seed, r) >= 0.9:
                    want[r[0], r[1]] = seed[1]
                else:
                    rest.append(r)
            left = rest
    assert {(r.list_id, r.pos): r.seed for r in similar_groups(refs).collect()} == want
    assert len(set(want.values())) < len(want) - 5
    merged = merge_similar(refs).collect()
    assert sorted((r.list_id, r.pos) for r in merged) == sorted(k for k, v in want.items() if k[1] == v)
    for r in merged:
        group = [x for x in rows if want[x[0], x[1]] == r.pos and x[0] == r.list_id]
        base = max(group, key=lambda x: (x[10] or 0, -x[1]))
        assert r.n_merged == len(group) and r.year == base[5] and r.doi == (base[6] or next((x[6] for x in group if x[6]), ""))
        assert len(r.authors) == max(len(x[3] or []) for x in group)
    assert merge_similar(refs.limit(0)).count() == 0


def test_verdicts(spark):
    j = '{"is_authentic": true, "confidence": 0.8, "reasoning": "r", "red_flags": ["short", "a longer flag", 3], "positive_indicators": ["found in dblp"]}'
    for raw in (j, f"Sure:\n```json\n{j}\n```\nBye", f"It is {j} so"):
        r = one(spark, raw, V.parse_verdict)
        assert (r.authentic, r.ai_confidence, r.reasoning, r.red, r.good) == (True, 0.8, "r", ["a longer flag"], ["found in dblp"])
    text = "Analysis: it appears to be legitimate and is\nlikely authentic.\n\nConfidence: 70\n- a positive sign that is long enough\n- a concern that is long enough"
    r = one(spark, text, V.parse_verdict)
    assert r.authentic and r.ai_confidence == pytest.approx(0.9) and r.reasoning == "it appears to be legitimate and is likely authentic."
    assert r.good == ["a positive sign that is long enough"] and r.red == ["a concern that is long enough"]
    assert one(spark, "clearly fabricated, confidence: 0.5", V.parse_verdict).ai_confidence == pytest.approx(0.6)
    assert one(spark, "no idea", V.parse_verdict).ai_confidence == 0.4 and one(spark, "7", V.parse_verdict).authentic is False
    assert one(spark, None, V.parse_verdict) is None and one(spark, "", V.parse_verdict).authentic is False
    q = spark.range(1).select(V.question_key(*[F.lit(None).cast("string"), F.array(F.lit("a")), F.lit("v"), F.lit(2001), F.lit(3)], model="m").alias("k"), V.prompt(F.lit("T"), F.array(F.lit("a")), F.lit(None), F.lit(2001), F.lit(""), F.array(F.lit("c"))).alias("p")).first()
    assert len(q.k) == 32 and "Title: T" in q.p and "Venue: not given" in q.p and "- c" in q.p


def test_preprint_scores(spark):
    s = lambda p, q: spark.createDataFrame([(p, q)], "p string, q string").select(E.title_score(F.col("p"), F.col("q"))).first()[0]
    assert (s("Lattice Sieves", "lattice sieves"), s("On lattice sieves", "Lattice sieves"), s("sieves", "lattice sieves"), s("", "x")) == (1.0, 0.8, 0.7, 0.0)
    assert s("fast lattice reduction", "lattice sieving reduction") == pytest.approx(max(0.6 * 2 / 4, 0.4 * 2 / 3))
    rows = [(["Ada Li", "Bo Wu"], ["ada li", "Cy Wu", "Bo"], 0.0), ([], ["x"], 0.0), (None, None, 0.0)]
    got = spark.createDataFrame(rows, "p array<string>, q array<string>, w double").select(E.author_score(F.col("p"), F.col("q"))).collect()
    assert [r[0] for r in got] == pytest.approx([(1 + 0.8 + 0.5) / 3, 0, 0])


def test_more_catalogues(spark):
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><AuthorList><Author><LastName>Li</LastName><ForeName>Ada</ForeName></Author><Author><LastName>Wu</LastName></Author><Author><CollectiveName>c</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/a</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
    r = one(spark, xml, B.from_pubmed)
    assert (r.paper_id, r.title, r.authors, r.year, r.venue, r.doi, r.volume) == ("7", "T", ["Ada Li", "Wu"], 2001, "J", "10.1/a", "3")
    r = one(spark, '{"title":" T ","creators":[{"creator":"Li, Ada"},{"creator":" "}],"onlineDate":"on 2001-02-03","publicationName":"J","doi":"10.1/a","startingPage":"1","endingPage":"9"}', B.from_springer)
    assert (r.title, r.authors, r.year, r.venue, r.pages, r.url) == ("T", ["Li, Ada"], 2001, "J", "1-9", "https://doi.org/10.1/a")
    r = one(spark, '{"bib":{"title":"T","author":"Ada Li and Bo Wu","pub_year":"2001"},"num_citations":3}', B.from_scholar)
    assert (r.title, r.authors, r.year, r.citations, r.snippet) == ("T", ["Ada Li", "Bo Wu"], 2001, 3, "T")
    r = one(spark, "<item><title>T</title><link>https://x.org/2021/12</link><creator>Ada Li</creator><category>c</category><description>d</description></item>", B.from_rss)
    assert (r.title, r.authors, r.year, r.paper_id, r.category, r.description) == ("T", ["Ada Li"], 2021, "2021/12", "c", "d")
    for fn in (B.from_springer, B.from_scholar):
        assert one(spark, None, fn).authors == [] and one(spark, "no json", fn).title == ""


def test_verify_with_evidence(spark):
    refs = spark.createDataFrame([(1, "On the growth of things", ["Ada Li"], 2001, "VLDB", "10.1/a"), (2, "Handbook of Nothing", ["Eva No"], 2001, "", ""), (3, None, None, None, None, None)], REF)
    papers = spark.createDataFrame([(1, "dblp", "On the growth of things", ["Ada Li"], 2001, "VLDB", "10.1/a", 4)], "paper_id long, source string, title string, authors array<string>, year int, venue string, doi string, citations long")
    notices = spark.createDataFrame([("10.1/a", "t", "retraction", "10.1/n", "2003", "update-to")], "doi string, title string, type string, notice_doi string, notice_date string, via string")
    hits = spark.createDataFrame([], HIT)
    people = spark.createDataFrame([("1", "Ada Li")], "author_id string, canonical_name string")
    book = F.size(book_signs(F.col("title"), F.col("venue"), F.col("year"), F.lit(""))) > 0
    rows = verify(refs, papers, registry=papers, notices=notices, hits=hits, authors=people, is_book=book)
    got = {r.ref_id: r for r in rows.collect()}
    assert (got[1]["class"], got[1].confidence, got[1].retracted) == ("authentic", 0.99, True)
    assert (got[2]["class"], got[2].confidence, got[3].confidence) == ("inconclusive", 0.4, 0.5)
    blocks = {r.ref_id: r.block for r in report(rows, F.col("is_book")).collect()}
    assert "[RETRACTED] Retraction, notice 10.1/n, 2003" in blocks[1] and "book" in blocks[2] and "RETRACTED" not in blocks[2]


def test_rule_engine(spark):
    kind = "authors array<string>, p_authors array<string>, venue string, p_venue string, year int, p_year int, title_sim double, author_sim double, venue_sim double, sources array<string>, score double"
    two, three = ["Ada Li", "Bo Wu"], ["Ada Li", "Bo Wu", "Eva No"]
    rows = [
        ((None, None, None, None, None, None, None, None, None, None, None), "fabricated", 0.85, "complete_fabrication", "high"),
        ((two, ["X Y"], "", "", 2001, 2001, 0.9, 0.0, 0.0, ["dblp"], 0.5), "author_manipulation", 0.9, "author_swap", "critical"),
        ((three, two, "", "", 2001, 2001, 0.84, 0.5, 0.0, ["dblp"], 0.5), "author_manipulation", 0.85, "author_injection", "critical"),
        ((two, two, "Nature", "arXiv", 2001, 2001, 1.0, 1.0, 0.0, ["dblp"], 0.9), "suspicious", 0.72, "venue_fabrication", "high"),
        ((two, two, "", "", 2001, 2001, 0.6, 0.5, 0.0, ["odd"], 0.5), "suspicious", 0.495, "", "medium"),
        ((two, two, "", "", 2003, 2001, 1.0, 1.0, 0.0, ["dblp"], 0.9), "authentic", 0.84 + 0.1, "newer_year", "low"),
        ((two, two, "", "", 2001, 2001, 0.2, 0.5, 0.0, ["dblp", "iacr"], 0.2), "inconclusive", 0.7, "", "high"),
        ((two, two, "", "", 2001, 2001, 0.2, 0.5, 0.0, ["arxiv"], 0.2), "fabricated", 0.7, "complete_fabrication", "high"),
    ]
    for row, name, conf, signs, review in rows:
        r = L.classify_rules(spark.createDataFrame([row], kind)).first()
        assert (r.rule_class, r.rule_confidence, ",".join(r.rule_signs), r.rule_review) == (name, pytest.approx(conf), signs, review), row


def test_notices_of_one_title_are_one(spark, monkeypatch):
    """Many notices of a title, and many references with it, meet once; the first notice is found all the same."""
    seen, near = [], O.near_texts
    monkeypatch.setattr(O, "near_texts", lambda left, right, ratio: seen.append(right.count()) or near(left, right, ratio))
    title = "a title of more than twenty letters"
    n = spark.range(40).selectExpr("concat('10.1/', id) AS doi", f"'{title}' AS title", "'retraction' AS type", "lpad(id, 3, '0') AS notice_doi", "CAST(NULL AS STRING) AS notice_date", "'update-to' AS via")
    refs = spark.range(30).selectExpr("id AS ref_id", "'' AS doi", f"'{title}' AS title")
    got = O.retractions(refs, n).collect()
    assert seen == [1] and len(got) == 30 and {(r.notice_doi, r.by) for r in got} == {("000", "title")}

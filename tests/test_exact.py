"""Scores over all references against plain programs, and the recall of blocking against all pairs."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from citegauge.functions import names as N
from citegauge.functions import text as T
from citegauge.operators import link as L
from citegauge.plans.queries import _tables

SF = "/root/testdata/sf0.001"


def plain(t):
    for pattern, to in T.LATEX:
        t = re.sub(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern), to.replace("$1", r"\1"), t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t.strip()) if unicodedata.category(c)[0] != "C")
    return re.sub("[\u2212\u2013\u2014]", "-", " ".join(t.split())).strip().lower()


def key(t):
    for pattern, to in T.TITLE_RULES:
        t = re.sub(pattern, to, t)
    return t.strip()


def title(a, b):
    if not a or not b:
        return 0.0
    forms = [(plain(a), plain(b)), (key(plain(a)), key(plain(b)))]
    x, y = (set(t.split()) for t in forms[1])
    ratio = lambda p, q: 0.0 if not p or not q else 1.0 if p == q else difflib.SequenceMatcher(None, p, q).ratio()
    return max(*(ratio(*f) for f in forms), len(x & y) / len(x | y) if x and y else 0.0)


def parts(name):
    words = re.sub("[.-]", " ", name.lower()).split()
    last = " ".join(words[-2:]) if len(words) > 1 and words[-2] in N.PARTICLES else words[-1]
    return " ".join(words), words[0] if len(words) > 1 else "", last


def person(a, b):
    (wa, ga, la), (wb, gb, lb) = parts(a), parts(b)
    spelt = lambda p, q: p == q or q in N.VARIANTS.get(p, ()) or p in N.VARIANTS.get(q, ())
    if wa == wb:
        return 1.0
    if not spelt(la, lb):
        return 0.0
    if not ga or not gb:
        return 0.6
    if spelt(ga, gb):
        return 0.95
    return 0.85 if (len(ga) == 1 and gb.startswith(ga)) or (len(gb) == 1 and ga.startswith(gb)) else 0.4


def people(own, theirs):
    used, total = set(), 0.0
    for a in own:
        best = max(((person(a, b), -k) for k, b in enumerate(theirs) if k not in used), default=(0.0, 0))
        if best[0] >= 0.4:
            used.add(-best[1])
            total += best[0]
    n = len(used)
    return max(0.0, total / max(len(own), len(theirs)) - 0.1 * (len(own) - n) - 0.05 * (len(theirs) - n)) if n else 0.0


@pytest.fixture(scope="module")
def scored(spark):
    refs, papers = _tables(spark, SF)
    rows = L.score(L.block(refs, papers), refs, papers).select("ref_id", "paper_id", "title", "p_title", "authors", "p_authors", "title_sim", "author_sim", "venue_sim", "year_sim", "score").collect()
    return refs.collect(), papers.collect(), rows


def test_scores_are_those_of_plain_programs(scored):
    _, _, rows = scored
    assert len(rows) > 200
    for r in rows:
        assert r.title_sim == pytest.approx(title(r.title, r.p_title), abs=1e-12)
        assert r.author_sim == pytest.approx(people(r.authors, r.p_authors), abs=1e-12)
        assert r.score == pytest.approx(0.55 * r.title_sim + 0.25 * r.author_sim + 0.15 * r.venue_sim + 0.05 * r.year_sim, abs=1e-8)


def test_titles_of_all_kinds(spark):
    pairs = [("The $\\textsc{Sphincs} +$ paper", "sphincs+ paper"), ("a\tb c", "ab c"), ("Équipe – x", "Equipe - x"), ("...", "..."), ("$$$", "$$$"), ("", "x"), (None, "x"), ("x" * 300, "x" * 299 + "y"), ("tide", "diet"), ("diet", "tide"), ("post-quantum keys!", "Postquantum keys")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [pytest.approx(title(a, b)) for a, b in pairs]


def test_recall_of_blocking(spark, scored):
    """Of the references whose best paper among all would pass for authentic, nearly all have one as good among their candidates."""
    refs, papers, rows = scored
    every = spark.createDataFrame([(r.ref_id, p.paper_id) for r in refs for p in papers], "ref_id long, paper_id long")
    r, p = _tables(spark, SF)
    all_pairs = L.score(every, r, p)
    best = all_pairs.groupBy("ref_id").agg(F.max("score").alias("top"), F.max("title_sim").alias("title")).where("title >= 0.8")
    own = {}
    for x in rows:
        own[x.ref_id] = max(own.get(x.ref_id, 0.0), x.score)
    wanted = best.collect()
    found = sum(own.get(w.ref_id, 0.0) >= w.top - 1e-9 for w in wanted)
    assert len(wanted) > 100 and found / len(wanted) >= 0.98
    alike = {(x.ref_id, x.paper_id) for x in all_pairs.where("title_sim >= 0.8").select("ref_id", "paper_id").collect()}
    kept = {(x.ref_id, x.paper_id) for x in rows}
    print("recall", found / len(wanted), "pairs", len(alike & kept) / len(alike))
    assert len(alike & kept) / len(alike) >= 0.98

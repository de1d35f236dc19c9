"""The join of texts by their ratio, and choices in order, against plain loops."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from citegauge.operators.greedy import keep_apart, seeds
from citegauge.operators.near_text import gram_size, near_texts
from citegauge.plans.queries import _tables

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def edited(draw, text, letters, many):
    out = list(text)
    for _ in range(draw.randint(0, 1 + len(out) // many)):
        k = draw.randint(0, len(out))
        kind = draw.random()
        if kind < 0.4 and k < len(out):
            out[k] = draw.choice(letters)
        elif kind < 0.7:
            out.insert(k, draw.choice(letters))
        elif k < len(out):
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("least, letters", [(0.95, "abcd é"), (0.9, "abü日🙂 "), (0.857, "abcdefgh "), (0.75, "ab")])
def test_near_texts_are_those_of_all_pairs(spark, least, letters):
    draw = random.Random(letters)
    texts = ["", None, "a", "ab", "b", "aba", "🙂", "🙂a", "x" * 300, "x" * 299 + "y", "aaaa", "aaaaa", "abab" * 5, "baba" * 5]
    while len(texts) < 170:
        texts.append("".join(draw.choices(letters, k=draw.randint(1, 60))) if draw.random() < 0.3 else edited(draw, draw.choice([t for t in texts if t]), letters, 40 if least > 0.9 else 6))
    left, right = [(t, draw.randint(0, 1)) for t in texts[::2] + texts[:30]], [(t, draw.choice([0, 1, None])) for t in texts]
    got = near_texts(spark.createDataFrame(left, "text string, year int"), spark.createDataFrame(right, "text string, year int"), least, ("year",)).collect()
    want = {(a, b, y): ratio(a, b) for a, y in left for b, z in right if a and b and a != b and y == z and ratio(a, b) >= least}
    assert {(r.l_text, r.r_text, r.year): r.ratio for r in got} == pytest.approx(want) and len(got) == len(want) > 15


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_near_titles_of_references_and_papers(spark, least):
    refs, papers = (d.select(F.lower("title").alias("text")) for d in _tables(spark, SF))
    a, b = ({r.text for r in d.collect() if r.text} for d in (refs, papers))
    want = {(x, y) for x in a for y in b if x != y and 2 * min(len(x), len(y)) >= least * (len(x) + len(y)) and ratio(x, y) >= least}
    got = near_texts(refs, papers, least)
    assert {(r.l_text, r.r_text) for r in got.collect()} == want and got.count() == len(want)
    assert near_texts(refs.limit(0), papers, least).count() == near_texts(refs, papers.limit(0), least).count() == 0


def test_grams(spark):
    assert [gram_size(r) for r in (0.95, 0.9, 0.857, 0.8)] == [4, 3, 2, 2]
    with pytest.raises(ValueError):
        near_texts(spark.createDataFrame([], "text string"), spark.createDataFrame([], "text string"), 0.7)


def test_seeds_are_those_of_the_loop(spark):
    draw = random.Random(5)
    for share in (0.02, 0.1, 0.4):
        nodes = [(g, k) for g in range(3) for k in range(40)] + [(9, 0)]
        edges = [(g, a, b) for g in range(3) for a in range(40) for b in range(a + 1, 40) if draw.random() < share or b == a + 1 and g == 2]
        linked, want = set(edges), {}
        for g, _ in nodes:
            left = sorted(k for h, k in nodes if h == g)
            while left:
                seed, left = left[0], left[1:]
                want[g, seed] = seed
                taken = [b for b in left if (g, seed, b) in linked]
                want |= {(g, b): seed for b in taken}
                left = [b for b in left if b not in taken]
        got = seeds(spark.createDataFrame(nodes, "list_id long, pos long"), spark.createDataFrame(edges, "list_id long, a long, b long"), "list_id", "pos")
        assert {(r.list_id, r.pos): r.seed for r in got.collect()} == want
    none = spark.createDataFrame([], "list_id long, a long, b long")
    assert seeds(spark.createDataFrame([(1, 2)], "list_id long, pos long"), none, "list_id", "pos").collect()[0].seed == 2


def test_rows_kept_apart_are_those_of_the_loop(spark):
    draw = random.Random(6)
    rows = [(draw.randint(0, 2), k, draw.choice(["a", "b", "c", "d", "e", None]), draw.choice([None, *range(8)])) for k in range(90)] + [(7, k, "hot", k % 3) for k in range(200)]
    seen, want = set(), set()
    for g, k, x, y in rows:
        keys = {(g, c, v) for c, v in (("x", x), ("y", y)) if v is not None}
        if not keys & seen:
            want.add((g, k))
            seen |= keys
    df = spark.createDataFrame(rows, "g long, k long, x string, y long")
    assert {(r.g, r.k) for r in keep_apart(df, "g", "k", ["x", "y"]).collect()} == want
    assert keep_apart(df.limit(0), "g", "k", ["x", "y"]).count() == 0

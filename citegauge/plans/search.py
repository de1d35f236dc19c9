"""Queries over searches, names, gates and reports, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import search as S
from ..functions import text as T
from ..operators import catalogue as K
from ..operators import context as C
from ..operators import leading as A
from ..operators import link as L
from ..operators import report as R
from ..operators import strategies as O
from ..operators.verify import verify as verified
from ..sources import bibliography as B
from . import exact as X
from .queries import _NDOI, _YEAR, BASE, BEST, PAIRS, SCORED, _best, _class_sql, _jac, _leading, _tables, query

SP = T.SPACE
W = S.W
#: Titles as people write them: with brackets, hyphens, articles, lost hyphens, last words that say nothing; some very long.
_TITLE = (
    "CASE ref_id % 6 WHEN 0 THEN 'The zero-correlation [attack] on ' || title WHEN 1 THEN title || ' approach' WHEN 2 THEN 'A an Zeroknowledge: (real-time) proof+ ' || title "
    "WHEN 3 THEN title || ' {again} ' || title || ' \"x\" ' || title WHEN 4 THEN 'Multiparty machinelearning ' || title || ' Method' ELSE title END"
)
_NAME = "CASE ref_id % 5 WHEN 0 THEN 'Dr. ' || {0} || ' 0001' WHEN 1 THEN 'Smith, ' || {0} WHEN 2 THEN {0} || ' Jr.' WHEN 3 THEN 'Prof ' || {0} || ' [2]' ELSE {0} || ' (3)' END"
_T = f"{BASE}, t AS (SELECT ref_id, {_TITLE} AS t, {_NAME.format('authors[1]')} AS a, CASE ref_id % 4 WHEN 0 THEN array_to_string(authors, '; ') WHEN 1 THEN array_to_string(authors, ' and ') WHEN 2 THEN array_to_string(authors, ' & ') ELSE array_to_string(authors, ', ') END || CASE WHEN ref_id % 3 = 0 THEN ', et al., Someone Else' WHEN ref_id % 3 = 1 THEN '; others' ELSE '' END AS list, authors, year FROM refs)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _ = _tables(spark, sf_dir)
    joined = F.when(F.col("ref_id") % 4 == 0, F.array_join("authors", "; ")).when(F.col("ref_id") % 4 == 1, F.array_join("authors", " and ")).when(F.col("ref_id") % 4 == 2, F.array_join("authors", " & ")).otherwise(F.array_join("authors", ", "))
    more = F.when(F.col("ref_id") % 3 == 0, ", et al., Someone Else").when(F.col("ref_id") % 3 == 1, "; others").otherwise("")
    return refs.select("ref_id", F.expr(_TITLE).alias("t"), F.expr(_NAME.format("authors[0]")).alias("a"), F.concat(joined, more).alias("list"), "authors", "year")


def _one(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SP}+', ' ', 'g'))"


def _term(e: str, source: str) -> str:
    bad = S.KEPT[source].replace(r"\s", SP[1:-1]).replace("'", "''")
    out = _one(f"regexp_replace({e}, '{bad}', ' ', 'g')")
    if source == "dblp":
        for pattern, to in S.NOISE:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        out = _one(out)
    if source == "semantic_scholar":
        out = f"CASE WHEN length({out}) > {S.LONGEST} THEN trim(regexp_replace(substring({out}, 1, {S.LONGEST}), ' [^ ]*$', '')) ELSE {out} END"
    return f"coalesce({out}, '')"


def _last(e: str) -> str:
    return f"CASE WHEN contains({e}, ',') THEN regexp_replace(string_split({_one(e)}, ' ')[1], ',+$', '') ELSE string_split({_one(e)}, ' ')[-1] END"


def _number(e: str) -> str:
    for pattern in (r"[ ]+[0-9]{4}$", r"[ ]*\([0-9]+\)$", r"[ ]*\[[0-9]+\]$"):
        e = f"regexp_replace({e}, '{pattern}', '')"
    return f"trim({e})"


def _bare(e: str) -> str:
    e = _number(_one(e))
    for pattern in (r"(?i)^(?:Dr\.?|Prof\.?|Mr\.?|Ms\.?|Mrs\.?) +", r"(?i) +(?:Jr\.?|Sr\.?|III?|IV)$", rf"[^{W} .-]"):
        e = f"regexp_replace({e}, '{pattern}', '', 'g')"
    return f"trim({e})"


def _simple(e: str) -> str:
    e = _one(f"lower({_number(e)})")
    e = f"CASE WHEN contains({e}, ',') THEN trim(regexp_extract({e}, '^[^,]*,(.*)$', 1)) || ' ' || trim(split_part({e}, ',', 1)) ELSE {e} END"
    for pattern, to in ((rf"(^|[^{W}])(?:dr|prof|professor)\. *", r"\1"), (r" +(?:jr|sr|ii|iii)\.?$", ""), (rf"(^|[^{W}])([a-z])\. *", r"\1\2 ")):
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return f"trim({e})"


@query(f"""{_T}, names AS (SELECT ref_id, list_filter(list_transform(regexp_split_to_array(list, ';| and | & |,'), lambda n: {_bare("n")}), lambda n: lower(n) NOT IN ('', 'others')) AS v FROM t)
SELECT ref_id, {", ".join(f"{_term('t', s)} AS {s}" for s in S.KEPT)}, {_last("a")} AS last, {_bare("a")} AS bare, {_simple("a")} AS simple,
CASE WHEN len(list_filter(v, lambda n: lower(n) IN ('et al', 'et al.'))) > 0 THEN array_to_string(list_append(v[1:list_position(list_transform(v, lambda n: lower(n) IN ('et al', 'et al.')), TRUE) - 1], 'et al.'), '; ') ELSE array_to_string(v, '; ') END AS names,
contains(lower(array_to_string(authors, ' ')), string_split({_one("lower(a)")}, ' ')[-1]) AS has_surname FROM t JOIN names USING (ref_id)""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as each source's search takes them, and first authors and lists of authors cleaned."""
    t, a = F.col("t"), F.col("a")
    cols = [F.coalesce(S.search_term(t, s), F.lit("")).alias(s) for s in S.KEPT]
    return _typed(spark, sf_dir).select("ref_id", *cols, S.last_name(a).alias("last"), S._bare_name(a).alias("bare"), S.simple_name(a).alias("simple"), F.array_join(S.author_list(F.col("list")), "; ").alias("names"), S.has_surname(a, F.col("authors")).alias("has_surname"))


_VARIED = "list_filter(list_concat([d, replace(d, '-', ''), regexp_replace(replace(d, '-', ' '), ' +', ' ', 'g')], [" + ", ".join(
    f"regexp_replace(d, '(?i)(^|[^{W}]){c.replace('-', '')}($|[^{W}])', '\\1{c}\\2', 'g')" for c in S.COMPOUNDS
) + "]), lambda v: v <> '')"
_FIRST = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"
_GOOD = "length({0}) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in S.STOP) + "], {0}) AND NOT regexp_matches({0}, '^\\p{{Nd}}+$')"
_KEYED = f"""{_T}, d AS (SELECT *, {_term("t", "dblp")} AS d FROM t), vs0 AS (SELECT *, {_VARIED} AS v0 FROM d), vs AS (SELECT *, {_FIRST.format("v0")} AS v FROM vs0),
formed AS (SELECT *, CASE WHEN len(v) > 1 AND length(v[2]) - length(replace(v[2], '-', '')) > length(v[1]) - length(replace(v[1], '-', '')) THEN v[2] ELSE coalesce(v[1], '') END AS b FROM vs),
ws AS (SELECT *, list_filter(list_transform(string_split(lower(b), ' '), lambda w: regexp_replace(regexp_replace(w, '[^{W}-]', '', 'g'), '^-+|-+$', '', 'g')), lambda w: {_GOOD.format("w")}) AS w FROM formed),
flat AS (SELECT *, flatten(list_transform(w, lambda x: list_concat([['', x]], list_transform(CASE WHEN contains(x, '-') THEN list_filter(string_split(x, '-'), lambda p: {_GOOD.format("p")}) ELSE [] END, lambda p: ['p', p])))) AS f FROM ws),
keyed AS (SELECT *, list_slice(list_transform(list_filter(f, lambda e, i: e[1] = '' OR NOT list_contains(list_transform(f[1:i - 1], lambda z: z[2]), e[2])), lambda e: e[2]), 1, 7) AS keys FROM flat),
words AS (SELECT *, list_filter(string_split({_term("t", "pubmed")}, ' '), lambda x: x <> '') AS pw FROM keyed),
asked AS (SELECT *, CASE WHEN len(pw) >= 2 THEN list_slice(list_filter(pw, lambda x: length(x) > 3), 1, 4) ELSE [] END AS w4, CASE WHEN len(pw) >= 2 THEN list_slice(list_filter(pw, lambda x: length(x) > 4), 1, 3) ELSE [] END AS w3, {_last("authors[1]")} AS name FROM words)"""


@query(f"""{_KEYED} SELECT ref_id, array_to_string(v, ' | ') AS variations, array_to_string(keys, ' ') AS keywords,
CASE WHEN len(keys) > 0 THEN array_to_string(keys, ' ') || ' ' || name || ' ' || year END AS q_keywords, CASE WHEN d <> '' THEN '"' || d || '" ' || year END AS q_title,
CASE WHEN len(w4) > 0 THEN '(' || array_to_string(w4, ' AND ') || ')[Title/Abstract] AND ' ELSE '' END || name || '[Author] AND (' || (year - 1) || ':' || (year + 1) || ')[PDAT]' AS q_medical, nullif(array_to_string(w3, ' AND '), '') AS q_words FROM asked""")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variations and keywords of titles, and the queries made of them."""
    rows = _typed(spark, sf_dir)
    q = S.queries(F.col("t"), F.col("authors"), F.col("year"))
    got = rows.select("ref_id", F.array_join(S.title_variations(F.col("t")), " | ").alias("variations"), F.array_join(S.title_keywords(F.col("t")), " ").alias("keywords"), q.alias("q"))
    return got.select("ref_id", "variations", "keywords", F.col("q")["dblp:keywords_author_year"].alias("q_keywords"), F.col("q")["dblp:exact_title_year"].alias("q_title"), F.col("q")["pubmed:words_author_year"].alias("q_medical"), F.col("q")["pubmed:words"].alias("q_words"))


_OFF = "CASE source " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in O.YEARS_OFF.items()) + " END"


_DT = _KEYED.replace(BASE, "", 1).lstrip(", ").replace(f"{_TITLE} AS t", "title AS t")
_NAME_KEY = lambda e: _one(f"regexp_replace({_one(f'lower({_number(e)})')}, '[^{W} -]', '', 'g')")
_ORDERED = lambda e: f"trim(regexp_replace(lower({e}), '[^{W}-]+', ' ', 'g'))"
_BARE = "regexp_replace(w, '^-+|-+$', '', 'g')"
#: Papers as searches see them: words of titles, phrases, names; and what each reference asks.
_SEEN = f"""{_DT}, tw AS (SELECT title, {_ORDERED(_term("title", "dblp"))} AS phrase, list_transform(regexp_split_to_array(lower(title), '[^{W}-]+'), lambda w: {_BARE}) AS ws FROM (SELECT DISTINCT title FROM papers WHERE title IS NOT NULL)),
titles AS MATERIALIZED (SELECT title, phrase, list_distinct(list_filter(list_concat(ws, flatten(list_transform(list_filter(ws, lambda w: contains(w, '-')), lambda w: regexp_split_to_array(w, '-+')))), lambda w: w <> '')) AS words FROM tw),
nk AS (SELECT paper_id, list_transform(authors, lambda n: {_NAME_KEY("n")}) AS whole FROM papers),
seen AS MATERIALIZED (SELECT paper_id, p.title, p.year, p.doi, phrase, words, list_concat(whole, flatten(list_transform(whole, lambda n: string_split(n, ' ')))) AS names FROM papers p JOIN nk USING (paper_id) LEFT JOIN titles USING (title)),
asks AS MATERIALIZED (SELECT ref_id, r.title, r.year, r.doi, keys, v, w4, w3, pw, {_NAME_KEY("name")} AS name, list_transform(r.authors, lambda n: {_NAME_KEY("n")}) AS people FROM asked JOIN refs r USING (ref_id))"""
_KEYS_IN = "len(keys) > 0 AND len(list_filter(keys, lambda k: len(list_filter(words, lambda w: starts_with(w, k))) = 0)) = 0"
_ALL_IN = lambda ws: f"len(list_filter({ws}, lambda k: NOT list_contains(words, lower(k)))) = 0"


@query(f"""{PAIRS}, {_SEEN}, t2 AS (SELECT DISTINCT title AS a, keys FROM asks), met AS (SELECT a, titles.title AS b FROM t2, titles WHERE {_KEYS_IN}),
every AS (SELECT ref_id, paper_id FROM pairs UNION SELECT ref_id, paper_id FROM met JOIN refs r ON r.title = a JOIN papers p ON p.title = b),
s AS (SELECT ref_id, paper_id, source, round({_jac("r.title", "p.title")}, 9) AS alike FROM every JOIN refs r USING (ref_id) JOIN papers p USING (paper_id) WHERE abs(r.year - p.year) <= {_OFF} OR {_OFF} IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY ref_id, source ORDER BY alike DESC, paper_id) AS place FROM s) SELECT ref_id, paper_id, CAST(place AS BIGINT) AS place FROM n WHERE place <= 10""")
def searched_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's own search would return of the candidates and of all papers with the title's keywords: its rule of years, the likest titles first, its rows at most."""
    return O.searched_by_source(*B.heads(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def _returned(spark: SparkSession, sf_dir: str, searches) -> DataFrame:
    refs, papers = _tables(spark, sf_dir)
    return K.first_strategy(K.search(refs, papers, searches())).select("ref_id", "paper_id", F.col("strategy").cast("long").alias("strategy"))


#: What each search finds, as hits (ref_id, strategy, paper_id).
_DBLP = f"""vs2 AS (SELECT ref_id, year, unnest(list_transform(v, lambda x: {_ORDERED("x")})) AS x, unnest(range(1, len(v) + 1)) AS i FROM asks),
hits AS (SELECT ref_id, 1 AS strategy, paper_id FROM asks JOIN seen ON seen.year = asks.year WHERE name <> '' AND list_contains(names, name) AND {_KEYS_IN}
  UNION ALL SELECT ref_id, i + 1, paper_id FROM vs2 JOIN seen ON seen.year = vs2.year WHERE regexp_matches(x, '[{W}]') AND contains(' ' || phrase || ' ', ' ' || x || ' '))"""
_PUBMED = f"""t3 AS (SELECT DISTINCT w3 FROM asks WHERE len(w3) > 0), met3 AS (SELECT w3, titles.title FROM t3, titles WHERE {_ALL_IN("w3")}),
hits AS (SELECT ref_id, 1 AS strategy, paper_id FROM asks JOIN seen ON {_NDOI.format("asks.doi")} = {_NDOI.format("seen.doi")} AND {_NDOI.format("asks.doi")} <> ''
  UNION ALL SELECT ref_id, 2, paper_id FROM asks JOIN seen ON abs(asks.year - seen.year) <= 1 WHERE (len(w4) > 0 OR name <> '') AND (name = '' OR list_contains(names, name)) AND (len(w4) = 0 OR {_ALL_IN("w4")})
  UNION ALL SELECT ref_id, 3, paper_id FROM asks JOIN met3 USING (w3) JOIN seen ON seen.title = met3.title)"""
_SPRINGER = f"""six AS (SELECT *, list_slice(list_filter(list_transform(pw, lambda x: lower(x)), lambda x: length(x) > 2), 1, 6) AS w6 FROM asks WHERE trim(title) <> ''),
hits AS (SELECT ref_id, 1 AS strategy, paper_id FROM six JOIN seen ON seen.year = six.year WHERE (len(w6) = 0 OR {_ALL_IN("w6")}) AND (len(people) = 0 OR len(list_intersect(names, people[1:3])) > 0))"""


def _returned_sql(name: str, hits: str) -> str:
    """CTEs that end in `name`: the rows of the first strategy that has any."""
    return f"""{hits.replace("hits AS (", f"{name}_hits AS (")},
{name}_cut AS (SELECT *, row_number() OVER (PARTITION BY ref_id, strategy ORDER BY paper_id) AS place FROM (SELECT DISTINCT ref_id, strategy, paper_id FROM {name}_hits)),
{name} AS (SELECT ref_id, paper_id, CAST(strategy AS BIGINT) AS strategy FROM (SELECT *, min(strategy) OVER (PARTITION BY ref_id) AS least FROM {name}_cut WHERE place <= {K.MOST_ROWS}) WHERE strategy = least)"""


@query(f"{BASE}, {_SEEN}, {_returned_sql('dblp', _DBLP)} SELECT * FROM dblp")
def dblp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the ordered strategies that finds papers in the whole catalogue, per reference, and the first papers it returns."""
    return _returned(spark, sf_dir, K.dblp_searches)


@query(f"{BASE}, {_SEEN}, {_returned_sql('pubmed', _PUBMED)} SELECT * FROM pubmed")
def pubmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By DOI, else by words, surname and years, else by words alone, over the whole catalogue, per reference."""
    return _returned(spark, sf_dir, K.pubmed_searches)


@query(f"{BASE}, {_SEEN}, {_returned_sql('springer', _SPRINGER)} SELECT * FROM springer")
def springer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six words of the title, one of three authors, and the year, over the whole catalogue."""
    return _returned(spark, sf_dir, K.springer_searches)


_GROUPED = "pairs AS MATERIALIZED (SELECT ref_id, paper_id, min(rank) AS rank FROM found GROUP BY ALL)"
_SEARCHED = BEST.replace(
    _GROUPED,
    f"""{_SEEN}, {", ".join(_returned_sql(name, hits) for name, hits in (("dblp", _DBLP), ("pubmed", _PUBMED), ("springer", _SPRINGER)))},
found_too AS (SELECT * FROM found UNION ALL SELECT ref_id, paper_id, {L.SEARCHED} FROM (SELECT ref_id, paper_id FROM dblp UNION SELECT ref_id, paper_id FROM pubmed UNION SELECT ref_id, paper_id FROM springer)),
{_GROUPED.replace("FROM found", "FROM found_too")}""",
)


@query(f"{_SEARCHED}, c AS ({_class_sql('balanced')}) SELECT ref_id, paper_id, rank::BIGINT AS rank, round(best.score, 6) AS score, c.class FROM best JOIN c USING (ref_id)")
def verify_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of what blocking and the sources' searches bring together, and its class."""
    refs, papers = B.heads(spark, sf_dir)
    return verified(refs, papers, searched=True).select("ref_id", "paper_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "class")


_KEYS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x))"
_EIGHT = "list_slice(list_filter({0}, lambda x, i: list_position({0}, x) = i), 1, 8)"


@query(f"""{BASE}, q AS (SELECT ref_id AS query_id, {_KEYS.format("title")} AS k FROM refs WHERE title IS NOT NULL), f AS (SELECT paper_id, {_KEYS.format("coalesce(title, '') || ' ' || array_to_string(authors, ' ') || ' ' || venue || ' ' || source")} AS k FROM papers),
q8 AS (SELECT query_id, {_EIGHT.format("k")} AS k FROM q), f8 AS (SELECT paper_id, {_EIGHT.format("k")} AS k FROM f),
m AS (SELECT query_id, paper_id, len(list_intersect(q8.k, f8.k))::DOUBLE / len(q8.k) AS overlap FROM q8, f8 WHERE len(q8.k) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, paper_id) AS place FROM m WHERE overlap > {O.LEAST_OVERLAP}) SELECT query_id, paper_id, round(overlap, 9) AS overlap, CAST(place AS BIGINT) AS place FROM n WHERE place <= 10""")
def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entries of a feed that share most of each title's terms."""
    refs, papers = _tables(spark, sf_dir)
    feed = papers.select("paper_id", "title", "authors", F.col("venue").alias("description"), F.col("source").alias("category"))
    out = O.feed_search(refs.select(F.col("ref_id").alias("query_id"), F.col("title").alias("text")), feed)
    return out.select("query_id", "paper_id", F.round("overlap", 9).alias("overlap"), F.col("place").cast("long").alias("place"))


@query(f"""{BASE}, k AS (SELECT paper_id, CASE WHEN paper_id % 4 > 0 THEN 'id:' || paper_id % 300 WHEN trim(title) <> '' THEN 'title:' || lower(trim(title)) END AS k FROM papers)
SELECT min(paper_id) AS paper_id FROM k WHERE k IS NOT NULL GROUP BY k""")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paper of each id or, without one, of each title."""
    _, papers = _tables(spark, sf_dir)
    own = F.when(F.col("paper_id") % 4 > 0, (F.col("paper_id") % 300).cast("string"))
    return O.distinct_ids(papers, own, F.col("title"), [F.col("paper_id")]).select("paper_id")


@query(f"{BASE} SELECT source, count(*) AS n FROM papers WHERE source IN ('openalex', 'dblp', 'iacr') GROUP BY source")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the sources that answer."""
    _, papers = _tables(spark, sf_dir)
    state = spark.createDataFrame([("openalex", True), ("dblp", True), ("iacr", True), ("arxiv", False), ("pubmed", None)], "source string, available boolean")
    return O.enabled(papers, state).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, near AS (SELECT ref_id, lower(trim(r.title)) AS x, lower(trim(p.title)) AS y, r.authors, p.authors AS pa, CASE WHEN p.paper_id % 2 = 0 THEN p.doi ELSE '' END AS pd FROM refs r JOIN papers p ON p.paper_id = r.ref_id),
{X.ratios("SELECT x, y FROM near")} SELECT ref_id, coalesce((x = y AND x <> '' OR coalesce(ratio, 0) >= 0.9) AND (pd <> '' OR contains(lower(array_to_string(pa, ' ')), string_split(lower(authors[1]), ' ')[-1])), FALSE) AS settles FROM near LEFT JOIN ratios USING (x, y)""")
def search_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reference's own paper would end the search."""
    refs, papers = _tables(spark, sf_dir)
    j = refs.join(papers.select(F.col("paper_id").alias("ref_id"), F.col("title").alias("p_title"), F.col("authors").alias("p_authors"), F.when(F.col("paper_id") % 2 == 0, F.col("doi")).otherwise("").alias("p_doi")), "ref_id")
    return j.select("ref_id", O.settles(*[F.col(c) for c in ("title", "authors", "p_title", "p_authors", "p_doi")]).alias("settles"))


_RESULTS = f"{BEST}, c AS ({_class_sql('balanced')}), res AS (SELECT best.*, c.class, c.confidence, best.ref_id % 13 = 0 AS retracted FROM best JOIN c USING (ref_id))"
_PCT = lambda k: f"round_even(100.0::DOUBLE * {k} / total, 1)"
_STATS = f"""{_RESULTS}, stats AS (SELECT count(*) AS total, round_even(avg(coalesce(score, 0)), 3) AS mean_score, round_even(avg(coalesce(confidence, 0)), 3) AS mean_confidence, count(*) FILTER (confidence > 0.8) AS sure,
  count(paper_id) AS matched, count(*) FILTER (retracted) AS retracted, {", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in L.CLASSES)}, CAST(NULL AS VARCHAR) AS message FROM res)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(_best(spark, sf_dir)).withColumn("retracted", F.col("ref_id") % 13 == 0)


@query(f"""{_STATS}, q AS (SELECT *, round_even({_PCT("author_manipulation")} + {_PCT("fabricated")}, 1) AS f, {_PCT("fake")} AS k, {_PCT("suspicious")} AS s FROM stats),
z AS (SELECT *, CASE WHEN f > 15 OR k > 20 THEN 'review recommended: unverified references' WHEN f > 5 OR k > 10 OR s > 30 THEN 'review recommended: manual verification' WHEN f > 0 OR k > 5 OR s > 15 THEN 'review suggested' WHEN s > 5 THEN 'minor concerns' ELSE 'ok' END AS step FROM q)
SELECT * EXCLUDE (f, k, s, step), CASE WHEN retracted > 0 THEN retracted || CASE WHEN retracted = 1 THEN ' retracted paper; ' ELSE ' retracted papers; ' END || CASE WHEN step IN ('ok', 'minor concerns') THEN 'citing them harms the work' ELSE step END ELSE step END AS risk FROM z""")
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means and risk of a batch in which every thirteenth reference is retracted."""
    return R.overall_risk(R.statistics(_results(spark, sf_dir)))


_SROWS = " UNION ALL ".join(f"SELECT {k} AS place, '{label}' AS label, {c} AS count, {f'100.0::DOUBLE * {c} / total' if c == 'retracted' else _PCT(c)} AS pct FROM stats" for k, (c, label) in enumerate(R.SUMMARY_ROWS))


@query(f"{_STATS}, s AS ({_SROWS}) SELECT CAST(place AS BIGINT) AS place, label, count, round(pct, 9) AS pct FROM s WHERE label <> '[!!] RETRACTED' OR count > 0")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's rows, with one for retracted papers."""
    return R.summary_rows(R.statistics(_results(spark, sf_dir))).select(F.col("place").cast("long").alias("place"), "label", "count", F.round("pct", 9).alias("pct"))


@query(f"""{PAIRS}, h AS (SELECT ref_id, source, count(*) AS hits FROM pairs JOIN papers USING (paper_id) GROUP BY ALL) SELECT ref_id, source, hits, round(hits / sum(hits) OVER (PARTITION BY ref_id), 6)::DOUBLE AS share FROM h""")
def hits_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, papers = _tables(spark, sf_dir)
    return R.hits_per_source(A.hits(refs, papers))


_THREE = lambda c: f"array_to_string(list_transform({c}, lambda n: {_number('n')})[1:3], ', ')"


@query(f"""{_RESULTS}, src AS (SELECT ref_id, list_slice(list_sort(list(DISTINCT source)), 1, 3) AS three FROM scored GROUP BY ref_id),
z AS (SELECT res.*, refs.authors AS ra, three, list_filter([CASE WHEN title_sim < 0.8 THEN 'the title differs' END, CASE WHEN author_sim < 0.7 THEN 'the authors differ' END, CASE WHEN paper_id IS NOT NULL AND p_doi = '' THEN 'there is no DOI to check' END], lambda f: f IS NOT NULL) AS faults
  FROM res JOIN refs USING (ref_id) LEFT JOIN src USING (ref_id))
SELECT ref_id, CASE WHEN class = 'authentic' THEN 'Verified in ' || array_to_string(three, ', ') || ': title, authors and details agree.'
WHEN class = 'author_manipulation' THEN 'Authors don''t match: the reference has [' || {_THREE("ra")} || '], the catalogue [' || {_THREE("p_authors")} || '].'
WHEN class = 'suspicious' AND len(faults) > 0 THEN 'Matches in part: ' || array_to_string(faults, '; ') || '.' WHEN class = 'suspicious' THEN 'Matches with middling confidence (' || CAST(round_even(100 * score, 0) AS BIGINT) || '%).'
ELSE 'Can''t be told: look it up by hand.' END AS issue FROM z""")
def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    refs, _ = _tables(spark, sf_dir)
    rows = rows.drop("authors").join(refs.select("ref_id", "authors"), "ref_id")
    return rows.select("ref_id", R.issue(rows).alias("issue"))


_PUB = "CASE paper_id % 9 WHEN 0 THEN 'Springer-Verlag' WHEN 1 THEN 'Some Press, Inc.' WHEN 2 THEN 'Association for Computing Machinery (ACM)' WHEN 3 THEN 'Elsevier B.V.' WHEN 4 THEN 'Acme Books Ltd.' WHEN 5 THEN 'Verlag Neu GmbH' WHEN 6 THEN '' WHEN 7 THEN 'IEEE' ELSE 'Oxford University Press (OUP)' END"
_PAGES = "CASE paper_id % 5 WHEN 0 THEN '10-19' WHEN 1 THEN '10–19' WHEN 2 THEN '10--19' WHEN 3 THEN '' ELSE '10−19' END"


def _publisher(e: str) -> str:
    cut = e
    for end in C.COMPANY_ENDINGS:
        cut = f"regexp_replace({cut}, '(?i){re.escape(end)}$', '')"
    equal = " ".join(f"WHEN lower(trim({e})) = '{name}' THEN '{short}'" for name, short in reversed(C.PUBLISHERS))
    within = " ".join(f"WHEN contains(lower(trim({e})), '{name}') THEN '{short}'" for name, short in C.PUBLISHERS)
    return f"CASE WHEN {e} = '' THEN {e} {equal} {within} ELSE trim({cut}) END"


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(venue), '{w}')" for w in words) + f" THEN '{name}'" for name, words in R.ENTRY_TYPES) + " ELSE 'article' END"
_LINE = lambda name, e: f"CASE WHEN {e} <> '' THEN '  ' || rpad({name}, 13, ' ') || '= {{' || {e} || '}}' END"


@query(f"""{BASE}, k AS (SELECT *, {_KIND} AS kind, {_publisher(_PUB)} AS pub, {_PAGES} AS pages, CASE WHEN paper_id % 5 > 0 THEN CAST(paper_id % 40 + 1 AS VARCHAR) ELSE '' END AS volume, CASE WHEN paper_id % 2 = 0 THEN CAST(paper_id % 12 + 1 AS VARCHAR) ELSE '' END AS number,
  CASE WHEN paper_id % 3 = 0 THEN '' ELSE 'https://doi.org/' || doi END AS d FROM papers)
SELECT paper_id, '@' || kind || '{{ref' || paper_id || ',' || chr(10) || array_to_string(list_filter([{_LINE("'author'", "array_to_string(authors, ' and' || chr(10) || repeat(' ', 18))")}, {_LINE("'title'", "title")},
{_LINE("CASE kind WHEN 'inproceedings' THEN 'booktitle' WHEN 'misc' THEN 'howpublished' ELSE 'journal' END", "venue")}, {_LINE("'volume'", "volume")}, {_LINE("'number'", "number")},
{_LINE("'pages'", "CASE paper_id % 5 WHEN 1 THEN '10---19' WHEN 3 THEN '' WHEN 4 THEN '10---19' ELSE '10--19' END")}, {_LINE("'publisher'", "pub")}, {_LINE("'year'", "CAST(year AS VARCHAR)")}, {_LINE("'doi'", "CASE WHEN d <> '' THEN doi ELSE '' END")},
{_LINE("'url'", "CASE WHEN d = '' THEN 'https://example.org/' || paper_id ELSE '' END")}], lambda f: f IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS entry FROM k""")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole BibTeX entries of the papers, with volumes, numbers, pages, publishers and addresses."""
    _, p = _tables(spark, sf_dir)
    k = F.col("paper_id")
    fields = {
        "authors": F.col("authors"), "title": F.col("title"), "venue": F.col("venue"), "volume": F.when(k % 5 > 0, (k % 40 + 1).cast("string")), "number": F.when(k % 2 == 0, (k % 12 + 1).cast("string")), "pages": F.expr(_PAGES),
        "publisher": F.expr(_PUB), "year": F.col("year"), "doi": F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://doi.org/"), "doi")), "url": F.concat(F.lit("https://example.org/"), k.cast("string")),
    }
    return p.select("paper_id", R.bibtex(F.concat(F.lit("ref"), k.cast("string")), fields).alias("entry"))


@query(f"""{BEST}, c AS ({_class_sql("balanced")}), g AS (SELECT ref_id, ref_id - ref_id % 20 AS file, ref_id % 20 AS pos, coalesce(title <> '' AND ref_id % 8 > 0, FALSE) AND (ref_id % 3 > 0 OR venue <> '') AS ok FROM refs)
SELECT ref_id, file, pos, CASE WHEN ok THEN class ELSE 'inconclusive' END AS class, CASE WHEN ok THEN confidence ELSE 0.0 END::DOUBLE AS confidence, round(CASE WHEN ok THEN score ELSE 0.0 END, 9)::DOUBLE AS score, CASE WHEN NOT ok THEN '{R.UNREADABLE}' END AS details
FROM g JOIN c USING (ref_id) JOIN best USING (ref_id)""")
def validity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a title, or with neither authors nor venue, are reported as inconclusive, in their files' order."""
    refs, _ = _tables(spark, sf_dir)
    k = F.col("ref_id")
    parsed = refs.select("ref_id", (k - k % 20).alias("file"), (k % 20).alias("pos"), F.when(k % 8 > 0, F.col("title")).alias("title"), F.when(k % 3 > 0, F.col("authors")).otherwise(F.array().cast("array<string>")).alias("authors"), "venue")
    return R.with_errors(L.classify(_best(spark, sf_dir)), R.gate(parsed)).withColumn("score", F.round("score", 9))


_CITED = "CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) BETWEEN 2 AND 3 THEN array_to_string(a[1:len(a) - 1], ', ') || ' and ' || a[-1] WHEN len(a) > 3 THEN a[1] || ' et al.' END"


@query(f"""{BASE}, c AS (SELECT ref_id, title, CASE ref_id % 5 WHEN 0 THEN [] WHEN 1 THEN list_concat(authors, ['X Y', 'Z W']) ELSE authors END AS a, CASE WHEN ref_id % 4 > 0 THEN venue ELSE '' END AS venue, CASE WHEN ref_id % 7 > 0 THEN year END AS year,
  CASE WHEN ref_id % 3 > 0 THEN CAST(ref_id % 50 + 1 AS VARCHAR) ELSE '' END AS volume, CASE WHEN ref_id % 2 = 0 THEN '1-9' ELSE '' END AS pages FROM refs),
n AS (SELECT *, {_CITED} AS names FROM c), l AS (SELECT *, list_filter([names, CASE WHEN names IS NULL THEN CAST(year AS VARCHAR) ELSE '(' || year || ')' END, CASE WHEN title <> '' THEN '"' || title || '"' END, nullif(venue, ''),
  nullif(CASE WHEN volume <> '' THEN 'vol. ' || volume ELSE '' END || CASE WHEN volume <> '' AND pages <> '' THEN ', ' ELSE '' END || CASE WHEN pages <> '' THEN 'pp. ' || pages ELSE '' END, '')], lambda x: x IS NOT NULL) AS parts FROM n)
SELECT ref_id, CASE WHEN len(parts) = 0 THEN 'Unknown reference' ELSE array_to_string(parts, '. ') || '.' END AS citation FROM l""")
def formatted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as one line each, with volumes and pages, some without authors, venue or year."""
    refs, _ = _tables(spark, sf_dir)
    k = F.col("ref_id")
    none = F.array().cast("array<string>")
    names = F.when(k % 5 == 0, none).when(k % 5 == 1, F.concat("authors", F.array(F.lit("X Y"), F.lit("Z W")))).otherwise(F.col("authors"))
    fields = [F.col("title"), names, F.when(k % 4 > 0, F.col("venue")).otherwise(""), F.when(k % 7 > 0, F.col("year")), F.when(k % 3 > 0, (k % 50 + 1).cast("string")).otherwise(""), F.when(k % 2 == 0, "1-9").otherwise("")]
    return refs.select("ref_id", R.formatted_citation(*fields).alias("citation"))


@query(f"""{SCORED}, h AS (SELECT ref_id, source, paper_id, p_title, round(score, 9) AS score, count(*) OVER (PARTITION BY ref_id, source) AS found, row_number() OVER (PARTITION BY ref_id, source ORDER BY score DESC, paper_id) AS place FROM scored)
SELECT ref_id, source, found, CAST(place AS BIGINT) AS place, paper_id, p_title AS title, score FROM h WHERE place <= 3""")
def report_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows of each source: how many candidates, and the first three."""
    rows = R.source_hits(_leading(spark, sf_dir, 3), A.hits(*_tables(spark, sf_dir)))
    return rows.select("ref_id", "source", "found", F.col("place").cast("long").alias("place"), "paper_id", F.col("p_title").alias("title"), F.round("score", 9).alias("score"))


_TEXT = "'Published ' || CAST(year AS STRING) || ', (doi: ' || doi || ') [' || CAST(ref_id AS STRING) || ']'"
_URL = "CASE ref_id % 6 WHEN 0 THEN 'https://link.Springer.com/x' WHEN 1 THEN 'https://ieeexplore.ieee.org/1' WHEN 2 THEN 'https://dl.acm.org/2' WHEN 3 THEN '' WHEN 4 THEN 'https://arxiv.org/abs/1' ELSE 'https://example.org' END"


@query(f"""{BASE}, x AS (SELECT ref_id, year, title, CASE WHEN doi = '' THEN 'none' ELSE {_TEXT} END AS x, {_URL} AS u FROM refs)
SELECT ref_id, TRY_CAST(regexp_extract(x, '\\b(19[5-9][0-9]|20[0-4][0-9])\\b', 1) AS INT) AS year_in, year + ref_id % 60 BETWEEN 1950 AND 2030 AS valid, regexp_extract(x, '(?i)(?:doi:[ ]*|doi\\.org/)(10\\.[0-9]+/[^ \\t\\r\\n]+)', 1) AS doi_in,
regexp_replace(x, '[!-/:-@\\[-`{{-~]', '', 'g') AS bare, CASE WHEN length(title) > 30 THEN substring(title, 1, 27) || '...' ELSE title END AS short,
CASE WHEN u = '' THEN 'Unknown' {" ".join(f"WHEN contains(lower(u), '{d}') THEN '{n}'" for d, n in T.PUBLISHER_DOMAINS)} ELSE 'Unknown Publisher' END AS publisher,
regexp_replace(x, '[^\\x00-\\x7F]+', '', 'g') AS ascii FROM x""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, DOIs, punctuation, lengths and publishers of texts."""
    refs, _ = _tables(spark, sf_dir)
    x = refs.select("ref_id", "year", "title", F.when(F.col("doi") == "", "none").otherwise(F.expr(_TEXT)).alias("x"), F.expr(_URL).alias("u"))
    c = F.col("x")
    return x.select("ref_id", T.year_in(c).alias("year_in"), T.valid_year(F.col("year") + F.col("ref_id") % 60).alias("valid"), T.doi_in(c).alias("doi_in"), T.without_punctuation(c).alias("bare"), T.truncate(F.col("title"), 30).alias("short"), T.publisher_of(F.col("u")).alias("publisher"), R.terminal_text(c).alias("ascii"))


_LATEX = r"CASE ref_id % 5 WHEN 0 THEN 'The $\\textsc{Sphincs} + $ : ' || title || '.' WHEN 1 THEN '\\emph{Post-quantum}  x' || title WHEN 2 THEN title || ' $a^2$ \\LaTeX' WHEN 3 THEN 'the ' || title || ' * #' ELSE title || ' — post quantum!' END"


@query(f"{BASE}, l AS (SELECT ref_id, {_LATEX.replace(chr(92) * 2, chr(92))} AS t FROM refs), f AS (SELECT ref_id, {X.plain_form('t')} AS plain FROM l) SELECT ref_id, plain, {X.key_form('plain')} AS key FROM f")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard and the aggressive form of titles with LaTeX, accents and dashes."""
    refs, _ = _tables(spark, sf_dir)
    t = refs.select("ref_id", F.expr(_LATEX).alias("t"))
    return t.select("ref_id", T.title_plain(F.col("t")).alias("plain"), T.title_key(F.col("t")).alias("key"))


_VENUES8 = ["Nature", "arXiv preprint", "Workshop on Things", "Proceedings of CRYPTO 2020", "FSE", "Journal of Odd Things", "", "IEEE Transactions on X"]
_TIER = lambda e: f"CASE WHEN {e} = '' THEN 'unknown' " + " ".join("WHEN " + " OR ".join(f"contains(lower({e}), '{w}')" for w in words) + f" THEN '{t}'" for t, words in N.TIERS) + " ELSE 'other' END"


_CLAIMED = f"CASE WHEN r.ref_id % 2 = 0 THEN r.venue ELSE ['{"', '".join(_VENUES8)}'][CAST(r.ref_id % 8 AS INT) + 1] END"


@query(f"""{BASE}, v AS (SELECT r.ref_id, {_CLAIMED} AS a, p.venue AS b FROM refs r JOIN papers p ON p.paper_id = r.ref_id + 1)
SELECT ref_id, {_TIER("a")} AS tier, {_TIER("b")} AS found_tier, {_TIER("a")} = 'tier1_journals' AND {_TIER("b")} IN ('preprints', 'workshops', 'other') AS implausible FROM v""")
def venue_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the references' venues and of the next paper's, and where the one would be odd beside the other."""
    refs, papers = _tables(spark, sf_dir)
    j = refs.join(papers.select((F.col("paper_id") - 1).alias("ref_id"), F.col("venue").alias("b")), "ref_id")
    a = F.when(F.col("ref_id") % 2 == 0, F.col("venue")).otherwise(F.element_at(F.array(*map(F.lit, _VENUES8)), (F.col("ref_id") % 8 + 1).cast("int")))
    return j.select("ref_id", N.venue_tier(a).alias("tier"), N.venue_tier(F.col("b")).alias("found_tier"), N.implausible_venue(a, F.col("b")).alias("implausible"))


_AUTH = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.CREDIBILITY.items()) + f" ELSE {N.DEFAULT_CREDIBILITY} END"
_ASYM = "CASE WHEN year IS NULL OR p_year IS NULL THEN 0.5 WHEN year = p_year THEN 1.0 WHEN year - p_year = 1 THEN 0.7 WHEN year - p_year = 2 THEN 0.4 WHEN year > p_year THEN 0.1 WHEN p_year - year = 1 THEN 0.9 WHEN p_year - year = 2 THEN 0.8 WHEN p_year - year <= 4 THEN 0.6 ELSE 0.3 END::DOUBLE"


@query(f"""{BEST}, auth0 AS (SELECT DISTINCT ref_id, source FROM scored), auth AS (SELECT ref_id, count(*) AS n, count(*) FILTER ({_AUTH} >= {N.AUTHORITATIVE_FROM}) AS auth, max({_AUTH})::DOUBLE AS top FROM auth0 GROUP BY 1),
w AS (SELECT best.*, coalesce(auth, 0) AS auth, coalesce(least(1.0::DOUBLE, top + least(0.15::DOUBLE, 0.05::DOUBLE * (n - 1)) + least(0.10::DOUBLE, 0.05::DOUBLE * auth)), 0.0)::DOUBLE AS strength, coalesce(injection, FALSE) AS inj,
  {_TIER("venue")} = 'tier1_journals' AND {_TIER("p_venue")} IN ('preprints', 'workshops', 'other') AS tier FROM best LEFT JOIN auth USING (ref_id)),
x AS (SELECT *, score IS NULL AS none, title_sim > 0.85 AND author_sim < 0.4 AS swap, CASE WHEN title_sim < 0.4 THEN 0.6::DOUBLE * title_sim WHEN inj THEN least(0.7::DOUBLE * title_sim, author_sim)
  ELSE (0.5::DOUBLE * title_sim + 0.3::DOUBLE * author_sim + 0.1::DOUBLE * venue_sim + 0.1::DOUBLE * {_ASYM}) * CASE WHEN auth = 0 THEN 0.9 ELSE 1.0 END::DOUBLE END AS s FROM w),
y AS (SELECT *, coalesce(tier, FALSE) AS odd, s >= 0.55 AS high, s >= 0.25 AS fair FROM x)
SELECT ref_id, round(s, 6) AS rule_score,
CASE WHEN none THEN 'fabricated' WHEN swap THEN 'author_manipulation' WHEN inj AND title_sim > 0.8 THEN 'author_manipulation' WHEN high AND (odd OR inj) THEN 'suspicious' WHEN high THEN 'authentic' WHEN fair THEN 'suspicious' WHEN auth >= 2 THEN 'inconclusive' ELSE 'fabricated' END AS rule_class,
round(CASE WHEN none THEN 0.85 WHEN swap THEN 0.9 WHEN inj AND title_sim > 0.8 THEN 0.85 WHEN high AND (odd OR inj) THEN 0.8::DOUBLE * s WHEN high THEN least(0.95::DOUBLE, s + 0.1::DOUBLE * strength) WHEN fair THEN s ELSE 0.7 END::DOUBLE, 6) AS rule_confidence,
array_to_string(list_filter([CASE WHEN none THEN 'complete_fabrication' END, CASE WHEN swap THEN 'author_swap' END, CASE WHEN inj AND NOT swap THEN 'author_injection' END, CASE WHEN odd AND NOT swap AND NOT (inj AND title_sim > 0.8) THEN 'venue_fabrication' END,
  CASE WHEN NOT none AND NOT swap AND year - p_year >= 2 THEN 'newer_year' END, CASE WHEN NOT none AND NOT swap AND NOT high AND NOT fair AND auth < 2 THEN 'complete_fabrication' END], lambda z: z IS NOT NULL), ',') AS rule_signs,
CASE WHEN none THEN 'high' WHEN swap THEN 'critical' WHEN inj AND title_sim > 0.8 THEN 'critical' WHEN high AND (odd OR inj) THEN 'high' WHEN high THEN 'low' WHEN fair THEN 'medium' WHEN auth >= 2 THEN 'high' ELSE 'high' END AS rule_review FROM y""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second rule engine."""
    return L.classify_rules(_best(spark, sf_dir)).select("ref_id", "rule_score", "rule_class", "rule_confidence", F.array_join("rule_signs", ",").alias("rule_signs"), "rule_review")


@query(f"""{SCORED}, o AS MATERIALIZED (SELECT ref_id, paper_id, coalesce(lower(trim(p_title)), '') AS t, nullif(p_doi, '') AS d, row_number() OVER (PARTITION BY ref_id ORDER BY rank, paper_id) AS k FROM scored),
greedy(ref_id, k, titles, dois, kept) AS (SELECT ref_id, 1::BIGINT, [t], CASE WHEN d IS NULL THEN [] ELSE [d] END, paper_id FROM o WHERE k = 1
  UNION ALL SELECT o.ref_id, o.k, CASE WHEN list_contains(titles, t) OR coalesce(list_contains(dois, d), FALSE) THEN titles ELSE list_append(titles, t) END,
  CASE WHEN d IS NULL OR list_contains(titles, t) OR list_contains(dois, d) THEN dois ELSE list_append(dois, d) END, CASE WHEN list_contains(titles, t) OR coalesce(list_contains(dois, d), FALSE) THEN NULL ELSE o.paper_id END FROM greedy JOIN o ON o.ref_id = greedy.ref_id AND o.k = greedy.k + 1)
SELECT ref_id, kept AS paper_id FROM greedy WHERE kept IS NOT NULL""")
def dedupe_title_or_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without those whose title or DOI stands in an earlier one that was kept."""
    return L.distinct_keys(A.first_of_titles(*_tables(spark, sf_dir))).select("ref_id", "paper_id")

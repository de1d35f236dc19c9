"""Queries over dumps read by record, a catalogue kept by key, and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import search as S
from ..functions import text as T
from ..operators import evidence as O
from ..operators import running as U
from ..operators.catalogue import dblp_searches
from ..sources import store as K
from ..sources.records import tei_records
from ..sources.storage import shared_path
from ..streaming import questions as Q
from . import exact as X
from .intake import _escaped
from .queries import _NDOI, BASE, SQL, _jac, _repairs_sql, _tables, query
from .search import _number, _one

_KEPT = _repairs_sql("regexp_replace(title, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")
_BROKEN = "ref_id % 50 = 7"


@query(f"""{BASE} SELECT 'r' || ref_id AS id, CASE WHEN {_BROKEN} THEN '' ELSE {_KEPT} END AS title, CASE WHEN {_BROKEN} THEN NULL ELSE array_to_string(authors, '; ') END AS authors, CASE WHEN {_BROKEN} THEN '' ELSE venue END AS venue,
CASE WHEN {_BROKEN} THEN NULL ELSE year END AS year, CASE WHEN {_BROKEN} OR NOT contains(doi, 'doi') THEN '' ELSE doi END AS doi, CASE WHEN {_BROKEN} THEN 'no reference' END AS error FROM refs""")
def tei_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a dump of TEI records, with names and DOIs as XML has them; each fiftieth record is malformed."""
    refs, _ = _tables(spark, sf_dir)
    name = lambda n: F.concat(F.lit("<author><persName><forename>"), _escaped(F.substring_index(n, " ", 1)), F.lit("</forename><surname>"), _escaped(F.regexp_replace(n, "^[^ ]+ ", "")), F.lit("</surname></persName></author>"))
    line = F.concat(
        F.lit('<biblStruct xml:id="r'), F.col("ref_id").cast("string"), F.lit('">\n<analytic>'), F.when(F.expr(_BROKEN), "<unclosed>").otherwise(""), F.lit('<title level="a">'), _escaped(F.col("title")), F.lit("</title>"),
        F.array_join(F.transform("authors", name), ""), F.when(F.col("doi") != "", F.concat(F.lit("<idno>"), _escaped(F.col("doi")), F.lit("</idno>"))).otherwise(""), F.lit('</analytic><monogr><title level="j">'), _escaped(F.col("venue")),
        F.lit('</title><imprint><date type="published" when="'), F.col("year").cast("string"), F.lit('-01"/></imprint></monogr></biblStruct>'),
    )
    path = shared_path(spark, "dump")
    refs.select(line.alias("value")).write.text(path)
    return tei_records(spark, path).select("id", "title", F.array_join("authors", "; ").alias("authors"), "venue", "year", "doi", "error")


@query(f"""{BASE} SELECT ref_id, paper_id, p.title, p.year FROM refs r JOIN papers p ON {_NDOI.format("r.doi")} = {_NDOI.format("p.doi")} AND {_NDOI.format("r.doi")} <> ''""")
def papers_by_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the references' DOIs, out of the catalogue kept by key."""
    refs, papers = _tables(spark, sf_dir)
    found = K.by_doi(refs.select("ref_id", "doi"), K.save(papers))
    return found.select("ref_id", F.col("p_paper_id").alias("paper_id"), F.col("p_title").alias("title"), F.col("p_year").alias("year"))


@query(f"""{BASE} SELECT ref_id, CASE ref_id % 5 WHEN 0 THEN ref_id + 1 ELSE ref_id END AS asked, p.title, array_to_string(p.authors, '; ') AS authors, p.venue, p.year, p.doi FROM refs JOIN (SELECT * REPLACE (CASE WHEN paper_id % 3 = 0 THEN '' ELSE doi END AS doi) FROM papers) p ON p.paper_id = CASE ref_id % 5 WHEN 0 THEN ref_id + 1 ELSE ref_id END""")
def papers_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries of papers asked for by id, a third of which have no DOI."""
    refs, papers = _tables(spark, sf_dir)
    k = F.col("ref_id")
    store = K.save(papers.withColumn("doi", F.when(F.col("paper_id") % 3 == 0, "").otherwise(F.col("doi"))))
    found = K.by_id(refs.select("ref_id", F.when(k % 5 == 0, k + 1).otherwise(k).alias("asked")), store, "asked")
    return found.select("ref_id", "asked", F.col("p_title").alias("title"), F.array_join("p_authors", "; ").alias("authors"), F.col("p_venue").alias("venue"), F.col("p_year").alias("year"), F.col("p_doi").alias("doi"))


@query("""WITH asked AS (SELECT event_id, event_type AS model, CASE WHEN event_id % 7 > 0 THEN value::DECIMAL(18, 2) END AS seconds, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS reused, ts FROM events)
SELECT event_id, count(*) OVER w AS n_requests, count(seconds) OVER w AS n_successes, round(CASE WHEN count(seconds) OVER w > 0 THEN (sum(seconds) OVER w)::DOUBLE / count(seconds) OVER w ELSE 0.0 END, 6)::DOUBLE AS mean_seconds,
round(count(*) FILTER (reused) OVER w / count(*) OVER w, 9)::DOUBLE AS reuse_rate, count(seconds) OVER (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_model FROM asked WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to models: successes, mean time, reuse of earlier answers, after each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("model"), F.when(F.col("event_id") % 7 > 0, F.col("value").cast("decimal(18,2)")).alias("seconds"))
    out = U.model_statistics(U.first_asked(events, ["user_id", "model"], ["ts", "event_id"]), ["ts", "event_id"])
    return out.select("event_id", "n_requests", "n_successes", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("reuse_rate", 9).alias("reuse_rate"), "n_model")


@query(SQL["dblp_search"].replace("SELECT * FROM dblp", "SELECT ref_id * 4 + k AS question_id, paper_id, strategy FROM dblp, (SELECT unnest(range(4)) AS k)"))
def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference asked four times within two hours, as a stream of files: the answers are those of the batch search."""
    refs, papers = _tables(spark, sf_dir)
    source, out, state = (shared_path(spark, name) for name in ("questions", "answers", "questions-state"))
    times = refs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    minutes = F.col("ref_id") % 24 * 60 + F.col("k") * 25
    questions = times.select((F.col("ref_id") * 4 + F.col("k")).alias("question_id"), F.timestamp_seconds(1_704_067_200 + 60 * minutes).alias("asked_at"), "title", "authors", "year")
    questions.write.parquet(source)
    Q.start(spark, source, questions.schema, papers, dblp_searches(), out, state).awaitTermination()
    return Q.answered(spark.read.schema(questions.schema).parquet(source), out).withColumn("strategy", F.col("strategy").cast("long"))


_HELPED = "CASE ref_id % 4 WHEN 0 THEN 'Dr. ' || authors[1] || ' 0001' WHEN 1 THEN authors[1] || ' Jr.' WHEN 2 THEN 'Prof ' || authors[1] || ' (2)' ELSE '  ' || authors[1] || ' III' END"


def _helped(e: str) -> str:
    e = _number(_one(e))
    for pattern in (r"(?i)^(?:Dr\.?|Prof\.?|Mr\.?|Ms\.?|Mrs\.?) +", rf"(?i){T.SPACE}+(?:Jr\.?|Sr\.?|III?|IV)$", rf"[^{S.W}{T.SPACE[1:-1]}.-]"):
        e = f"regexp_replace({e}, '{pattern}', '', 'g')"
    return f"trim({e})"


_TOKS = "list_filter(regexp_split_to_array(trim(lower({0})), ' +'), lambda w: w <> '')"
_DOT = f"list_sum(list_transform(list_distinct({_TOKS.format('x')}), lambda w: len(list_filter({_TOKS.format('x')}, lambda z: z = w)) * len(list_filter({_TOKS.format('y')}, lambda z: z = w))))"
_NORM = lambda v: f"sqrt(list_sum(list_transform(list_distinct({_TOKS.format(v)}), lambda w: len(list_filter({_TOKS.format(v)}, lambda z: z = w)) ** 2)))"


@query(f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, k AS (SELECT r.ref_id, lower(r.venue) AS x, lower(p.venue || ' ' || r.venue) AS y, {_helped(_HELPED.replace("ref_id", "r.ref_id").replace("authors", "r.authors"))} AS name,
  CASE r.ref_id % 3 WHEN 0 THEN r.venue WHEN 1 THEN p.venue ELSE '' END AS field, r.ref_id % 10 / 10.0::DOUBLE AS score, r.ref_id % 5 AS n FROM refs r JOIN papers p ON p.paper_id = r.ref_id + 1),
{X.ratios("SELECT x, y FROM k")} SELECT ref_id, name, field, n >= 3 AND score < 0.7 AS fallback, round({_jac("x", "y")}, 9) AS jaccard, round({_DOT} / ({_NORM("x")} * {_NORM("y")}), 9) AS cosine, round(coalesce(ratio, 0.0), 9) AS sequence FROM k LEFT JOIN ratios USING (x, y)""")
def helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cleaned with their case, the first field that names a venue, when a further search is due, and likeness by each of three methods."""
    refs, papers = _tables(spark, sf_dir)
    k = F.col("ref_id")
    j = refs.join(papers.select((F.col("paper_id") - 1).alias("ref_id"), F.col("venue").alias("p_venue")), "ref_id")
    given = F.expr(_HELPED.replace("authors[1]", "authors[0]"))
    fields = S.venue_field(F.when(k % 3 == 0, F.col("venue")), F.when(k % 3 == 1, F.col("p_venue")).otherwise(""), F.lit(None).cast("string"))
    rows = j.withColumn("both", F.concat("p_venue", F.lit(" "), "venue"))
    for method in ("jaccard", "cosine", "sequence"):
        rows = T.with_similarity(rows, method, "venue", "both", method)
    return rows.select("ref_id", S.helper_name(given).alias("name"), fields.alias("field"), O.ask_fallback(k % 10 / 10, k % 5).alias("fallback"), *[F.round(m, 9).alias(m) for m in ("jaccard", "cosine", "sequence")])


#: Names as they are typed: titles before, the surname first, suffixes, numbers, capitals, marks; and against them initials, spellings, others.
_X = "{0}"
_FIRST_NAME, _REST = "split_part({0}, ' ', 1)", "substring({0}, length(split_part({0}, ' ', 1)) + 2)"
_TYPED = f"CASE ref_id % 8 WHEN 0 THEN 'Dr. ' || {_X} WHEN 1 THEN {_REST} || ', ' || {_FIRST_NAME} WHEN 2 THEN {_X} || ' Jr.' WHEN 3 THEN {_X} || ' 0001' WHEN 4 THEN upper({_X}) WHEN 5 THEN replace(replace({_X}, 'a', 'á'), 'o', 'ö') WHEN 6 THEN '  Prof. ' || {_REST} || ',  ' || {_FIRST_NAME} || ' (2)' ELSE {_X} END"
_OTHER = (
    f"CASE ref_id % 13 WHEN 0 THEN substring({_X}, 1, 1) || '. ' || {_REST} WHEN 1 THEN {_REST} WHEN 2 THEN replace(replace(replace({_X}, 'Dmitry', 'Dmitri'), 'Li', 'Lee'), 'Karl', 'Carl') WHEN 3 THEN replace(replace({_X}, 'Sanchez', 'Sánchez'), 'Moreau', 'Moréau') "
    f"WHEN 4 THEN 'Zoe ' || {_REST} WHEN 5 THEN {_X} || ' PhD' WHEN 6 THEN replace({_X}, '-', ' ') WHEN 7 THEN {_FIRST_NAME} || ' Else' WHEN 8 THEN '' WHEN 9 THEN {_X} || ' III' WHEN 10 THEN {_REST} || ', ' || substring({_X}, 1, 1) ELSE {_X} END"
)


def _cleaned(e: str) -> str:
    n = f"lower(trim({e}))"
    for pattern in (r"\s+[0-9]{4}$", r"\s+\([0-9]+\)$", r"\s+\[[0-9]+\]$", r"\b(dr|prof|professor|mr|mrs|ms|sir|dame)\.\s*", r"\s+(jr|sr|ii|iii|iv|phd|md|esq)\.?$"):
        n = f"regexp_replace({n}, '{pattern}', '', 'g')"
    turned = f"CASE WHEN contains({n}, ',') THEN regexp_extract({n}, '(?s)^[^,]*,(.*)$', 1) || ' ' || split_part({n}, ',', 1) ELSE {n} END"
    return f"trim(regexp_replace(regexp_replace(strip_accents({turned}), '[.-]', ' ', 'g'), '\\s+', ' ', 'g'))"


_WHOLE = lambda w: f"CASE WHEN len({w}) > 1 AND {w}[-2] IN ({', '.join(repr(p) for p in N.PARTICLES)}) THEN {w}[-2] || ' ' || {w}[-1] ELSE {w}[-1] END"


@query(f"""{BASE}, spelled(k, v) AS (VALUES {X._SPELLED}), ways AS (SELECT k, v FROM spelled UNION SELECT v, k FROM spelled UNION SELECT n, n FROM (SELECT '' AS n)),
t AS (SELECT ref_id, {_TYPED.format("authors[1]")} AS a, {_OTHER.format("authors[1]")} AS b FROM refs), c AS (SELECT ref_id, {_cleaned("a")} AS a, {_cleaned("b")} AS b FROM t),
w AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM c), p AS (SELECT ref_id, a, b, CASE WHEN len(x) > 1 THEN x[1] ELSE '' END AS ga, CASE WHEN len(y) > 1 THEN y[1] ELSE '' END AS gb, {_WHOLE("x")} AS la, {_WHOLE("y")} AS lb FROM w)
SELECT ref_id, a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN la <> lb AND NOT EXISTS (SELECT 1 FROM ways WHERE k = la AND v = lb) THEN 0.0 WHEN ga = '' OR gb = '' THEN 0.6 WHEN ga = gb OR EXISTS (SELECT 1 FROM ways WHERE k = ga AND v = gb) THEN 0.95
WHEN length(ga) = 1 AND starts_with(gb, ga) OR length(gb) = 1 AND starts_with(ga, gb) THEN 0.85 ELSE 0.4 END::DOUBLE AS likeness FROM p""")
def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with titles, commas, suffixes, numbers and marks, cleaned and compared with other spellings of them."""
    refs, _ = _tables(spark, sf_dir)
    t = refs.select("ref_id", F.expr(_TYPED.format("authors[0]")).alias("a"), F.expr(_OTHER.format("authors[0]")).alias("b"))
    return t.select("ref_id", N.clean_name(F.col("a")).alias("a"), N.clean_name(F.col("b")).alias("b"), N.compare_names(F.col("a"), F.col("b")).alias("likeness"))

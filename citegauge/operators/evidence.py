"""Evidence beside the catalogues: DOI metadata, retraction notices, hits of a scholar search, an author registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import doi_author_similarity, let
from ..functions.text import normalise_doi, present, sequence_ratio, token_jaccard, tokens
from .link import MAJOR
from .near_text import near_texts

#: Sequence ratio from which a notice's title is a reference's.
SAME_TITLE = 0.95
#: What a venue of cryptography has in its name.
CRYPTO_VENUES = ["crypto", "eurocrypt", "asiacrypt", "ches", "pkc", "tcc", "fse", "iacr", "journal of cryptology", "tches", "tosc"]


def _alike(a: Column, b: Column, exact: bool) -> Column:
    return sequence_ratio(F.lower(F.trim(a)), F.lower(F.trim(b))) if exact else token_jaccard(a, b)


def doi_metadata(refs: DataFrame, registry: DataFrame, exact: bool = False) -> DataFrame:
    """ref_id, resolves, matches, boost by a registry (doi, title, authors, year, venue) of one row a DOI.

    A match needs title above .7, authors above .6 and, if claimed, the year within one. exact compares characters, else words.
    """
    k = normalise_doi(F.col("doi"))
    fields = [F.col(c).alias(f"r_{c}") for c in ("title", "authors", "year", "venue")]
    j = refs.withColumn("k_doi", k).join(registry.where(k != "").select(k.alias("k_doi"), *fields, F.lit(True).alias("__found__")), "k_doi", "left")
    found = F.col("__found__").isNotNull()
    t, v = _alike(F.col("title"), F.col("r_title"), exact), _alike(F.col("venue"), F.col("r_venue"), exact)
    a, near = doi_author_similarity(F.col("authors"), F.col("r_authors")), F.coalesce(F.abs(F.col("year") - F.col("r_year")) <= 1, F.lit(False))
    j = j.select("ref_id", found.alias("resolves"), t.alias("t"), a.alias("a"), near.alias("y"), (present(F.col("venue")) & present(F.col("r_venue")) & (v > 0.5)).alias("v"), "year")
    ok = F.col("resolves") & F.coalesce((F.col("t") > 0.7) & (F.col("a") > 0.6) & (F.col("year").isNull() | F.col("y")), F.lit(False))
    more = lambda c, value: F.when(c, value).otherwise(0.0)
    boost = F.least(F.lit(0.2), 0.1 + more(F.col("t") > 0.9, 0.05) + more(F.col("a") > 0.8, 0.05) + more(F.col("y"), 0.02) + more(F.col("v"), 0.03))
    return j.select("ref_id", "resolves", ok.alias("matches"), F.round(F.when(ok, boost).when(F.col("resolves"), -0.1).otherwise(0.0), 6).alias("boost"))


def _notice_rank(via: Column, kind: Column) -> Column:
    """A retraction or removal goes before a relation, that before a concern; other updates count for nothing."""
    return F.when((via == "update-to") & F.lower(kind).isin("retraction", "removal"), 1).when(via == "is-retracted-by", 2).when(via == "concern", 3)


def retractions(refs: DataFrame, notices: DataFrame) -> DataFrame:
    """ref_id, kind, notice_doi, notice_date, by of the references that a notice (doi, title, type, notice_doi, notice_date, via) names.

    By DOI; references without one, of titles over 20 characters, by a title whose sequence ratio is .95 or more, all such.
    Only the first notice of a DOI and of a title can be a reference's first, so others go before the joins, and titles are met once each.
    """
    rank = _notice_rank(F.col("via"), F.col("type"))
    kind = F.when(rank == 1, F.initcap("type")).when(rank == 2, "Retraction").otherwise("Expression of Concern")
    n = notices.withColumns({"rank": rank, "kind": kind, "k_doi": normalise_doi(F.col("doi")), "n_title": F.lower(F.trim("title"))}).where("rank is not null")
    n = n.select("k_doi", "n_title", "rank", "kind", "notice_doi", "notice_date")
    r = refs.select("ref_id", normalise_doi(F.col("doi")).alias("k_doi"), F.lower(F.trim("title")).alias("r_title"), present(F.trim("doi")).alias("__doi__"))
    first = F.min(F.struct("rank", "notice_doi", "notice_date", "kind")).alias("n")
    by_doi = r.where("k_doi <> ''").join(n.where("k_doi <> ''").groupBy("k_doi").agg(first), "k_doi").select("ref_id", F.lit("doi").alias("by"), "n")

    some = r.where(~F.col("__doi__") & (F.char_length("r_title") > 20)).select("ref_id", F.col("r_title").alias("text"))
    titled = n.where("n_title <> ''").groupBy(F.col("n_title").alias("text")).agg(first)
    near = near_texts(some, titled, SAME_TITLE).select(F.col("l_text").alias("text"), "r_text")
    same = some.select("text").distinct().select("text", F.col("text").alias("r_text"))
    of_title = near.union(same).join(titled.withColumnRenamed("text", "r_text"), "r_text").groupBy("text").agg(F.min("n").alias("n"))
    by_title = some.join(of_title, "text").select("ref_id", F.lit("title").alias("by"), "n")
    out = by_doi.union(by_title).groupBy("ref_id").agg(F.min(F.struct("n.rank", "n.notice_doi", "n.notice_date", "n.kind", "by")).alias("n"))
    return out.select("ref_id", "n.kind", "n.notice_doi", "n.notice_date", "n.by")


def doi_statistics(refs: DataFrame, registry: DataFrame, notices: DataFrame) -> DataFrame:
    """One row: references, those with a DOI, with a valid one, with an invalid one, with a retracted one."""
    checked = doi_metadata(refs, registry).select("ref_id", "resolves")
    gone = retractions(refs.where(present(F.trim("doi"))), notices).select("ref_id", F.lit(True).alias("gone"))
    j = refs.select("ref_id", present(F.trim("doi")).alias("has")).join(checked, "ref_id", "left").join(gone, "ref_id", "left")
    ok = F.coalesce("resolves", F.lit(False))
    return j.agg(F.count("*").alias("total"), F.count_if("has").alias("with_doi"), F.count_if(F.col("has") & ok).alias("valid"), F.count_if(F.col("has") & ~ok).alias("invalid"), F.count_if(F.col("has") & ok & F.col("gone")).alias("retracted"))


def surname_likeness(a: Column, b: Column) -> Column:
    """Shared over all last words of two lists of names; 0 if either is empty."""
    last = lambda names: F.array_compact(F.array_distinct(F.transform(names, lambda n: F.try_element_at(tokens(n), F.lit(-1)))))
    share = lambda s: F.when((F.size(s["x"]) <= 0) | (F.size(s["y"]) <= 0), 0.0).otherwise(F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])))
    return F.coalesce(let(F.struct(last(a).alias("x"), last(b).alias("y")), share), F.lit(0.0))


def _hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs of a reference and its hits (ref_id, hit_rank, title, authors, status), references without one too."""
    h = hits.select("ref_id", "hit_rank", F.col("title").alias("h_title"), F.col("authors").alias("h_authors"), "status")
    return rows.join(h, "ref_id", "left")


def fabrication_evidence(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (ref_id, title, authors) asked of a scholar search -> ref_id, validated (true: no such paper), conclusion, found, evidence_confidence.

    A search that failed (a row of a status other than ok) tells nothing: null.
    """
    j = _hits(rows.select("ref_id", "title", "authors"), hits)
    hit = F.col("h_title").isNotNull() & (F.col("status") == "ok")
    j = j.withColumns({"t": F.when(hit, sequence_ratio(F.lower("title"), F.lower("h_title"))), "a": F.when(hit, surname_likeness(F.col("authors"), F.col("h_authors")))})
    t, a = F.col("t"), F.col("a")
    related = (t > 0.98) | ((t > 0.8) & (t <= 0.95) & (a > 0.8))
    g = j.groupBy("ref_id").agg(
        F.count_if(hit).alias("found"), F.max(F.coalesce(F.col("status") != "ok", F.lit(False))).alias("failed"), F.max(F.coalesce((t > 0.95) & (a > 0.8), F.lit(False))).alias("real"),
        F.max(F.when(related, F.struct("t", (-F.col("hit_rank")).alias("k"), "a"))).alias("best"),
    )
    other = (F.col("best.t") > 0.98) & (F.col("best.a") < 0.5)
    arms = [
        (F.col("failed") & (F.col("found") == 0), None, "unknown", 0.0),
        (F.col("found") == 0, True, "confirmed_fabrication", 0.9),
        (F.col("real"), False, "paper_exists", 0.85),
        (other, None, "possible_author_manipulation", 0.7),
        (F.col("best").isNotNull(), True, "related_paper_only", 0.8),
    ]
    return g.select("ref_id", *_arms(arms, (True, "likely_fabrication", 0.85)), "found")


def manipulation_evidence(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (ref_id, title, authors, p_authors) suspected -> ref_id, validated (true: the authors were changed), conclusion, found, evidence_confidence."""
    j = _hits(rows.select("ref_id", "title", "authors", "p_authors"), hits)
    hit = F.col("h_title").isNotNull() & (F.col("status") == "ok")
    j = j.withColumns({"t": F.when(hit, sequence_ratio(F.lower("title"), F.lower("h_title"))), "own": surname_likeness(F.col("authors"), F.col("h_authors")) > 0.7, "other": surname_likeness(F.col("p_authors"), F.col("h_authors")) > 0.7})
    t = F.col("t")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    g = j.groupBy("ref_id").agg(
        F.count_if(hit).alias("found"), F.count_if(t > 0.95).alias("same"), some(F.when(t > 0.8, F.col("own"))).alias("own"), some(F.when(t > 0.8, F.col("other"))).alias("other"),
        some(F.when(t > 0.95, F.col("other"))).alias("same_other"),
    )
    many = F.col("same") >= 2
    arms = [
        (many & F.col("own") & F.col("other"), False, "legitimate_different_papers", 0.8),
        (many & F.col("other"), True, "confirmed_author_manipulation", 0.85),
        ((F.col("same") == 1) & F.col("same_other"), True, "confirmed_author_manipulation", 0.9),
    ]
    return g.select("ref_id", *_arms(arms, (None, "inconclusive", 0.3)), "found")


def _arms(arms: list, other: tuple) -> list[Column]:
    out = []
    for k, (name, kind) in enumerate((("validated", "boolean"), ("conclusion", "string"), ("evidence_confidence", "double"))):
        c = F.lit(other[k]).cast(kind)
        for arm in reversed(arms):
            c = F.when(arm[0], F.lit(arm[k + 1]).cast(kind)).otherwise(c)
        out.append(c.alias(name))
    return out


def ask_fallback(score: Column, n_sources: Column, below: float = 0.7, sources: int = 3) -> Column:
    """A scholar search is due: enough catalogues were asked, and the best paper is not like the reference."""
    return (n_sources >= sources) & (F.coalesce(score, F.lit(0.0)) < below)


def ask_fabrication(score: Column, sources: Column) -> Column:
    """No major catalogue has the paper, and the likeness is low."""
    return ~F.coalesce(F.arrays_overlap(sources, F.array(*map(F.lit, MAJOR))), F.lit(False)) & (score < 0.5)


def compatible_names(a: Column, b: Column) -> Column:
    """As many words in both, each equal or, if either is an initial, of the same first letter."""
    words = lambda c: F.transform(tokens(c), lambda w: F.regexp_replace(w, r"\.+$", ""))
    short = lambda x, y: (F.char_length(x) == 1) | (F.char_length(y) == 1)
    fits = lambda s: (F.size(s["x"]) == F.size(s["y"])) & F.forall(F.zip_with(s["x"], s["y"], lambda x, y: F.when(short(x, y), F.left(x, F.lit(1)) == F.left(y, F.lit(1))).otherwise(x == y)), lambda ok: ok)
    return let(F.struct(words(a).alias("x"), words(b).alias("y")), fits)


def registry_ids(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, author_id) of distinct names: the id of a registered author (author_id, canonical_name) of an equal name, else of one of that surname whose words fit.

    Words that fit are as many and begin with one letter, so surname, first letter and number of words are the key.
    """
    parts = lambda d, c: d.withColumn("__words__", tokens(F.col(c))).withColumns({"last": F.try_element_at("__words__", F.lit(-1)), "head": F.left(F.get("__words__", F.lit(0)), F.lit(1)), "size": F.size("__words__")}).drop("__words__")
    n = parts(names.select("name").distinct(), "name").where("last is not null")
    j = n.join(parts(registry.select("author_id", "canonical_name"), "canonical_name"), ["last", "head", "size"])
    j = j.withColumn("place", F.when(F.lower("name") == F.lower("canonical_name"), 1).when(compatible_names(F.col("name"), F.col("canonical_name")), 2)).where("place is not null")
    return j.groupBy("name").agg(F.min_by("author_id", F.struct("place", "author_id")).alias("author_id"))


def registry_similarity(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """pairs (ref_id, paper_id, authors, p_authors, p_venue, author_sim): author_sim mixed with the share of authors of one registered id.

    Only for venues of cryptography, and only where that share is the higher: .7 of it and .3 of the plain likeness.
    """
    crypto = F.exists(F.array(*map(F.lit, CRYPTO_VENUES)), lambda v: F.contains(F.lower("p_venue"), v))
    some = pairs.where(crypto).select(F.struct("ref_id", "paper_id").alias("key"), "authors", "p_authors")
    named = lambda c: some.select("key", F.explode(F.array_distinct(c)).alias("name"))
    known = registry_ids(named("authors").select("name").union(named("p_authors").select("name")), registry)
    ids = lambda c: named(c).join(known, "name").select("key", "author_id").groupBy("key").agg(F.collect_list("author_id").alias(f"ids_{c}"))
    matched = F.size(F.filter("ids_authors", lambda x: F.array_contains("ids_p_authors", x)))
    shared = ids("authors").join(ids("p_authors"), "key").select("key.*", matched.alias("shared"))
    share = F.coalesce("shared", F.lit(0)) / F.greatest(F.size("authors"), F.lit(1))
    better = share > F.col("author_sim")
    return pairs.join(shared, ["ref_id", "paper_id"], "left").withColumn("author_sim", F.when(better, 0.7 * share + 0.3 * F.col("author_sim")).otherwise(F.col("author_sim"))).drop("shared")


def with_evidence(rows: DataFrame, registry: DataFrame | None = None, notices: DataFrame | None = None, hits: DataFrame | None = None, is_book: Column | None = None, exact: bool = False) -> DataFrame:
    """rows of `verify`, before the classification, with the columns of evidence that `classify` heeds, and retracted, retraction."""
    refs = rows.select("ref_id", "title", "authors", "year", "venue", "doi")
    if is_book is not None:
        rows = rows.withColumn("is_book", is_book)
    if registry is not None:
        rows = rows.join(doi_metadata(refs, registry, exact).selectExpr("ref_id", "resolves AS doi_resolves", "matches AS doi_matches", "boost AS doi_boost"), "ref_id", "left")
    if notices is not None:
        gone = retractions(refs, notices).select("ref_id", F.struct("kind", "notice_doi", "notice_date", "by").alias("retraction"))
        rows = rows.join(gone, "ref_id", "left").withColumn("retracted", F.col("retraction").isNotNull())
    if hits is not None:
        suspected = rows.where(F.col("fraud_author").isNotNull())
        differs = manipulation_evidence(suspected, hits).select("ref_id", F.col("validated").alias("scholar_differs"))
        asked = rows.where(ask_fabrication(F.col("score"), F.col("sources")))
        absent = fabrication_evidence(asked, hits).select("ref_id", F.lit(True).alias("scholar_asked"), F.col("validated").alias("scholar_absent"))
        rows = rows.join(differs, "ref_id", "left").join(absent, "ref_id", "left")
    return rows

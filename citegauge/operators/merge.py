"""Merging of similar references within one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import completeness
from ..functions.text import present, sequence_ratio
from ..sources.storage import written
from .greedy import seeds
from .near_text import LEAST_RATIO, near_texts

FIELDS = ["title", "venue", "doi", "pages", "volume", "issue"]
#: Weights of titles, authors and years, and the ratio of titles that is needed in any case.
TITLE, NAMES, YEAR, LEAST_TITLE = 0.7, 0.2, 0.1, 0.6


def likeness(title: Column, names: Column, same_year: Column) -> Column:
    """Ratios of titles and of authors, and equal years, weighted; 0 for titles that are less than .6 alike."""
    whole = title * TITLE + names * NAMES + F.when(same_year, YEAR).otherwise(0.0)
    return F.when(title >= LEAST_TITLE, whole).otherwise(0.0)


def _listed(refs: DataFrame) -> DataFrame:
    return refs.select("list_id", "pos", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.array_join(F.coalesce("authors", F.array()), " ")).alias("names"), F.coalesce("year", F.lit(-1)).alias("year"))


def alike(some: DataFrame, least: float = 0.9) -> DataFrame:
    """(list_id, a, b): places of one list, the earlier first, whose references (list_id, pos, title, names, year) are alike.

    Few titles are compared: where the threshold asks for so much that, even with equal authors and years, titles must be alike by
    some ratio, those of one list (and, if need be, one year) that can have it are found by their q-grams. Below that, each two of a list.
    """
    # ratios of titles that are needed with equal years and without, authors alike
    same, other = ((least - NAMES - more) / TITLE - 1e-9 for more in (YEAR, 0.0))
    side = lambda mark: some.select("list_id", *[F.col(c).alias(f"{mark}_{c}") for c in ("pos", "title", "names", "year")])
    if same < LEAST_RATIO:
        met = side("l").join(side("r"), "list_id").withColumn("t", F.when(F.col("l_title") == F.col("r_title"), 1.0).otherwise(sequence_ratio(F.col("l_title"), F.col("r_title"))))
    else:
        one_year = other > 1  # then references of different years are never alike
        beside = ("list_id", "year") if one_year else ("list_id",)
        texts = some.select(F.col("title").alias("text"), *beside)
        near = near_texts(texts, texts, min(same, 1.0), beside).select(*beside, F.col("l_text").alias("l_title"), F.col("r_text").alias("r_title"), F.col("ratio").alias("t"))
        equal = some.select(*beside, F.col("title").alias("l_title"), F.col("title").alias("r_title"), F.lit(1.0).alias("t")).distinct()
        titles = near.unionByName(equal)
        left, right = (d.withColumn("year", F.col(f"{mark}_year")) if one_year else d for mark, d in (("l", side("l")), ("r", side("r"))))
        met = left.join(titles, [*beside, "l_title"]).join(right, [*beside, "r_title"])
    names = F.when((F.col("l_names") != "") & (F.col("r_names") != ""), sequence_ratio(F.col("l_names"), F.col("r_names"))).otherwise(0.0)
    whole = likeness(F.col("t"), names, F.col("l_year") == F.col("r_year"))
    return met.where("l_pos < r_pos").where(whole >= least).select("list_id", F.col("l_pos").alias("a"), F.col("r_pos").alias("b"))


def similar_groups(refs: DataFrame, least: float = 0.9) -> DataFrame:
    """(list_id, pos, seed): in order, each reference not yet taken is a seed and takes later ones that are alike to it alone.

    One row a place. Null titles equal empty ones; two empty ones are wholly alike. Lists of any length: rows equal in title, authors
    and year are one, their first, since what takes or is taken by it does so with all, and nothing of a list meets in one task.
    """
    some = written(_listed(refs), "listed")
    same = ["list_id", "title", "names", "year"]
    first = written(some.groupBy(*same).agg(F.min("pos").alias("pos")), "first")
    # equal rows are alike but for those without authors where the threshold is above the rest: those are alike to none
    lonely = (F.col("names") == "") & (F.lit(TITLE * 1.0 + YEAR) < least)
    found = seeds(first.where(~lonely), alike(first.where(~lonely), least), "list_id", "pos").select(*same, "seed")
    taken = some.join(found, same).select("list_id", "pos", "seed")
    alone = some.join(found.select(*same), same, "left_anti").select("list_id", "pos", F.col("pos").alias("seed"))
    return taken.union(alone)


def merge_similar(refs: DataFrame, least: float = 0.9) -> DataFrame:
    """refs (list_id, pos, title, authors, venue, year, doi, pages, volume, issue, completeness; one row a place) with groups merged.

    The most complete row stays, at the seed's place; its blank fields come from the others, in order, and its authors are the longest list.
    """
    rows = refs.join(similar_groups(refs, least), ["list_id", "pos"])
    whole = F.array_sort(F.collect_list(F.struct("pos", "completeness", "year", "authors", *FIELDS)))
    g = rows.groupBy("list_id", "seed").agg(whole.alias("rows"), F.max_by(F.struct("pos", "year", "authors", *FIELDS), F.struct("completeness", -F.col("pos"))).alias("base"))
    given = lambda c: F.coalesce(F.when(present(F.col("base")[c]), F.col("base")[c]), F.try_element_at(F.filter(F.transform("rows", lambda r: r[c]), present), F.lit(1)), F.lit(""))
    lists = F.concat(F.array(F.coalesce("base.authors", F.array())), F.transform("rows", lambda r: F.coalesce(r["authors"], F.array())))
    longest = F.aggregate(lists, F.array().cast("array<string>"), lambda best, x: F.when(F.size(x) > F.size(best), x).otherwise(best))
    out = g.select("list_id", F.col("seed").alias("pos"), *[given(c).alias(c) for c in FIELDS], longest.alias("authors"), F.col("base.year").alias("year"), F.size("rows").alias("n_merged"))
    again = completeness(*[F.col(c) for c in ("title", "authors", "venue", "year", "doi", "pages")])
    return out.withColumn("completeness", F.round(F.least(F.lit(1.0), again + F.when(present(F.col("volume")), 0.05).otherwise(0.0)), 6))

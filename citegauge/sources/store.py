"""A catalogue kept by key: written once in buckets, looked up without moving it.

Papers lie in buckets by their DOI, those without one by their id, so no bucket holds all that lack a DOI. A narrow table leads from ids
to keys. A lookup shuffles what is asked to the buckets' partitions; the catalogue is read where it lies.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_doi
from .storage import shared_path


@dataclass(frozen=True)
class Store:
    """Names of the two tables, bucketed alike: papers by store_key, and (store_id, store_key) by store_id."""

    papers: str
    ids: str

    def drop(self, spark: SparkSession) -> None:
        for name in (self.papers, self.ids):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def store_key(doi: Column, paper_id: Column) -> Column:
    own = normalise_doi(doi)
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.concat(F.lit("id:"), paper_id.cast("string")))


def save(papers: DataFrame, buckets: int = 64) -> Store:
    """papers (paper_id, doi, ...) as a store, in the shared folder. Repeated rows, ids and DOIs stay; a null id can be found by DOI only."""
    spark, mark = papers.sparkSession, uuid.uuid4().hex
    store = Store(f"papers_{mark}", f"paper_ids_{mark}")
    keyed = papers.withColumn("store_key", store_key(F.col("doi"), F.col("paper_id")))
    for name, rows, key in ((store.papers, keyed, "store_key"), (store.ids, keyed.where("paper_id is not null").select(F.col("paper_id").cast("string").alias("store_id"), "store_key").distinct(), "store_id")):
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(name)
    return store


def by_doi(asked: DataFrame, store: Store, doi: str = "doi") -> DataFrame:
    """asked + the papers of its DOIs, each under p_ names; rows without a DOI, or with one that isn't there, go."""
    return _joined(asked.withColumn("store_key", normalise_doi(F.col(doi))).where("store_key <> ''"), store)


def by_id(asked: DataFrame, store: Store, paper_id: str = "paper_id") -> DataFrame:
    """asked + the papers of its ids, under p_ names; ids that aren't there go. The ids' keys are found first, then the papers."""
    spark = asked.sparkSession
    keyed = asked.withColumn("store_id", F.col(paper_id).cast("string")).join(spark.table(store.ids), "store_id")
    # a key may hold papers of several ids; as an equality this would become a key of the join, and the catalogue would move
    own = F.array_contains(F.array(F.col("p_paper_id").cast("string")), F.col("store_id"))
    return _joined(keyed, store).where(own).drop("store_id")


def _joined(keyed: DataFrame, store: Store) -> DataFrame:
    papers = keyed.sparkSession.table(store.papers)
    named = papers.select("store_key", *[F.col(c).alias(f"p_{c}") for c in papers.columns if c != "store_key"])
    return keyed.join(named, "store_key").drop("store_key")

"""Connected components of links, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of any orderable type -> (node, root), root the smallest node reachable.

    Nodes without a link to another node are absent. Null ends and self-links are ignored; repeated links
    count once. A round is two shuffles of at most as many links as there were; rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder; the driver sees only counts.
    A node with very many links is joined with them by broadcast, so none of its links meet in one task.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before, n = None, edges.count()
    for _ in range(most_rounds):
        # large star: of each node's larger neighbours, link them to its smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("many"))
        large = spread_join(both.where("v > u"), least, ["u"], "many", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link each node's smaller neighbours, and the node, to the smallest of them
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = spread_join(large, least, ["u"], "many", 2 * n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "links")
        # fixed when every larger end has one smaller end and no smaller end is itself a larger end
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def linked_rows(rows: DataFrame, classes: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """rows (row_id, node) + class_id, n_links, component_id, root.

    classes (node, weight, least): the rows that are one node, how many, and the smallest row_id. found (node, other,
    links): links a node was found to have, in rows, and one node it hangs together with. Rows of one node link with
    each other; a null node links with nothing. root is one node of the component, null for a null node.
    """
    found, total = written(found, "found"), rows.count()
    by_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = classes.select("node", "weight", "least").join(by_node, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("node", "weight", F.col("least").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("root", "node").alias("root"))
    nodes = written(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("many"))
    nodes = spread_join(nodes, least, ["root"], "many", total)
    out = spread_join(rows, nodes, ["node"], "weight", total, "left")
    alone = F.col("node").isNull()
    return out.select(
        *rows.columns,
        F.when(alone, F.col(row_id)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col(row_id)).otherwise(F.col("component_id")).alias("component_id"),
        "root",
    )

"""Connected components of a graph that is never in one place: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import spread_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type to (node, root): every node of an edge, with the least node it can reach.

    Each round ties neighbours to the least node around them, by grouped minima and equi-joins; rounds are
    written to the shared folder and go on until the set of ties no longer changes. The ties of a large class meet at its
    least node, so the join by node spreads nodes with many ties over several tasks. An empty graph has no rows;
    null ends and loops are passed over.
    """
    ties = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ties, seen = written(ties, "ties"), None
    while True:
        mark = ties.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # u > v in ties, so a node's greater neighbours are those that name it as v.
        least = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = spread_join(ties.select(F.col("u").alias("x"), F.col("v").alias("u")), least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ties = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "ties")
    return ties.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ties.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """id, node, class_id, n_links and kept for every row.

    rows: a written table of (id, node), the node null where a row is linked with nothing; nodes: (node, copies, least_id); found:
    (a, b, links), a tie between two nodes, and links to count for a, with their copies.
    """
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = written(connected_components(found.select("a", "b")).join(nodes.select("node", "least_id"), "node"), "roots")
    named = spread_join(roots, roots.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select("node", "class_id")
    about = nodes.select("node", "copies", "least_id").join(named, "node", "left").join(links, "node", "left")
    about = about.select("node", F.coalesce("class_id", "least_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = spread_join(rows.select("id", "node"), written(about, "about"), "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select("id", "node", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("id").eqNullSafe(class_id).alias("kept"))

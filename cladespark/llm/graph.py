"""Connected components by alternating large-star and small-star steps, on the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, first_row, hot_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")  # a union would have twice the tasks
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of each node that an edge touches; the component is its smallest node.

    Edges are pairs of long ids; self loops, repeats, both directions and null ends are allowed (the last are ignored).
    Every round is two aggregations and two equi-joins over the edges that are left, and ends in a checkpoint. The
    rounds stop once the edges form stars, which takes a number of rounds logarithmic in the longest chain.
    """
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).filter("u <> v").distinct()
    e, last = durable(e), None
    for _ in range(most_rounds):
        e = durable(_small_star(_large_star(e)))
        # Only the stars of a finished forest have no node that is both a leaf and a centre; the sums tell when nothing moves.
        now = first_row(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))))
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def members(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(doc_id, node, component_id)`` for each of the durable ``rows`` (doc_id, node): the smallest id that the
    pairs ``(a, b)`` of nodes reach, and null where no row of a component has an id.

    Different nodes under one id are one document, whose pairs join. All steps but the last see a row for each node;
    the last joins nodes that hold many rows by broadcast.
    """
    per = durable(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    ids = rows.filter("doc_id is not null").select("doc_id", "node")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    same = ids.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    of = components(pairs.union(same))
    placed = durable(per.join(of, "node", "left").select("node", "least", "n", F.coalesce("component", "node").alias("c")))
    named = placed.groupBy("c").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    by_node = durable(hot_join(placed, named, "c", "k").select("node", "component_id", "n"))
    return hot_join(rows, by_node, "node", "n").select("doc_id", "node", "component_id")

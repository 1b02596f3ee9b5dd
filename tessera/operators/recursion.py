"""Recursion over tables: closures of edges with a guard against circles, chains by doubling, and sums over subtrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import held


def closure(edges: DataFrame, roots: DataFrame, parent: str, child: str, max_rounds: int = 10_000) -> DataFrame:
    """root, node, depth: every node that can be reached from each root (a column `root`), with the least number of edges; the root itself has depth 0.

    Semi-naive: a round joins the edges with the nodes found in the round before alone, and what was found in any round
    is dropped, so a circle ends by itself and each (root, node) comes once. Rounds are written tables, so lineage does not
    grow; their number is the greatest depth. Null ends lead nowhere; repeated edges and roots count once. A hot node is
    a skewed join key, which adaptive execution splits.
    """
    step = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("from"), F.col(child).alias("to")).distinct()
    step = held(step)
    found = now = held(roots.where(F.col("root").isNotNull()).select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_rounds + 1):
        reached = now.join(step, F.col("node") == F.col("from")).select("root", F.col("to").alias("node")).distinct()
        now = held(reached.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if now.isEmpty():
            return found
        found = found.unionByName(now)
    raise RuntimeError("the closure did not end within max_rounds")


def chain_ends(links: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """node, root, depth, in_circle: where each node's chain of parents ends and how many steps away that is.

    Every node has one parent at most (of several the smallest counts). Pointer doubling: each round replaces a node's
    pointer by that of the node it points to, so a chain of n nodes takes log2(n) rounds. A node whose pointer
    never comes to an end leads into a circle: it gets root and depth null and in_circle true. A parent that is no
    node itself is a root all the same, and null parents end a chain.
    """
    own = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("to"))
    now = own.select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("to").isNull().alias("ended"))
    outside = own.where("to IS NOT NULL").select(F.col("to").alias("node")).distinct().join(own, "node", "left_anti")
    now = held(now.unionByName(outside.select("node", F.col("node").alias("to"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("ended"))))
    open_before = None
    for _ in range(max_rounds):
        left = now.where("NOT ended")
        n = left.count()
        # a chain of n nodes has ended after log2(n) rounds; what is open then and no longer shrinks is in a circle
        if not n or n == open_before and _circles_only(left):
            break
        open_before = n
        next_ = now.select(F.col("node").alias("mid"), F.col("to").alias("far"), F.col("depth").alias("more"), F.col("ended").alias("done"))
        stepped = left.join(next_, F.col("to") == F.col("mid")).select("node", F.col("far").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done").alias("ended"))
        now = held(now.where("ended").unionByName(stepped))
    else:
        raise RuntimeError("the chains did not end within max_rounds")
    return now.select("node", F.when(F.col("ended"), F.col("to")).alias("root"), F.when(F.col("ended"), F.col("depth")).alias("depth"), (~F.col("ended")).alias("in_circle"))


def _circles_only(left: DataFrame) -> bool:
    """Whether every open pointer points to an open node: then none can end any more."""
    return left.join(left.select(F.col("node").alias("mid")), F.col("to") == F.col("mid"), "left_anti").isEmpty()


def subtree_sums(links: DataFrame, node: str, parent: str, values: Sequence[str]) -> DataFrame:
    """node, n, and for each of values its sum over the node and all below it.

    links: a row for each node; a root has parent null. Built from the closure upwards: each node hands its own values
    to every node above it, combined in partial sums, so a root over all nodes is no hot task. Nodes on or below a
    circle count once in each node that they are below. The rows joined are those of all pairs (node, node above):
    the number of nodes times their depth.
    """
    up = closure(links, links.select(F.col(node).alias("root")), node, parent)
    own = links.groupBy(F.col(node).alias("root")).agg(*[F.sum(v).alias(v) for v in values])
    sums = up.join(own, "root").groupBy(F.col("node")).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
    return sums.join(own.select(F.col("root").alias("node")), "node", "left_semi")

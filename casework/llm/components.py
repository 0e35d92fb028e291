"""Connected components of a table of links, as DataFrame rounds.

Each round, every node hooks onto its smallest smaller neighbour (one map-side combined
aggregate), the hooks are shortened to their roots by pointer jumping, and the links are
rewritten between roots; rounds end when no link is left.  At least half of the roots that
have a link go each round.  Every intermediate table is written to the shared checkpoint
folder and read back, so a lost executor costs at most one round, and no plan grows.  Joins
have an exchange on both sides, so adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.session import written


def _roots(hooks: DataFrame) -> DataFrame:
    """(child, parent) with every parent replaced by its root."""
    while True:
        up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = written(hooks.join(up, "parent", "left").select(
            "child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")),
            "cc-jump")
        hooks = jumped.select("child", "parent")
        if jumped.where("moved").isEmpty():
            return hooks


def _lift(df: DataFrame, col: str, roots: DataFrame) -> DataFrame:
    """``df`` with ``col`` replaced by its root."""
    r = roots.select(F.col("child").alias(col), F.col("parent").alias("__root"))
    return df.join(r, col, "left").withColumn(col, F.coalesce("__root", col)).drop("__root")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component: the smallest node reachable.

    Nodes may be of any type that has an order.  Links of a node to itself make it a
    component of its own, repeated links count once, links with a null end are left out, no
    links give no rows.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                    "cc-links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = nodes.withColumn("component", F.col("node"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        hooks = written(edges.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")), "cc-hooks")
        roots = _roots(hooks)
        label = written(_lift(label, "component", roots), "cc-label")
        moved = _lift(_lift(edges, "a", roots), "b", roots).where("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        "cc-edges")
    return label

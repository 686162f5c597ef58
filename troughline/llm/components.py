"""Connected components of a table of links by hooking and pointer jumping.

Each round hooks every component to its smallest neighbour, shortens the chains of hooks to their ends
and drops the links that have become internal. Rounds are logarithmic in practice; each is written to
the shared folder, and only "is a link left" reaches the driver.
"""

from pyspark.sql import functions as F

from troughline.llm.base import stage


def connected(links, a="a", b="b"):
    """(node, root) for every node of ``links``; the root is the smallest node of its component."""
    links = stage(_pairs(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        # every component with a smaller neighbour hooks to the smallest; smaller ones stay roots
        hooks = links.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent"))
        moving = True
        while moving:
            hooks = stage(_jumped(hooks), "hooks")
            moving = not hooks.where("moved").isEmpty()
            hooks = hooks.select("child", "parent")
        labels = stage(
            labels.join(hooks, F.col("root") == F.col("child"), "left").select(
                "node", F.coalesce("parent", "root").alias("root")
            ),
            "labels",
        )
        ends = hooks.select(F.col("child").alias("child2"), F.col("parent").alias("parent2"))
        moved = links.join(hooks, F.col("a") == F.col("child"), "left").join(ends, F.col("b") == F.col("child2"), "left")
        links = stage(_pairs(moved.select(F.coalesce("parent", "a").alias("a"), F.coalesce("parent2", "b").alias("b"))), "links")
    return labels


def _pairs(links):
    """Each link between two different nodes once, the smaller node first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _jumped(hooks):
    """Every chain of hooks shortened to a half, and whether a link of it is left."""
    up = hooks.select(F.col("child").alias("middle"), F.col("parent").alias("top"))
    return hooks.join(up, F.col("parent") == F.col("middle"), "left").select(
        "child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")
    )

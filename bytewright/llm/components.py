"""Connected components by contraction, entirely in DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it reaches: ``(node, component)``.

    Each round points every node at its smallest neighbour, follows the pointers by doubling until they rest,
    and contracts the edges to the roots.  Minima are aggregated map-side, so the hub of a large star costs one
    row a task; a sorted path rests after log2(length) doublings.  Every step is a table in the shared folder.
    Self-loops and repeated or null edges are ignored; no edges give no rows.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels: DataFrame | None = None
    while live.limit(1).count():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        parent = settle(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent")), "cc-parent")
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand")).where("parent <> grand")
            jumped = settle(parent.join(above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "cc-jump")
            discard(parent)
            parent = jumped
            if not jumped.where("moved").limit(1).count():
                break
        roots = parent.select("node", "parent")
        if labels is None:
            labels = settle(roots.select("node", F.col("parent").alias("component")), "cc-labels")
        else:
            moved = labels.join(roots.withColumnRenamed("node", "component"), "component", "left")
            newer = settle(moved.select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
            discard(labels)
            labels = newer
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        mapped = live.join(left, "a").join(right, "b").where("ra <> rb")
        nxt = settle(mapped.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        discard(live)
        discard(parent)
        live = nxt
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
        labels._scratch_path = live._scratch_path
    else:
        discard(live)
    return labels


def class_nodes(classes: DataFrame, key: list[str], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, bool]:
    """Name each class of ``classes(*key, rep, ...)`` by a number ``node``: the id ``rep``, or a hash of its key where another
    class has that id too (an id is repeated with different contents).  Also whether there are such."""
    mark = F.xxhash64(*key)
    shared = classes.where("rep IS NOT NULL").groupBy("rep").agg(F.min(mark).alias("least"), F.count("*").alias("c"))
    shared = keep(shared.where("c > 1").select(F.col("rep").alias("again"), "least"), "nodes-repeated")
    if not shared.limit(1).count():
        return classes.withColumn("node", F.col("rep")), False
    named = classes.join(shared, F.col("rep") == F.col("again"), "left")
    node = F.when(F.col("least") != mark, mark).otherwise(F.col("rep"))
    return keep(named.select(*classes.columns, node.alias("node")), "nodes-named"), True


def class_components(named: DataFrame, labels: DataFrame, repeated: bool) -> DataFrame:
    """Add to the classes of ``class_nodes`` the smallest id of their component, as ``component``."""
    linked = named.join(labels.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").drop("linked")
    found = linked.withColumn("component", F.coalesce("component", "node"))
    if not repeated:
        return found
    # A component is named by its smallest node, which need not be an id.
    least = found.groupBy("component").agg(F.min("rep").alias("least"))
    return found.join(least, "component").drop("component").withColumnRenamed("least", "component")

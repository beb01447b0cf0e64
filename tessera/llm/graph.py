"""Connected components by falling labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import drop, saved

#: So many edges are followed in one task: a shuffle a step would take far longer than the steps.
FEW_EDGES = 10_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that undirected edges reach, for nodes with an edge.

    In each round a node takes the least label among its own, its neighbours' and its label's
    label, so labels travel two ways at once and long chains need few rounds. Rounds end when no
    label has changed. Node ids must not be null; loops and repeated edges are harmless.

    ``edges`` is read three times. Up to FEW_EDGES of them are followed without a shuffle, more of
    them are shuffled in every step.
    """
    few = edges.count() <= FEW_EDGES

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    turned = edges.select(F.col(b).alias("node"), F.col(a).alias("near"))
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(turned)
    both = saved(dealt(links).distinct(), "links")
    labels = saved(
        dealt(both).groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("component")
        ),
        "labels",
    )
    while True:
        of_near = dealt(labels).select(F.col("node").alias("near"), F.col("component").alias("seen"))
        heard = dealt(both).join(of_near, "near").groupBy("node").agg(F.min("seen").alias("seen"))
        of_label = dealt(labels).select(F.col("node").alias("label"), F.col("component").alias("further"))
        jumped = dealt(labels).join(of_label, labels["component"] == of_label["label"], "left").select(
            "node", "component", F.coalesce("further", "component").alias("further")
        )
        new = saved(
            jumped.join(heard, "node", "left").select(
                "node",
                F.least("component", "further", "seen").alias("component"),
                F.col("component").alias("old"),
            ),
            "labels",
        )
        drop(labels)
        labels = new
        if new.filter("component <> old").isEmpty():
            drop(both)
            return labels.select("node", "component")


def extended(labels: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``labels`` (node, component) after more edges: only components that these join are looked at.

    Edges become edges between components, loops go, and components are joined as nodes.
    The work grows with the number of components that meet, not with all edges there ever were.
    """

    def end(name: str, alias: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("component").alias(alias))

    between = edges.join(end(a, "_a"), a, "left").join(end(b, "_b"), b, "left")
    between = between.select(F.coalesce("_a", a).alias("one"), F.coalesce("_b", b).alias("other"))
    between = saved(between.filter("one <> other"), "between")
    if between.isEmpty():
        drop(between)
        return labels
    roots = components(between, "one", "other").select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = labels.join(roots, labels["component"] == roots["was"], "left").select(
        "node", F.coalesce("now", "component").alias("component")
    )
    added = roots.join(labels, roots["was"] == labels["node"], "left_anti")
    out = saved(moved.unionByName(added.select(F.col("was").alias("node"), F.col("now").alias("component"))), "labels")
    drop(between)
    return out

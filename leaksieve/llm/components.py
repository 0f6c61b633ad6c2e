"""Connected components as joins: every round hooks components together and shortens paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def min_labels(edges: DataFrame) -> DataFrame:
    """``id, label`` for the ends of ``edges`` (``a, b``): the smallest id of its component.

    Each round every component takes the smallest label next to any of its members, then
    labels follow their own labels to the end. Rounds grow with the logarithm of the
    longest path. What a round makes is written to the shared folder, so plans stay short,
    and the sides of each join are read from there, so Spark can split skewed keys.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        labels = _shortened(labels)
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooks = (
            labels.join(written(near, "near"), F.col("id") == F.col("a"))
            .where("near < label")
            .groupBy("label")
            .agg(F.min("near").alias("to"))
        )
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        labels = written(
            labels.join(hooks, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels"
        )


def _shortened(labels: DataFrame) -> DataFrame:
    while True:
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("to"))
        step = written(labels.join(further, "label").select("id", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")), "labels")
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels

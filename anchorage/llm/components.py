"""Connected components of a graph given as edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import stage


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id that can be reached) of every end of ``edges`` (columns ``a, b``).

    Each round takes the smallest label among the neighbours, then the label of that label; so labels
    travel distances that double.  Neighbours are pre-aggregated per map task, which keeps hubs cheap.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = stage(both.filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["id"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("new"))
        step = stage(step, "step")
        of = step.select(F.col("id").alias("_label"), F.col("new").alias("_of_label"))
        jumped = step.join(of, step["new"] == of["_label"]).select("id", "component", F.least("new", "_of_label").alias("new"))
        jumped = stage(jumped, "labels")
        labels = jumped.select("id", F.col("new").alias("component"))
        if jumped.filter(F.col("new") != F.col("component")).isEmpty():
            return labels

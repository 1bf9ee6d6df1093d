"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node that links reach, for every node of ``links`` (a, b: long).

    A round takes the smallest label among neighbours, then the label of that label. Labels are written each round, which cuts the
    lineage and survives lost executors; only a count comes to the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = labels.join(near, "node").join(jump, "label", "left").select(
            "node", F.least("label", "near", "beyond").alias("now"), (F.least("label", "near", "beyond") < F.col("label")).alias("moved"))
        new = written(new, "labels")
        labels = new.select("node", F.col("now").alias("label"))
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")

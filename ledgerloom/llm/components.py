"""Connected components of a link table, by passing on the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    Each round an id takes the smallest label among its own, its neighbours' and
    its label's label; the last halves long chains. Every round is a written
    table, so a lost executor costs no earlier round. A neighbour's labels are
    folded before the shuffle, so one id may have any number of links.
    """
    both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = pinned(both.union(both.select("b", "a")).toDF("a", "b").dropDuplicates(), "links")
    labels = pinned(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        neighbours = labels.select(F.col("id").alias("b"), F.col("label").alias("theirs"))
        heard = both.join(neighbours, "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("heard"))
        ahead = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        least = F.least("label", "heard", "jump")
        after = labels.join(heard, "id").join(ahead, "label")
        after = pinned(after.select("id", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")

"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """id and component_id (the smallest id reachable) of every linked id.

    ``links`` has a, b and least, an id of the same component that is at most a and b.
    A round takes the least label among the neighbours and then the label's own label, so
    labels travel over exponentially growing distances; each round is a table in the
    shared folder.  Nothing but one count per round reaches the driver.
    """
    links = kept(links, "links")
    both = kept(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = kept(
        links.select(F.col("a").alias("id"), "least").union(links.select("b", "least"))
        .groupBy("id").agg(F.min("least").alias("label")), "labels")
    while True:
        heard = (both.join(labels.withColumnsRenamed({"id": "b"}), "b")
                 .groupBy("a").agg(F.min("label").alias("heard")))
        lower = labels.join(heard.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        lower = kept(lower, "labels")
        own = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = kept(lower.join(own, "label", "left").select(
            "id", "was", F.coalesce("further", "label").alias("label")), "labels")
        changed = labels.where(F.col("was") != F.col("label")).limit(1).count()
        labels = labels.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component_id")

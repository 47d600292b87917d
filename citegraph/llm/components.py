"""Connected components of an undirected graph of ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.shared import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of `edges` (a, b): label is the least id of its component.

    Each round takes the least label among neighbours and then the label of
    that label (pointer jumping), so a chain shortens by half or more; rounds end
    when no label changed.  Labels are written each round, nothing is collected
    but one count.  Edges with a null end are ignored; an empty table gives an
    empty table.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        low = written(low.join(up, "label").select("id", "old", F.least("label", "above").alias("label")), "labels")
        discard(last)
        last, labels = low, low.select("id", "label")
        if low.filter("label <> old").limit(1).count() == 0:
            discard(both)
            return labels

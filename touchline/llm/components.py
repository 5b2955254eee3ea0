"""Connected components of a link table as joins and minima, with a written table after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Node and comp (its smallest reachable node) for every node of the links (a, b).

    In each step a node takes the least label among its neighbours' labels, proposes it to the node that its own
    label names as well, and then moves on to the label of its label. So whole groups merge at once and the
    number of steps grows with the logarithm of their size. It ends when a step lowers nothing. Self links,
    repeated links and an empty table are fine; a null end is linked with nothing.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        own = labels.join(near, "node")
        proposed = own.select("node", "low").unionByName(own.select(F.col("comp").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = materialise(labels.join(proposed, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp")), "labels")
        jump = hooked.select(F.col("node").alias("at"), F.col("comp").alias("via"))
        stepped = materialise(hooked.join(jump, F.col("comp") == F.col("at")).select("node", "old", F.col("via").alias("comp")), "labels")
        labels = stepped.select("node", "comp")
        if stepped.where("comp < old").isEmpty():
            return labels

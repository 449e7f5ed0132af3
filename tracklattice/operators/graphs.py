"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.plans.shared import materialize


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b): the component is its smallest node.

    Stars are hooked to the smallest label next to them and flattened, a round at a time; every round is a table in
    the shared folder, and the driver learns only whether a label still moved.
    """
    links = materialize(edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b").distinct(), "edges")
    parent = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "parents")
    for _ in range(most_rounds):
        hooked = links.join(parent.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        lowered = parent.join(hooked, F.col("node") == F.col("a")).select("node", "component", F.least("component", "c").alias("up"))
        flat = lowered.join(parent.select(F.col("node").alias("up"), F.col("component").alias("top")), "up", "left").select("node", F.col("component").alias("was"), F.least("up", F.coalesce("top", "up")).alias("component"))
        flat = materialize(flat, "parents")
        parent = flat.select("node", "component")
        if not flat.filter("component <> was").limit(1).count():
            return parent
    raise RuntimeError(f"connected: no end after {most_rounds} rounds")

"""Connected components by labels that shrink to the smallest id, as tables in the shared folder.

Neither links nor components come to the driver; it sees one number a round. Each round takes every
node's smallest neighbouring label and then jumps to that label's own label, so long chains halve. Both joins may have hot keys, a star's hub and a component's label, and are
salted; a round's tables go as soon as the next round's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.plans.shared import discard, materialize


SALTS = 8


def _salted(many: DataFrame, one: DataFrame, on: str, by: str, how: str) -> DataFrame:
    """A join of rows with a unique table; rows of a hot key are dealt to SALTS tasks. Never a broadcast, as the planner's estimate doesn't see the copies."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return left.join(one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [on, "salt"], how).drop("salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): component is the smallest node reachable.

    Rounds are bounded by the logarithm of the longest path, but for adverse orders of ids; should
    ``most_rounds`` not be enough, it raises rather than return a wrong result.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = _salted(both, labels.select(F.col("node").alias("other"), "component"), "other", "node", "inner").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("to"))
        after = materialize(_salted(lower, jump, "label", "node", "left").select("node", "was", F.least("label", F.coalesce("to", "label")).alias("component")), "labels")
        discard(labels)
        if not after.filter("component < was").limit(1).count():
            discard(edges)
            return after.select("node", "component")
        labels = after
    raise RuntimeError(f"components: no end after {most_rounds} rounds")

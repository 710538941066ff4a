"""Greedy selection over a conflict graph, computed in parallel rounds.

A greedy pass takes items by priority and drops those that conflict with an item already taken. The
same set comes out of rounds: every undecided item without an undecided stronger rival is taken, and
its weaker rivals are dropped. No group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.session import cut, shuffled


def greedy_keep(items: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """Keys kept by the greedy pass. `conflicts(strong, weak)`: taking `strong` drops `weak`."""
    edges = cut(conflicts.select("strong", "weak").distinct())
    dropped = None
    while not edges.isEmpty():
        # taken this round: rivals of someone, and nobody's weaker side
        heads = edges.select(F.col("strong").alias("k")).distinct().join(
            shuffled(edges.select(F.col("weak").alias("k")).distinct()), "k", "left_anti")
        gone = edges.join(shuffled(heads), edges.strong == heads.k, "left_semi").select(F.col("weak").alias("k")).distinct()
        gone = cut(gone)
        dropped = gone if dropped is None else dropped.union(gone)
        left = edges.join(shuffled(gone), edges.strong == gone.k, "left_anti")
        left = left.join(shuffled(gone), left.weak == gone.k, "left_anti")
        left = left.join(shuffled(heads), left.strong == heads.k, "left_anti")
        edges = cut(left)
    if dropped is None:
        return items
    return items.join(shuffled(dropped.withColumnRenamed("k", key)), key, "left_anti")

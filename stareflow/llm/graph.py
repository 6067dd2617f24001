"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stareflow.llm.common import forget, joined, stored

#: Bytes of a row of two ids, as a broadcast holds it.
ROW = 40


def _roots(edges: DataFrame) -> DataFrame:
    """(node, comp): each node points to the least of itself and its neighbours; comp is where the
    pointers end. Each step doubles how far they reach, so long chains need few steps."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    found = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")))
    while True:
        jump = found.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = joined(found.select("node", "comp"), jump, "comp", ROW)
        new = stored(new.select("node", F.col("next").alias("comp"), (F.col("next") < F.col("comp")).alias("moved")))
        if not new.where("moved").limit(1).count():
            forget(new)
            return found.select("node", "comp")
        forget(found)
        found = new


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node that it reaches.

    Each round lets every node point to its smallest neighbour, follows the pointers to their ends,
    and replaces the nodes of each link by these ends: links inside a tree vanish, and links that
    come to be equal count once. So a star of any size goes in a round or two, and later rounds
    have few links left. Minima are combined before each shuffle. Joins by a root or a star's centre
    go through joined(), which broadcasts a small side and else the few roots that hold many rows,
    so no component is gathered in one task. An empty table gives an empty table; repeated links and
    loops change nothing.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = stored(links.select(*ends).where("a <> b").distinct())
    labels = None
    for _ in range(max_rounds):
        roots = _roots(edges)
        at_a, at_b = roots.toDF("a", "x"), roots.toDF("b", "y")
        moved = joined(joined(edges, at_a, "a", ROW), at_b, "b", ROW, ready=False).select(F.col("x").alias("a"), F.col("y").alias("b"))
        rest = stored(moved.where("a <> b").select(*ends).distinct())
        if labels is None:
            labels = roots
        else:
            new = joined(labels, roots.toDF("comp", "then"), "comp", ROW, "left").select("node", F.coalesce("then", "comp").alias("comp"))
            new = stored(new)
            forget(labels, roots)
            labels = new
        forget(edges)
        edges = rest
        if not edges.limit(1).count():
            forget(edges)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

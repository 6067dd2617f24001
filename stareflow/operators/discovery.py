"""Link discovery under scope rules: the frontier grows by one depth at a time.

All links of the fetched pages that the rules can ever allow are one table of edges, written once. A round
joins the newest layer of the frontier to the edges of its pages, keeps what its kind may follow, and
takes away what is known. There are as many rounds as the scope allows depths, each layer is a stored
table, and a frontier that was kept can be given again: then only what is new is expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stareflow.functions import text as tx
from stareflow.operators.staging import staged

FRONTIER = "url string, kind string, depth int, parent string"


@dataclass(frozen=True)
class Scope:
    """Hosts that are followed; kinds of URLs, (pattern, kind), the first that matches; to which kinds a kind's links
    lead; kinds that are followed inside one work only; and how deep."""

    hosts: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...]
    follow: dict[str, tuple[str, ...]]
    same_work: tuple[str, ...] = ()
    max_depth: int = 1

    def may_follow(self, kind: Column, to: Column) -> Column:
        out = F.lit(False)
        for a, kinds in self.follow.items():
            out = out | ((kind == a) & to.isin(*kinds))
        return out


def edges(pages: DataFrame, scope: Scope) -> DataFrame:
    """(src, dst, kind, same_work) of the links of pages(url, html) to hosts and kinds of the scope, each once."""
    links = pages.select(F.col("url").alias("src"), tx.origin(F.col("url")).alias("base"), F.explode(tx.page_links(F.col("html"))).alias("link"))
    links = links.select("src", tx.resolved(F.col("link"), F.col("base")).alias("dst")).where("dst IS NOT NULL AND dst <> src").distinct()
    host = F.lower(F.try_parse_url("dst", F.lit("HOST")))
    kept = links.where(host.isin(*scope.hosts))
    kept = kept.withColumn("kind", tx.first_kind(tx.origin(F.col("dst")), list(scope.kinds))).where(F.col("kind").isin(*{k for kinds in scope.follow.values() for k in kinds}))
    same = tx.work_of(F.col("src")) == tx.work_of(F.col("dst"))
    return kept.where(same | ~F.col("kind").isin(*scope.same_work) if scope.same_work else F.lit(True)).select("src", "dst", "kind")


def discovered(pages: DataFrame, seeds: DataFrame, scope: Scope, known: DataFrame | None = None) -> DataFrame:
    """(url, kind, depth, parent) of everything that seeds(url, kind) lead to over pages(url, html): each URL once, at its
    least depth, from the parent that comes first by URL. A seed has depth 0 and no parent.

    known: a frontier of an earlier call. Its URLs keep their rows, and its pages are expanded from the
    depths that they have; so pages that were fetched since bring their links, and nothing is done twice.
    """
    link = staged(edges(pages, scope))
    start = seeds.select("url", "kind", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["url"])
    if known is not None:
        start = known.select("url", "kind", "depth", "parent").unionByName(start.join(known.select("url"), "url", "left_anti"))
    every = staged(start)
    for depth in range(scope.max_depth):
        layer = every.where(F.col("depth") == depth).select(F.col("url").alias("src"), F.col("kind").alias("from"))
        found = link.join(layer, "src").where(scope.may_follow(F.col("from"), F.col("kind")))
        found = found.groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"), F.first("kind").alias("kind"))  # a URL has one kind
        new = staged(found.join(every.select("url"), "url", "left_anti").select("url", "kind", F.lit(depth + 1).alias("depth"), "parent"))
        every = every.unionByName(new)
    return every

"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows


def _contracted(links: DataFrame) -> DataFrame:
    """Links within one task are replaced by stars around the smallest node they reach there."""

    def stars(given: Iterator[tuple]) -> Iterator[tuple]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flushed() -> Iterator[tuple]:
            yield from ((r, x) for x in parent if (r := root(x)) != x)

        for a, b in given:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
            if len(parent) >= 1 << 20:  # bounded memory: what is found so far goes out as stars
                yield from flushed()
                parent.clear()
        yield from flushed()

    return map_rows(links, stars, "src bigint, dst bigint", rows=1 << 15)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``src, dst``); ``root`` is the component's smallest node.

    Large and small stars alternate until nothing changes. Each round is a few aggregates with map-side combine and
    joins on the node; nothing but a changed-row count reaches the driver. Null links are ignored.
    """
    links = links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    current = durable(_contracted(links).distinct())
    while True:
        both = current.union(current.select("dst", "src"))
        lowest = both.groupBy("src").agg(F.min("dst").alias("m")).select(
            F.col("src").alias("k"), F.least("src", "m").alias("m")
        )
        large = both.where("dst > src").join(lowest, F.col("src") == F.col("k")).select(
            F.col("m").alias("src"), "dst"
        )
        # Small star: every node passes its lower neighbours on to the lowest of them.
        down = large.where("src <> dst").distinct()
        lower = down.groupBy("dst").agg(F.min("src").alias("m")).select(F.col("dst").alias("k"), "m")
        joined = down.join(lower, F.col("dst") == F.col("k"))
        small = joined.select(F.col("m").alias("src"), "dst").union(joined.select(F.col("m").alias("src"), F.col("src").alias("dst")))
        following = durable(_contracted(small.where("src <> dst")).distinct())
        # Stars are final once no node has two centres and no centre is itself a leaf.
        leaves = following.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        twice = leaves.where("n > 1").limit(1).count()
        chained = 0 if twice else following.join(leaves.select(F.col("dst").alias("leaf")), F.col("src") == F.col("leaf"), "left_semi").limit(1).count()
        current = following
        if not twice and not chained:
            break
    nodes = current.select(F.col("dst").alias("node"), F.col("src").alias("root"))
    return nodes.union(current.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct())

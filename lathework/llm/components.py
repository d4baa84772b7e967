"""Connected components of links, as DataFrame steps: alternating large and small stars.

Every step writes the edges to the shared folder, so lineage stays short and a lost
executor costs one step; no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Neighbours from which a node is a hub, whose edges meet its least neighbour by broadcast, not in one task. Where edges are so many
#: that there could be over MOST_HUBS of these, a hub has more: edges / MOST_HUBS, and so the broadcast has a bound.
HUB, MOST_HUBS = 100_000, 500_000
#: Steps after which something must be wrong; the method needs about the square of the logarithm.
MOST_STEPS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def _with_least(edges: DataFrame, source: DataFrame, count: int) -> DataFrame:
    """edges (a, b) with m, the least b of each a in source, or a itself if that is less."""
    least = source.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
    met, hub = F.col("a") == F.col("k"), max(HUB, count // MOST_HUBS)
    if count <= hub:
        return edges.join(least, met).select("a", "b", "m")
    hubs = written(least.filter(F.col("n") > hub).select("k", "m"), "hubs")
    rest = edges.join(F.broadcast(hubs), met, "left_anti").join(least, met).select("a", "b", "m")
    return rest.unionAll(edges.join(F.broadcast(hubs), met).select("a", "b", "m"))


def labels(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of links (a, b) but the labels themselves."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(MOST_STEPS):
        if not before[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, both, 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        if before[0] > HUB:
            large = written(large, "large")
        joined = _with_least(large, large, before[0])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, edges = edges, written(small, "edges")
        discard(last, large)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out.__dict__.update(_written_to=edges.__dict__.get("_written_to"))
    return out

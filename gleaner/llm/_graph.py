"""Connected components by alternating large-star and small-star passes (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._io import dealt_join, discarded, frequent, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a long, b long. Returns (id, component) for each node of an edge, component being its least reachable id.

    Each pass only aggregates minima and joins them back; a node with very many links is dealt over several tasks, and
    links shrink towards stars. Self-links and repeated links are harmless; an empty table gives an empty one.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = _state(links)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hot = frequent(both, ["u"], 2 * before[0])
        large = dealt_join(both.where("v > u"), least, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, down, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v")
        old, links = links, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discarded(old)
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

"""Connected components of links between ids, by alternating large-star and small-star steps.

Once few links are left one task finishes them; both ways give the same roots.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.frames import stored


FEW_LINKS = 500_000


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with the smallest id as root."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    ids = [x for x in above if top(x) != x]
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """`id`, `root` (smallest id of the component) for every id in `links` (columns u, v) but the roots.

    Every step keeps the components, and the edges shrink to stars in a number of steps that
    grows with the logarithm of the longest chain. Loops on one id are no links.
    """
    edges = stored(links.where("u <> v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= few:
            return stored(edges.coalesce(1).mapInArrow(_finish, "id long, root long"), "link-roots")
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now
        edges = stored(_small_star(_large_star(edges)), "links")

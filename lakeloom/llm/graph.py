"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGE = "u long, v long"


def spanning_edges(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A star (node, smallest node) for each component of the given pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch becomes its spanning stars: no more rows than before, and a few nodes deep."""
    for batch in batches:
        if batch.num_rows:
            star = spanning_edges(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in star], pa.int64()), pa.array([s[1] for s in star], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: two long columns. Returns (u, v): v is the smallest node of u's component, for each u that isn't it itself.

    Self-loops and rows with a null are ignored; an empty edge table gives an empty result. Edges are
    contracted within Arrow batches first, so that cliques and long chains shrink before any shuffle. A hot node's
    minimum is pre-aggregated; the joins below are plain equi-joins, whose skewed side Spark splits at run time. Both their sides grow with
    the edges, so neither is broadcast: many rounds would fill the driver with such tables, small as they may be.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null and u != v")
    e = materialize(e.mapInArrow(_contract, EDGE).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.filter("u != v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

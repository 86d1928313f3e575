"""Embedding near-dedup: a tree of spherical k-means cells, blocked cosine products within cells, one representative per group.

The roots are the groups of one label and length. At each level every group of over CELL_ROWS rows (SPLIT times that below the roots) is
cut: about PER_FIT of its own vectors, drawn by a hash, meet on an executor, which fits at most MOST_CELLS centroids; they travel to the group's
rows in the same sorted stream, so neither samples nor centroids pass through the driver, and each group has its own, however many
there are. Groups of many rows are salted. A pair at or above the threshold can lie across a border between two
cells, but then both are within sqrt(2 - 2 * threshold) of the plane between the two centroids. So each vector is also shown,
as a guest, to every earlier cell whose plane is that close: no pair is lost, and each is compared in exactly one cell.
A pair counts where, at each level, at least one of the two is at home. A cut that would show its sample over MOST_SHOWN times,
as it does to vectors that are nearly all within that distance, or that doesn't save half of the pairs, isn't made; of those with more and
fewer cells the one with the fewest pairs left is. What is left in a cell is cut into
blocks of about BLOCK rows that are compared two by two in separate tasks. A block pair returns link counts and a spanning
forest, never its pairs. Equal vectors of a label collapse first and count by their number.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without label, link
with nothing, as do vectors of different lengths; a null vec_id has a null component; rows that share a vec_id
count links each by its own vector; a vector of a label stands under the smallest vec_id that has it, and
vectors that stand under the same one are one vertex; further columns aren't looked at; an empty table gives an empty result.

What is broadcast: numbers of groups or vectors that hold over 1 / HOT_SHARE of all rows, so fewer than HOT_SHARE rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, join_by_size, materialize, settled, sorted_groups, table
from .graph import connected_components, spanning_edges

CELL_ROWS, SPLIT, LEVELS, BLOCK, ROUNDS = 4_000, 4, 8, 2_000, 8
PER_FIT, PER_CELL, MOST_CELLS, MOST_SHOWN = 2_000, 16, 64, 2.0
HOT_SHARE, SALT_ROWS = 1000, 100_000


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label and the vector's doubles as bytes; null where it links with nothing."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            x = None if not v or None in v else np.array(v, np.float64)
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors from vanishing or overflowing
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids for unit rows, seeded by rows spread evenly over the sample's order; an empty cell keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _shown(near: np.ndarray, gaps: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and the cells that they are shown to, and each row's home; near: products with the centroids, gaps: distances between these."""
    own = near.argmax(axis=1)
    best = near[np.arange(len(own)), own]
    border = (best[:, None] - near) <= reach * gaps[own] + 1e-9
    at_row, cell = np.nonzero(border & (np.arange(near.shape[1])[None] <= own[:, None]))
    return at_row, cell, own


def _gaps(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))


def _fit(threshold: float):
    reach = np.sqrt(2 - 2 * threshold) + 1e-9

    def fit(sample: pa.Table) -> pa.Table:
        """The centroids of one group from its sample, some PER_FIT rows, as one row; none where no cut helps."""
        sample = sample.sort_by("id")
        x, rows = _unit(sample.column("vec").to_pylist()), sample.column("rows")[0].as_py()
        k = min(MOST_CELLS, len(x) // PER_CELL, -(-rows // CELL_ROWS))
        best, least = None, len(x) ** 2 / 2  # pairs of the sample to compare: a cut must save half of them
        while k > 1:
            centroids = spherical_kmeans(x, k)
            at_row, cell, _ = _shown(x @ centroids.T, _gaps(centroids), reach)
            work = (np.bincount(cell) ** 2).sum()
            if len(at_row) <= MOST_SHOWN * len(x) and work < least:
                best, least = centroids, work
            k = k // 4 if k > 8 else k - 1 if k < 5 else 4
        some = [best] if best is not None else []
        return pa.table({"group": pa.array([sample.column("group")[0].as_py()] * len(some), pa.int64()), "vec": pa.array([c.tobytes() for c in some], pa.binary()), "id": pa.array([len(c) for c in some], pa.int64())})

    return fit


def _cells(threshold: float, level: int):
    """Each row with its home cell, and with every earlier cell whose border is within the greatest distance of a link; rows come by group, behind their group's centroids.

    Of a group without centroids the rows stay as they are (cell -1), at home.
    """
    reach = np.sqrt(2 - 2 * threshold) + 1e-9
    names = ["id", "rep", "m", "vec", "group", "home", "cell"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                groups, heads = part.column(4).to_numpy(), part.column(5).to_numpy() < 0
                for k in np.flatnonzero(heads):
                    c = np.frombuffer(part.column(3)[k].as_py(), np.float64).reshape(part.column(0)[k].as_py(), -1)
                    held[int(groups[k])] = c, _gaps(c)
                for g in [g for g in held if g < groups[0]]:
                    del held[g]
                plain = ~heads & ~np.isin(groups, list(held))
                if plain.any():
                    rows = part.take(pa.array(np.flatnonzero(plain)))
                    home = rows.column(5).to_numpy() | np.int32(1 << level)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(home, pa.int32()), pa.array(np.full(len(home), -1, np.int32))], names=names)
                for g, (c, gaps) in held.items():
                    rows = part.take(pa.array(np.flatnonzero((groups == g) & ~heads)))
                    if not rows.num_rows:
                        continue
                    at_row, cell, own = _shown(_unit(rows.column(3).to_pylist()) @ c.T, gaps, reach)
                    got = rows.take(pa.array(at_row))
                    home = got.column(5).to_numpy() | (cell == own[at_row]).astype(np.int32) << level
                    yield pa.RecordBatch.from_arrays([*got.columns[:5], pa.array(home, pa.int32()), pa.array(cell.astype(np.int32))], names=names)

    return cells


def _compare(threshold: float, everywhere: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pair of blocks: (id, other rows linked, null) and spanning edges (rep, 0, smaller rep)."""
        for g in sorted_groups(batches, 3):
            bi, bj = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            blk, ids, reps, m, home = (g.column(k).to_numpy() for k in (3, 4, 5, 6, 7))
            x = _unit(g.column(8).to_pylist())
            left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            counts, edges = np.zeros(len(ids), np.int64), []
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                ok = (x[a] @ x[right].T >= threshold) & ((home[a][:, None] | home[right][None]) == everywhere)
                if bi == bj:
                    ok &= a[:, None] < right[None]
                p, q = np.nonzero(ok)
                p, q = a[p], right[q]
                np.add.at(counts, p, m[q])
                np.add.at(counts, q, m[p])
                edges = spanning_edges([*edges, *zip(reps[p].tolist(), reps[q].tolist())])
            some = np.flatnonzero(counts)
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), *(e[0] for e in edges)], pa.int64()), pa.array([*counts[some].tolist(), *[0] * n], pa.int64()), pa.array([*[None] * len(some), *(e[1] for e in edges)], pa.int64())], names=["id", "links", "other"]
            )

    return compare


@settled("near-vectors")
def near_dups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """A row for each vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = materialize(rows.mapInArrow(_vectors, "id long, label string, vec binary"), "vectors")
    reps = rows.filter("vec is not null and label is not null").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    reps = materialize(reps.withColumn("key", F.monotonically_increasing_id()), "distinct")
    found = _links(reps.filter("rep is not null").select(F.col("key").alias("id"), "rep", "label", "m", "vec"), threshold)
    links = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("other is not null").select("id", "other"))
    of_rep = reps.join(links.withColumnRenamed("id", "key"), "key", "left").join(components.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left")
    of_rep = materialize(of_rep.select("label", "vec", "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("comp", "rep").alias("comp")), "of-vectors")
    able = F.col("vec").isNotNull() & F.col("label").isNotNull()
    linked = join_by_size(rows.filter(able), of_rep, ["label", "vec"], "m", rows.count() // HOT_SHARE).select("id", "n", "comp")
    out = linked.unionByName(rows.filter(~able).select("id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("comp")))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _cut(rows: DataFrame, total: int, threshold: float, level: int) -> DataFrame | None:
    """rows with the groups of the next level; None if there is nothing to cut."""
    most = CELL_ROWS * (SPLIT if level else 1)
    large = materialize(rows.groupBy("group").agg(F.count("*").alias("rows")).filter(F.col("rows") > most), "large-cells")
    if not large.head(1):
        return None
    draw = lambda share: drawn(f"cells{level}", F.col("id"), share)  # noqa: E731  a smaller share draws some of a larger one's rows
    sample = join_by_size(rows.filter(draw(min(1.0, PER_FIT / most))).select("group", "id", "vec"), large, ["group"], "rows", total // HOT_SHARE)
    centroids = materialize(sample.filter(draw(PER_FIT / F.col("rows"))).groupBy("group").applyInArrow(_fit(threshold), "group long, vec binary, id long"), "centroids")
    if not centroids.head(1):
        return None
    salted = large.filter(F.col("rows") > max(SALT_ROWS, total // HOT_SHARE)).select("group", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts"))  # fewer than HOT_SHARE rows, as guests are at most MOST_SHOWN - 1 of them a level
    with_salts = lambda df: df.join(F.broadcast(salted), "group", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    heads = with_salts(centroids).select("id", F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("m"), "vec", "group", F.lit(-1).alias("home"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    body = with_salts(rows).select("id", "rep", "m", "vec", "group", "home", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    stream = heads.unionByName(body).repartition("group", "salt").sortWithinPartitions("group", "home").drop("salt")
    out = stream.mapInArrow(_cells(threshold, level), "id long, rep long, m long, vec binary, group long, home int, cell int")
    of_cell = F.when(F.col("cell") < 0, F.col("group")).otherwise(F.xxhash64("group", "cell", F.lit(level)))
    return materialize(out.withColumn("group", of_cell).drop("cell"), "cells")


def _links(reps: DataFrame, threshold: float) -> DataFrame:
    """Link counts and spanning edges of distinct vectors (id, rep, label, m, vec)."""
    rows, everywhere, total = reps.select("id", "rep", "m", "vec", F.xxhash64("label", F.length("vec")).alias("group"), F.lit(0).alias("home")), 0, reps.count()
    for level in range(LEVELS):
        if (cut := _cut(rows, total, threshold, level)) is None:
            break
        rows, everywhere = cut, everywhere | 1 << level
    sizes = rows.groupBy("group").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    tasks = join_by_size(rows, materialize(sizes, "cell-sizes"), ["group"], "rows", total // HOT_SHARE)
    tasks = tasks.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["group", "bi", "bj"]
    tasks = tasks.select("group", F.least("blk", "mate").alias("bi"), F.greatest("blk", "mate").alias("bj"), "blk", "id", "rep", "m", "home", "vec")
    return materialize(tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold, everywhere), "id long, links long, other long"), "links")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), d AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT m.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.x = m.vec_id LEFT JOIN d ON d.x = m.vec_id
"""

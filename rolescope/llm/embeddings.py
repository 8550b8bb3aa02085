"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column, components, forest, run_starts, trimmed, whole_runs

THRESHOLD = 0.9
RECALL = 0.999  # share of the pairs at the threshold that shall meet; the number of tables follows from it
TABLES = 16  # at least
MOST_TABLES = 256  # beyond, fewer hashes per table are taken: larger buckets, but no pair lost
TRIALS = 1 << 15  # meetings tried to learn how often a pair at the threshold meets in one table; fewer of long vectors
PROBES = 4
BUCKET = 0.25  # unrelated vectors a bucket shall hold on average; the number of hashes per table follows from it
BLOCK = 1024  # vectors of a bucket that one run compares with as many others
CELLS = 1 << 20  # cells of vectors that are held at a time
SEED = 11


def _width(dims: int) -> int:
    return 1 << max(1, (dims - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def cells(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Cells of unit vectors, shape (vectors, tables, probes); probe 0 is the vector's own bucket.

    A hash rotates by three rounds of random signs and a Hadamard transform and takes the corner of the
    cross-polytope (axis and sign) that is nearest. ``hashes`` of them make a bucket. The further probes change the one hash where a
    second corner is almost as near. The number of the table is part of a cell.
    """
    n, dims = x.shape
    width = _width(dims)
    padded = np.zeros((n, width))
    padded[:, :dims] = x
    draw = np.random.default_rng(SEED)
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, options, gaps = np.zeros(n, np.int64), [], []
        for h in range(hashes):
            y = padded
            if width <= 16:  # of these, signs and Hadamard transforms make too few rotations for tables to be drawn apart
                y = y @ np.linalg.qr(draw.normal(size=(width, width)))[0]
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], width))
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, : min(3, width)]
            scale = (2 * width) ** h
            corner = [near[:, r] * 2 + (y[rows, near[:, r]] > 0) for r in range(near.shape[1])]
            first += corner[0] * scale
            for r in range(1, near.shape[1]):
                options.append((corner[r] - corner[0]) * scale)
                gaps.append(size[rows, near[:, 0]] - size[rows, near[:, r]])
        order = np.argsort(np.array(gaps).T, axis=1, kind="stable")[:, : probes - 1]
        moved = first[:, None] + np.take_along_axis(np.array(options).T, order, axis=1)
        base = t * (2 * width) ** hashes
        out[:, t, 0] = base + first
        out[:, t, 1:] = base + moved[:, np.arange(probes - 1) % moved.shape[1]]
    return out


def hashes_for(vectors: int, dims: int, bucket: float = BUCKET, tables: int = TABLES) -> int:
    """Hashes per table so that unrelated vectors fill a bucket with about ``bucket`` of them; cells stay below 2^62."""
    corners = 2 * _width(dims)
    most = int((62 - ceil(log(tables, 2))) / log(corners, 2))
    return max(1, min(most, ceil(log(max(1, vectors) / bucket, corners))))


@cache
def meeting(dims: int, threshold: float, hashes: int, probes: int) -> float:
    """Chance that two vectors with cosine ``threshold`` meet in a table, tried with random pairs; two standard errors below what was found."""
    width = _width(dims)
    pairs = max(64, min(1 << 10, (1 << 16) // width))
    draw = np.random.default_rng(SEED + 1)
    a, b = draw.normal(size=(2, pairs, max(2, dims)))
    a /= np.sqrt((a * a).sum(1))[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.sqrt((b * b).sum(1))[:, None]
    b = threshold * a + sqrt(max(0.0, 1 - threshold**2)) * b
    tables = max(8, min(TRIALS, (1 << 21) // width) // pairs)
    found = cells(np.concatenate([a, b]), tables, hashes, probes)
    one, other = found[:pairs], found[pairs:]
    p = float(((one[:, :, :1] == other) | (other[:, :, :1] == one)).any(2).mean())
    return p - 2 * sqrt(p * (1 - p) / (pairs * tables))


def tables_for(dims: int, threshold: float, hashes: int, probes: int = PROBES, recall: float = RECALL) -> int | None:
    """Tables of which ``recall`` of the pairs at the threshold share one bucket at least, as tables are drawn apart; none if they never meet."""
    p = meeting(dims, threshold, hashes, probes)
    return max(TABLES, ceil(log(1 - recall) / log(1 - p))) if 0 < p < 1 else TABLES if p >= 1 else None


def layout(vectors: int, dims: int, threshold: float = THRESHOLD, probes: int = PROBES) -> tuple[int, int]:
    """Tables and hashes per table: as many hashes as the number of vectors asks for, and tables for the recall."""
    for hashes in range(hashes_for(vectors, dims, tables=MOST_TABLES), 0, -1):
        tables = tables_for(dims, threshold, hashes, probes)
        if tables and tables <= MOST_TABLES:
            return tables, hashes
    raise ValueError(f"pairs with cosine {threshold} meet too rarely in {dims} dimensions")


def _matrix(rows: pa.Table | pa.RecordBatch, name: str, dtype: type, *shape: int) -> np.ndarray:
    """A column of lists, all of one length and without nulls, as an array."""
    col = rows.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), *shape)


def _hashed(dims: int, tables: int, hashes: int, probes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "vector", float, dims)
            x = x / np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
            x /= np.sqrt((x * x).sum(1))[:, None]
            step = CELLS // (tables * probes) + 1
            for at in range(0, len(x), step):
                part = x[at : at + step]
                found = cells(part, tables, hashes, probes).reshape(len(part), -1)
                yield pa.RecordBatch.from_pydict({
                    "vec": batch.column("vec").slice(at, step), "copies": batch.column("copies").slice(at, step),
                    "unit": pa.array(list(part), pa.list_(pa.float64())), "cells": pa.array(list(found), pa.list_(pa.int64())),
                })

    return rows


def _cell_rows(probes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _matrix(batch, "cells", np.int64, -1)
                n, width = found.shape
                probed = found.reshape(n, -1, probes)
                new = np.ones(probed.shape, bool)  # few hashes have fewer other corners than probes, which repeat then
                for r in range(1, probes):
                    new[:, :, r] = (probed[:, :, :r] != probed[:, :, r : r + 1]).all(2)
                new = new.reshape(-1)
                yield pa.RecordBatch.from_pydict({
                    "cell": found.reshape(-1)[new], "vec": np.repeat(column(batch, "vec"), width)[new],
                    "own": np.tile(np.arange(width) % probes == 0, n)[new],
                })

    return rows


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: cut each bucket into blocks and deal out every pair of blocks, so that no task gets a whole hot bucket.

    Buckets with one vector, or without any whose own bucket it is, make no pair.
    """

    def dealt(cell: np.ndarray, i: int, j: int, vec: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        n = len(vec)
        return pa.RecordBatch.from_pydict(
            {"cell": cell, "i": np.full(n, i, np.int32), "j": np.full(n, j, np.int32), "vec": vec, "side": side.astype(np.int32)})

    for rows in whole_runs(batches, ["cell"]):
        cell, vec, own = column(rows, "cell"), column(rows, "vec"), column(rows, "own")
        starts = run_starts(cell)
        sizes = np.diff(np.append(starts, len(cell)))
        alive = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
        small = np.repeat(alive & (sizes <= BLOCK), sizes)
        yield dealt(cell[small], 0, 0, vec[small], np.zeros(small.sum()))
        for start, size in zip(starts[alive & (sizes > BLOCK)].tolist(), sizes[alive & (sizes > BLOCK)].tolist()):
            blocks = [vec[at : min(at + BLOCK, start + size)] for at in range(start, start + size, BLOCK)]
            for i, first in enumerate(blocks):
                yield dealt(np.full(len(first), cell[start]), i, i, first, np.zeros(len(first)))
                for j in range(i + 1, len(blocks)):
                    both = np.concatenate([first, blocks[j]])
                    yield dealt(np.full(len(both), cell[start]), i, j, both, np.arange(len(both)) >= len(first))


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell in which pairs of vectors meet: one's own bucket that is among the other's probes."""
    far = np.iinfo(np.int64).max
    best = np.full(len(a), far)
    for one, other in ((a, b), (b, a)):
        met = (one[:, :, :1] == other).any(2)
        best = np.minimum(best, np.where(met, one[:, :, 0], far).min(1))
    return best


def _verified(dims: int, tables: int, probes: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cell, i, j): link the vectors of a run, each pair only in the smallest cell where it meets."""
        step = CELLS // (tables * probes) + 1
        for rows in whole_runs(batches, ["cell", "i", "j"], min(1 << 13, step)):
            vec, copies, cell, side = (column(rows, c) for c in ("vec", "copies", "cell", "side"))
            i, j = column(rows, "i"), column(rows, "j")
            x, found = _matrix(rows, "unit", float, dims), _matrix(rows, "cells", np.int64, tables, probes)
            starts = run_starts(cell, i, j)
            sizes = np.diff(np.append(starts, len(vec)))
            links = np.zeros(len(vec), np.int64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, end in zip(starts.tolist(), (starts + sizes).tolist()):
                near = np.triu(x[start:end] @ x[start:end].T >= threshold, 1)
                if i[start] != j[start]:  # pairs within one block belong to that block's own run
                    near &= side[start:end, None] != side[None, start:end]
                a, b = (k + start for k in np.nonzero(near))
                for at in range(0, len(a), step):
                    p, q = a[at : at + step], b[at : at + step]
                    once = _first_meeting(found[p], found[q]) == cell[start]
                    p, q = p[once], q[once]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    s, r = forest(vec[p], vec[q])
                    left.append(s)
                    right.append(r)
            a, b = forest(np.concatenate(left), np.concatenate(right))
            some = links > 0
            yield pa.RecordBatch.from_pydict({
                "vec": np.concatenate([vec[some], a]), "links": np.concatenate([links[some], np.zeros(len(a), np.int64)]),
                "root": pa.array([None] * int(some.sum()) + b.tolist(), pa.int64()),
            })

    return verify


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per id, whatever other columns ``vectors`` has.

    Vectors are linked if their cosine, in double precision, is at least ``threshold``; no pair below it is. n_links counts the
    other vectors linked directly, component_id is the smallest id reachable, kept tells whether that is the vector itself.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
    different lengths never link. Rows with equal ids are one vector; of several embeddings the smallest counts. Rows
    with a null id are one row: no links, null component, kept.

    ``RECALL`` of the pairs at the threshold are found, and more of nearer ones, however many vectors there are: unless ``tables`` are given,
    their number follows from dimensions, threshold and hashes per table. A threshold too low for that is refused.

    Equal vectors are one class, counted with its copies, so that copies are never paired. A class is stored in its own bucket of each
    table and probes the nearest other buckets. Buckets are compared in pairs of blocks; a pair found in several buckets counts in the
    first only, and leaves a bucket as two counts and one link of a star, not as a pair.
    """
    named = vectors.groupBy(F.col(vec_id).cast("long").alias("vec")).agg(F.min(F.col(embedding).cast("array<double>")).alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.col("vec").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    named = stored(named.withColumn("valid", F.coalesce(valid, F.lit(False))), "embedding-rows")
    classes = named.where("valid").groupBy("vector").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"))
    classes = stored(classes, "embedding-classes")
    widths = classes.groupBy(F.size("vector").alias("dims")).count().orderBy("dims").collect()
    counts, stars = [], []
    for dims, n in widths:
        derived, hashes = layout(n, dims, threshold, probes) if tables is None else (tables, hashes_for(n, dims, tables=tables))
        own = classes.where(F.size("vector") == dims)
        hashed = stored(
            own.mapInArrow(trimmed(_hashed(dims, derived, hashes, probes)), "vec long, copies long, unit array<double>, cells array<long>"), "embedding-cells")
        rows = hashed.select("vec", "cells").mapInArrow(trimmed(_cell_rows(probes)), "cell long, vec long, own boolean")
        buckets = rows.repartition("cell").sortWithinPartitions("cell", "vec")
        pairs = buckets.mapInArrow(trimmed(_block_pairs), "cell long, i int, j int, vec long, side int")
        dealt = pairs.join(hashed, "vec").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "vec")
        found = stored(dealt.mapInArrow(trimmed(_verified(dims, derived, probes, threshold)), "vec long, links long, root long"), "embedding-links")
        counts.append(found.groupBy("vec").agg(F.sum("links").alias("links")))
        stars.append(found.where("root IS NOT NULL").select(F.col("vec").alias("a"), F.col("root").alias("b")))
    if not widths:
        return named.select(
            F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"), F.lit(True).alias("kept"))
    reached = components(reduce(DataFrame.unionByName, stars))
    linked = classes.join(reduce(DataFrame.unionByName, counts), "vec", "left").join(reached, F.col("vec") == F.col("node"), "left").select(
        F.col("vector").alias("like"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "vec").alias("root"))
    own = named.join(linked, F.col("valid") & (F.col("vector") == F.col("like")), "left")
    component = F.coalesce("root", "vec")
    return own.select(
        F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec") == component, F.lit(True)).alias("kept"))

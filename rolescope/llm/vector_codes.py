"""Vectors as short codes: integer product quantization with exact distances.

Components become whole numbers, vectors are cut into equal parts, and each part is named by the nearest entry of its position's codebook. Distances are
compared as |c|^2 - 2 x.c. The dot products of all parts with all entries are matrix products: both sides are broken into limbs so narrow that
float64 products and their sums stay below 2^53, where they are exact, and the limbs' products are put together in int64. The first
smallest distance wins.

Codebooks are bounded (parts x entries x width numbers), go out with the tasks and come back as sums of whole numbers, which
do not depend on the order of rows, so a task that is run again changes nothing. A round is one pass over the stored whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import trimmed

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 13  # vectors compared at once


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float matrices whose sum, each shifted by ``bits`` more than the one before, is ``values``; none beyond +-2^bits."""
    out, rest = [], values
    while np.abs(rest).max(initial=0) > 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact where the result is in the range of int64."""
    bits = (52 - max(1, x.shape[1]).bit_length()) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for k, b in enumerate(right):
            if bits * (i + k) < 64:  # what is shifted further leaves the range and cancels out
                total += (a @ b.T).astype(np.int64) << (bits * (i + k))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equal ones, and its squared distance."""
    apart = (entries * entries).sum(1) - 2 * exact_products(x, entries)
    best = apart.argmin(1)
    return best, apart[np.arange(len(x)), best] + (x * x).sum(1)


def largest_component(width: int) -> int:
    """Bound of whole components for which each squared distance of a whole vector fits int64, with room to spare."""
    return 1 << ((60 - max(1, width).bit_length()) // 2)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` as whole numbers, that is ``scale`` times the components."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all numbers, decimal and joined by commas, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, codes: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        return self.entries[np.arange(len(codes)), np.frombuffer(codes, np.uint8)].ravel() / self.scale


def _matrices(batches: Iterator[pa.RecordBatch], name: str, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as (rows, parts, width)."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(low, BLOCK)
            flat = rows.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield rows, flat.reshape(rows.num_rows, parts, -1) if len(flat) else np.zeros((rows.num_rows, parts, 0), np.int64)


def _whole(scale: int):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components turn into NaN
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(sizes)
            good = (wrong[ends] == wrong[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                floors = np.floor(flat[np.repeat(good, sizes)] * scale)
            if (np.abs(floors) > 2.0**62).any():
                raise ValueError("components are too large for exact distances")
            values = pa.array(floors.astype(np.int64))
            starts = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            kept = batch.filter(pa.array(good))
            columns = {c: kept.column(c) for c in kept.schema.names if c != "vector"}
            yield pa.RecordBatch.from_pydict(columns | {"whole": pa.ListArray.from_arrays(pa.array(starts), values)})

    return convert


def whole_vectors(vectors: DataFrame, columns: list[str], vector: str, scale: int) -> DataFrame:
    """``columns`` and the whole components ``whole`` of all rows whose vector has neither nulls nor non-finite components."""
    rows = vectors.select(*columns, F.col(vector).cast("array<double>").alias("vector"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(trimmed(_whole(scale)), f"{kinds}, whole array<long>")


def _sums(entries: np.ndarray):
    """Per task: count and component sums of the parts that fall to each entry. Sums are handed on before they could leave int64."""
    parts, size, width = entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            return pa.RecordBatch.from_pydict({
                "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(counts[part, entry]),
                "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))})

        counts, sums, seen = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64), 0
        for rows, x in _matrices(batches, "whole", parts):
            for part in range(parts):
                best, _ = nearest(x[:, part], entries[part])
                counts[part] += np.bincount(best, minlength=size)
                np.add.at(sums[part], best, x[:, part])
            seen += len(x)
            if seen >= 1 << 30:
                yield row(counts, sums)
                counts[:], sums[:], seen = 0, 0, 0
        if seen:
            yield row(counts, sums)

    return add


def learn(rows: DataFrame, order: str, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of stored whole vectors. They start as the parts of the vectors that come first by ``order`` (nulls last, then by components), at
    most ``entries``; each round replaces an entry by the floor of the mean of its parts, and leaves entries without parts as they are."""
    first = rows.orderBy(F.col(order).asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    held = np.array([r.whole for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        partial = rows.select("whole").mapInArrow(trimmed(_sums(held)), "part int, entry int, n long, sums array<long>")
        # One row per number of the codebooks; decimals, as sums over all tasks may leave the range of long.
        added = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        for r in added.collect():
            held[r.part, r.entry, r.at] = int(r["sum"]) // r.n
    return Codebooks(held, scale)


def _encode(books: Codebooks, keep: list[str]):
    parts = len(books.entries)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _matrices(batches, "whole", parts):
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for part in range(parts):
                best, apart = nearest(x[:, part], books.entries[part])
                codes[:, part], error = best, error + apart
            yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in keep} | {
                "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)})

    return encode


def compress(vectors: DataFrame, columns: list[str], order: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors and the codebooks learned from all of them. Runs the rounds at once.

    Returns ``columns`` with codes (binary, a byte per part) and error (squared distance of the whole components from the code's). ``columns`` must hold
    ``order`` and neither codes, error, vector nor whole.
    Rows whose vector is null or holds null or non-finite components are left out. Rows with equal or null ids are rows of their own; null ids come
    last and equal ids by components when the first entries are taken. Fewer vectors than ``entries`` give smaller codebooks, and an empty
    table gives no rows. Raises ValueError if vectors differ in length, if it is no multiple of ``parts``, or if components are so
    large that a distance could leave the range of long. Vectors without components have code 0 and error 0.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte")
    rows = stored(whole_vectors(vectors, columns, vector, scale), "whole-vectors")
    seen = rows.agg(F.min(F.size("whole")).alias("least"), F.max(F.size("whole")).alias("most"),
                    F.max(F.array_max("whole")).alias("high"), F.min(F.array_min("whole")).alias("low")).first()
    if seen.least != seen.most or (seen.most or 0) % parts:
        raise ValueError(f"vectors of {seen.least} to {seen.most} components, not of one length that is a multiple of {parts}")
    if max(seen.high or 0, -(seen.low or 0)) > largest_component(seen.most or 0):
        raise ValueError("components are too large for exact distances")
    books = learn(rows, order, scale, parts, entries, rounds)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(trimmed(_encode(books, columns)), f"{kinds}, codes binary, error long"), books


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """Adds label_error: the errors of all rows with an equal label, nulls together. Errors are added up per label before they are joined."""
    sums = stored(codes.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, codes[label].eqNullSafe(sums["_label"]), "left").drop("_label")

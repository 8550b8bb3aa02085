"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column, components, forest, run_starts, trimmed, whole_runs, words

BITS = 64
SEED = 42
SHINGLE = 3
MAX_BITS = 2
PIVOTS = 10  # coordinates of 6 bits each, so that a table row's coordinates fit one long
BLOCKS = 8


def fingerprint(tokens: list[bytes], shingle: int) -> int:
    """64 majority bits over the XXH64 of all shingles, repeats included. No words: zero."""
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(tokens) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans]
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory, also for very long texts
        part = np.array(hashes[at : at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp): fp holds the 64 bits as a signed long. One row per row of ``docs``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(words(t), shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string")).mapInArrow(trimmed(compute), "doc long, fp long")


def pivots(n: int, bits: int = BITS) -> np.ndarray:
    """Reference fingerprints: fixed, spread evenly over the space."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def masks(max_bits: int, blocks: int) -> np.ndarray:
    """Every choice of ``blocks - max_bits`` of the blocks, as a bit mask.

    Two fingerprints that differ in at most ``max_bits`` bits agree in at least one of these masks.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return np.array([sum(block[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)], np.uint64)


def pivot_table(prints: np.ndarray, mask: np.uint64, references: np.ndarray) -> np.ndarray:
    """Hamming distances to the references within a mask, packed into one long per fingerprint."""
    packed = np.zeros(len(prints), np.int64)
    for j, reference in enumerate(references):
        packed |= np.bitwise_count((prints ^ reference) & mask).astype(np.int64) << 6 * j
    return packed


def _table_rows(max_bits: int, blocks: int):
    chosen, references = masks(max_bits, blocks), pivots(PIVOTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = column(batch, "fp").view(np.uint64)
            n = len(prints)
            yield pa.RecordBatch.from_pydict({
                "number": np.repeat(np.arange(len(chosen), dtype=np.int32), n),
                "coordinates": np.concatenate([pivot_table(prints, m, references) for m in chosen]),
                "fp": np.tile(prints.view(np.int64), len(chosen)),
                "doc": np.tile(column(batch, "doc"), len(chosen)),
            })

    return rows


def near_pairs(prints: np.ndarray, references: np.ndarray, max_bits: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``max_bits``, by a pivot table over all bits: rows are sorted by their first coordinate, a pair whose
    coordinates differ by more than ``max_bits`` anywhere is discarded, the rest is verified."""
    table = np.array([np.bitwise_count(prints ^ r) for r in references], np.int16)
    order = np.argsort(table[0], kind="stable")
    table, sorted_prints = table[:, order], prints[order]
    for start in range(0, len(prints), block):
        end = min(start + block, len(prints))
        stop = int(np.searchsorted(table[0], table[0, end - 1] + max_bits, "right"))
        for low in range(start, stop, block):
            high = min(low + block, stop)
            alive = np.arange(low, high)[None, :] > np.arange(start, end)[:, None]
            for coordinate in table:
                alive &= np.abs(coordinate[start:end, None] - coordinate[None, low:high]) <= max_bits
            a, b = np.nonzero(alive)
            a, b = a + start, b + low
            near = np.bitwise_count(sorted_prints[a] ^ sorted_prints[b]) <= max_bits
            yield order[a[near]], order[b[near]]


def _links(max_bits: int):
    references = pivots(PIVOTS + 6)[PIVOTS:]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (number, coordinates): bring each bucket's near fingerprints together, as stars and not as all pairs."""
        for rows in whole_runs(batches, ["number", "coordinates"]):
            prints, docs = column(rows, "fp").view(np.uint64), column(rows, "doc")
            starts = run_starts(column(rows, "number"), column(rows, "coordinates"))
            sizes = np.diff(np.append(starts, len(prints)))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = starts[sizes == 2]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits]
            a.append(docs[near])
            b.append(docs[near + 1])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = docs[start : start + size]
                for i, j in near_pairs(prints[start : start + size], references, max_bits):
                    left, right = forest(own[i], own[j])
                    a.append(left)
                    b.append(right)
            left, right = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_pydict({"a": left, "b": right})

    return links


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    A fingerprint bit is 1 if more than half the shingles' hashes have it; the string has 16 hex digits. Documents are
    linked if their fingerprints differ in at most ``max_bits`` bits; component_id is the smallest id reachable. Null,
    empty and blank texts have fingerprint zero and link like any other. A row with a null id has its
    fingerprint, but neither links nor gets a component. Repeated rows each come back.

    Equal fingerprints are one row from here on, under their smallest id. The bits are cut into ``blocks`` blocks; for each choice of
    ``blocks - max_bits`` of them a table holds the fingerprints' distances to the pivots within these blocks. Two near
    fingerprints agree in one choice, so there all their coordinates are equal: rows are dealt by table and coordinates, which
    discards every pair with any other difference. In a bucket, pivot distances over all bits discard further pairs and the rest
    is verified bit by bit. Buckets are small, however large a group of copies is: with 8 blocks and 2 bits, 16 bits are free.
    """
    prints = stored(fingerprints(docs, shingle, doc_id, text), "simhash-prints")
    named = prints.where("doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("doc"))
    named = stored(named, "simhash-classes")
    tables = named.mapInArrow(trimmed(_table_rows(max_bits, blocks)), "number int, coordinates long, fp long, doc long")
    dealt = tables.repartition("number", "coordinates").sortWithinPartitions("number", "coordinates")
    reached = components(dealt.mapInArrow(trimmed(_links(max_bits)), "a long, b long"))
    classes = named.join(reached, F.col("doc") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component_id", "doc").alias("component_id"))
    return prints.join(classes, F.col("fp") == F.col("_fp"), "left").select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without an id stay."""
    groups = near_duplicates(docs, shingle, max_bits, doc_id=doc_id, text=text)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_doc"], "left_anti")

"""What several operators here share: reading tables, streaming sorted groups, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure as configure_session
from ..session import stored

ASCII_SPACE = " \t\n\x0b\x0c\r"  # fixed value: the class [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def configure(spark: SparkSession) -> SparkSession:
    """The session's settings, with Arrow batches small enough for several Python workers beside a small executor's heap."""
    configure_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def words(value: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased. ``bytes.lower`` and ``bytes.split`` know ASCII only, as the contract asks."""
    return raw_text(value).lower().split()


def trimmed(function):
    """The same function on batches, which gives freed memory back to the system at the end of a task: Python workers live on, and
    what one task needed would stay with each of them."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables of about ``rows`` rows that never cut a run of equal integer keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if all(held[0].column(k)[0] == v for k, v in zip(keys, last)):
            continue  # one run fills all that is held
        start = int(run_starts(*[column(batch, k) for k in keys])[-1])
        if start == 0 and len(held) > 1:  # the last run began in an earlier batch
            whole = pa.Table.from_batches(held).combine_chunks()
            start = int(run_starts(*[column(whole, k) for k in keys])[-1])
            yield whole.slice(0, start)
            rest = whole.slice(start).to_batches()
        else:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, start)]).combine_chunks()
            rest = [batch.slice(start)]
        held, n = rest, sum(b.num_rows for b in rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    col = rows.column(name)
    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).to_numpy(zero_copy_only=False)


def fixed_bytes(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of byte strings, all ``width`` long, as a matrix of bytes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contract links to stars: each node that has a link and the smallest node it reaches through them."""
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        # Hang both roots below the smaller label, then halve the paths until they are flat.
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links in a chunk of bounded size; fewer links, same reachability."""
    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        node, root = forest(column(links, "a"), column(links, "b"))
        return pa.RecordBatch.from_pydict({"a": node, "b": root})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= 1 << 20:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links ``a``, ``b`` (long, not null): one row (node, component_id) per node whose
    smallest reachable node is another one.

    Links are contracted to stars inside each task, then large-star and small-star rounds alternate on all links until
    nothing changes. The neighbours of a node never meet in one task: a round takes the minimum per node (reduced before the
    shuffle) and joins it back, and AQE splits hot nodes in that join. Each round is written to the shared folder.
    """
    # Written first, so that a task never holds two Python workers.
    found = stored(links.select("a", "b").where("a <> b"), "links")
    edges = stored(found.mapInArrow(trimmed(_contract), "a long, b long").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: the larger neighbours of a node move to the smallest one.
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and itself, move to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a")
        edges = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        edges = stored(edges.distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, which itself has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[s : s + n]`` one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
    return values[at]


class WordStore:
    """Codes of the words met so far in a Python worker, so that frequent ones are encoded once. Bounded: when it is full, the half
    that was used most stays.

    ``encode`` takes a list of words and returns all their codes in a row, and the number of codes of each.
    """

    def __init__(self, encode, max_words: int = 200_000, max_codes: int = 2_000_000):
        self.encode, self.max_words, self.max_codes = encode, max_words, max_codes
        self.rows: dict = {}
        self.values, self.lengths, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        kept = np.argsort(-self.uses, kind="stable")[: self.max_words // 2]
        kept = np.sort(kept[np.cumsum(self.lengths[kept]) <= self.max_codes // 2])
        known = list(self.rows)  # in the order of their rows
        self.values = gather(self.values, (np.cumsum(self.lengths) - self.lengths)[kept], self.lengths[kept])
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2
        self.rows = {known[i]: row for row, i in enumerate(kept.tolist())}

    def codes(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """All codes of the words in order, and the number of codes of each word."""
        if len(self.rows) > self.max_words or len(self.values) > self.max_codes:
            self._shrink()
        missing = list(set(words) - self.rows.keys())
        if missing:
            found, counts = self.encode(missing)
            self.rows.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing))))
            self.values, self.lengths = np.concatenate([self.values, found]), np.concatenate([self.lengths, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int64)])
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(row, minlength=len(self.uses))
        starts, lengths = (np.cumsum(self.lengths) - self.lengths)[row], self.lengths[row]
        return gather(self.values, starts, lengths), lengths


def text_slices(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Cut a list of texts where about ``size`` characters are reached; memory then depends on this and the longest text only."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part

"""Reversible line dedup: exact reference tables with sharded cuckoo filters over the repeated lines.

State of a ``LineIndex``, three tables in the shared folder; each change writes new versions and never alters old ones:

- references: one row per (key, document). Deleting a document removes its rows.
- counts: one row per key, its number of documents and the largest of them. Only keys that a change touches are counted again.
- filters: one cuckoo filter per shard, which holds the keys found in at least ``min_docs`` documents. A key enters when its
  count reaches that number and leaves when it falls below. A filter that is full is built anew from the counts.

Line keys go to the shard of their hash and meet its filter there. What the filter lacks is not repeated; what it holds is checked
against the exact counts, so false positives change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import column, fixed_bytes, raw_text, run_starts, trimmed

MIN_CHARS = 20
MIN_DOCS = 3
SLOTS = 4
REFERENCES = "key binary, doc long"
COUNTS = "key binary, n_docs long, last_doc long"
FILTERS = "shard int, room long, filter binary"
FULL = 0.9  # of a filter's slots; beyond it the shard's filter is built anew, twice as large as its keys need


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a lower-cased line, stripped of ASCII white space; None if it is too short to count."""
    stripped = line.strip()
    if len(stripped) < min_chars or len(stripped.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return hashlib.blake2b(stripped, digest_size=16).digest()


class CuckooFilter:
    """Cuckoo filter with four 16-bit slots a bucket. Keys are 16 hash bytes, of which bytes 0-7 pick the bucket and 8-9 the print.

    A key that finds no room after ``KICKS`` moves goes to a list that every lookup searches, so there are no false negatives.
    """

    KICKS = 200

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.extra: list[tuple[int, int]] = []

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) * 2 / SLOTS)))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, extra = np.frombuffer(data, "<i8", 2)
        self = cls(0)
        self.table = np.frombuffer(data, "<u2", buckets * SLOTS, 16).reshape(buckets, SLOTS).copy()
        rest = np.frombuffer(data, "<i8", extra * 2, 16 + buckets * SLOTS * 2).reshape(extra, 2)
        self.extra = [(int(b), int(p)) for b, p in rest]
        return self

    def to_bytes(self) -> bytes:
        head = np.array([len(self.table), len(self.extra)], "<i8")
        return head.tobytes() + self.table.astype("<u2").tobytes() + np.array(self.extra, "<i8").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both buckets and the print (never 0) of each key in a matrix of bytes."""
        first = keys[:, :8].copy().view("<u8")[:, 0].astype(np.int64) & (len(self.table) - 1)
        prints = np.maximum(keys[:, 8:10].copy().view("<u2")[:, 0], 1)
        return first, first ^ self._step(prints), prints

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1)

    def insert(self, keys: np.ndarray) -> None:
        draw = 1
        for bucket, other, print_ in zip(*(x.tolist() for x in self._places(keys))):
            for at in (bucket, other):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = print_
                    break
            else:
                at = other
                for _ in range(self.KICKS):
                    draw = draw * 1103515245 + 12345 & 0x7FFFFFFF
                    slot = draw >> 16 & SLOTS - 1
                    print_, self.table[at, slot] = int(self.table[at, slot]), print_
                    at ^= int(print_) * 0x5BD1E995 & len(self.table) - 1
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = print_
                        break
                else:
                    self.extra.append((at, print_))

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for bucket, other, print_ in zip(*(x.tolist() for x in self._places(keys))):
            for at in (bucket, other):
                held = np.flatnonzero(self.table[at] == print_)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
                if (at, print_) in self.extra:
                    self.extra.remove((at, print_))
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        first, second, prints = self._places(keys)
        hit = (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)
        for bucket, print_ in self.extra:
            hit |= (prints == print_) & ((first == bucket) | (second == bucket))
        return hit


def _key_rows(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_key(line, min_chars) for line in raw_text(text).lower().split(b"\n")} - {None}
                found += own
                docs += [doc] * len(own)
            yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.binary()), "doc": pa.array(docs, pa.int64())})

    return keys


def _shard(shards: int):
    """Shard of a key, from hash bytes that the filter does not use."""
    return F.pmod(F.conv(F.hex(F.substring("key", 11, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _update_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): the old filter (0), how many keys will enter (1), keys to take out (2), to put in (3).

    One filter is held at a time; the keys stream past it.
    """
    shard, held = None, None

    def done():
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "room": pa.array([held.table.size], pa.int64()), "filter": pa.array([held.to_bytes()], pa.binary())})

    for batch in batches:
        shards, kinds = column(batch, "shard"), column(batch, "kind")
        bounds = [*run_starts(shards, kinds).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if shards[start] != shard:
                if held is not None:
                    yield done()
                shard, held = int(shards[start]), None
            part = batch.slice(start, end - start)
            kind = int(kinds[start])
            if kind == 0:
                held = CuckooFilter.from_bytes(part.column("data")[0].as_py())
            elif kind == 1:
                held = held or CuckooFilter.sized(part.column("n")[0].as_py())
            else:
                keys = fixed_bytes(part.column("data"), 16)
                held.delete(keys) if kind == 2 else held.insert(keys)
    if held is not None:
        yield done()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt, kind): a filter (0), then the references (1) that it is asked about."""
    at, held = None, None
    for batch in batches:
        shards, salts, kinds = (column(batch, c) for c in ("shard", "salt", "kind"))
        bounds = [*run_starts(shards, salts, kinds).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if (shards[start], salts[start]) != at:
                at, held = (shards[start], salts[start]), None
            part = batch.slice(start, end - start)
            if kinds[start] == 0:
                held = CuckooFilter.from_bytes(part.column("data")[0].as_py())
            elif held is not None:
                hit = part.filter(pa.array(held.contains(fixed_bytes(part.column("data"), 16))))
                if hit.num_rows:
                    yield pa.RecordBatch.from_pydict({"key": hit.column("data"), "doc": hit.column("doc")})


def _drop_lines(min_chars: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                if not keys:
                    texts.append(text or "")
                    lines.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                drop, all_lines = set(keys), raw_text(text).split(b"\n")
                kept = [line for line in all_lines if line_key(line.lower(), min_chars) not in drop]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "kept": pa.array(texts, pa.string()),
                "lines": pa.array(lines, pa.int64()), "dropped": pa.array(dropped, pa.int64()),
            })

    return apply


@dataclass(frozen=True)
class LineIndex:
    """Which lines repeat across documents. Immutable: ``insert`` and ``delete`` return the next version.

    A key is a line, stripped of ASCII white space and with A-Z lower-cased, of at least ``min_chars`` code points. A
    document counts once for a key, however often it holds the line and however often its row is repeated. Rows without an id
    are never counted. Null and empty texts are one empty line. Only the id and text columns are read.
    """

    spark: SparkSession
    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    salts: int
    min_docs: int
    min_chars: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, salts: int = 16, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        """``shards`` bounds a filter's size: choose about one per million repeated lines expected. ``salts``: into so many parts
        the references of a shard are cut when they are looked up, as one key may hold a third of them."""
        tables = [spark.createDataFrame([], s) for s in (REFERENCES, COUNTS, FILTERS)]
        return cls(spark, *tables, shards, salts, min_docs, min_chars)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with the lines of more documents; a document that is known adds the lines it did not have."""
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        new = rows.mapInArrow(trimmed(_key_rows(self.min_chars)), REFERENCES)
        references = stored(self.references.unionByName(new).dropDuplicates(["key", "doc"]), "line-references")
        return self._next(references, references.join(rows.select("doc").distinct(), "doc", "left_semi") if self._known() else references)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the documents listed, as if they had never been inserted."""
        gone = ids.select(F.col(doc_id).cast("long").alias("doc")).distinct()
        touched = self.references.join(gone, "doc", "left_semi")
        return self._next(stored(self.references.join(gone, "doc", "left_anti"), "line-references"), touched)

    def _known(self) -> bool:
        return not self.counts.isEmpty()

    def _next(self, references: DataFrame, changed: DataFrame) -> LineIndex:
        keys = changed.select("key").distinct()
        own = references.join(keys, "key", "left_semi") if self._known() else references
        recounted = own.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        if not self._known():
            counts = stored(recounted, "line-counts")
            crossed = counts.where(F.col("n_docs") >= self.min_docs).select("key", F.lit(3).alias("kind"))
        else:
            kept = self.counts.join(keys, "key", "left_anti")
            counts = stored(kept.unionByName(recounted), "line-counts")
            before = self.counts.join(keys, "key", "left_semi").where(F.col("n_docs") >= self.min_docs).select("key", F.lit(1).alias("was"))
            after = counts.join(keys, "key", "left_semi").where(F.col("n_docs") >= self.min_docs).select("key", F.lit(1).alias("is"))
            both = before.join(after, "key", "full_outer").where("was IS NULL OR is IS NULL")
            crossed = both.select("key", F.when(F.col("is").isNull(), 2).otherwise(3).alias("kind"))
        return replace(self, references=references, counts=counts, filters=stored(self._filtered(crossed, counts), "line-filters"))

    def _filtered(self, crossed: DataFrame, counts: DataFrame) -> DataFrame:
        """The filters after keys have crossed ``min_docs`` up or down; shards without any stay as they are, full ones are built from the counts."""
        old_filters = self.filters
        if self._known():
            held = counts.where(F.col("n_docs") >= self.min_docs).select("key", _shard(self.shards).alias("shard"))
            rooms = old_filters.select("shard", "room")
            full = stored(held.groupBy("shard").agg(F.count("*").alias("n")).join(rooms, "shard").where(F.col("n") > FULL * F.col("room")).select("shard"), "full-shards")
            refilled = held.join(full, "shard", "left_semi").select("key", F.lit(3).alias("kind"))
            old_filters = old_filters.join(full, "shard", "left_anti")
            others = crossed.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_anti").select("key", "kind")
            crossed = others.unionByName(refilled)
        keyed = crossed.select(_shard(self.shards).alias("shard"), "kind", F.col("key").alias("data"), F.lit(0).cast("long").alias("n"))
        sizes = keyed.where("kind = 3").groupBy("shard").agg(F.count("*").alias("n")).select(
            "shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), "n")
        old = old_filters.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("data"), F.lit(0).cast("long").alias("n"))
        rows = old.unionByName(sizes).unionByName(keyed).repartition("shard").sortWithinPartitions("shard", "kind", "data")
        return rows.mapInArrow(trimmed(_update_filters), FILTERS)

    def repeated(self) -> DataFrame:
        """(key, doc): the lines that a document loses. Filters first, then the exact counts."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(self.salts)).cast("int").alias("salt")
        asked = self.references.select(_shard(self.shards).alias("shard"), salt, F.lit(1).alias("kind"), F.col("key").alias("data"), "doc")
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt")
        filters = self.filters.select("shard", salts, F.lit(0).alias("kind"), F.col("filter").alias("data"), F.lit(None).cast("long").alias("doc"))
        rows = filters.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        hits = rows.mapInArrow(trimmed(_probe), REFERENCES)
        counts = self.counts.where(F.col("n_docs") >= self.min_docs)
        return hits.join(counts, "key").where("doc <> last_doc").select("key", "doc")

    def deduplicate(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """All rows and columns of ``docs`` with kept_text (the text without its repeated lines), n_lines and n_dropped, which
        replace columns of these names.

        A repeated line stays only in the largest document that holds it, there as often as it stands. Rows whose id is null
        or not in the index keep all lines. A null text becomes one empty line.
        """
        drops = self.repeated().groupBy("doc").agg(F.collect_list("key").alias("drop"))
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        joined = rows.join(drops, F.col("id") == F.col("doc"), "left").select("row", "text", "drop")
        schema = T.StructType([
            T.StructField("row", joined.schema["row"].dataType), T.StructField("kept", T.StringType()),
            T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType()),
        ])
        applied = joined.mapInArrow(trimmed(_drop_lines(self.min_chars)), schema)
        others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
        return applied.select(*others, F.col("kept").alias("kept_text"), F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"))

"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordStore, text_slices, trimmed

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
MAX_LABELLED = 8_192
THRESHOLD = 0.3
COUNT_CLASSES = 16
FIXED = 1 + 2 * COUNT_CLASSES  # bias, and how much of the text repeats how often, for single words and pairs


@dataclass(frozen=True)
class Ftrl:
    """Settings of the update: learning rate alpha / (beta + sqrt(n)), penalties l1 and l2, passes over the rows."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    passes: int = 2


class Features:
    """Sparse rows: hashed words and word pairs with their share of the text, and how often they repeat."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.store = WordStore(lambda words: (
            np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)).view(np.int32),
            np.ones(len(words), np.int64)))

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64) + FIXED

    def rows(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots, values) of each text; slots ascend and differ. The bias is slot 0, alone if the text has no words."""
        tokens, counts = [], []
        for text in texts:
            own = TOKEN.findall((text or "").lower())
            counts.append(len(own))
            tokens += own
        hashes = self.store.codes(tokens)[0].view(np.uint32).astype(np.uint64)
        out, at = [], 0
        for n in counts:
            h = hashes[at : at + n]
            at += n
            slots, values = [np.zeros(1, np.int64)], [np.ones(1)]
            grams = [h, h[:-1] * np.uint64(0x100000001B3) + h[1:] + np.uint64(1)]
            for order, gram in enumerate(g for g in grams if len(g)):
                found, times = np.unique(self._slot(gram), return_counts=True)
                slots.append(found)
                values.append(np.sqrt(times / len(gram)))
                kind = np.minimum(np.log2(times).astype(np.int64), COUNT_CLASSES - 1)
                share = np.bincount(kind, times, COUNT_CLASSES) / len(gram)
                slots.append(np.flatnonzero(share) + 1 + order * COUNT_CLASSES)
                values.append(share[share > 0])
            slot, where = np.unique(np.concatenate(slots), return_inverse=True)
            out.append((slot, np.bincount(where, np.concatenate(values), len(slot))))
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, settings: Ftrl) -> np.ndarray:
    """Weights after FTRL-proximal updates, row by row in the given order."""
    z, n = np.zeros(size), np.zeros(size)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= settings.l1, 0.0, (np.sign(z) * settings.l1 - z) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))

    for _ in range(settings.passes):
        for slots, values, label in rows:
            w = weights(z[slots], n[slots])
            g = (_sigmoid(w @ values) - label) * values
            old = n[slots]
            z[slots] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / settings.alpha * w
            n[slots] = old + g * g
    return weights(z, n)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(
    docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED, settings: Ftrl = Ftrl(),
    label: str = "quality", doc_id: str = "doc_id", text: str = "text",
) -> np.ndarray:
    """Weights learned from at most ``max_labelled`` labelled rows; runs at once.

    The sample holds the labelled ids with the smallest hashes, so it is the same however the table is laid out; below that bound
    all are taken. Null ids and labels are no labels; of several labels of an id the smallest counts, of several texts the smallest.
    Texts are turned into sparse rows where they are read; one task, of bounded size, does the updates in hash order. Without any
    label the weights are zero.
    """
    named = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc")).agg(
        F.min(F.col(label).cast("int")).alias("label"))
    sample = named.withColumn("order", F.xxhash64("doc")).orderBy("order", "doc").limit(max_labelled)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc")  # at most max_labelled rows of three numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(bits)
        for batch in batches:
            at = 0
            for part in text_slices(batch.column("text").to_pylist()):
                rows = own.rows(part)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, len(part)) for c in ("doc", "order", "label")),
                    pa.array([s.astype(np.int32) for s, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))],
                    ["doc", "order", "label", "slots", "row"])
                at += len(part)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.array(s.values), np.array(v.values), float(y))
            for b in batches for s, v, y in zip(b.column("slots"), b.column("row"), b.column("label").to_pylist())
        ]
        weights = train(rows, FIXED + (1 << bits), settings)
        slots = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"slot": slots, "weight": weights[slots]})

    hashed = chosen.select("doc", "order", "label", "text").mapInArrow(trimmed(features), "doc long, order long, label int, slots array<int>, row array<double>")
    hashed = hashed.groupBy("doc").agg(F.min(F.struct("order", "label", "slots", "row")).alias("r")).select("doc", "r.*")
    learned = hashed.repartition(1).sortWithinPartitions("order", "doc").mapInArrow(trimmed(learn), "slot long, weight double").collect()
    weights = np.zeros(FIXED + (1 << bits))
    for slot, weight in learned:
        weights[slot] = weight
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1) and predicted (1 from ``threshold``), which replace columns of these names.

    A score is the sparse dot product of the text's n-grams with the weights; null and empty texts have the bias only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers, whatever the input

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = Features(bits), shared.value
        for batch in batches:
            at = 0
            for part in text_slices(batch.column("text").to_pylist()):
                scores = np.array([_sigmoid(w[s] @ v) for s, v in own.rows(part)])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), pa.array(scores)], ["row", "score"])
                at += len(part)

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return rows.mapInArrow(trimmed(apply), schema).select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold(doc_id: str = "doc_id", folds: int = 5):
    """The fold of an id, from its decimal text; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs``, learned from the ``labels`` outside fold 0."""
    return score(docs, fit(docs, labels.where(fold() != 0)))

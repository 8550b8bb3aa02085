"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gather, run_starts, text_slices, trimmed

TOKEN = re.compile(r"\w+")
# Which positions of a window count (1) and which may differ (0). Six tokens must agree. However a fifth of the tokens is replaced, one of
# these windows stays whole in every span of 13 tokens or more (the tests try all patterns).
MASKS = ("111111", "1101100101", "1011010011", "11001001011", "1010010001011")
SIMILARITY = 0.8
MIN_TOKENS = 13
BLOCK_TOKENS = 1 << 18
FILTER_BITS = 22
HITS = 1 << 20


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


NO_CODE = np.uint64(0)  # before the first window of a stretch


def _offsets(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def _codes(ids: np.ndarray, starts: np.ndarray, number: int, offsets: np.ndarray) -> np.ndarray:
    """Hash of the tokens at the mask's positions, for each window start; ``number`` tells the masks apart."""
    code = np.full(len(starts), number + 1, np.uint64)
    for off in offsets.tolist():
        code = (code ^ ids[starts + off].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def short_masks(length: int, similarity: float) -> list[str]:
    """Masks over all of a short item, of which one stays whole whatever tokens the similarity lets differ: the item is cut into two more parts
    than tokens may differ, and each mask keeps two of them."""
    differ = length - math.ceil(round(similarity * length, 9))
    if not differ:
        return ["1" * length]
    cuts = [length * i // (differ + 2) for i in range(differ + 3)]
    return ["".join("1" if a <= i < b or c <= i < d else "0" for i in range(length)) for (a, b), (c, d) in combinations(pairwise(cuts), 2)]


class TestSeeds:
    """The seeds of a block of test items: hash, item and position, sorted by hash.

    Items under ``min_tokens`` tokens must be met as a whole, so they have masks of their own besides, at one place each."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS):
        listed = [(i, tokens(t)) for i, t in items]
        self.items = [(i, t) for i, t in listed if t]
        self.number = {t: n for n, t in enumerate(dict.fromkeys(t for _, ts in self.items for t in ts))}
        self.ids = [np.array([self.number[t] for t in ts], np.int64) for _, ts in self.items]
        self.longest = max(map(len, self.ids), default=0)
        own: dict[str, dict[int, list[int]]] = {}  # mask without zeros at its ends: places in items of a length
        for n in sorted({len(i) for i in self.ids if len(i) < min_tokens}):
            for mask in short_masks(n, similarity):
                own.setdefault(mask.strip("0"), {}).setdefault(n, []).append(mask.index("1"))
        self.masks = [*masks, *own]
        codes, before, at, where = [], [], [], []
        for k, mask in enumerate(self.masks):
            offsets = _offsets(mask)
            for n, ids in enumerate(self.ids):
                starts = np.arange(max(0, len(ids) - len(mask) + 1)) if k < len(masks) else np.array(sorted(set(own[mask].get(len(ids), []))), np.int64)
                code = _codes(ids, starts, k, offsets)
                codes.append(code)
                before.append(np.concatenate([[NO_CODE + np.uint64(1)], code[:-1]])[: len(code)] if k < len(masks) else np.full(len(code), NO_CODE + np.uint64(1)))
                at.append(starts)
                where.append(np.full(len(starts), n))
        codes, before = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in (codes, before))
        order = np.lexsort((before, codes))
        self.codes = codes[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *at])[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *where])[order]
        # Codes and the codes before them as one sorted number.
        self.code_set, self.before_set = np.unique(codes), np.unique(before)
        self.pairs = np.searchsorted(self.code_set, self.codes) * len(self.before_set) + np.searchsorted(self.before_set, before[order])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.codes >> np.uint64(64 - FILTER_BITS)] = True

    def diagonals(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (document, item, token position less item position) on which a document shares a seed with an item, once and in order.

        ``ids`` are the tokens of some documents, -1 where no item has the token; ``doc`` tells which document. Where the windows before
        two equal windows are equal, too, these stand for the diagonal: so a word or phrase that is repeated over and over costs its length and not the product
        with the item's, and what is held at a time is bounded.
        """
        found = [np.zeros(0, np.int64)]
        known = np.flatnonzero(ids >= 0)
        span = len(ids) + 2 * self.longest + 1
        for k, mask in enumerate(self.masks):
            starts = known[known + len(mask) <= len(ids)]
            starts = starts[doc[starts] == doc[starts + len(mask) - 1]]
            offsets = _offsets(mask)
            for off in offsets[1:].tolist():
                starts = starts[ids[starts + off] >= 0]
            codes = _codes(ids, starts, k, offsets)
            before = np.full(len(codes), NO_CODE)
            follows = np.flatnonzero(starts[1:] == starts[:-1] + 1) + 1
            before[follows] = codes[follows - 1]
            maybe = self.filter[codes >> np.uint64(64 - FILTER_BITS)]
            starts, codes, before = starts[maybe], codes[maybe], before[maybe]
            low, high = np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
            met = high > low
            starts, codes, before, low, high = starts[met], codes[met], before[met], low[met], high[met]
            if not len(starts):
                continue
            place = np.minimum(np.searchsorted(self.before_set, before), len(self.before_set) - 1)
            pair = np.where(self.before_set[place] == before, np.searchsorted(self.code_set, codes) * len(self.before_set) + place, -1)
            same, past = np.searchsorted(self.pairs, pair, "left"), np.searchsorted(self.pairs, pair, "right")
            same, past = np.where(pair < 0, low, same), np.where(pair < 0, low, past)
            # What is left of each window's entries: those before and those after the ones that follow an equal window.
            first, n, starts = np.concatenate([low, past]), np.concatenate([same - low, high - past]), np.concatenate([starts, starts])
            total, done = np.cumsum(n), 0
            while done < len(n):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HITS, "right")))
                part = slice(done, upto)
                at, item = np.repeat(starts[part], n[part]), gather(self.item, first[part], n[part])
                shift = at - gather(self.at, first[part], n[part]) + self.longest
                found.append(np.unique((doc[at] * len(self.ids) + item) * span + shift))
                done = upto
        keys = np.unique(np.concatenate(found))
        rest, shift = np.divmod(keys, span)
        return rest // max(1, len(self.ids)), rest % max(1, len(self.ids)), shift - self.longest

    def overlaps(self, texts: list[str | None], similarity: float, min_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item id, start in the text, start in the item, tokens, matching tokens): the best overlap per text and item."""
        ids, counts = [], []
        for text in texts:
            own = tokens(text)
            counts.append(len(own))
            ids += [self.number.get(t, -1) for t in own]
        ids, doc = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        docs, items, shifts = self.diagonals(ids, doc)
        if not len(docs):
            return []
        # Inside a run of one word, a diagonal shows the same as the one before it and starts later.
        sizes = np.array([len(i) for i in self.ids])[items]
        ends = np.append(run_starts(ids, doc)[1:], len(ids))
        run_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        again = np.zeros(len(docs), bool)
        again[1:] = (docs[1:] == docs[:-1]) & (items[1:] == items[:-1]) & (shifts[1:] == shifts[:-1] + 1) & (shifts[:-1] >= first[docs[1:]])
        again[again] = run_end[shifts[again] - 1] >= shifts[again] + sizes[again]
        best: dict[tuple[int, int], tuple] = {}
        whole = set()  # (document, item) whose item was met without a difference: later starts are no better
        for d, n, o in zip(docs[~again].tolist(), items[~again].tolist(), shifts[~again].tolist()):
            if (d, n) in whole:
                continue
            test = self.ids[n]
            low = max(0, int(first[d]) - o)
            high = min(len(test), int(first[d]) + counts[d] - o)
            same = ids[o + low : o + high] == test[low:high]
            found = _best_span(same, similarity, min(min_tokens, len(test)))
            if found:
                a, b = found
                matches = int(same[a:b].sum())
                rank = (matches, b - a, -(o + a))
                if (d, n) not in best or rank > best[d, n][0]:
                    best[d, n] = (rank, (d, self.items[n][0], o + low + a - int(first[d]), low + a, b - a, matches))
                if matches == len(test):
                    whole.add((d, n))
        return [row for _, row in best.values()]


def _best_span(same: np.ndarray, similarity: float, min_tokens: int) -> tuple[int, int] | None:
    """Of the spans of at least ``min_tokens`` tokens, the one whose matches exceed the similarity most; None if none reaches it."""
    if len(same) < min_tokens:
        return None
    asked = round(similarity * 1000)  # whole numbers: a span that just reaches the similarity has a surplus of 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1000 - asked, -asked))])
    lowest = np.minimum.accumulate(total[: len(total) - min_tokens])
    surplus = total[min_tokens:] - lowest
    best = int(np.argmax(surplus))
    if surplus[best] < 0:
        return None
    return int(np.flatnonzero(total[: best + 1] == lowest[best])[0]), best + min_tokens


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_tokens: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).distinct()
    block, size = [], 0
    for i, t in rows.orderBy(item_id, text).toLocalIterator():
        block.append((i, t))
        size += len(t) // 4 + 1
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, block_tokens: int = BLOCK_TOKENS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_matches): the best overlap of each document and test item that share one.

    Tokens are runs of word characters, lower-cased; starts count tokens. Windows of documents and items meet if they agree in the
    positions that a mask keeps; items under ``min_tokens`` tokens have masks for their length, so that no allowed difference hides them. Around each meeting the texts are laid side by side; the overlap is the span whose matches exceed the
    similarity most. It counts if at least ``similarity`` of its tokens agree and it has ``min_tokens`` tokens, or all of a shorter item.

    The test items are the query set: they go through all documents in blocks of about ``block_tokens`` tokens, each broadcast.
    Null and blank texts on either side share nothing. Repeated rows give one row; a null id is reported as null.
    """
    parts = []
    for block in _blocks(benchmark, item_id, "text", block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = TestSeeds(shared.value, similarity=similarity, min_tokens=min_tokens)
            for batch in batches:
                ids, at = batch.column("doc").to_pylist(), 0
                for part in text_slices(batch.column("text").to_pylist()):
                    rows = [(ids[at + d], *rest) for d, *rest in seeds.overlaps(part, similarity, min_tokens)]
                    at += len(part)
                    columns = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
        parts.append(rows.mapInArrow(trimmed(search), ", ".join(f"{n} long" for n in NAMES)))
    if not parts:
        return docs.sparkSession.createDataFrame([], ", ".join(f"{n} long" for n in NAMES))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct(*NAMES[2:]), F.struct("n_matches", "n_tokens", -F.col("doc_start"))).alias("best")).select("doc_id", "item_id", "best.*")


NAMES = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matches"]


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS,
                  block_tokens: int = BLOCK_TOKENS, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose own text overlaps no test item (see ``leaks``). No shuffle: each row is
    judged where it is read."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])
    for block in _blocks(benchmark, item_id, "text", block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = TestSeeds(shared.value, similarity=similarity, min_tokens=min_tokens)
            for batch in batches:
                clean, at = np.ones(batch.num_rows, bool), 0
                for part in text_slices(batch.column("text").to_pylist()):
                    for d, *_ in seeds.overlaps(part, similarity, min_tokens):
                        clean[at + d] = False
                    at += len(part)
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(trimmed(keep), schema)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A string of ``length`` bytes is dealt out by its anchor: the k-gram in it whose hash is smallest, the leftmost among equals. Equal strings
have equal anchors, so groups of one anchor are judged apart, and no task ever sees more than its groups. Neighbouring strings of a
document with one anchor are a piece, about a third longer than ``length``. Steps:

1. Cut all texts into pieces, known by hashes of anchor and content. Equal pieces are one class; a piece that has an earlier
   equal is removed. Each task does so for its own pieces first, so that copies cost one row per task.
2. Anchors with one class are done. Of the others, one piece per class is fetched as text.
3. Pieces of some anchors are a bounded collection, cut into shards. Each shard is sorted and transformed once. The transforms are
   merged by refining their interleave byte by byte; suffixes do not get sorted again. After ``length`` rounds, the blocks are
   the strings that occur more than once, and all but the first of each are removed.
   Groups of one anchor that two further anchors do not make small are dealt out string by string instead: the first place of
   each string is an aggregate, so that neither a group nor a string is held by one task.
4. Removed spans are united per document and cut out of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import row_numbers
from ..session import stored
from .common import column, raw_text, run_starts, trimmed, whole_runs

LENGTH = 100
GRAM = 24
BUFFER = 1 << 21  # bytes of text that step 1 holds at a time
COLLECTION = 1 << 17  # bytes of pieces that are merged at a time
SHARD = 1 << 16
CROWD = 4096  # classes of an anchor beyond which its pieces are cut by further anchors; pieces of a group beyond which strings are dealt out
STRETCH = 1 << 16  # bytes of a document whose removed strings are united in one task
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
POSITION_BITS = 26


VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)  # a number per byte value, the same everywhere
_powers: list[np.ndarray] = []


def _tables(size: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, kept in the worker and made longer when needed."""
    if not _powers or len(_powers[0]) <= size:
        _powers.clear()
        for factor in (MULTIPLIER, INVERSE):
            power = np.full(max(size, 1 << 16) * 5 // 4, factor, np.uint64)
            power[0] = 1
            _powers.append(np.multiply.accumulate(power))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Hashes:
    """Hashes of any span of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * self.powers[: len(data)], out=self.prefix[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return _mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchored(data: np.ndarray, ends: np.ndarray, hashes: Hashes, length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first and last start of a run, and the place of the anchor.

    ``ends`` are the ends of the texts in ``data``; strings lie within a text."""
    grams = hashes.grams(gram)
    if salt:
        grams = _mix(grams ^ np.uint64(salt * MULTIPLIER % (1 << 64)))
    keys = grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    if len(keys) < width:
        return (np.zeros(0, np.int64),) * 3
    anchor = (_sliding_min(keys, width) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    mark = np.zeros(len(anchor) + 1, np.int32)  # a string may start where its text has as many bytes left
    fits = ends - starts >= length
    np.add.at(mark, starts[fits], 1)
    np.add.at(mark, ends[fits] - length + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    text_start = np.zeros(len(anchor) + 1, bool)
    text_start[starts[fits]] = True
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | text_start[1:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last), anchor[first]


def _pieces(length: int, gram: int):
    """Step 1: rows (h, c, doc, at, n): a piece by the hashes of its anchor and content, its place, and its number of strings.

    n is negative in rows that report a removed span of -n bytes."""

    def flush(texts: list[bytes], docs: list[int]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        hashes = Hashes(data)
        first, last, anchor = anchored(data, ends, hashes, length, gram)
        h = hashes.span(anchor, anchor + gram).view(np.int64)
        c = (hashes.span(first, last + length) ^ _mix((anchor - first).astype(np.uint64))).view(np.int64)
        text = np.searchsorted(ends, first, "right")
        doc, at = np.array(docs, np.int64)[text], first - (ends - lengths)[text]
        # Of equal pieces in this buffer the first goes on; the spans of the others are united.
        order = np.lexsort((at, doc, c, h))
        head = np.zeros(len(order), bool)
        head[run_starts(h[order], c[order])] = True
        keep = np.zeros(len(order), bool)
        keep[order] = head
        gone, start, end = united(doc[~keep], at[~keep], (at + last - first + length)[~keep])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (
            np.concatenate([h[keep], _mix(gone.astype(np.uint64)).view(np.int64)]), np.concatenate([c[keep], np.zeros(len(gone), np.int64)]),
            np.concatenate([doc[keep], gone]), np.concatenate([at[keep], start]),
            np.concatenate([(last - first + 1)[keep], start - end]))], ["h", "c", "doc", "at", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, size = [], [], 0
        for batch in batches:
            for doc, text in zip(column(batch, "doc").tolist(), batch.column("text").to_pylist()):
                raw = raw_text(text)
                if len(raw) < length:
                    continue
                for low in range(0, len(raw) - length + 1, BUFFER):  # a text of any length, in parts that share length - 1 bytes
                    texts.append(raw[low : low + BUFFER + length - 1])
                    docs.append(doc)
                    size += len(texts[-1])
                    if low or len(raw) - low > BUFFER:
                        yield from parts(texts, docs, low)
                        texts, docs, size = [], [], 0
                if size >= BUFFER:
                    yield flush(texts, docs)
                    texts, docs, size = [], [], 0
        if texts:
            yield flush(texts, docs)

    def parts(texts: list[bytes], docs: list[int], low: int) -> Iterator[pa.RecordBatch]:
        """The texts before a part of a very long one, then that part, moved to its place."""
        if len(texts) > 1:
            yield flush(texts[:-1], docs[:-1])
        batch = flush(texts[-1:], docs[-1:])
        moved = pa.array(column(batch, "at") + low)
        yield pa.RecordBatch.from_arrays([moved if n == "at" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return rows


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans per document, sorted, with overlapping and touching ones united."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = end.copy()
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    span = int(max(end.max(), start.max())) + 1
    if base[-1] * span < 1 << 62:  # a running maximum that starts anew with each document
        reach = np.maximum.accumulate(end + base * span) - base * span
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _classes(length: int):
    """Step 2, rows sorted by (h, c, doc, at): kind 0, a removed span; kind 1, the first piece of a class whose anchor has other classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # hashes of the piece before
        waiting = None  # the first piece of the current anchor, as long as that has one class
        for batch in batches:
            x = {name: column(batch, name) for name in ("h", "c", "doc", "at", "n")}
            span = x["n"] < 0
            spans = x["doc"][span], x["at"][span], x["at"][span] - x["n"][span]
            x = {name: values[~span] for name, values in x.items()}
            taken = []
            if len(x["h"]):
                h, c = x["h"], x["c"]
                new_h = np.concatenate([[before is None or h[0] != before[0]], h[1:] != h[:-1]])
                new_c = new_h | np.concatenate([[before is None or c[0] != before[1]], c[1:] != c[:-1]])
                other = new_c & ~new_h  # a second class of its anchor, or a later one
                anchor = np.cumsum(new_h)  # 0: still the anchor of the batch before
                crowded = np.unique(anchor[other])
                begins = np.flatnonzero(new_h)
                if waiting is not None and len(crowded) and crowded[0] == 0:
                    taken.append(waiting)
                    waiting = None
                take = np.sort(np.concatenate([np.flatnonzero(other), begins[np.isin(anchor[begins], crowded)]]))
                if len(begins):
                    last = begins[-1]
                    waiting = None if anchor[last] in crowded else tuple(int(x[n][last]) for n in ("h", "doc", "at", "n"))
                before = h[-1], c[-1]
                spans = [np.concatenate(pair) for pair in zip(spans, (x["doc"][~new_c], x["at"][~new_c], (x["at"] + x["n"] - 1 + length)[~new_c]))]
                first = [np.concatenate([np.array([w[i] for w in taken], np.int64), x[n][take]]) for i, n in enumerate(("h", "doc", "at", "n"))]
            else:
                first = [np.zeros(0, np.int64)] * 4
            kind = np.repeat(np.arange(2, dtype=np.int32), [len(spans[0]), len(first[0])])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(parts)) for parts in (
                (np.zeros(len(spans[0]), np.int64), first[0]), (spans[0], first[1]), (spans[1], first[2]), (spans[2], first[2] + first[3] - 1 + length)))],
                ["kind", "h", "doc", "start", "end"])

    return rows


def _texts(length: int, gram: int):
    """Pieces as text. Those of crowded anchors are cut where two further hash functions choose another gram."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, packed, wanted in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = _unpacked(packed)
                group, at, piece, crowd = [], [], [], []
                for w in wanted:
                    own = raw[w["start"] : w["end"]]
                    cuts = [(w["h"], 0, len(own))]
                    for salt in (1, 2) if w["crowd"] else ():
                        cuts = [
                            (_joined(h, mark), low + int(first), low + int(last) + length)
                            for h, low, high in cuts for first, last, mark in _recut(own[low:high], length, gram, salt)
                        ]
                    for h, low, high in cuts:
                        group.append(h)
                        at.append(w["start"] + low)
                        piece.append(own[low:high])
                        crowd.append(w["crowd"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(piece, pa.binary()), pa.array(crowd, pa.bool_())],
                    ["h", "doc", "at", "piece", "crowd"])

    return rows


def _recut(piece: bytes, length: int, gram: int, salt: int) -> list[tuple[int, int, int]]:
    data = np.frombuffer(piece, np.uint8)
    hashes = Hashes(data)
    first, last, anchor = anchored(data, np.array([len(data)]), hashes, length, gram, salt)
    return list(zip(first.tolist(), last.tolist(), hashes.span(anchor, anchor + gram).tolist()))


def _joined(a: int, b: int) -> int:
    """One group number from two; as signed 64 bits."""
    x = (a * MULTIPLIER ^ b) & (1 << 64) - 1
    x = (x ^ x >> 31) * INVERSE & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def transform(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a shard, sorted by their first ``depth`` bytes at least: for each its place in the shard's bytes (texts in a row,
    each with an end mark), its length, and the transform: the two symbols before it, as one number, the nearer one in its low
    byte; the farther one is 0 where the text does not reach so far. Symbols are bytes plus one; 0 is an end mark.

    Text has no byte 255, so symbols fit a byte. End marks differ: the earlier text's is smaller."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    n = len(symbols)
    rest = (np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(n)).astype(np.int32)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(rest > k, padded[k : k + n], np.uint64(0))
    done = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (rest[order][1:] < done)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if done >= depth or new.all():
            break
        beyond = np.zeros(n, np.uint64)
        beyond[: n - done] = rank[done:]
        key = rank << np.uint64(32) | np.where(rest >= done, beyond, np.uint64(0))
        done *= 2
    near = np.concatenate([[0], symbols[:-1]]).astype(np.uint16)
    far = np.concatenate([[0], near[:-1]]).astype(np.uint16)
    return order, rest[order], (near | np.where(near > 0, far, 0) << 8).astype(np.uint16)[order]


def repeated_strings(texts: list[bytes], length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards of ``texts``: (place, block) of every suffix of at least ``length`` bytes, in the order of these bytes.

    Places count bytes of all texts in a row with an end mark each; suffixes in one block agree in their first ``length`` bytes.

    ``turn`` is the interleave: which shard the next suffix comes from, in the order of the first k bytes. A round reads, in this order, the
    two symbols before the suffixes off the shards' transforms and sorts the turns by them, keeping order: that is the interleave by
    k + 2 bytes of the suffixes two longer. A block is a common prefix of k bytes; it falls apart where the symbols differ. Suffixes
    shorter than k are left out, as nothing longer comes from them. An odd length takes its first round with one symbol."""
    shards, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= shard:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    made = [transform(s, length) for s in shards]
    base = np.concatenate([[0], np.cumsum([len(m[0]) for m in made])])
    rest = np.concatenate([m[1] for m in made])
    before = np.concatenate([m[2] for m in made])
    place = np.concatenate([m[0] + b for m, b in zip(made, base)])[rest >= length]
    turn = np.repeat(np.arange(len(made), dtype=np.uint16 if len(made) > 255 else np.uint8), np.diff(base))
    block = np.zeros(len(turn), np.int32)
    k = 0
    while k < length:
        step = 1 if (length - k) % 2 else 2
        symbol = np.empty(len(turn), np.uint16)
        symbol[np.argsort(turn, kind="stable")] = before if step == 2 else before & 0xFF
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        # Before an end mark nothing goes on.
        begin = int(np.searchsorted(symbol, 0x100 if step == 2 else 1))
        order, symbol = order[begin:], symbol[begin:]
        turn, old = turn[order], block[order]
        new = np.zeros(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(new, dtype=np.int32)
        k += step
        longer = rest >= k
        rest, before = rest[longer], before[longer]
    merged = np.empty(len(turn), np.int64)
    merged[np.argsort(turn, kind="stable")] = place
    return merged, block


def _merged(length: int):
    """Step 3, rows sorted by h: spans of the strings that are not the first of their kind."""

    def judge(doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        place, block = repeated_strings(texts, length)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(starts, place, "right") - 1
        own, pos = doc[text], at[text] + place - starts[text]
        order = np.lexsort((pos, own, block))
        own, pos, block = own[order], pos[order], block[order]
        first = run_starts(block)
        head = np.repeat(first, np.diff(np.append(first, len(block))))
        later = (own != own[head]) | (pos != pos[head])
        gone, start, end = united(own[later], pos[later], pos[later] + length)
        return pa.RecordBatch.from_arrays([pa.array(gone), pa.array(start), pa.array(end)], ["doc", "start", "end"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["h"], 1 << 13):
            h, doc, at = (column(table, c) for c in ("h", "doc", "at"))
            texts = table.column("piece").to_pylist()
            size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
            ends = [*run_starts(h)[1:].tolist(), len(h)]
            low = 0
            for high, following in zip(ends, [*ends[1:], None]):
                if following is None or size[following] - size[low] > COLLECTION:
                    yield judge(doc[low:high], at[low:high], texts[low:high])
                    low = high

    return rows


def _strings(length: int):
    """Every string of some pieces, known by 128 bits of its hash, and its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ats, pieces = column(batch, "doc"), column(batch, "at"), batch.column("piece").to_pylist()
            for low in range(0, len(pieces), CROWD):
                part = pieces[low : low + CROWD]
                counts = np.fromiter((max(0, len(p) - length + 1) for p in part), np.int64, len(part))
                known = [blake2b(p[k : k + length], digest_size=16).digest() for p, n in zip(part, counts.tolist()) for k in range(n)]
                within = np.arange(len(known)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(known, pa.binary()), pa.array(np.repeat(docs[low : low + CROWD], counts)),
                    pa.array(np.repeat(ats[low : low + CROWD], counts) + within)], ["s", "doc", "at"])

    return rows


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = united(*(column(batch, c) for c in ("doc", "start", "end")))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in gone], ["doc", "start", "end"])


def _repeated_strings_of(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of all strings of ``pieces`` that are not the first of their kind, whatever many pieces share a string."""
    strings = stored(pieces.select("doc", "at", "piece").mapInArrow(trimmed(_strings(length)), "s binary, doc long, at long"), "repeats-strings")
    firsts = strings.groupBy("s").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("s", "first")
    later = strings.join(firsts, "s").where("doc <> first.doc OR at <> first.at")
    spans = later.select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    dealt = spans.repartition("doc", F.floor(F.col("start") / STRETCH)).sortWithinPartitions("doc", "start")
    return dealt.mapInArrow(trimmed(_united_rows), "doc long, start long, end long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled twice."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        raw = [raw_text(t) for t in batch.column("text").to_pylist()]
        packed = [len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary())], ["doc", "text"])


def _unpacked(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the bytes that are left, as binary, as a removed run may cut a character."""
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for packed, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            raw = _unpacked(packed)
            start = np.array([g["start"] for g in gone or ()], np.int64)
            end = np.array([g["end"] for g in gone or ()], np.int64)
            _, start, end = united(np.zeros(len(start), np.int64), start, end)
            edges = zip([0, *end.tolist()], [*start.tolist(), len(raw)])
            kept.append(b"".join(raw[a:b] for a, b in edges))
            sizes.append(len(raw))
            removed.append(int((end - start).sum()))
            spans.append(len(start))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())],
            ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's UTF-8 bytes without those that a string of ``length`` bytes covers which also
    starts earlier: in a smaller doc_id, or before in the same document. kept is binary.

    Null texts are empty. Rows with equal id and text are one document, of which each row gets the result. Texts that share an id
    are documents of their own, ordered by text; null ids come first. Strings never cross documents; overlaps count. Runs in part at once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n, ids = rows.agg(F.count("*"), F.count("doc")).first()
    unique = n == ids and rows.groupBy("doc").count().where("count > 1").isEmpty()
    if unique:
        return _removed(rows, length, gram).withColumnRenamed("doc", "doc_id")
    numbered = stored(row_numbers(rows.distinct(), [], ["doc", "text"], "number"), "repeats-numbers")
    removed = _removed(numbered.select(F.col("number").alias("doc"), "text"), length, gram).withColumnRenamed("doc", "number")
    known = numbered.select(F.col("doc").alias("id"), F.col("text").alias("own"), "number").join(removed, "number")
    return rows.join(known, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text") == F.col("own"))).select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _removed(rows: DataFrame, length: int, gram: int) -> DataFrame:
    pieces = rows.mapInArrow(trimmed(_pieces(length, gram)), "h long, c long, doc long, at long, n long")
    dealt = pieces.repartition("h").sortWithinPartitions("h", "c", "doc", "at")
    found = stored(dealt.mapInArrow(trimmed(_classes(length)), "kind int, h long, doc long, start long, end long"), "repeats-classes")
    wanted = found.where("kind = 1")
    crowds = stored(wanted.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("crowd")), "repeats-crowds")
    marked = wanted.join(crowds, "h", "left").select("doc", F.struct("h", "start", "end", F.col("crowd").isNotNull().alias("crowd")).alias("w"))
    per_doc = marked.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    packed = rows.mapInArrow(trimmed(_packed), "doc long, text binary")
    texts = packed.join(per_doc, "doc").mapInArrow(trimmed(_texts(length, gram)), "h long, doc long, at long, piece binary, crowd boolean")
    hot = None
    if not crowds.isEmpty():
        texts = stored(texts, "repeats-texts")
        large = stored(texts.where("crowd").groupBy("h").count().where(F.col("count") > CROWD).select("h"), "repeats-large")
        if not large.isEmpty():
            hot = _repeated_strings_of(texts.join(large, "h"), length)
            texts = texts.join(large, "h", "left_anti")
    grouped = texts.select("h", "doc", "at", "piece").repartition("h").sortWithinPartitions("h")
    merged = stored(grouped.mapInArrow(trimmed(_merged(length)), "doc long, start long, end long"), "repeats-merged")
    if hot is not None:
        merged = merged.unionByName(stored(hot, "repeats-hot"))
    spans = found.where("kind = 0").select("doc", "start", "end").unionByName(merged)
    gone = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    left = packed.join(gone, "doc", "left")
    return left.mapInArrow(trimmed(_cut), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")

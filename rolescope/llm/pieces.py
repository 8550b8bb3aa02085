"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordStore, column, gather, text_slices, trimmed

SPACE = "▁"  # fixed value: how pieces write a blank
NONE = np.int64(1 << 30)
LONG = 512


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, dummy prefix and no further normalization, as flat tables."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(processor.serialized_model_proto())
        trained, rules, kind = proto.trainer_spec, proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        if not (trained.model_type == 2 and trained.byte_fallback and plain and rules.escape_whitespaces and not trained.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with byte fallback, dummy prefix and no normalization are supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.end_id = processor.eos_id()
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)

        # Symbols: every piece and every character of a piece. What is no piece is written as bytes.
        self.symbols = list(dict.fromkeys([*normal, *(c for piece in normal for c in piece)]))
        number = {s: i for i, s in enumerate(self.symbols)}
        self.piece_of = np.array([normal.get(s, -1) for s in self.symbols], np.int32)
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        by_rank = sorted(normal, key=lambda piece: -proto.pieces[normal[piece]].score)
        pairs = {}
        neighbours = set()
        for rank, piece in enumerate(by_rank):
            neighbours.update(ord(a) << 32 | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank, number[piece])
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.merged = np.array([number[p] for p in by_rank], np.int32)
        # Characters that stand side by side in some piece; between all others no merge can ever reach across.
        self.neighbours = np.array(sorted(neighbours), np.int64)
        joins = "".join(c for c in (SPACE, "\n") if not any(n & 0xFFFFFFFF == ord(c) and n >> 32 != ord(SPACE) for n in neighbours))
        if SPACE not in joins:
            self.word = re.compile(r"(?s).+")
        elif "\n" in joins:
            self.word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}*\n|{SPACE}+")
        else:
            self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # Decoding: the bytes of each id.
        shown = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.NORMAL:
                shown[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                shown[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                shown[i] = trained.unk_surface.encode()
        self.shown_length = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.zeros(len(shown), bool)
        self.is_byte[self.byte_ids] = True
        self.space_first = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self.store = WordStore(self.encode_words)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat arrays: symbols, and the ascending segment number of each.

        Each round takes in every segment the pair of lowest rank, leftmost among equals, merges these pairs all at once, and
        closes the gaps. A segment without a pair leaves the round. Returns symbols and segments in order.
        """
        place = np.arange(len(symbols), dtype=np.int64)
        done = []
        ranks = np.full(len(symbols), NONE)
        same = segment[1:] == segment[:-1]
        ranks[:-1][same] = self._ranks(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            lowest = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
            alive = lowest >> 32 < NONE
            if not alive.all():
                sizes = np.diff(np.append(starts, len(symbols)))
                keep = np.repeat(alive, sizes)
                done.append((place[~keep], symbols[~keep], segment[~keep]))
                symbols, segment, ranks, place = symbols[keep], segment[keep], ranks[keep], place[keep]
                lowest = lowest[alive] - np.cumsum(np.where(alive, 0, sizes))[alive]
                if not len(symbols):
                    break
            at = lowest & 0xFFFFFFFF
            symbols[at] = self.merged[lowest >> 32]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes per segment, so places move up by the segments before
            symbols, segment, ranks, place = symbols[left], segment[left], ranks[left], place[left]
            for first in (at - 1, at):
                first = first[(first >= 0) & (first < len(symbols))]
                inside = np.zeros(len(first), bool)
                inside[first < len(symbols) - 1] = segment[first[first < len(symbols) - 1]] == segment[first[first < len(symbols) - 1] + 1]
                ranks[first[~inside]] = NONE
                ranks[first[inside]] = self._ranks(symbols[first[inside]], symbols[first[inside] + 1])
        if not done:
            return symbols, segment
        place, symbols, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return symbols[order], segment[order]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one very long segment, where a round per merge would take quadratic time: a heap of pairs."""
        following, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        symbols = [*symbols, -1]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and following[i] < len(following):
                found = self.pairs.get(symbols[i] << 32 | symbols[following[i]]) if symbols[i] >= 0 and symbols[following[i]] >= 0 else None
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[following[i]], following[i]))

        for i in range(len(following)):
            offer(i)
        gone = bytearray(len(following))
        while heap:
            rank, i, a, b, j = heapq.heappop(heap)
            if gone[i] or following[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = int(self.merged[rank])
            gone[j] = 1
            following[i] = following[j]
            if following[j] < len(following):
                before[following[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, g in zip(symbols, gone) if not g]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and their number per word. Words are cut where no piece reaches across."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        keys = chars[:-1] << 32 | chars[1:]
        at = np.minimum(np.searchsorted(self.neighbours, keys), len(self.neighbours) - 1)
        cut = np.concatenate([[True], (self.neighbours[at] != keys) | (word[1:] != word[:-1])])[: len(chars)]
        segment = np.cumsum(cut) - 1
        symbols = self.char_symbol[chars]
        char_of = np.where(symbols < 0, chars, 0)
        # Characters outside the vocabulary are segments of their own; they pass as -1 - code point.
        symbols = np.where(symbols < 0, -1 - char_of, symbols).astype(np.int64)
        sizes = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
        first = np.flatnonzero(cut)
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            short = ~np.isin(segment, long)
            parts = [self.merge(symbols[short], segment[short])]
            for s in long.tolist():
                own = np.array(self.merge_long(symbols[first[s] : first[s] + sizes[s]].tolist()), np.int64)
                parts.append((own, np.full(len(own), s)))
            symbols, segment = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(segment, kind="stable")
            symbols, segment = symbols[order], segment[order]
        else:
            symbols, segment = self.merge(symbols, segment)
        word = word[first][segment] if len(segment) else segment
        ids = np.where(symbols >= 0, self.piece_of[np.maximum(symbols, 0)], -1)
        counts = np.ones(len(ids), np.int64)
        for i in np.flatnonzero(ids < 0).tolist():  # not in the vocabulary: one id per byte
            counts[i] = len(self._bytes(int(symbols[i])))
        out = np.repeat(ids, counts).astype(np.int32)
        starts = np.cumsum(counts) - counts
        for i in np.flatnonzero(ids < 0).tolist():
            data = np.frombuffer(self._bytes(int(symbols[i])), np.uint8)
            out[starts[i] : starts[i] + len(data)] = self.byte_ids[data]
        return out, np.bincount(word, counts, len(words)).astype(np.int64)

    def _bytes(self, symbol: int) -> bytes:
        return (chr(-1 - symbol) if symbol < 0 else self.symbols[symbol]).encode("utf-8", "surrogatepass")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, each ended by the end id, and the number of ids of each text."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self.word.findall(SPACE + text.replace(" ", SPACE))
                counts[i] = len(own)
                words += own
        ids, lengths = self.store.codes(words)
        doc = np.repeat(np.arange(len(texts)), counts)
        per_doc = np.bincount(doc, lengths, len(texts)).astype(np.int64)
        ends = np.cumsum(per_doc)
        return np.insert(ids, ends, self.end_id), per_doc + 1

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of flat ids. Control ids are silent, the dummy blank in front goes, invalid bytes become U+FFFD each."""
        shown = self.shown_length[ids]
        data = gather(self.shown, self.shown_start[ids], shown)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum(shown)])[ends]
        # Only a piece drops its blank, not a byte that happens to be one.
        heard = np.flatnonzero(shown > 0)
        first = np.searchsorted(heard, ends[:-1])
        inside = (first < len(heard)) & (heard[np.minimum(first, len(heard) - 1)] < ends[1:]) if len(heard) else np.zeros(len(lengths), bool)
        blank = np.zeros(len(lengths), np.int64)
        blank[inside] = self.space_first[ids[heard[first[inside]]]]
        raw = data.tobytes()
        return [self._text(raw[s + b : e]) for s, b, e in zip(at[:-1].tolist(), blank.tolist(), at[1:].tolist())]

    @staticmethod
    def _text(data: bytes) -> str:
        parts = []
        while data:
            try:
                parts.append(data.decode())
                break
            except UnicodeDecodeError as problem:
                parts += [data[: problem.start].decode(), "�"]
                data = data[problem.start + 1 :]
        return "".join(parts)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a file, read once per Python worker. The file must stand at this path on every executor."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the column ids: array<int>, the ids of the whole text and the end id.

    Ids equal those of the sentencepiece library without sampling. Null and empty texts have the end id only. With ``decoded``, a column of
    that name has the text that ``decode`` makes of the ids, in the same pass. Columns named ids and decoded are replaced.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text").to_pylist()):
                ids, lengths = own.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                shown = own.decode(ids, lengths) if decoded else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.array(shown, pa.string())], ["row", "ids", "decoded"])
                at += len(texts)

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    made = ["ids", "decoded"] if decoded else ["ids"]
    return rows.mapInArrow(trimmed(apply), schema).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in made], *made)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` with the column decoded: the text of the ids. Null ids give an empty text. A column named
    decoded is replaced."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            lists = batch.column("ids")
            lengths = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < len(lengths):  # bounded pieces, as in text_slices
                low = int(ends[at] - lengths[at])
                stop = max(at + 1, int(np.searchsorted(ends, low + (1 << 21), "right")))
                texts = own.decode(flat[low : int(ends[stop - 1])], lengths[at:stop])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, stop - at), pa.array(texts, pa.string())], ["row", "decoded"])
                at = stop

    rows = docs.select(F.struct(*[c for c in docs.columns if c != "decoded"]).alias("row"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(trimmed(apply), schema).select("row.*", "decoded")

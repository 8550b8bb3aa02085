"""Token ids in binary files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level k the chunk k of those ids that
need one. Beside its chunks a level has a bitmap, set where an id goes on to the next level, and a rank directory: how many bits
are set before every 512th. The place of a chunk on the next level is the rank of its bit, so any id is read without
decoding others.

File layout, little-endian: magic ``DAC1``, then 64-bit numbers: documents, ids, levels; document ids (64 bit), a byte per document that is 1 if
its id is null, where each document starts among the file's ids and where the last one ends (64 bit); per level the number of
chunks (64 bit), bitmap words (64 bit), directory (64 bit), chunks (8 bit). Sections are padded to 8 bytes.
"""

from __future__ import annotations

import os
import re
import string
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WordStore, column, gather, raw_text, text_slices, trimmed

MAGIC = b"DAC1\0\0\0\0"
STEP = 512
IDS_PER_FILE = 1 << 21


def pack(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> bytes:
    """A file of the ids of some documents."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // 64) * 64, np.uint8)
        bits[: len(rest)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        directory = counts[:: STEP // 64]
        levels.append((len(rest), words, directory, (rest & 0xFF).astype(np.uint8)))
        rest = rest[more] >> 8
        if not len(rest):
            break
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    out = [MAGIC, np.array([len(docs), len(ids), len(levels)], "<i8").tobytes()]
    out += [np.array([d or 0 for d in docs], "<i8").tobytes(), _padded(bytes(d is None for d in docs)), starts.tobytes()]
    for n, words, directory, chunks in levels:
        out += [np.array([n], "<i8").tobytes(), words.tobytes(), directory.astype("<i8").tobytes(), _padded(chunks.tobytes())]
    return b"".join(out)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class TokenFile:
    """Reads a packed file; ``get`` gives the ids at any places."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.at = data, 8
        n_docs, self.n_ids, n_levels = self._take("<i8", 3).tolist()
        docs, null = self._take("<i8", n_docs), self._take("u1", n_docs)
        self.docs = [None if gone else d for d, gone in zip(docs.tolist(), null.tolist())]
        self.starts = self._take("<i8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<i8", 1)[0])
            words = -(-n // 64)
            self.levels.append((self._take("<u8", words), self._take("<i8", words // (STEP // 64) + 1), self._take("u1", n)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        part = np.frombuffer(self.data, kind, n, self.at)
        self.at += -(-part.nbytes // 8) * 8
        return part

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before the places ``at``: the directory, then the words of one step, then a part of a word."""
        word, step = at >> 6, at // STEP
        rank = directory[step].copy()
        for k in range(STEP // 64 - 1):
            other = step * (STEP // 64) + k
            inside = other < word
            rank[inside] += np.bitwise_count(words[other[inside]])
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return rank + np.bitwise_count(words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at places of the file, in any order."""
        at = np.asarray(at, np.int64)
        out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (words, directory, chunks) in enumerate(self.levels):
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            goes_on = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            open_, at = open_[goes_on], at[goes_on]
            if not len(at):
                break
            at = self._rank(words, directory, at)
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of a span: one rank per level, then slices."""
        out, open_ = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, (words, directory, chunks) in enumerate(self.levels):
            out[open_] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 6
            bits = np.unpackbits(words[first : (end + 63) >> 6].view(np.uint8), bitorder="little")[start - first * 64 : end - first * 64]
            open_ = open_[bits.astype(bool)]
            if not len(open_):
                break
            start = int(self._rank(words, directory, np.array([start]))[0])
            end = start + len(open_)
        return out


class WordTokenizer:
    """A tokenizers file whose pre-tokens never span blanks or line ends, so that what stands between these is encoded once.

    Blanks and line ends must yield no ids and end every pre-token, and special tokens must hold neither. Where the file ignores the
    case of A-Z, words are looked up in lower case; where it parts letters from full stops and commas, these are words of their own.
    """

    # A stop or comma that follows no letter or digit may belong to a longer run of signs. Letters are those of ASCII and of the two Latin blocks
    # after it, but for the dotted capital I, which ends in a mark once it is in lower case.
    SIGNS = re.compile("[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f][.,][ \n]")
    JOINED = 256

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        if self.tokenizer.encode(" \n ", add_special_tokens=False).ids:
            raise ValueError("this tokenizer gives ids to blanks")
        letters = string.ascii_uppercase
        self.lowers = all(self._ids(c) == self._ids(c.lower()) for c in letters)
        self.parts = all(self._ids(f"{c}{s} {c}") == self._ids(f"{c} {s} {c}") for c in letters + letters.lower() + string.digits for s in ".,")
        self.store = WordStore(self._encode, 400_000, 4_000_000)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _prepared(self, text: str) -> str:
        """The text with a blank between any two words."""
        if "<|" not in text:  # special tokens are found before case is changed
            if self.lowers:
                text = raw_text(text).lower().decode("utf-8", "surrogatepass")
            if self.parts and not self.SIGNS.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.replace("\n", " ")

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words. Many of them are joined by blanks and encoded as one text, whose ids are dealt out by their offsets."""
        groups = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        ids, lengths = [], np.zeros(len(words), np.int64)
        for k, found in enumerate(self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids += found.ids
            starts = np.cumsum([0] + [len(w) + 1 for w in groups[k][:-1]])
            at = np.fromiter((first for first, _ in found.offsets), np.int64, len(found.ids))
            low = k * self.JOINED
            lengths[low : low + len(starts)] = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
        return np.array(ids, np.int32), lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each ended by the end id, and the number of ids of each."""
        # Cut and numbered in Arrow: Python sees each word of a slice once.
        cut = pc.split_pattern(pa.array([self._prepared(t or "") for t in texts], pa.large_string()), " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        words = cut.flatten().dictionary_encode()
        ids, lengths = self.store.codes(words.dictionary.to_pylist())
        word = words.indices.to_numpy().astype(np.int64)
        starts, lengths = (np.cumsum(lengths) - lengths)[word], lengths[word]
        ids = gather(ids, starts, lengths)
        per_doc = np.add.reduceat(lengths, np.cumsum(counts) - counts) if len(texts) else counts
        return np.insert(ids, np.cumsum(per_doc), self.end_id), per_doc + 1


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """Read once per Python worker. The file must stand at this path on every executor."""
    return WordTokenizer(path, end_id)


def _write(path: str, vocabulary: str, end_id: int, ids_per_file: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        own, part = tokenizer(vocabulary, end_id), TaskContext.get().partitionId()
        held, docs, counts, made = [], [], [], []

        def flush() -> None:
            ids = np.concatenate(held)
            name = f"part-{part:06d}-{len(made):06d}.dac"
            draft = f"{folder}/_draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(pack(ids, docs, np.concatenate(counts)))
            store.move(draft, f"{folder}/{name}")  # a repeated task writes the same file again
            made.append((name, part, len(made), len(docs), len(ids)))
            held.clear(), docs.clear(), counts.clear()

        for batch in batches:
            at, names = 0, batch.column("doc").to_pylist()
            for texts in text_slices(batch.column("text").to_pylist(), 1 << 21):
                ids, lengths = own.encode(texts)
                held.append(ids.astype(np.uint32))
                docs += names[at : at + len(texts)]
                counts.append(lengths)
                at += len(texts)
                if sum(map(len, held)) >= ids_per_file:
                    flush()
        if docs:
            flush()
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string())] + [pa.array(c, pa.int64()) for c in columns[1:]], ["name", "part", "number", "n_docs", "n_ids"])

    return write


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, ids_per_file: int = IDS_PER_FILE,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write files of ids to the folder ``path``, in ascending order of the document ids.

    Returns the manifest: name, part, number, n_docs, n_ids, base (ids in all files before). Runs at once. Null ids come first; rows with
    equal ids are documents of their own, ordered by text. Null and empty texts have the end id only. Documents are
    range-partitioned by id and encoded where they are written, one file per ``ids_per_file`` ids.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts, "doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"), "text")
    manifest = stored(ordered.mapInArrow(trimmed(_write(path, vocabulary, end_id, ids_per_file)), "name string, part long, number long, n_docs long, n_ids long"), "token-manifest")
    # Ids before a part: one row per part. Ids before a file: within its part.
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return manifest.withColumn("_within", within).join(before, "part").select(
        "name", "part", "number", "n_docs", "n_ids", (F.col("_before") + F.col("_within")).alias("base"))


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): one row per document of the files; ``ids`` as little-endian unsigned 32-bit numbers, ``start`` counts
    the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("content"), column(batch, "base").tolist()):
                file = TokenFile(data.as_py())
                for low in range(0, len(file.docs), 1024):
                    high = min(low + 1024, len(file.docs))
                    starts = file.starts[low : high + 1]
                    ids = file.span(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                    cuts = ((starts - starts[0]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.docs[low:high], pa.int64()), "start": pa.array(starts[:-1] + base),
                        "ids": pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(manifest.select("name", "base"), "name")
    return named.select("content", "base").mapInArrow(trimmed(read), "doc_id long, start long, ids binary")

"""Language-model scores as the marginal likelihood of a subword lattice."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column, run_starts, text_slices, trimmed, words

SPACE = ord("▁")  # fixed value: how pieces write the start of a word
ROUNDS = 2
SMOOTHING = 0.1
UNIT = 1 << 16  # expected counts are added up as whole numbers of this fraction, so that no order of rows changes them
HOT_WORDS = 1 << 18  # broadcast scores; a bound on their number and length, so on their size
HOT_BYTES = 64
HASH = np.uint64(0x9E3779B97F4A7C15)
LN10 = np.log(10.0)


def _dot(bits: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (bits ^ symbol.astype(np.uint64)) * HASH + np.uint64(1)


class Vocabulary:
    """The pieces of an existing vocabulary file and its scores. The pieces are the arcs of the lattice; 256 byte pieces stand for characters
    that are no piece. The last unit is the end of a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = [model.id_to_piece(i) for i in usable]
        # The scores of a merge vocabulary are ranks: 0, -1, -2 and so on. They weight pieces by Zipf's law.
        scores = np.array([model.get_score(i) for i in usable])
        weights = np.concatenate([1 / (1 + scores.max() - scores), np.full(256, 1 / (2 + scores.max() - scores.min())), [0.0]])
        weights[-1] = weights.sum() / 100
        self.size = len(weights)
        self.bytes_at, self.end = len(self.pieces), self.size - 1
        self.existing = np.log(weights / weights.sum())
        by_length: dict[int, list[int]] = {}
        prefixes: dict[int, set[int]] = {}
        for number, piece in enumerate(self.pieces):
            by_length.setdefault(len(piece), []).append(number)
        self.longest = max(by_length)
        chars = np.zeros((len(self.pieces), self.longest), np.int64)
        for number, piece in enumerate(self.pieces):
            chars[number, : len(piece)] = [ord(c) for c in piece]
        hashes = np.zeros(len(self.pieces), np.uint64)
        lengths = np.array([len(p) for p in self.pieces])
        for n in range(1, self.longest + 1):
            has = lengths >= n
            hashes[has] = _dot(hashes[has], chars[has, n - 1])
            prefixes[n] = set(hashes[has].tolist())
            if n in by_length:
                by_length[n] = np.array(by_length[n])[np.argsort(hashes[by_length[n]], kind="stable")]
        # Prefix hashes by length, sorted; where a prefix is a piece itself, its number.
        self.prefix = {n: np.array(sorted(p), np.uint64) for n, p in prefixes.items()}
        self.piece_at = {}
        for n, known in self.prefix.items():
            self.piece_at[n] = np.full(len(known), -1)
            if n in by_length:
                whole = np.zeros(len(by_length[n]), np.uint64)
                for k in range(n):
                    whole = _dot(whole, chars[by_length[n], k])
                self.piece_at[n][np.searchsorted(known, whole)] = by_length[n]

        self.starts = np.array([ord(p[0]) == SPACE for p in self.pieces])

    def end_log(self, logs: np.ndarray) -> float:
        """Log of the chance that a text ends here and no other word begins."""
        return float(logs[-1] - np.logaddexp(logs[-1], np.logaddexp.reduce(logs[: self.bytes_at][self.starts])))

    def lattice(self, listed: list[bytes]) -> Lattice:
        return Lattice(self, listed)


class Lattice:
    """All segmentations of a list of words, as flat arcs (from node, to node, pieces), sorted by the place where they end.

    A word has a node before and after each character, the first of them before the mark of the word's start.
    """

    def __init__(self, vocabulary: Vocabulary, listed: list[bytes]):
        self.vocabulary = vocabulary
        texts = [chr(SPACE) + w.decode("utf-8", "surrogatepass") for w in listed]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n, word = len(chars), np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(lengths)
        self.first = ends - lengths + np.arange(len(texts))
        self.last = ends + np.arange(len(texts))
        self.nodes = n + len(texts)
        left = ends[word] - np.arange(n)  # characters up to the end of the word
        at, hashes = np.arange(n), np.zeros(n, np.uint64)
        froms, sizes, pieces = [], [], []
        single = np.zeros(n, bool)
        for size in range(1, vocabulary.longest + 1):
            open_ = left[at] >= size
            at, hashes = at[open_], hashes[open_]
            if not len(at):
                break
            hashes = _dot(hashes, chars[at + size - 1])
            known = vocabulary.prefix[size]
            where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            alive = known[where] == hashes
            at, hashes, where = at[alive], hashes[alive], where[alive]
            piece = vocabulary.piece_at[size][where]
            whole = piece >= 0
            froms.append(at[whole])
            sizes.append(np.full(whole.sum(), size))
            pieces.append(piece[whole])
            if size == 1:
                single[at[whole]] = True
        # A character that is no piece is spelled in bytes: one arc whose probability is theirs together.
        other = np.flatnonzero(~single)
        self.spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for c in chars[other].tolist()]
        froms.append(other)
        sizes.append(np.ones(len(other), np.int64))
        pieces.append(-1 - np.arange(len(other)))
        froms, sizes, pieces = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, sizes, pieces))
        start = froms + word[froms]  # node before the character
        reach = start - self.first[word[froms]] + sizes
        order = np.lexsort((start + sizes, reach))
        self.start, self.stop, self.piece = start[order], (start + sizes)[order], pieces[order]
        self.steps = np.append(run_starts(reach[order]), len(order)) if len(order) else np.zeros(1, np.int64)

    def costs(self, logs: np.ndarray) -> np.ndarray:
        out = logs[np.maximum(self.piece, 0)]
        for arc in np.flatnonzero(self.piece < 0).tolist():
            out[arc] = logs[self.vocabulary.bytes_at + self.spelled[-1 - self.piece[arc]]].sum()
        return out

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways from a word's start to each node."""
        costs, alpha = self.costs(logs), np.full(self.nodes, -np.inf)
        alpha[self.first] = 0.0
        for low, high in zip(self.steps[:-1].tolist(), self.steps[1:].tolist()):
            _add(alpha, self.stop[low:high], alpha[self.start[low:high]] + costs[low:high])
        return alpha

    def marginal(self, logs: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        return self.forward(logs)[self.last]

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each unit is used in ``counts`` copies of the words, on average over segmentations, in whole ``UNIT`` fractions."""
        costs, alpha, beta = self.costs(logs), self.forward(logs), np.full(self.nodes, -np.inf)
        beta[self.last] = 0.0
        for low, high in zip(self.steps[-2::-1].tolist(), self.steps[:0:-1].tolist()):
            order = np.argsort(self.start[low:high], kind="stable")
            _add(beta, self.start[low:high][order], (beta[self.stop[low:high]] + costs[low:high])[order])
        word = np.searchsorted(self.first, self.start, "right") - 1
        share = np.exp(np.minimum(0.0, alpha[self.start] + costs + beta[self.stop] - alpha[self.last][word]))
        uses = np.rint(share * UNIT).astype(np.int64) * counts[word]
        out = np.zeros(self.vocabulary.size, np.int64)
        known = self.piece >= 0
        np.add.at(out, self.piece[known], uses[known])
        for arc in np.flatnonzero(~known).tolist():
            np.add.at(out, self.vocabulary.bytes_at + self.spelled[-1 - self.piece[arc]], uses[arc])
        return out


def _add(sums: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> None:
    """Add logs of probabilities at sorted nodes, to what is there."""
    starts = run_starts(nodes)
    own = nodes[starts]
    top = np.maximum(np.maximum.reduceat(values, starts), sums[own])
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.add.reduceat(np.exp(values - np.repeat(safe, np.diff(np.append(starts, len(nodes))))), starts)
    with np.errstate(divide="ignore"):
        sums[own] = np.log(total + np.exp(sums[own] - safe)) + safe


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker. The file must stand at this path on every executor."""
    return Vocabulary(path)


def _word_batches(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches of words into parts of about ``size`` bytes; a lattice takes a multiple of that."""
    for batch in batches:
        listed = batch.column("word").to_pylist()
        at, n = 0, 0
        for i, w in enumerate(listed):
            n += len(w)
            if n >= size or i == len(listed) - 1:
                yield batch.slice(at, i + 1 - at), listed[at : i + 1]
                at, n = i + 1, 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers in training rows and in all rows, added up over as many texts as memory may hold."""
    trained, total = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array([trained[w] for w in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
            ["word", "c", "n"])
        trained.clear(), total.clear()
        return out

    for batch in batches:
        for text, training in zip(batch.column("text").to_pylist(), batch.column("training").to_pylist()):
            own = words(text)
            total.update(own)
            if training:
                trained.update(own)
            if len(total) > 400_000:
                yield flush()
    yield flush()


def train(spoken: DataFrame, path: str, ends: float, rounds: int = ROUNDS) -> np.ndarray:
    """Natural logs of the units' probabilities. Starts from the file's own scores; each round replaces them with the shares of the
    expected uses in all distinct training words (column c > 0), plus ``SMOOTHING`` each; words count once, as the lattice stands in for
    words that are new. ``ends`` is the number of ends to that many words. Without words the file's scores stay."""
    logs = vocabulary(path).existing
    spark = spoken.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logs)  # one number per unit of the vocabulary file

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = vocabulary(path)
            sums = np.zeros(own.size, np.int64)
            for batch, listed in _word_batches(batches):
                sums += own.lattice(listed).expected(shared.value, np.ones(len(listed), np.int64))
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"unit": used, "uses": sums[used]})

        uses = spoken.where("c > 0").select("word").mapInArrow(trimmed(expect), "unit long, uses long").groupBy("unit").agg(
            F.sum(F.col("uses").cast("decimal(38,0)")).alias("uses")).collect()
        if not uses:
            return logs
        sums = np.full(len(logs), SMOOTHING)
        for unit, n in uses:
            sums[unit] += float(n) / UNIT
        sums[-1] += ends
        logs = np.log(sums / sums.sum())
    return logs


def backed_off(counts: np.ndarray, marginal: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 of a word's probability: its share of the training tokens, and the lattice's for the share left to the rest."""
    if not tokens:
        return marginal / LN10
    with np.errstate(divide="ignore"):
        return (np.logaddexp(np.log(counts), np.log(types) + marginal) - np.log(tokens + types)) / LN10


PARTS = "row long, doc long, word binary, k long, tokens long, known long, base double, model double"


def _doc_rows(hot):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: one row with the sums over its hot words, under a word that no text holds (it has a blank), and a row per other word.

        Rows are numbered in the order they are read, as an id may be null or repeated.
        """
        found, number = hot.value, TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in PARTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            docs, at = batch.column("doc").to_pylist(), 0
            for part in text_slices(batch.column("text").to_pylist()):
                out = []
                for doc, text in zip(docs[at : at + len(part)], part):
                    times = Counter(words(text))
                    known, base, model = 0, 0.0, 0.0
                    for word, k in times.items():
                        entry = found.get(word)
                        if entry is None:
                            out.append((number, None, word, k, 0, 0, 0.0, 0.0))
                        else:
                            known += k * (entry[0] > 0)
                            base += k * entry[1]
                            model += k * entry[2]
                    out.append((number, doc, b" %d" % number, 0, times.total(), known, base, model))
                    number += 1
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows


def score(docs: DataFrame, training: Column, path: str, rounds: int = ROUNDS, hot_words: int = HOT_WORDS,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``. The words are counted at once.

    Words are what ASCII white space separates, A-Z lower-cased; a text ends with one more token. base_score adds up
    log10((c + 1) / (N + V + 1)) over the tokens: c is the token's count in the rows where ``training`` holds, N of all tokens, V of distinct ones.
    score is the model's: a word is spelled by pieces of the vocabulary file, the first with the mark of a word's start, or by bytes; its
    marginal probability L is the sum over all ways to cut it. Whole words seen in training are arcs of the lattice, too, with the share that
    Witten and Bell give to what is known: (c + V L) / (N + V), likewise for the end. n_known counts tokens with c > 0.
    Null texts are empty. Without training rows N and V are 0, base_score counts from 1 and the file's own scores decide. Repeated rows count, and come back, as often
    as they stand; a null ``training`` does not hold.

    All words with their counts are one table, by far smaller than the texts. The ``hot_words`` most frequent short ones are broadcast,
    with their scores: a bounded number of bounded size. Every other word of a text meets its score in a join by word, as one row per text,
    and the rows of a text are added up.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("training"))
    counted = rows.select("text", "training").mapInArrow(trimmed(_count_words), "word binary, c long, n long")
    spoken = stored(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    texts = rows.where("training").count()
    seen, distinct = spoken.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, types = seen + texts, distinct + (texts > 0)
    logs = train(spoken, path, texts * distinct / max(1, seen), rounds)
    shared = spark.sparkContext.broadcast(logs)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch, listed in _word_batches(batches):
            c = column(batch, "c")
            model = backed_off(c, own.lattice(listed).marginal(shared.value), tokens, types)
            base = np.log10((c + 1) / (tokens + types + 1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("n"), pa.array(base), pa.array(model)], ["w", "c", "n", "b", "m"])

    scored = stored(spoken.mapInArrow(trimmed(marginals), "w binary, c long, n long, b double, m double"), "lm-scores")
    top = scored.where(F.length("w") <= HOT_BYTES).orderBy(F.desc("n"), "w").limit(hot_words).select("w", "c", "b", "m").toArrow()
    values = zip(*(top.column(name).to_pylist() for name in ("c", "b", "m")))
    hot = spark.sparkContext.broadcast(dict(zip(top.column("w").to_pylist(), values)))
    parts = rows.select("doc", "text").mapInArrow(trimmed(_doc_rows(hot)), PARTS)
    own = parts.join(scored.drop("n"), F.col("word") == F.col("w"), "left")
    k = F.col("k")
    sums = own.groupBy("row").agg(
        F.max("doc").alias("doc_id"), F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, k).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.coalesce(k * F.col("b"), F.lit(0.0))).alias("base"),
        F.sum(F.col("model") + F.coalesce(k * F.col("m"), F.lit(0.0))).alias("model"))
    end_base, end_model = float(np.log10((texts + 1) / (tokens + types + 1))), float(backed_off(np.array([texts]), np.array([vocabulary(path).end_log(logs)]), tokens, types)[0])
    return sums.select(
        "doc_id", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + int(texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), (F.col("model") + end_model).alias("score"))

"""How far the sources of a language differ in their words, by sorted pointers to word starts.

A task reads its texts as Arrow buffers and never cuts them into strings: the start of each word in the buffer is a pointer. Pointers
are sorted as by multikey quicksort, eight bytes a digit: a quicksort by the first digit, then each slice of equal digits whose words go on by the
next one. Equal words end up as runs; their length per document group gives the counts per source, and the different documents
in a run its document frequency. Only these runs are shuffled, one row per (language, word, source) and slice of texts.

All arithmetic is in whole numbers. The share of a word is p = 1 + floor(SCALE (c + 1) / (N + V)), with its count c, the count N of all kept words
in the group and the number V of kept words. The divergence of p from q is floor((p - q)^2 / q).

A pair of sources is compared over all kept words, but work is done only where words occur: with a word's share p0 if it is absent,
the sum is V f(p0, q0), a term for each word of the one and of the other source, which depends on its count alone and so is taken from the source's
histogram of counts, and a correction for each word that both hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import gather, run_starts, trimmed

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
SLICE = 1 << 24  # bytes of text whose pointers are sorted at once
DEEP = 64  # bytes after which the few words left in a run are compared as a whole
PAIRS = 1 << 20

# Bytes of words: ASCII letters, and all of the characters beyond ASCII; the latter are left as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def word_pointers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word in a buffer of texts that begin at ``starts``; words never cross into another text."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    border = starts[(starts > 0) & (starts < len(data))]
    begins[border] = inside[border + 1]
    ends[border - 1] = inside[border]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1 - at


def sort_pointers(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their words, and the number of the run of equal words at each place of that order."""
    n = len(at)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.ndarray((len(data) + 1,), ">u8", padded, 0, (1,))  # eight bytes from any place

    def digit(which: np.ndarray, depth: int) -> np.ndarray:
        rest = np.minimum(lengths[which] - depth, 8)
        value = digits[at[which] + depth].astype(np.uint64)
        return value >> ((8 - rest).astype(np.uint64) << np.uint64(3)) << ((8 - rest).astype(np.uint64) << np.uint64(3))

    key = digit(np.arange(n), 0)
    order = np.argsort(key)
    new = np.zeros(n, bool)
    new[run_starts(key[order])] = True
    depth = 8
    while True:
        run = np.cumsum(new) - 1
        size = np.bincount(run, minlength=1)
        # Slices of two pointers or more that hold a word which goes on. A word that ends is the smallest: its digit is zero.
        goes_on = np.zeros(len(size), bool)
        goes_on[run[lengths[order] > depth]] = True
        left = np.flatnonzero((goes_on & (size > 1))[run])
        if not len(left):
            return order, run
        which, slices = order[left], run[left]
        if depth >= DEEP:
            words = [data[a + depth : a + m].tobytes() for a, m in zip(at[which].tolist(), lengths[which].tolist())]
            ranks = {w: i for i, w in enumerate(sorted(set(words)))}
            key = np.fromiter(map(ranks.__getitem__, words), np.uint64, len(words))
        else:
            key = np.zeros(len(which), np.uint64)
            longer = lengths[which] > depth
            key[longer] = digit(which[longer], depth)
        inner = np.lexsort((key, slices))
        order[left], key, slices = which[inner], key[inner], slices[inner]
        new[left[run_starts(slices, key)]] = True
        if depth >= DEEP:
            return order, np.cumsum(new) - 1
        depth += 8


def count_words(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that begin at ``starts``, as one row per (word, group): word, group, occurrences, texts that hold it."""
    at, lengths = word_pointers(data, starts)
    if not len(at):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    order, run = sort_pointers(low, at, lengths)
    # Texts are numbered by group, so that the texts of a run and group lie together.
    place = np.argsort(groups, kind="stable")
    number = np.empty(len(place), np.int64)
    number[place] = np.arange(len(place))
    text = np.searchsorted(starts, at, "right") - 1
    first = run_starts(run)
    words, width = at[order[first]], lengths[order[first]]
    both = np.sort(run << 32 | number[text[order]])
    pairs = run_starts(both)
    run, group = both[pairs] >> 32, groups[place][both[pairs] & 0xFFFFFFFF]
    cells = run_starts(run, group)
    docs = np.diff(np.append(cells, len(pairs)))
    counts = np.diff(np.append(pairs[cells], len(both)))
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    spelled = pa.LargeStringArray.from_buffers(len(width), pa.py_buffer(ends), pa.py_buffer(gather(low, words, width)))
    return spelled.take(pa.array(run[cells])), group[cells], counts, docs


def _long_text(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``count_words`` of a single long text, in pieces that end at a byte outside of words."""
    total: dict[str, int] = {}
    while len(data):
        cut = SLICE
        while cut < len(data) and IN_WORD[data[cut - 1]]:
            outside = np.flatnonzero(~IN_WORD[data[cut : cut + SLICE]])
            cut += int(outside[0]) + 1 if len(outside) else SLICE
        part, data = data[:cut], data[cut:]
        words, _, counts, _ = count_words(part, np.zeros(1, np.int64), np.zeros(1, np.int64))
        for word, n in zip(words.to_pylist(), counts.tolist()):
            total[word] = total.get(word, 0) + n
    n = len(total)
    return pa.array(total, pa.large_string()), np.zeros(n, np.int64), np.fromiter(total.values(), np.int64, n), np.ones(n, np.int64)


COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the batches' texts, one slice of whole texts after the other."""

    def rows(names: pa.Table, words: pa.Array, group: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(group), 1 << 17):
            part = slice(low, low + (1 << 17))
            labels = pa.array(group[part])
            yield pa.RecordBatch.from_arrays(
                [names["lang"].combine_chunks().take(labels), names["source"].combine_chunks().take(labels), words[part].cast(pa.string()),
                 pa.array(counts[part]), pa.array(docs[part])], ["lang", "source", "term", "n", "docs"])

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.Table.from_batches(held)
        names = texts.select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
        label = {(a, b): i for i, (a, b) in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
        groups = np.array([label[pair] for pair in zip(texts["lang"].to_pylist(), texts["source"].to_pylist())], np.int64)
        buffers, sizes = [], []
        for chunk in texts["text"].cast(pa.large_binary()).chunks:
            ends = np.frombuffer(chunk.buffers()[1], np.int64, len(chunk) + 1, chunk.offset * 8)
            buffers.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
            sizes.append(np.diff(ends))
        data, sizes = np.concatenate(buffers), np.concatenate(sizes)
        starts = np.cumsum(sizes) - sizes
        some = sizes > 0  # texts of no bytes share their start with the next one
        if len(sizes) == 1 and sizes[0] > SLICE:
            words, _, counts, docs = _long_text(data)
            yield from rows(names, words, np.repeat(groups, len(counts)), counts, docs)
        elif some.any():
            yield from rows(names, *count_words(data, starts[some], groups[some]))

    held, size = [], 0
    for batch in batches:
        widths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        low = 0
        for i, width in enumerate(widths.tolist()):
            if width > SLICE:
                if i > low:
                    held.append(batch.slice(low, i - low))
                yield from counted([batch.slice(i, 1)])
                low = i + 1
                continue
            size += width
            if size >= SLICE:
                held.append(batch.slice(low, i + 1 - low))
                yield from counted(held)
                held, size, low = [], 0, i + 1
        if low < len(widths):
            held.append(batch.slice(low))
    if held:
        yield from counted(held)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, sources): the words that at least ``min_docs`` documents of their language hold, with their occurrences in the language and
    the (source, n) of each source that holds them. ``docs`` has the columns text, lang and source, not null; every row is a document."""
    counted = docs.select("text", "lang", "source").mapInArrow(trimmed(_counted), COUNTED)
    # One exchange serves both groupings.
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by_term.where(F.col("docs") >= min_docs).drop("docs")


def _share(count, total, kept):
    """p of a count, in decimals, as counts of large corpora times SCALE leave the range of long."""
    return F.expr(f"1 + (cast({count} + 1 AS DECIMAL(20, 0)) * {SCALE}BD) div cast({total} + {kept} AS DECIMAL(20, 0))")


def _apart(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two sources that hold a word: what their shares there add beside the sums over each source alone."""
    codes: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    for batch in batches:
        lists = batch.column("sources")
        sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)).astype(np.int64)
        flat = lists.flatten()
        langs = np.repeat(batch.column("lang").to_numpy(zero_copy_only=False), sizes)
        code = np.array([codes.setdefault(pair, len(codes)) for pair in zip(langs, flat.field("source").to_pylist())], np.int64)
        p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        ends = np.cumsum(sizes)
        # Each entry meets all entries of its word, as many entries at a time as make a bounded number of pairs.
        own = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.cumsum(sizes[own])
        low = 0
        while low < len(own):
            high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + PAIRS, "right")))
            width = sizes[own[low:high]]
            left = np.repeat(np.arange(low, high), width)
            first = ends[own[low:high]] - width
            right = np.arange(len(left)) + np.repeat(first - (np.cumsum(width) - width), width)
            value = apart(p[left], p[right]) - apart(p[left], p0[right]) - apart(p0[left], p[right]) + apart(p0[left], p0[right])
            both = code[left] << 32 | code[right]
            keys, where = np.unique(both, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, value)
            for k, v in zip(keys.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + v
            low = high
    names = list(codes)
    keys = [(k >> 32, k & 0xFFFFFFFF) for k in sums]
    for low in range(0, len(keys), 1 << 17):
        some = keys[low : low + (1 << 17)]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([names[a][0] for a, _ in some], pa.string()), "source": pa.array([names[a][1] for a, _ in some], pa.string()),
            "item": pa.array([names[b][1] for _, b in some], pa.string()),
            "value": pa.array([sums[a << 32 | b] for a, b in some], pa.int64())})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language (part ``pair``, all ranks), and the words
    that set it most apart from the whole language (part ``term``, ranks to ``top``).

    Null text, lang and source count as empty. Every row is a document, also rows with equal ids. Words are runs of ASCII letters and characters beyond ASCII,
    A-Z lower-cased, of any length. A language without kept words has pairs of value 0 and no terms; one with a single source has no pairs. Equal
    values are ranked by item in byte order. An empty table gives no rows. Other columns are not read.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    terms = stored(term_counts(named, min_docs), "terms")
    single = terms.select("lang", "term", F.col("n").alias("whole"), F.inline("sources"))
    sums = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    totals = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = named.select("lang", "source").distinct().join(sums, "lang", "left").join(totals, ["lang", "source"], "left")
    sources = sources.na.fill(0, ["lang_total", "kept", "total"])
    # The share of an absent word; without any kept word there is nothing to divide by.
    groups = stored(sources.withColumn("p0", F.when(F.col("kept") > 0, _share("0", "total", "kept"))), "sources")
    shares = single.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", _share("n", "total", "kept").alias("p"), _share("whole", "lang_total", "kept").alias("q"))

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    ranked = apart.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)

    # Per source, how many of its words occur how often; all words of a count have the same share.
    histogram = shares.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("words"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = histogram.join(other, "lang").where("source <> item")
    one = met.select("lang", "source", "item", (F.col("words") * (_apart("p", "q0") - _apart("p0", "q0"))).alias("value"))
    two = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("words") * (_apart("q0", "p") - _apart("q0", "p0"))).alias("value"))
    none = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * _apart("p0", "q0"), F.lit(0)).alias("value"))
    whole = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
    shared = whole.select("lang", "sources").mapInArrow(trimmed(_corrections), "lang string, source string, item string, value long").where("source <> item")
    pairs = none.unionByName(one).unionByName(two).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ordered))
    return pairs.withColumn("part", F.lit("pair")).unionByName(ranked.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHING, documents
from pyspark.sql import functions as F

from rolescope.llm import lattice, quality

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary(PATH)


def by_hand(vocabulary, word, logs):
    """Sum over all segmentations, and the expected uses of each unit, by listing them."""
    number = {p: i for i, p in enumerate(vocabulary.pieces)}
    text = "▁" + word

    def ways(at):
        if at == len(text):
            yield []
            return
        if text[at] not in number:
            for rest in ways(at + 1):
                yield [vocabulary.bytes_at + b for b in text[at].encode()] + rest
        for end in range(at + 1, min(len(text), at + vocabulary.longest) + 1):
            if text[at:end] in number:
                for rest in ways(end):
                    yield [number[text[at:end]], *rest]

    found = [(w, math.exp(sum(logs[u] for u in w))) for w in ways(0)]
    total, uses = sum(p for _, p in found), np.zeros(vocabulary.size)
    for units, p in found:
        for u in units:
            uses[u] += p / total
    return math.log(total), uses


WORDS = ["the", "thtionha", "a", "ñuear", "é你x", "🙂🙂", "unbelievable", "$$$%%%", "x", ""]


def test_all_segmentations(vocabulary):
    listed = [w.encode() for w in WORDS]
    held = vocabulary.lattice(listed)
    for logs in (vocabulary.existing, np.roll(vocabulary.existing, 7)):
        want = [by_hand(vocabulary, w, logs) for w in WORDS]
        assert np.allclose(held.marginal(logs), [m for m, _ in want])
        counts = np.arange(1, len(WORDS) + 1)
        assert np.allclose(held.expected(logs, counts) / lattice.UNIT, sum(c * u for c, (_, u) in zip(counts, want)), atol=1e-3)
    assert vocabulary.lattice([]).marginal(vocabulary.existing).tolist() == []
    long = vocabulary.lattice([b"ab" * 20_000, b"the"]).marginal(vocabulary.existing)
    assert np.isfinite(long).all() and long[0] < -10_000


def test_existing_scores_are_probabilities(vocabulary):
    assert math.isclose(np.exp(vocabulary.existing).sum(), 1.0)
    # Words and the end together: a word starts with a marked piece and goes on with others.
    logs = vocabulary.existing
    start = np.exp(logs[: vocabulary.bytes_at][vocabulary.starts]).sum()
    assert math.isclose(start / (start + math.exp(logs[-1])) + math.exp(vocabulary.end_log(logs)), 1.0)


def naive(rows, trained):
    count, n = Counter(), 0
    for (_, text), t in zip(rows, trained):
        if t:
            own = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
            count.update([*own, None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        own = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        own.append(None)
        out.append((doc, len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)))
    return out, count, n, v


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_scores(spark, vocabulary, hot):
    rows = [(i, t) for i, t in enumerate(["the cat the Cat", "a cat\xa0sat", None, "", "the\tdog\nñ", "zebra the", "The dog"])] + [(None, "the x"), (1, "other"), (1, "other")]
    docs = documents(spark, rows, **CLASHING)
    got = lattice.score(docs, F.col("doc_id") % 3 != 1, PATH, rounds=0, hot_words=hot).collect()
    want, count, n, v = naive(rows, [d is not None and d % 3 != 1 for d, _ in rows])
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    assert [tuple(r)[:4] for r in sorted(got, key=key)] == [w[:4] for w in sorted(want, key=key)]
    assert np.allclose([r.base_score for r in sorted(got, key=key)], [w[4] for w in sorted(want, key=key)])
    model = {w: (count[w] + v * math.exp(by_hand(vocabulary, w, vocabulary.existing)[0])) / (n + v) for w in ("the", "x")}
    end = (count[None] + v * math.exp(vocabulary.end_log(vocabulary.existing))) / (n + v)
    row = next(r for r in got if r.doc_id is None)
    assert math.isclose(row.score, math.log10(model["the"] * model["x"] * end), rel_tol=1e-9)


def test_learning_helps_held_out_texts(spark):
    """The base gives all unknown words of any spelling one probability each, so it sums to more than one and is no yardstick for
    texts with new words; the model that has learned nothing is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = lattice.score(docs, quality.fold(folds=7) != 2, PATH).toPandas()
    plain = lattice.score(docs, F.lit(False), PATH).toPandas().set_index("doc_id").score
    held = scored[[zlib.crc32(str(i).encode()) % 7 == 2 for i in scored.doc_id]]
    assert len(scored) == 1000 and len(held) > 100
    assert (held.score.to_numpy() > plain[held.doc_id].to_numpy()).mean() > 0.99 and held.score.sum() > 0.7 * plain[held.doc_id].sum()
    known = held[held.n_known == held.n_tokens]
    assert np.allclose(known.score, known.base_score, rtol=0.1)
    assert (scored.train_tokens == scored[~scored.index.isin(held.index)].n_tokens.sum()).all()


def test_without_training_and_empty(spark):
    none = lattice.score(documents(spark, [(1, "a b"), (2, None)]), F.lit(None).cast("boolean"), PATH).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(3, 0, 0), (1, 0, 0)] and all(r.score < 0 for r in none)
    assert lattice.score(documents(spark, []), F.lit(True), PATH).count() == 0

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import CLASHING, rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.llm import divergence

WORD = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "text string, lang string, source string"
NAMES = {c: "mine" for c in ("term", "n", "docs", "p", "q", "p0", "q0", "value", "rank", "item", "part", "total", "kept", "words", "whole", "lang_total")}


def found(text):
    return [w.translate(UPPER) for w in WORD.findall(text or "")]


def expected(rows, min_docs=3, top=200):
    """By the definition, over all words and pairs, in Python's whole numbers."""
    docs, counts, out = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        docs[lang].update(set(found(text)))
        counts[lang, source].update(found(text))
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in groups if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("aAbzZé你🙂 ,.1\n", max_size=40), st.text(max_size=20), st.lists(st.sampled_from(["abcdefgh", "abcdefghi", "x" * 70, "x" * 70 + "y", "abcdefgh12"]), max_size=5).map(" ".join))))
def test_runs_of_equal_words(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    groups = np.arange(len(texts)) % 3
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    some, starts = sizes > 0, np.cumsum(sizes) - sizes
    words, group, counts, docs = divergence.count_words(np.frombuffer(b"".join(raw), np.uint8), starts[some], groups[some])
    want, held = Counter(), Counter()
    for t, g in zip(texts, groups.tolist()):
        want.update((w, g) for w in found(t))
        held.update({(w, g) for w in found(t)})
    got = list(zip(words.to_pylist(), group.tolist()))
    assert len(set(got)) == len(got) and words.to_pylist() == sorted(words.to_pylist(), key=str.encode)
    assert dict(zip(got, counts.tolist())) == want and dict(zip(got, docs.tolist())) == held


@pytest.mark.parametrize("size", [divergence.SLICE, 200])
def test_like_the_definition(spark, size, monkeypatch):
    draw = rng(3)
    pool = ["aa", "Bb", "c", "é", "É", "你好", "longer-word", "x" * 100, "abcdefgh", "abcdefghi", "1", "d1e"]
    rows = []
    for i in range(300):
        words = draw.choice(pool, draw.integers(0, 30), p=np.arange(1, 13) / 78)
        rows.append((" ".join(words), ["en", "de", None][i % 3], "s0" if i % 2 else f"s{i % 9}"))
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("aa aa", None, None), ("a b c", "xx", "one"), ("z", "yy", "one"), ("z", "yy", "two"), ("w " * 3000, "de", "s0")] + [rows[5]] * 4
    if size == 200:  # in many slices, and texts that are longer than a slice
        monkeypatch.setattr(divergence, "SLICE", size)
        parts = [tuple(r) for r in divergence_rows(rows)]
        assert sum(n for *_, n, _ in parts) == sum(len(found(r[0])) for r in rows)
        return
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(v) for n, v in (CLASHING | NAMES).items()})
    got = [tuple(r) for r in divergence.divergence(table, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, top=4)
    assert {r[3] for r in got if r[0] == "yy"} == {"one", "two"} and {r[4] for r in got if r[0] == "yy"} == {0}


def divergence_rows(rows):
    """The partial counts of a task whose batches hold ten rows, united."""
    import pyarrow as pa

    texts = pa.table({"text": [r[0] or "" for r in rows], "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows]})
    total = Counter()
    held = Counter()
    for batch in divergence._counted(iter(texts.to_batches(max_chunksize=10))):
        for r in batch.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            held[r["lang"], r["source"], r["term"]] += r["docs"]
    want = Counter()
    for text, lang, source in rows:
        want.update({(lang or "", source or "", w) for w in found(text)})
    assert held == want
    return [(*key, n, held[key]) for key, n in total.items()]


def test_counts_beyond_long_and_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    share = spark.createDataFrame([(3 * 10**12, 10**13, 10**7)], "n long, total long, kept long").select(divergence._share("n", "total", "kept").alias("p"))
    assert share.first().p == 1 + 10**9 * (3 * 10**12 + 1) // (10**13 + 10**7)

import random

import numpy as np
import pytest
from helpers import CLASHING, documents

from rolescope.llm import repeats


def expected(rows, length=100):
    """Every string of the length, in order of documents and starts; a later one is removed."""
    seen, out = set(), {}
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    for known, doc, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            part = raw[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(doc if known else None), text] = (len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return sorted(((d, *out[d, t or ""]) for d, t in rows), key=str)


def result(docs, **options):
    rows = repeats.without_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)


def corpus(seed, n=90):
    draw = random.Random(seed)

    def text(size):
        return "".join(draw.choice("abcde é\n") for _ in range(size))

    base = [text(draw.randint(120, 900)) for _ in range(9)]
    rows = []
    for i in range(n):
        t = draw.choice(base)
        for _ in range(draw.randint(0, 4)):
            p, kind = draw.randint(0, len(t)), draw.randint(0, 3)
            t = [t[:p] + text(1) + t[p + 1 :], t[:p] + draw.choice(base)[: draw.randint(0, 250)] + t[p:], t[p:], text(50) + t][kind]
        rows.append((i * 7, t))
    rows += [(2000, "a" * 700), (2001, "ab" * 300), (2002, "a" * 99), (2003, ""), (2004, "x" * 100), (2005, "x" * 101), (2006, "aab" * 200), (5, "ab" * 90)]
    draw.shuffle(rows)
    return rows


def test_like_brute_force(spark):
    rows = corpus(3)
    assert result(documents(spark, rows, **CLASHING).repartition(5)) == expected(rows)
    assert result(documents(spark, rows).repartition(3), length=30, gram=10) == expected(rows, 30)


def test_crowded_anchors(spark, monkeypatch):
    """One line before and after which every document differs: its anchors have many classes and are cut by further ones."""
    monkeypatch.setattr(repeats, "CROWD", 3)
    draw = random.Random(4)
    line = "".join(draw.choice("abcdef") for _ in range(70))
    tails = ["".join(draw.choice("xyz") for _ in range(60)) for _ in range(12)]
    rows = [(i, draw.choice(tails) + line + draw.choice(tails) + str(i) * 20) for i in range(60)]
    assert result(documents(spark, rows).repartition(4)) == expected(rows)


def test_passage_before_different_text_is_dealt_out(spark, monkeypatch):
    """A passage longer than a string in most documents, different text after it: no merged group exceeds the bound, and the result is whole."""
    monkeypatch.setattr(repeats, "CROWD", 5)
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdef ") for _ in range(160))
    rows = [(i, passage + "".join(draw.choice("uvwxyz") for _ in range(90)) + ("tail " * 30 if i % 3 else "")) for i in range(40)]
    rows += [(100 + i, "".join(draw.choice("abc") for _ in range(150))) for i in range(5)]
    sizes = spark.sparkContext.accumulator(0)
    merged = repeats._merged

    def watched(length):
        def run(batches):
            def seen():
                for batch in batches:
                    groups = np.unique(batch.column("h").to_numpy(), return_counts=True)[1]
                    sizes.add(int((groups > 5).sum()))
                    yield batch

            yield from merged(length)(seen())

        return run

    monkeypatch.setattr(repeats, "_merged", watched)
    assert result(documents(spark, rows).repartition(4)) == expected(rows)
    assert sizes.value == 0


def test_nulls_shared_ids_repeats_and_empty(spark):
    t = "".join(random.Random(1).choice("abc") for _ in range(300))
    rows = [(1, t), (1, t), (1, "z" + t), (None, t[:200]), (None, None), (2, None), (3, t[100:]), (0, "")]
    assert result(documents(spark, rows)) == expected(rows)
    assert result(documents(spark, [])) == []


def test_very_long_text_in_parts(spark):
    raw = "".join(random.Random(2).choice("abcdefgh") for _ in range(4000))
    rows = [(1, raw * 3 + "x"), (2, raw[50:3000])]
    batches = documents(spark, rows)
    whole = result(batches)
    assert whole == expected(rows)
    pieces = repeats._pieces(100, 24)
    import pyarrow as pa

    table = [pa.RecordBatch.from_pydict({"doc": [1, 2], "text": [r[1] for r in rows]})]
    default, repeats.BUFFER = repeats.BUFFER, 1000
    try:
        cut = [b for b in pieces(iter(table))]
    finally:
        repeats.BUFFER = default
    starts = sum(int(np.maximum(b.column("n").to_numpy(), 0).sum()) for b in cut)
    spans = [(d, a, a - n) for b in cut for d, a, n in zip(b.column("doc").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist()) if n < 0]
    total = sum(len(r[1]) - 99 for r in rows)
    assert starts + sum(e - s - 99 for _, s, e in spans) >= total - len(spans) * 99 and starts <= total


@pytest.mark.parametrize("shard", [1, 60, 10_000])
def test_merged_transforms(shard):
    """Places in the order of their strings, blocks of equal ones, however the texts are cut into shards."""
    draw = random.Random(6)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 60))).encode() for _ in range(30)]
    texts += texts[:5] + ["é".encode() * 9, b"a" * 40, b"a" * 40]
    place, block = repeats.repeated_strings(texts, 8, shard)
    whole = b"".join(t + b"\xff" for t in texts)
    strings = [whole[p : p + 8] for p in place.tolist()]
    assert len(place) == sum(max(0, len(t) - 7) for t in texts) and strings == sorted(strings)
    assert [b != a for a, b in zip(block, block[1:])] == [b != a for a, b in zip(strings, strings[1:])]


def test_united():
    doc, start, end = repeats.united(np.array([2, 1, 1, 1, 1]), np.array([5, 0, 8, 3, 20]), np.array([6, 4, 9, 8, 30]))
    assert list(zip(doc.tolist(), start.tolist(), end.tolist())) == [(1, 0, 9), (1, 20, 30), (2, 5, 6)]

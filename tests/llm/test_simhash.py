import random

import numpy as np
import xxhash
from helpers import CLASHING, components, documents
from hypothesis import given
from hypothesis import strategies as st

from rolescope.llm import simhash


def fingerprint(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def expected(rows, bits=2):
    prints = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: p for p, i in enumerate(order)}
    label = components(len(rows), [(place[i], place[j]) for i, j in links])
    return {(rows[i][0], f"{prints[i]:016x}", rows[order[label[place[i]]]][0]) for i in range(len(rows))}


def variants():
    """Texts around a few long ones, with small edits, so that many fingerprints differ in a few bits."""
    draw = random.Random(2)
    base = [[f"w{draw.randint(0, 400)}" for _ in range(400)] for _ in range(3)]
    rows = [(10 * i, t) for i, t in enumerate(["", None, " \n", "one", "One two", "one\x0btwo", "É é", "one two three", "a\xa0b"])]
    for i in range(120):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 9)}"
        rows.append((1000 - i * 3, " ".join(words)))
    return rows


def test_like_brute_force(spark):
    rows = variants()
    got = simhash.near_duplicates(documents(spark, rows, **CLASHING)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected(rows)
    assert 20 < len({r.component_id for r in got}) < len(rows)
    kept = simhash.one_of_each(documents(spark, rows, **CLASHING))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected(rows)}) and "component_id" in kept.columns


def test_other_distances_and_shingles(spark):
    rows = variants()[40:70]
    for bits in (0, 4):
        got = simhash.near_duplicates(documents(spark, rows), max_bits=bits, blocks=bits + 4).collect()
        assert {tuple(r) for r in got} == expected(rows, bits)
    one = simhash.near_duplicates(documents(spark, [(1, "a b c")]), shingle=5).first()
    assert one.fingerprint == f"{fingerprint('a b c', 5):016x}"


def test_nulls_repeats_long_and_empty(spark):
    long = "word " * 100_000
    rows = [(1, long), (1, long), (None, long), (None, None), (2, None)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted([tuple(r)[::2] for r in got], key=str) == sorted([(1, 1), (1, 1), (None, None), (None, None), (2, 2)], key=str)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, rows)).count() == 5


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_near_fingerprints_share_a_table_row(x, flips):
    y = x ^ sum(1 << b for b in flips)
    references = simhash.pivots(simhash.PIVOTS)
    pair = np.array([x, y], np.uint64)
    rows = [simhash.pivot_table(pair, m, references) for m in simhash.masks(2, 8)]
    assert any(a == b for a, b in rows)


def test_near_pairs_like_brute_force():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 63, 5, np.uint64)[draw.integers(0, 5, 700)] ^ (np.uint64(1) << draw.integers(0, 12, 700).astype(np.uint64))
    found = set()
    for a, b in simhash.near_pairs(prints, simhash.pivots(6), 2, block=64):
        found |= {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(700) for j in range(i + 1, 700) if int(prints[i] ^ prints[j]).bit_count() <= 2}

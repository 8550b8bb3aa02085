import hashlib

import numpy as np
import pytest
from helpers import rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.llm import vector_codes
from rolescope.llm.vector_codes import compress, exact_products, nearest, with_label_error

SCHEMA = "vec_id long, label int, embedding array<double>"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 28), st.integers(0, 2**32))
def test_products_are_exact(width, bits, seed):
    draw = np.random.default_rng(seed)
    x, y = (draw.integers(-(1 << bits), (1 << bits) + 1, (7, width)) for _ in range(2))
    want = [[sum(a * b for a, b in zip(r, s)) for s in y.tolist()] for r in x.tolist()]
    assert exact_products(x, y).tolist() == want
    best, apart = nearest(x, y)
    all_ = [[sum((a - b) ** 2 for a, b in zip(r, s)) for s in y.tolist()] for r in x.tolist()]
    assert apart.tolist() == [min(r) for r in all_] and best.tolist() == [r.index(min(r)) for r in all_]


def test_limbs_of_all_signs():
    for bits in (3, 24):
        values = np.array([[0, 1, -1, 7, -8, 8, -9, 2**40, -(2**40), 2**40 - 1]])
        parts = vector_codes.limbs(values, bits)
        assert sum(p.astype(object) * 2 ** (bits * i) for i, p in enumerate(parts)).tolist() == values.tolist()
        assert all(np.abs(p).max() <= 2**bits for p in parts)


def expected(rows, parts=8, entries=16, rounds=6):
    """By the definition, in Python's whole numbers."""
    kept = [(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][k] for r in first] for k in range(parts)]

    def assign():
        apart = [[[sum((a - b) ** 2 for a, b in zip(row[k], e)) for e in books[k]] for k in range(parts)] for row in cut]
        return [[d.index(min(d)) for d in row] for row in apart], [sum(min(d) for d in row) for row in apart]

    for _ in range(rounds):
        codes, _ = assign()
        for k in range(parts):
            for e in range(len(first)):
                own = [row[k] for row, code in zip(cut, codes) if code[k] == e]
                if own:
                    books[k][e] = [sum(column) // len(own) for column in zip(*own)]
    codes, errors = assign()
    per_label = {}
    for (_, label, _), error in zip(kept, errors):
        per_label[label] = per_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for k in books for e in k for x in e).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), e, per_label[label]) for (i, label, _), c, e in zip(kept, codes, errors)), key=str), digest


def run(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("codes", "error", "whole", "vector", "part", "entry", "n", "label_error", "_label")})
    codes, books = compress(table, ["vec_id", "label"])
    got = with_label_error(codes, "label").select("vec_id", F.lower(F.hex("codes")), "error", "label_error").collect()
    return sorted((tuple(r) for r in got), key=str), books.sha256()


def test_like_the_definition(spark):
    draw = rng(4)
    rows = [(int(i), int(draw.integers(0, 4)) or None, (draw.normal(size=24) * 10.0 ** draw.integers(-4, 3)).tolist()) for i in draw.permutation(200)]
    rows += [(500, 1, None), (501, 1, [None] * 24), (502, 1, [float("nan")] * 24), (503, 1, [float("inf")] + [0.0] * 23), (504, None, [0.0] * 24)]
    rows += [rows[0]] * 3 + [(None, 2, rows[1][2]), (None, None, None), (1, 3, rows[2][2]), (505, 2, [-0.00001] * 24), (506, 2, [20000.0] * 24)] + [(600 + i, 7, rows[3][2]) for i in range(40)]
    assert run(spark, rows) == expected(rows)


def test_few_and_no_vectors(spark):
    rows = [(3, 1, [0.5] * 8), (1, None, [0.25, -1.0] * 4)]
    got, digest = run(spark, rows)
    assert (got, digest) == expected(rows) and {r[2] for r in got} == {0}
    assert run(spark, [])[0] == [] and run(spark, [(1, 1, None)])[0] == []
    assert run(spark, [(1, 1, []), (2, 1, [])])[0] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    for bad in ([(1, 1, [1.0] * 9)], [(1, 1, [1.0] * 8), (2, 1, [1.0] * 16)], [(1, 1, [1e30] * 8)], [(1, 1, [1e9] * 8)]):
        with pytest.raises(Exception, match="components"):
            run(spark, bad)


def test_decoded_vectors_are_near(spark):
    draw = rng(9)
    base = draw.normal(size=(12, 16))
    rows = [(i, 0, (base[i % 12] + draw.normal(size=16) * 0.01).tolist()) for i in range(120)]
    codes, books = compress(spark.createDataFrame(rows, SCHEMA), ["vec_id"])
    for r in codes.collect():
        assert ((books.decoded(r.codes) - rows[r.vec_id][2]) ** 2).sum() <= r.error / 4096**2 + 0.001 and r.error / 4096**2 < 3

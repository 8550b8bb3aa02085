import numpy as np
import pytest
from helpers import CLASHING, components, rng
from pyspark.sql import functions as F

from rolescope.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>"


def clusters():
    """Random vectors; clusters of near ones, also around the threshold; a group of copies."""
    draw = rng()
    base = draw.normal(size=(40, 24))
    parts = [base]
    for i in range(12):
        parts.append(base[i] + draw.normal(size=(15, 24)) * draw.uniform(0.02, 0.6))
    parts.append(np.repeat(base[20:21], 30, 0))
    parts.append(base[21:22] * 3.5)
    x = np.concatenate(parts).astype(np.float32)
    return x[draw.permutation(len(x))]


def expected(x, threshold=0.9):
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1))[:, None]
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    return near.sum(1), components(len(x), np.argwhere(np.triu(near)).tolist())


def test_like_brute_force(spark):
    x = clusters()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).withColumns({n: F.lit(v) for n, v in CLASHING.items()})
    got = embeddings.near_duplicates(rows).orderBy("vec_id").collect()
    links, label = expected(x)
    assert sum(r.n_links for r in got) >= 0.99 * links.sum() and all(r.n_links <= n for r, n in zip(got, links))
    assert np.mean([r.component_id == c for r, c in zip(got, label)]) > 0.98
    assert all(r.kept == (r.component_id == r.vec_id) for r in got) and len(got) == len(x)


def test_hot_group_in_blocks(spark):
    """One group larger than a block: pairs are counted once each across its block pairs."""
    draw = rng(8)
    x = (draw.normal(size=16) + draw.normal(size=(2 * embeddings.BLOCK + 100, 16)) * 0.02).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = embeddings.near_duplicates(rows).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {len(x) - 1}


def test_invalid_vectors_and_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]),
            (9, [1.0, 2.0]), (10, [1.0, 2.0]), (None, v), (None, None), (11, [1e30, 2e30, 3e30]), (12, [1e-30, 2e-30, 3e-30])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    near = {i: (3, 1, i == 1) for i in (1, 2, 11, 12)}
    alone = {i: (0, i, True) for i in range(3, 9)}
    assert got == near | alone | {9: (1, 9, True), 10: (1, 9, False), None: (0, None, True)}
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(3, None)], SCHEMA)).first().kept


def test_hadamard_keeps_lengths_and_hashes_grow():
    x = rng().normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)
    assert [embeddings.hashes_for(n, 64) for n in (0, 30, 3000, 10**5, 10**9)] == [1, 1, 2, 3, 5]


def pairs_at(cosine, n, dims, seed=21):
    """Vectors i and n + i have this cosine."""
    a, b = rng(seed).normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]])


@pytest.mark.parametrize("dims, hashes", [(64, 3), (64, 4), (64, 5), (16, 5), (3, 6), (2, 8)])
def test_recall_at_the_threshold_with_any_number_of_hashes(dims, hashes):
    n = 2000
    tables = embeddings.tables_for(dims, 0.9, hashes)
    found = embeddings.cells(pairs_at(0.9, n, dims), tables, hashes, embeddings.PROBES)
    one, other = found[:n], found[n:]
    assert ((one[:, :, :1] == other) | (other[:, :, :1] == one)).any((1, 2)).mean() >= embeddings.RECALL - 0.002


@pytest.mark.parametrize("hashes", [3, 4, 5])
def test_large_tables_like_brute_force(spark, monkeypatch, hashes):
    """As many hashes per table as many more vectors would get."""
    monkeypatch.setattr(embeddings, "hashes_for", lambda *a, **b: hashes)
    x = pairs_at(0.901, 600, 64).astype(np.float32)
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)).orderBy("vec_id").collect()
    links, label = expected(x)
    assert links.sum() >= 1200 and sum(r.n_links for r in got) >= 0.995 * links.sum() and all(r.n_links <= n for r, n in zip(got, links))
    assert np.mean([r.component_id == c for r, c in zip(got, label)]) >= 0.997


def test_layout_fits_and_refuses_thresholds_that_are_too_low():
    for vectors, dims in ((300, 64), (10**5, 64), (10**8, 64), (10**9, 8)):
        tables, hashes = embeddings.layout(vectors, dims)
        assert embeddings.TABLES <= tables <= embeddings.MOST_TABLES and tables * (2 * dims) ** hashes < 1 << 62
    with pytest.raises(ValueError):
        embeddings.layout(10**5, 64, threshold=-0.5)

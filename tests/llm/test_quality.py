import numpy as np
from helpers import CLASHING, documents
from pyspark.sql import functions as F

from rolescope.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = quality.judged(docs, labels).join(labels, "doc_id").where(quality.fold() == 0).toPandas()
    bad = scored.quality == 0
    assert len(scored) > 600 and ((scored.predicted == 1) == (scored.quality == 1)).mean() > 0.98
    assert (scored[bad].predicted == 0).mean() > 0.9 and (scored[~bad].predicted == 1).mean() > 0.99
    assert scored[bad].score.mean() < 0.1 < 0.9 < scored[~bad].score.mean()


def test_labels_outside_the_sample_change_nothing(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"junk ### %%% {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = documents(spark, rows)
    weights = quality.fit(docs, labels, bits=12, max_labelled=40)
    first = [r.doc_id for r in labels.withColumn("o", F.xxhash64("doc_id")).orderBy("o").limit(40).collect()]
    others = labels.withColumn("quality", F.when(F.col("doc_id").isin(first), F.col("quality")).otherwise(1 - F.col("quality")))
    assert (quality.fit(docs, others, bits=12, max_labelled=40) == weights).all() and (weights != 0).any()
    got = quality.score(docs, weights, bits=12).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_nulls_repeats_long_empty_and_clashes(spark):
    rows = [(1, "fine text"), (1, "fine text"), (2, None), (3, ""), (None, "x " * 100_000), (4, "$$$ %%%"), (5, " ")]
    docs = documents(spark, rows, **CLASHING)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    weights = quality.fit(docs, labels, bits=10)
    scored = quality.score(docs, weights, bits=10)
    got = scored.collect()
    assert len(got) == len(rows) and set(scored.columns) == {"doc_id", "text", *CLASHING} and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    none = quality.fit(docs, labels.limit(0), bits=10)
    assert not none.any() and {(r.score, r.predicted) for r in quality.score(docs, none, bits=10).collect()} == {(0.5, 1)}
    assert quality.score(documents(spark, []), none, bits=10).count() == 0


def test_updates_follow_the_regularised_leader():
    """Against the rule written out for one weight at a time."""
    draw = np.random.default_rng(3)
    rows = [(np.sort(draw.choice(9, 4, replace=False)), draw.normal(size=4), float(draw.integers(0, 2))) for _ in range(40)]
    s = quality.Ftrl(passes=2)
    z, n, w = [0.0] * 9, [0.0] * 9, [0.0] * 9
    for _ in range(2):
        for slots, values, y in rows:
            for i in slots:
                sign = 1 if z[i] > 0 else -1
                w[i] = 0.0 if abs(z[i]) <= s.l1 else -(z[i] - sign * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(slots, values))))
            for i, v in zip(slots, values):
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    final = [0.0 if abs(a) <= s.l1 else -(a - np.sign(a) * s.l1) / ((s.beta + b**0.5) / s.alpha + s.l2) for a, b in zip(z, n)]
    assert np.allclose(quality.train(rows, 9, s), final)

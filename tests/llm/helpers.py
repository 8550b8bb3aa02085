"""Fixtures that several tests here share."""

import numpy as np

DOCS = "doc_id long, text string"
# Columns whose names the operators use for their own results or inside.
CLASHING = {
    c: "mine" for c in (
        "doc", "row", "id", "key", "kept", "kept_text", "n_lines", "n_dropped", "score", "predicted", "component_id", "fingerprint", "fp",
        "ids", "decoded", "judged", "host", "n_links", "vec", "cell", "drop", "h", "node", "number", "label", "order", "word", "training", "url_")
}


def documents(spark, rows, **extra):
    """A documents table from (doc_id, text) pairs, with further columns of one value."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(v) for n, v in extra.items()}) if extra else spark.createDataFrame(rows, DOCS)


def components(n, links):
    """Smallest reachable member per node, by plain search."""
    near = [[] for _ in range(n)]
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    label = [None] * n
    for start in range(n):
        stack = [start]
        while stack:
            node = stack.pop()
            if label[node] is None:
                label[node] = start
                stack += near[node]
    return label


def rng(seed=5):
    return np.random.default_rng(seed)

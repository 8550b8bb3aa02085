import pandas as pd
from pyspark.sql import functions as F


def test_python_batches_are_small(spark):
    """A Python worker holds a few MB of texts at a time, whatever the input."""

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000 + F.col("id").cast("int")).alias("t")).select(together("t").alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 16_000_000

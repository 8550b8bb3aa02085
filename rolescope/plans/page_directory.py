"""A stored order of rows with a directory of its files, for pages anywhere in it.

Layout below ``path``: ``rows`` holds the rows, range-partitioned and sorted, in files of a bounded number of rows; ``directory`` one row per file with the
number of rows before it, its own rows and its first key. A page reads the directory's few rows that meet it and then only those files.
The directory is made from the files that were written, so it is right also if tasks were run again. The order is that of a snapshot: new rows need a new
directory beside the old one, and readers that go on paging keep theirs.

Keys are in ascending order, NULLs last, and must tell all rows apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _after(columns: list[Column], values: list[Any], inclusive: bool = False) -> Column:
    """Whether the columns come after the values in the order; ``inclusive`` also takes what is equal to them."""
    tests, equal = [], F.lit(True)
    for column, value in zip(columns, values, strict=True):
        if value is not None:
            tests.append(equal & (column.isNull() | F.coalesce(column > F.lit(value), F.lit(False))))
        equal = equal & column.eqNullSafe(F.lit(value))
    return reduce(or_, [*tests, equal] if inclusive else tests, F.lit(False))


@dataclass(frozen=True)
class PageDirectory:
    spark: SparkSession
    path: str
    order: tuple[str, ...]
    schema: T.StructType
    directory: DataFrame

    @classmethod
    def create(cls, rows: DataFrame, path: str, order: tuple[str, ...], rows_per_file: int = 100_000, partitions: int | None = None) -> PageDirectory:
        """Write ``rows`` in the given order. ``rows_per_file`` bounds what a page must sort; ``partitions`` are the tasks that write, by
        default the session's shuffle partitions. A key that a third of the rows share at its front is split by what follows."""
        path, keys = path.rstrip("/"), [F.asc_nulls_last(c) for c in order]
        spread = rows.repartitionByRange(*([partitions] if partitions else []), *keys)
        spread.sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
        written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
        first = F.min(F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]))
        files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), first.alias("first"))
        # One row per file: the only rows that pass through one task.
        before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        placed = files.select("file", "n", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        placed.select("file", "n", "start", *[F.col(f"first.{c}").alias(f"first_{c}") for c in order]).coalesce(1).write.parquet(f"{path}/directory")
        return cls.open(rows.sparkSession, path, order, rows.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, order: tuple[str, ...], schema: T.StructType) -> PageDirectory:
        """What ``create`` has written."""
        path = path.rstrip("/")
        firsts = [T.StructField(f"first_{c}", schema[c].dataType) for c in order]
        listed = T.StructType([T.StructField("file", T.StringType()), T.StructField("n", T.LongType()), T.StructField("start", T.LongType()), *firsts])
        return cls(spark, path, tuple(order), schema, spark.read.schema(listed).parquet(f"{path}/directory"))

    def total(self) -> int:
        return self.directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _open(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f in files])

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*[F.asc_nulls_last(c) for c in self.order])

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order. Opens the files they lie in: at most two if ``limit`` is no more than a file's rows,
        but for files that a small range has left short."""
        met = self.directory.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).orderBy("start").select("file", "start").collect()
        skipped = offset - met[0].start if met else 0
        return self._sorted(self._open([r.file for r in met])).offset(skipped).limit(limit)

    def after(self, last: tuple, limit: int) -> DataFrame:
        """The ``limit`` rows that follow the key ``last``, which need not exist (any more): paging that goes on where it stopped."""
        rows = self._open(self._from(list(last), limit)).where(_after([F.col(c) for c in self.order], list(last)))
        return self._sorted(rows).limit(limit)

    def _from(self, key: list, limit: int) -> list[str]:
        """The file that a key lies in, or the first, and the following files that surely hold ``limit`` more rows."""
        firsts = [F.col(f"first_{c}") for c in self.order]
        begun = self.directory.where(~_after(firsts, key))
        home = begun.orderBy(F.desc("start")).select("file", "start", "n").limit(1).collect()
        end = home[0].start + home[0].n if home else 0
        # Files that begin before the limit is met.
        more = self.directory.where((F.col("start") >= end) & (F.col("start") < end + limit)).orderBy("start").select("file").collect()
        return [r.file for r in [*home, *more]]

    def _rank(self, values: list, inclusive: bool) -> int:
        """How many rows come before the first row whose leading columns come after the values, or, ``inclusive``, are not before them."""
        leading = list(self.order[: len(values)])
        past = _after([F.col(f"first_{c}") for c in leading], values, inclusive)
        home = self.directory.where(~past).orderBy(F.desc("start")).select("file", "start").limit(1).collect()
        if not home:
            return 0
        inside = self._open([home[0].file]).where(~_after([F.col(c) for c in leading], values, inclusive)).count()
        return home[0].start + inside

    def span(self, *leading: Any) -> tuple[int, int]:
        """First place of the rows whose leading key columns have these values, and the place after the last. Counts in at most two files;
        the rows between are known from the directory."""
        return self._rank(list(leading), True), self._rank(list(leading), False)

    def page_within(self, leading: tuple, offset: int, limit: int) -> DataFrame:
        """A page among the rows of ``span(*leading)``, with their number as ``total``."""
        first, past = self.span(*leading)
        return self.page(first + offset, max(0, min(limit, past - first - offset))).withColumn("total", F.lit(past - first).cast("long"))

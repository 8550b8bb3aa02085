"""Substring search by an inverted table of three-character grams, beside a keyed table of postings.

One row per (gram, span of ids) lists the postings whose texts hold the gram, with the table's bucket of each. A frequent gram so spreads over
as many rows as there are spans, and no list outgrows a span. A search reads the rows of its needle's grams only, intersects
the rarest of them, opens the buckets that the remaining postings lie in, and verifies these postings by ``contains_text``.

Postings that change are added again: what the index says about their old texts is settled by the verification.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import needle_grams, text_grams
from ..functions.predicates import job_filters
from ..operators.keyed_table import KeyedTable
from ..session import stored
from .search import search_jobs

SPAN = 1 << 18
RAREST = 3
_ROWS = "gram string, span long, n long, postings array<struct<id: long, bucket: int>>, part int"


@dataclass(frozen=True)
class TextIndex:
    """The index at ``path`` of the texts in ``columns`` of a table keyed in any way, whose rows have a number ``id``."""

    path: str
    columns: tuple[str, ...] = ("title", "raw_description")
    parts: int = 64

    @classmethod
    def create(cls, table: KeyedTable, path: str, columns: tuple[str, ...] = ("title", "raw_description"), parts: int = 64) -> TextIndex:
        """Index all rows of the table. ``parts`` are the folders that grams are hashed to; a search opens one per gram it reads."""
        index = cls(path.rstrip("/"), tuple(columns), parts)
        index._write(table, table.read(), "errorifexists")
        return index

    def add(self, table: KeyedTable, changed: DataFrame) -> None:
        """Index new rows, and rows whose texts have changed, in files of their own. Work grows with these rows only."""
        self._write(table, changed, "append")

    def _write(self, table: KeyedTable, rows: DataFrame, mode: str) -> None:
        # Until a list is whole, a posting is one number in it: its place in the span, then its bucket.
        packed = F.call_function("shiftleft", F.col("id") % SPAN, F.lit(32)) + F.col("bucket")
        cut = table.bucketed(rows).select("id", "bucket", F.explode(text_grams(self.columns)).alias("gram"))
        listed = cut.groupBy("gram", F.expr(f"id div {SPAN}").alias("span")).agg(
            F.count("*").alias("n"), F.array_sort(F.collect_list(packed)).alias("_packed"))
        listed = listed.select("gram", "span", "n", F.transform("_packed", lambda p: F.struct(
            (F.shiftright(p, 32) + F.col("span") * SPAN).alias("id"), p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("bucket"))).alias("postings"))
        listed = listed.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int"))
        # Sorted by gram, so that a search skips row groups inside the files, too.
        listed.hint("rebalance", F.col("part")).sortWithinPartitions("part", "gram", "span").write.mode(mode).partitionBy("part").parquet(self.path)

    def rows(self, table: KeyedTable, wanted: list[str]) -> DataFrame:
        """The lists of some grams; folders of other grams are pruned."""
        spark = table.spark
        parts = [r.part for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(
            F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int").alias("part")).distinct().collect()]
        return spark.read.schema(_ROWS).parquet(self.path).where(F.col("part").isin(parts) & F.col("gram").isin(wanted))

    def grams(self, table: KeyedTable, needle: str) -> list[str]:
        """What a posting must hold to contain the needle; empty if the needle is too short between its wildcards."""
        return table.spark.range(1).select(needle_grams(F.lit(needle))).first()[0]

    def candidates(self, table: KeyedTable, wanted: list[str]) -> DataFrame:
        """``id, bucket`` of the postings that hold the rarest of the wanted grams."""
        lists = self.rows(table, wanted)
        held = {r.gram: r.n for r in lists.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(held) < len(wanted):
            return lists.select(F.inline("postings")).limit(0)
        rarest = sorted(wanted, key=lambda g: (held[g], g))[:RAREST]
        numbers = F.array(*[F.lit(g) for g in rarest])
        met = self.rows(table, rarest).select(F.array_position(numbers, F.col("gram")).cast("int").alias("number"), F.inline("postings"))
        # A posting that was added again is listed more than once; bits count each gram once.
        bits = met.groupBy("id", "bucket").agg(F.bit_or(F.expr("shiftleft(1, number - 1)")).alias("bits"))
        return bits.where(F.col("bits") == (1 << len(rarest)) - 1).select("id", "bucket")


def search(table: KeyedTable, index: TextIndex, query: str, **filters) -> DataFrame:
    """The postings that contain the query in the index's columns and pass the other filters of ``job_filters``.

    A query whose pieces between wildcards are all under three characters cannot be looked up; it goes through ``scan``.
    """
    wanted = index.grams(table, query)
    if not wanted:
        return scan(table, index, query, **filters)
    found = stored(index.candidates(table, wanted), "candidates")
    buckets = [r.bucket for r in found.select("bucket").distinct().collect()]
    rows = table.scan(buckets).join(found.select("id"), "id", "left_semi").select(*table.schema.names)
    return rows.where(job_filters(query=query, query_columns=index.columns, **filters))


def scan(table: KeyedTable, index: TextIndex, query: str, **filters) -> DataFrame:
    """The same by reading every posting."""
    return search_jobs(table.read(), query=query, query_columns=index.columns, **filters)

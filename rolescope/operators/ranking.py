"""Exact row numbers without putting a group, or the whole table, into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BATCH_SIZE
from ..session import stored


def row_numbers(df: DataFrame, groups: list[str], order: list[str], name: str = "row_number") -> DataFrame:
    """Number the rows of each group from 1 in the given order; no groups means one numbering for all.

    A window would sort a whole group in one task. Here rows are range-partitioned on group and order,
    so a hot group spreads over many partitions; each row's place in its own partition comes
    with the sort, and only the row counts per (partition, group) are added up across partitions.
    The placed rows are written to a table in the shared folder: counting and numbering must see the same
    partition borders, also after an executor is lost, and counting reads the key columns only.
    ``order`` must tell all rows of a group apart. Only the key columns are sorted and written, which happens at once; other columns are
    joined back by the keys, of which no two rows share one.
    """
    keys = list(dict.fromkeys([*groups, *order]))
    sorted_rows = df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    # One row per (partition, group): at most partitions + groups rows, whatever the data size.
    counts = placed.groupBy("_part", *groups).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        *[F.col(g).alias(f"_{g}") for g in groups],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    ).withColumnRenamed("_part", "_offset_part")
    same = [F.col("_part") == F.col("_offset_part")] + [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    numbered = placed.join(offsets, reduce(and_, same)).select(*keys, (F.col("_place") + F.col("_shift")).alias(name))
    if set(keys) == set(df.columns):
        return numbered.select(*df.columns, name)
    known = numbered.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    return df.join(known, reduce(and_, [df[k].eqNullSafe(known[f"_{k}"]) for k in keys])).select(*df.columns, name)


def batch_numbers(postings: DataFrame, size: int = BATCH_SIZE, position: str | None = None) -> DataFrame:
    """Cut each company's postings into batches of ``size``.

    With a ``position`` column (as the file scan gives) the number is plain arithmetic on the row.
    Without one, postings are numbered by ``job_id``.
    """
    if position is not None:
        return postings.withColumn("batch_id", F.floor(F.col(position) / size).cast("int"))
    numbered = row_numbers(postings, ["company", "ats"], ["job_id"], "_number")
    return numbered.withColumn("batch_id", F.floor((F.col("_number") - 1) / size).cast("int")).drop("_number")


def number_new(source: DataFrame, target: DataFrame, keys: list[str], highest: Column, asked: DataFrame | None = None) -> DataFrame:
    """``source``, one row per key, with an ``id`` for the postings that ``target`` lacks: numbered on from ``highest`` by system, company
    and posting. Only the new keys are sorted and written; of the target, only the keys are read. ``asked`` are the source's keys, if they are had for less."""
    order = ["ats", "company", "job_id"]
    numbered = new_numbers(source if asked is None else asked, target, keys).select(*order, "_number")
    return source.drop("id").join(numbered, order, "left").withColumn("id", (F.col("_number") + highest).cast("bigint")).drop("_number")


def new_numbers(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``source`` that ``target`` lacks, with a ``_number`` from 1 by system, company and posting."""
    order = ["ats", "company", "job_id"]
    new = source.select(*keys).join(target.select(*keys), keys, "left_anti").select(*order)
    return row_numbers(new, [], order, "_number")


def deep_page(df: DataFrame, order: list[str], offset: int | Column, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order, in that order, for pages too deep for a top-k heap.

    Only the order columns are numbered; the page's ``limit`` keys then fetch their rows.
    """
    number = F.col("_number")
    wanted = row_numbers(df.select(*order), [], order, "_number").where((number > offset) & (number <= offset + F.lit(limit)))
    keys = wanted.select(*[F.col(k).alias(f"_{k}") for k in order])
    rows = df.join(keys, reduce(and_, [df[k].eqNullSafe(keys[f"_{k}"]) for k in order]), "left_semi")
    return rows.orderBy(*order)

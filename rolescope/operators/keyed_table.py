"""A table of one row per key, cut into hash buckets, whose merges read and write only what incoming keys touch.

Layout below ``path``: ``data/v=<version>/bucket=<bucket>`` is a part, what a version wrote of a bucket; ``manifest/version=<version>`` has one row per part
that is in use: its bucket and version, its rows and its highest id. A merge compares the incoming keys with those of their buckets. It writes a part of its
own to each such bucket, and then the manifest that takes them up. The part takes over the rows of the bucket's parts that hold an incoming key, and of those
under ``SLICE`` rows, so that a bucket has few parts; the other parts and buckets stay where they are. Readers follow the newest manifest, so they never see half
a merge, and nothing that is read is overwritten. What a failed merge has left is written over by the next one. One writer at a time.

Keys are hashed, so buckets are even however many rows a company has. Of a table, only the manifest comes to the driver: one row per part.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEY
from ..session import stored
from .ranking import row_numbers
from .upsert import PARSED_COLUMNS, SCRAPED_COLUMNS, dedupe_at_rest, dedupe_postings, latest_extractions

# Rows that one task of a merge sorts and writes.
SLICE = 100_000
# Up to so many buckets, the tasks that make a new table write a file each for every bucket; with more, the files would be small, and rows are sent to their bucket first.
FEW_BUCKETS = 32
_MANIFEST = "bucket int, v long, n_rows long, top_id long, marks map<string, long>, keys array<string>, buckets int, json string"


@dataclass(frozen=True)
class KeyedTable:
    """A version of a table. Merges return the next version; this one stays readable until ``vacuum``.

    ``parts`` tells the rows and the highest id of each (bucket, version) in use. ``marks`` is the last batch that each stream has merged.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    version: int = -1
    parts: dict[tuple[int, int], tuple[int, int | None]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    @property
    def places(self) -> dict[int, tuple[int, int, int | None]]:
        """Per bucket, the version that wrote to it last, its rows and its highest id."""
        found: dict[int, tuple[int, int, int | None]] = {}
        for (b, v), (n, top) in self.parts.items():
            last, rows, highest = found.get(b, (v, 0, None))
            found[b] = (max(last, v), rows + n, max((t for t in (highest, top) if t is not None), default=None))
        return found

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Iterable[str] = KEY, buckets: int = 256) -> KeyedTable:
        """Write ``rows``, which hold each key once, as the first version. A bucket should hold some 100 MB at the size the table will have."""
        empty = cls(rows.sparkSession, path.rstrip("/"), rows.schema, tuple(keys), buckets)
        return empty._write(empty.bucketed(rows), set(), {}, gathered=buckets <= FEW_BUCKETS)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        """The newest version of a table."""
        path = path.rstrip("/")
        newest = spark.read.parquet(f"{path}/manifest").agg(F.max("version").alias("version")).first().version
        return cls._at(spark, path, int(newest))

    @classmethod
    def _at(cls, spark: SparkSession, path: str, version: int) -> KeyedTable:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()
        head = rows[0]
        parts = {(r.bucket, r.v): (r.n_rows, r.top_id) for r in rows if r.bucket is not None}
        return cls(spark, path, T.StructType.fromJson(json.loads(head.json)), tuple(head["keys"]), head.buckets, version, parts, dict(head.marks))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self._bucket())

    def scan(self, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of the given buckets, or of all, with their bucket; the folders of other buckets and versions are not even listed."""
        wanted = None if only is None else set(only)
        return self._scan(p for p in self.parts if wanted is None or p[0] in wanted).drop("v")

    def _scan(self, parts: Iterable[tuple[int, int]]) -> DataFrame:
        """Rows of the given parts, with their bucket and version."""
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("v", T.LongType())])
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(parts)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self) -> DataFrame:
        return self.scan().drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are opened."""
        asked = self.bucketed(keys.select(*self.keys).distinct())
        found = [r.bucket for r in asked.select("bucket").distinct().collect()]
        return self.scan(found).join(asked, ["bucket", *self.keys], "left_semi").select(*self.schema.names)

    @property
    def rows(self) -> int:
        return sum(n for n, _ in self.parts.values())

    def merge(self, source: DataFrame, replaced: list[str], inserted: tuple[str, ...] = (), numbered: bool = False,
              mark: tuple[str, int] | None = None, at_rest: bool = False) -> KeyedTable:
        """The next version, with ``source``, one row per key, merged in as by ``upsert``. If ``numbered``, new keys get ids, numbered
        on from the highest there is. ``mark`` names the stream and batch that the rows come from: a batch that was merged before is skipped.
        ``at_rest`` tells that the source only reads files that stay as they are: of it, no more than the keys is stored before the merge."""
        if mark and self.marks.get(mark[0], -1) >= mark[1]:
            return self
        taken = [c for c in self.schema.names if c in (*self.keys, *replaced, *inserted)]
        incoming = self.bucketed(source.select(*taken))
        asked = stored(incoming.select("bucket", *self.keys) if at_rest else incoming, "incoming")
        incoming, asked = incoming if at_rest else asked, asked.select("bucket", *self.keys)
        arrived = {r.bucket: r["count"] for r in asked.groupBy("bucket").count().collect()}
        # Where the incoming keys are: only keys are compared, and the parts that hold none of them need not be sent or written.
        held = self._scan(p for p in self.parts if p[0] in arrived).select("bucket", *self.keys, "v")
        known = stored(held.join(asked, ["bucket", *self.keys]), "known")
        taken_over = {(r.bucket, r.v) for r in known.select("bucket", "v").distinct().collect()}
        taken_over |= {p for p, (n, _) in self.parts.items() if p[0] in arrived and n < SLICE}
        numbers = None
        if numbered:
            top = max((t for _, t in self.parts.values() if t is not None), default=0)
            order = ["ats", "company", "job_id"]
            new = row_numbers(asked.join(known, ["bucket", *self.keys], "left_anti").select(*order), [], order, "_number")
            numbers = self.bucketed(new).withColumn("_number", F.col("_number") + F.lit(top))
        for b, n in ((b, self.parts[b, v][0]) for b, v in taken_over):
            arrived[b] += n
        merged = self._merged(self._scan(taken_over).drop("v"), incoming, numbers, arrived, replaced, (*inserted, "id") if numbered else inserted)
        marks = self.marks | (dict([mark]) if mark else {})
        return self._write(merged, taken_over, marks, gathered=True)

    def _merged(self, old: DataFrame, incoming: DataFrame, numbers: DataFrame | None, held: dict[int, int], replaced: list[str],
                inserted: tuple[str, ...]) -> DataFrame:
        """What ``upsert`` gives for the ``old`` rows of the touched buckets, each bucket's rows in the tasks that write them. ``held`` is how many rows meet in a bucket.

        Stored rows, incoming rows and the numbers of new keys are sent once, to a slice of their bucket; equal keys meet there, and the
        slices are written as they are. A bucket has so many slices that one holds about ``SLICE`` rows, by a hash of the key that is even where a bucket ends.
        """
        slices = max(1, -(-max(held.values(), default=0) // SLICE))
        order = F.create_map(*[F.lit(x) for i, b in enumerate(sorted(held)) for x in (b, i * slices)]) if held else F.create_map(F.lit(0), F.lit(0))
        slice_ = order[F.col("bucket")] + F.pmod(F.xxhash64(F.lit("slice"), *self.keys), F.lit(slices)).cast("int")
        given = [c for c in incoming.columns if c not in (*self.keys, "bucket")]
        rows = old.withColumn("_side", F.lit(0)).unionByName(
            incoming.select("bucket", *self.keys, F.struct(F.lit(True).alias("_is"), *given).alias("_new"), F.lit(1).alias("_side")), allowMissingColumns=True)
        if numbers is not None:
            rows = rows.unionByName(numbers.select("bucket", *self.keys, "_number", F.lit(2).alias("_side")), allowMissingColumns=True)
        else:
            rows = rows.withColumn("_number", F.lit(None).cast("long"))
        # A key with a NULL in it equals no other, so each side's stay among themselves.
        lone = F.when(reduce(or_, [F.col(k).isNull() for k in self.keys]), F.col("_side"))
        spread = rows.withColumns({"_slice": slice_, "_lone": lone}).repartitionById(max(1, len(held) * slices), "_slice")
        same = Window.partitionBy("bucket", "_slice", *self.keys, "_lone")
        met = spread.withColumns({
            "_given": F.first("_new", ignorenulls=True).over(same), "_id": F.first("_number", ignorenulls=True).over(same),
            "_known": F.min("_side").over(same) == 0,
        }).where((F.col("_side") == 0) | (F.col("_side") == 1) & ~F.col("_known"))
        stays = F.col("_side") == 0

        def merged(name: str) -> Column:
            if name in self.keys:
                return F.col(name)
            new = F.col("_id") if name == "id" and numbers is not None else F.col(f"_given.{name}") if name in given else None
            if name in replaced:
                return F.when(F.col("_given._is"), new).otherwise(F.col(name))
            if name in inserted:
                return F.when(stays, F.col(name)).otherwise(new)
            return F.col(name)

        return met.select(*[merged(c).alias(c) for c in self.schema.names], "bucket")

    def remove(self, keys: DataFrame) -> KeyedTable:
        """The next version, without the rows of the given keys."""
        gone = stored(self.bucketed(keys.select(*self.keys).distinct()), "gone")
        touched = self._touched(gone)
        kept = self.scan(touched).join(gone, ["bucket", *self.keys], "left_anti").select(*self.schema.names, "bucket")
        return self._write(kept, {p for p in self.parts if p[0] in touched}, self.marks)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r.bucket for r in rows.select("bucket").distinct().collect()}

    def _write(self, rows: DataFrame, taken_over: set[tuple[int, int]], marks: dict[str, int], gathered: bool = False) -> KeyedTable:
        """The next version, with ``rows`` instead of the parts they take over. ``gathered`` tells that no task holds rows of many buckets, so that they need not be sent once more."""
        version = self.version + 1
        (rows if gathered else rows.hint("rebalance", F.col("bucket"))).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(
            f"{self.path}/data/v={version}")
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        top = F.max("id") if "id" in self.schema.names else F.lit(None).cast("long")
        written = self.spark.read.schema(schema).parquet(f"{self.path}/data/v={version}").groupBy("bucket").agg(
            F.count("*").alias("n_rows"), top.alias("top_id")).collect()
        parts = {p: n for p, n in self.parts.items() if p not in taken_over} | {(r.bucket, version): (r.n_rows, r.top_id) for r in written}
        following = replace(self, version=version, parts=parts, marks=marks)
        following._publish()
        return following

    def _publish(self) -> None:
        """Write the manifest; from then on the version is what readers find."""
        shared = (self.marks, list(self.keys), self.buckets, self.schema.json())
        rows = [(*part, *counts, *shared) for part, counts in self.parts.items()] or [(None, None, None, None, *shared)]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={self.version}")

    def vacuum(self, keep: int = 2) -> int:
        """Remove the parts that none of the last ``keep`` versions reads, and the older manifests. Returns the number of removed folders."""
        first = max(0, self.version - keep + 1)
        kept = {(v, b) for version in range(first, self.version + 1) for b, v in self._at(self.spark, self.path, version).parts}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system, removed = root.getFileSystem(conf), 0
        for pattern, used in ((f"{self.path}/data/v=*/bucket=*", lambda a, b: (int(a), int(b)) in kept),
                              (f"{self.path}/manifest/version=*", lambda _, v: int(v) >= first)):
            for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)):
                place = status.getPath()
                if not used(place.getParent().getName().partition("=")[2], place.getName().partition("=")[2]):
                    system.delete(place, True)
                    removed += 1
        return removed


def merge_scraped(table: KeyedTable, postings: DataFrame, mark: tuple[str, int] | None = None, at_rest: bool = False) -> KeyedTable:
    """Merge scraped postings: a known posting keeps its id, its extracted fields and its first ``scraped_at``. ``at_rest`` tells that
    the postings only read files that stay as they are, so that reading them again costs less than sending them."""
    latest = dedupe_at_rest(postings) if at_rest else dedupe_postings(postings)
    return table.merge(latest, SCRAPED_COLUMNS, ("scraped_at",), True, mark, at_rest)


def merge_parsed(table: KeyedTable, extracted: DataFrame) -> KeyedTable:
    """Merge extracted postings: a known posting keeps its id and ``raw_description``; NULL replaces, too."""
    return table.merge(latest_extractions(extracted), PARSED_COLUMNS, ("scraped_at",), True)

import glob
import json
import os

import pytest
from test_upsert import POSTING, posting

from rolescope.operators.keyed_table import KeyedTable, merge_scraped
from rolescope.operators.upsert import upsert, upsert_scraped
from rolescope.streaming import landing

SMALL = "k string, a long, b string"


def rows_of(table):
    return sorted(map(str, table.read().collect()))


def test_a_small_load_reads_and_writes_its_buckets_only(spark, tmp_path):
    target = spark.range(20_000).selectExpr("concat('k', id) AS k", "id AS a", "concat('old ', id) AS b")
    table = KeyedTable.create(target, str(tmp_path / "t"), ["k"], buckets=200)
    assert len(table.places) == 200 and table.rows == 20_000
    load = spark.createDataFrame([("k17", 0, None), ("k18", 1, "y"), ("new", 2, "z")], SMALL)
    touched = {r.bucket for r in table.bucketed(load).select("bucket").collect()}
    after = table.merge(load, ["a", "b"])
    written = {int(os.path.basename(p)[7:]) for p in glob.glob(str(tmp_path / "t/data/v=1/bucket=*"))}
    assert written == touched and len(touched) <= 3
    assert {b for b, p in after.places.items() if p[0] == 1} == touched
    files = table.scan(touched).inputFiles()
    assert {int(os.path.basename(os.path.dirname(f))[7:]) for f in files} == touched
    assert rows_of(after) == sorted(map(str, upsert(target, load, ["k"], ["a", "b"]).collect()))
    assert rows_of(table) == sorted(map(str, target.collect()))  # the version before stays as it was
    assert len(after.lookup(load).inputFiles()) <= 3 and {r.k for r in after.lookup(load).collect()} == {"k17", "k18", "new"}


def test_many_merges_equal_one_table(spark, tmp_path, jobs_from):
    jobs = jobs_from(*[{"id": 10 + i, "job_id": str(i), "title": f"t{i}", "department": "HR"} for i in range(30)])
    table, plain = KeyedTable.create(jobs, str(tmp_path / "t"), buckets=7), jobs
    for load in range(4):
        source = spark.createDataFrame([posting(str(i), f"load {load}", load + 1) for i in range(load * 9, load * 9 + 12)], POSTING)
        table, plain = merge_scraped(table, source), upsert_scraped(plain, source)
        plain = spark.createDataFrame(plain.collect(), plain.schema)
    assert rows_of(KeyedTable.open(spark, str(tmp_path / "t"))) == sorted(map(str, plain.collect()))
    assert len({r.id for r in table.read().select("id").collect()}) == table.rows == plain.count()
    left = table.remove(jobs.where("id < 20").unionByName(jobs.where("id < 15")))
    assert rows_of(left) == sorted(map(str, plain.where("id >= 20").collect()))
    assert left.vacuum(keep=1) > 0 and rows_of(left) == rows_of(KeyedTable.open(spark, str(tmp_path / "t")))
    assert left.remove(plain).read().count() == 0


def test_empty_tables_nulls_and_hot_company(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], SMALL), str(tmp_path / "t"), ["k"], buckets=4)
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], SMALL), ["a"]).read().count() == 0
    again = KeyedTable.open(spark, str(tmp_path / "t")).merge(spark.createDataFrame([("x", None, None), ("y", 1, "b")], SMALL), ["a"], ("b",))
    more = again.merge(spark.createDataFrame([("x", 5, "kept out"), ("z", 6, "in")], SMALL), ["a"], ("b",))
    assert {tuple(r) for r in more.read().collect()} == {("x", 5, None), ("y", 1, "b"), ("z", 6, "in")}
    hot = spark.range(3000).selectExpr("CAST(id AS STRING) AS job_id", "IF(id % 3 = 0, 'hot', concat('c', id)) AS company", "'lever' AS ats", "id")
    spread = KeyedTable.create(hot, str(tmp_path / "h"), buckets=10)
    assert max(n for _, n, _ in spread.places.values()) < 2 * 300


def test_a_failed_merge_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark.createDataFrame([("x", 1, "a")], SMALL), str(tmp_path / "t"), ["k"], buckets=4)
    monkeypatch.setattr(KeyedTable, "_publish", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([("x", 2, "a"), ("y", 2, "a")], SMALL), ["a"])
    monkeypatch.undo()
    assert rows_of(KeyedTable.open(spark, str(tmp_path / "t"))) == rows_of(table)
    after = KeyedTable.open(spark, str(tmp_path / "t")).merge(spark.createDataFrame([("z", 3, "c")], SMALL), ["a", "b"])
    assert {tuple(r) for r in after.read().collect()} == {("x", 1, "a"), ("z", 3, "c")}


def test_stream_merges_each_batch_once(spark, tmp_path, jobs_from):
    folder, path, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "check")
    folder.mkdir()
    KeyedTable.create(jobs_from({"id": 1, "job_id": "1", "department": "HR"}), path, buckets=8)

    def arrive(name, title, ids):
        jobs = [{"id": i, "title": title, "location": "x", "url": "u", "description": "d"} for i in ids]
        (folder / name).write_text(json.dumps({"company": "acme", "slug": "acme", "ats": "lever", "scraped_at": "2026-01-01T00:00:00", "jobs": jobs}))

    stream = lambda: landing.read_landing(spark, str(folder), files_per_batch=1)
    arrive("a.json", "first", "12")
    landing.drain_into(stream(), path, check)
    arrive("b.json", "second", "23")
    landing.drain_into(stream(), path, check)
    landing.drain_into(stream(), path, check)
    table = KeyedTable.open(spark, path)
    assert {(r.job_id, r.title, r.department, r.id) for r in table.read().collect()} == {("1", "first", "HR", 1), ("2", "second", None, 2), ("3", "second", None, 3)}
    assert list(table.marks.values()) == [1]
    # The same batch again, as after a crash between merge and checkpoint.
    same = merge_scraped(table, spark.createDataFrame([posting("1", "again")], POSTING), (next(iter(table.marks)), 1))
    assert same.version == table.version


def test_a_merge_sends_its_rows_once(spark, tmp_path, monkeypatch):
    """Also with several slices per bucket, and with repeated and missing keys in the table."""
    from rolescope.operators import keyed_table

    monkeypatch.setattr(keyed_table, "SLICE", 50)
    old = spark.range(600).selectExpr("IF(id < 3, NULL, concat('k', id div 2)) AS k", "id AS a", "concat('old ', id) AS b")
    table = KeyedTable.create(old, str(tmp_path / "t"), ["k"], buckets=4)
    load = spark.createDataFrame([("k17", 0, None), ("new", 2, "z"), (None, 3, "w")], SMALL)
    plans, write = [], KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, rows, *args, **kw: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, *args, **kw))[1])
    after = table.merge(load, ["a"], ("b",))
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1 and "Join" not in plans[0]
    assert rows_of(after) == sorted(map(str, upsert(old, load, ["k"], ["a"], ("b",)).collect()))


def test_parts_that_hold_no_incoming_key_stay(spark, tmp_path, monkeypatch):
    """New keys are added beside a bucket's large parts, and known keys replace only the parts that hold them; also with repeated and missing keys."""
    from rolescope.operators import keyed_table

    monkeypatch.setattr(keyed_table, "SLICE", 50)

    def versions(held):
        return sorted({int(f.split("/v=")[1].split("/")[0]) for f in held.scan().inputFiles()})

    old = spark.range(600).selectExpr("IF(id < 3, NULL, concat('k', id div 2)) AS k", "id AS a", "concat('old ', id) AS b")
    table = KeyedTable.create(old, str(tmp_path / "t"), ["k"], buckets=2)
    fresh = spark.range(200).selectExpr("IF(id = 0, NULL, concat('new', id)) AS k", "id AS a", "concat('one ', id) AS b")
    first = table.merge(fresh, ["a"], ("b",))
    assert versions(first) == [0, 1] and first.rows == 800 == sum(n for _, n, _ in first.places.values())
    assert glob.glob(str(tmp_path / "t/data/v=1/bucket=*/*")) and spark.read.parquet(str(tmp_path / "t/data/v=1")).count() == 200
    again = spark.range(1, 150).selectExpr("concat('new', id) AS k", "-id AS a", "CAST(NULL AS STRING) AS b")
    second = first.merge(again, ["a", "b"])
    assert versions(second) == [0, 2]
    plain = upsert(upsert(old, fresh, ["k"], ["a"], ("b",)), again, ["k"], ["a", "b"])
    assert rows_of(second) == sorted(map(str, plain.collect())) and rows_of(first) == sorted(map(str, upsert(old, fresh, ["k"], ["a"], ("b",)).collect()))
    assert second.vacuum(keep=1) > 0 and rows_of(KeyedTable.open(spark, str(tmp_path / "t"))) == rows_of(second)
    both = spark.createDataFrame([("k17", 7, "x"), ("new3", 8, "y"), ("new160", 9, "z")], SMALL)
    third = second.merge(both, ["a"], ("b",))
    assert rows_of(third) == sorted(map(str, upsert(plain, both, ["k"], ["a"], ("b",)).collect()))
    assert {r.a for r in third.lookup(both).collect()} == {7, 8, 9}
    gone = third.remove(both)
    assert rows_of(gone) == sorted(map(str, upsert(plain, both, ["k"], ["a"], ("b",)).where("k IS NULL OR k NOT IN ('k17', 'new3', 'new160')").collect()))


def test_ids_go_on_over_all_parts(spark, tmp_path, jobs_from, monkeypatch):
    from rolescope.operators import keyed_table

    monkeypatch.setattr(keyed_table, "SLICE", 2)
    jobs = jobs_from(*[{"id": 10 + i, "job_id": str(i), "title": f"t{i}"} for i in range(20)])
    table, plain = KeyedTable.create(jobs, str(tmp_path / "t"), buckets=3), jobs
    for load, ids in enumerate((range(20, 40), range(30, 45), range(5, 7), range(50, 52))):
        source = spark.createDataFrame([posting(str(i), f"load {load}", load + 1) for i in ids for _ in range(2)], POSTING)
        table, plain = merge_scraped(table, source, at_rest=True), upsert_scraped(plain, source)
        plain = spark.createDataFrame(plain.collect(), plain.schema)
    assert rows_of(KeyedTable.open(spark, str(tmp_path / "t"))) == sorted(map(str, plain.collect()))
    assert len({v for _, v in table.parts}) > 1 and len({r.id for r in table.read().select("id").collect()}) == table.rows

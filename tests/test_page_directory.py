import random

import pytest
from pyspark.sql import functions as F

from rolescope.plans.page_directory import PageDirectory

ORDER = ("company", "title", "id")
SCHEMA = "company string, title string, id long, note string"


def drawn(n, seed):
    draw = random.Random(seed)
    companies = ["acme"] * 6 + ["zeta", "Beta", "ünder", "", None]
    return [(draw.choice(companies), draw.choice([None, "", "a", "b", "ab", "ñ"]), i, draw.choice([None, "x" * 30])) for i in range(n)]


def key(row):
    # Spark orders strings by their UTF-8 bytes; NULLs come last.
    return [(v is None, b"" if v is None else v.encode()) for v in row[:2]] + [row[2]]


def opened_files(rows):
    return len(set(rows.inputFiles()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = drawn(1000, 5)
    random.Random(6).shuffle(rows)
    path = str(tmp_path_factory.mktemp("pages") / "order")
    made = PageDirectory.create(spark.createDataFrame(rows, SCHEMA), path, ORDER, rows_per_file=40, partitions=7)
    return made, sorted(rows, key=key)


def test_pages(made):
    pages, want = made
    assert pages.total() == 1000 and pages.directory.count() >= 25 and pages.directory.agg(F.max("n")).first()[0] <= 40
    for offset, limit in [(0, 10), (0, 1), (333, 40), (500, 200), (995, 20), (1000, 5), (5000, 5), (7, 0)]:
        assert [tuple(r) for r in pages.page(offset, limit).collect()] == want[offset : offset + limit], (offset, limit)


def test_a_page_opens_few_files(made):
    """Pages of less than half a file, whatever their place."""
    pages, _ = made
    opened = [opened_files(pages.page(offset, 10)) for offset in range(0, 1000, 97)]
    assert max(opened) <= 2 and min(opened) == 1
    assert opened_files(pages.after(("acme", "b", 500), 10)) <= 3


def test_seek_paging_meets_every_row_once(made):
    pages, want = made
    got, last = [], None
    while True:
        rows = (pages.page(0, 150) if last is None else pages.after(last, 150)).collect()
        if not rows:
            break
        got += [tuple(r) for r in rows]
        last = tuple(rows[-1])[:3]
    assert got == want


def test_seek_from_keys_that_no_row_has(made):
    pages, want = made
    for last in [("acme", "a", -1), ("acme", "zz", 0), ("aaaa", None, 3), (None, None, 10**6), ("zzzz", "", 0), ("", "", -5), (None, "ab", 500)]:
        follow = [r for r in want if key(r) > key((*last, None))]
        assert [tuple(r) for r in pages.after(last, 30).collect()] == follow[:30], last


@pytest.mark.parametrize("leading", [("acme",), (None,), ("",), ("ünder", "ñ"), ("acme", None), ("nobody",), ("zzz", "a"), ()])
def test_pages_within(made, leading):
    pages, want = made
    own = [r for r in want if r[: len(leading)] == leading]
    first, past = pages.span(*leading) if leading else (0, pages.total())
    assert past - first == len(own) and want[first:past] == own
    if leading:
        for offset in (0, 3, len(own) + 1):
            rows = pages.page_within(leading, offset, 25).collect()
            assert [tuple(r)[:4] for r in rows] == own[offset : offset + 25] and all(r.total == len(own) for r in rows)


def test_opened_again_and_empty(spark, made, tmp_path):
    pages, want = made
    again = PageDirectory.open(spark, pages.path, ORDER, pages.schema)
    assert [tuple(r) for r in again.page(610, 5).collect()] == want[610:615]
    none = PageDirectory.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), ORDER)
    assert none.total() == 0 and none.page(0, 5).count() == 0 and none.after(("a", "b", 1), 5).count() == 0 and none.span("a") == (0, 0)

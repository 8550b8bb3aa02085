import json
import os

import pytest

from rolescope.sources import manifest
from rolescope.sources.files import scan_scraped

COLUMNS = ["job_id", "company", "ats", "title", "raw_description", "pos"]


def put(tree, ats, company, titles, later=0):
    folder = tree / ats
    folder.mkdir(parents=True, exist_ok=True)
    file = folder / f"{company}.json"
    file.write_text(json.dumps({"company": company, "scraped_at": "2026-01-01T00:00:00", "jobs": [{"id": str(i), "title": t} for i, t in enumerate(titles)]}))
    if later:
        os.utime(file, (file.stat().st_mtime + later, file.stat().st_mtime + later))
    return file


@pytest.fixture
def scanned(spark, tmp_path):
    tree, places = tmp_path / "tree", (str(tmp_path / "manifest"), str(tmp_path / "out"))
    for ats, company, titles in [("lever", "acme", "ab"), ("lever", "b eta+", "c"), ("ashby", "acme", "d"), ("ashby", "x[1]", "ef"), ("ashby", "none", "")]:
        put(tree, ats, company, titles)
    run = lambda: manifest.refresh(spark, str(tree), *places, per_read=2)

    def out():
        return sorted(map(tuple, manifest.read_refreshed(spark, places[1]).select(*COLUMNS).collect()))

    def whole():
        return sorted(map(tuple, scan_scraped(spark, str(tree)).select(*COLUMNS).collect()))

    return tree, run, out, whole


def folders(tmp_path):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}


def test_only_changes_are_parsed(scanned, tmp_path):
    tree, run, out, whole = scanned
    assert run() == manifest.Refreshed(5, 5, 0, 5) and out() == whole() and len(out()) == 6
    before = folders(tmp_path)
    assert run() == manifest.Refreshed(0, 0, 0, 0) and folders(tmp_path) == before
    # A file that was only touched is opened, not parsed; the next scan does not open it again.
    put(tree, "lever", "acme", "ab", later=5)
    assert run() == manifest.Refreshed(1, 0, 0, 0) and folders(tmp_path) == before
    assert run() == manifest.Refreshed(0, 0, 0, 0)
    # One changed, one new: the other companies' files stay.
    put(tree, "ashby", "x[1]", "efg", later=9)
    put(tree, "ashby", "new", "h")
    assert run() == manifest.Refreshed(2, 2, 0, 2) and out() == whole() and len(out()) == 8
    after = folders(tmp_path)
    assert all(after[p] == t for p, t in before.items() if "x%5B1%5D" not in str(p) and "x[1]" not in str(p))


def test_removed_files_and_lost_postings_go(scanned):
    tree, run, out, whole = scanned
    run()
    (tree / "lever" / "acme.json").unlink()
    put(tree, "ashby", "acme", "", later=3)
    assert run() == manifest.Refreshed(1, 1, 1, 2) and out() == whole() and len(out()) == 3
    (tree / "lever" / "b eta+.json").unlink()
    assert run() == manifest.Refreshed(0, 0, 1, 1) and out() == whole() and len(out()) == 2
    put(tree, "lever", "acme", "z", later=20)
    assert run() == manifest.Refreshed(1, 1, 0, 1) and out() == whole() and len(out()) == 3


def test_a_stopped_refresh_is_run_again(spark, scanned, monkeypatch):
    tree, run, out, whole = scanned
    run()
    put(tree, "lever", "acme", "new", later=4)
    with monkeypatch.context() as broken:
        broken.setattr(manifest, "save_postings", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError, match="disk"):
            run()
    assert run() == manifest.Refreshed(1, 1, 0, 1) and out() == whole()

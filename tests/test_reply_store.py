import json
import uuid

import pytest
from pyspark.sql import functions as F
from test_extract import postings

from rolescope.operators import extract
from rolescope.operators.reply_store import ReplyStore, extract_stored, normalized_text


def counting(folder, fail_after=None, rejects=()):
    """A model that leaves a file per prompt it was sent, as its tasks run in other processes."""
    folder.mkdir(exist_ok=True)
    where = str(folder)

    def model(prompts):
        import os

        replies = []
        for p in prompts:
            if fail_after is not None and len(os.listdir(where)) >= fail_after:
                os._exit(3)  # the worker dies, as on a lost machine
            with open(f"{where}/{uuid.uuid4().hex}", "w") as out:
                out.write(p)
            replies.append(None if any(r in p for r in rejects) else json.dumps({"department": "HR", "salary_min": len(p)}))
        return replies

    return model


def sent(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def answers(rows):
    return sorted((r.job_id, r.department or "", r.salary_min or 0, r.error or "") for r in rows.collect())


TEXTS = [c * 120 for c in "ABABABCA"] + ["short", None]


def test_distinct_prompts_are_sent_once_over_two_runs(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"), "m1", parts=4, parallelism=2)
    rows = postings(spark, *TEXTS).withColumn("title", F.lit("t"))
    direct = answers(extract.extract_jobs(rows, counting(tmp_path / "direct")))
    assert answers(extract_stored(rows, counting(tmp_path / "sent"), store)) == direct
    assert len(sent(tmp_path / "direct")) == 8 and len(sent(tmp_path / "sent")) == 3
    more = rows.unionByName(postings(spark, "D" * 120).withColumn("title", F.lit("t")))
    assert len(answers(extract_stored(more, counting(tmp_path / "sent"), store))) == len(TEXTS) + 1
    assert len(sent(tmp_path / "sent")) == 4 and store.read().count() == 4
    # Another model has replies of its own.
    extract_stored(rows, counting(tmp_path / "other"), ReplyStore(spark, store.path, "m2", parts=4, parallelism=2))
    assert len(sent(tmp_path / "other")) == 3 and store.read().count() == 7


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = postings(spark, *[f"{i:03}" * 50 for i in range(40)])
    store = ReplyStore(spark, str(tmp_path / "store"), "m", parts=2, per_round=8, parallelism=1, call_size=4)
    with pytest.raises(Exception):  # noqa: B017, PT011 - however Spark reports the lost worker
        extract_stored(rows, counting(tmp_path / "sent", fail_after=20), store)
    kept = store.read().count()
    assert 0 < kept < 40
    done = answers(extract_stored(rows, counting(tmp_path / "again"), store))
    assert len(sent(tmp_path / "again")) == 40 - kept and all(a[1] == "HR" for a in done) and len(done) == 40


def test_missing_replies_are_asked_again(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"), "m", parts=2, parallelism=2)
    rows = postings(spark, "A" * 120, "B" * 120)
    first = answers(extract_stored(rows, counting(tmp_path / "sent", rejects=("BBB",)), store))
    assert [a[3] for a in first] == ["", "Failed to parse LLM response"]
    assert [a[3] for a in answers(extract_stored(rows, counting(tmp_path / "later"), store))] == ["", ""]
    assert len(sent(tmp_path / "later")) == 1


def test_postings_of_one_text_share_an_extraction(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"), "m", parts=2, parallelism=2)
    rows = postings(spark, "Join our  team! " * 10, "join our team " * 10, "JOIN our-team. " * 10, "other " * 30).withColumn("title", F.lit("Cook"))
    got = answers(extract_stored(rows, counting(tmp_path / "sent"), store, same=normalized_text()))
    assert len(sent(tmp_path / "sent")) == 2 and len({a[2] for a in got[:3]}) == 1 and got[3][2] != got[0][2]


def test_nothing_to_ask(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"), "m")
    assert [a[3] for a in answers(extract_stored(postings(spark, None, "x"), counting(tmp_path / "sent"), store))] == ["No description"] * 2
    assert extract_stored(postings(spark, "x").limit(0), counting(tmp_path / "sent"), store).count() == 0 and sent(tmp_path / "sent") == []

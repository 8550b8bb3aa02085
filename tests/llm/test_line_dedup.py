import hashlib

import numpy as np
from helpers import CLASHING, documents

from rolescope.llm.line_dedup import CuckooFilter, LineIndex

LONG = "this line is long enough to count"
ROWS = [
    (1, f"{LONG}\nalpha\n"), (2, f"  {LONG.upper()}\t\nbeta"), (3, f"gamma\n{LONG}\n{LONG}"), (4, "short\nshort"), (5, "short"), (6, "short"),
    (7, None), (8, ""), (None, LONG), (None, None), (9, "x" * 200_000 + "\n" + LONG[:19]), (9, "x" * 200_000 + "\n" + LONG[:19]),
    (10, "Éé" * 10), (11, "Éé" * 10), (12, "Éé" * 10), (13, "éÉ" * 10),
]


def key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def expected(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(index, docs):
    rows = index.deduplicate(docs).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    return sorted(map(tuple, rows), key=str)


def test_like_brute_force_and_reversible(spark):
    docs = documents(spark, ROWS, **CLASHING)
    index = LineIndex.empty(spark, shards=3, salts=2).insert(docs)
    assert result(index, docs) == expected(ROWS)
    kept = index.deduplicate(docs)
    assert set(kept.columns) == {"doc_id", "text", *CLASHING, "kept_text", "n_lines", "n_dropped"} and kept.first()["row"] == "mine"

    # In two steps, and back again.
    first, rest = ROWS[:2] + ROWS[6:8], ROWS[2:6] + ROWS[8:]
    stepwise = LineIndex.empty(spark, shards=3, salts=2).insert(documents(spark, first))
    assert result(stepwise, documents(spark, first)) == expected(first)
    whole = stepwise.insert(documents(spark, rest))
    assert result(whole, docs) == expected(ROWS)
    back = whole.delete(documents(spark, rest))
    assert result(back, documents(spark, first)) == expected(first)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, stepwise.counts.collect()))
    # The largest holder goes: the next one keeps its line.
    fewer = [r for r in ROWS if r[0] != 13 and r[0] != 3] + [(20, LONG)]
    changed = whole.insert(documents(spark, [(20, LONG)])).delete(documents(spark, [(13, ""), (3, "")]))
    assert result(changed, documents(spark, fewer)) == expected(fewer)


def test_empty_table(spark):
    docs = documents(spark, [])
    index = LineIndex.empty(spark).insert(docs)
    assert result(index, docs) == [] and result(index.delete(docs), documents(spark, [(1, LONG)])) == [(1, LONG, 1, 0)]


def test_cuckoo_filter():
    keys = np.frombuffer(b"".join(hashlib.blake2b(b"%d" % i, digest_size=16).digest() for i in range(6000)), np.uint8).reshape(-1, 16)
    for size in (3000, 700):  # the second is far too small: what finds no room is listed
        held = CuckooFilter.sized(size)
        held.insert(keys[:3000])
        held = CuckooFilter.from_bytes(held.to_bytes())
        assert held.contains(keys[:3000]).all() and held.contains(keys[3000:]).mean() < 0.01
        held.delete(keys[:1500])
        assert held.contains(keys[1500:3000]).all() and held.contains(keys[:1500]).mean() < 0.01
        assert (held.table > 0).sum() + len(held.extra) == 1500


def test_full_filters_are_built_anew(spark):
    """A filter made for 30 keys takes 3,000 more: nothing is listed beside it, and lookups and deletions stay exact."""
    line = lambda i: f"a line of some length, number {i}"
    waves = [range(0, 30), range(30, 300), range(300, 3000)]
    rows = [[(w * 10 + d, "\n".join(map(line, wave))) for d in range(3)] for w, wave in enumerate(waves)]
    index = LineIndex.empty(spark, shards=2, salts=2)
    for wave in rows:
        index = index.insert(documents(spark, wave))
    held = [(r.room, CuckooFilter.from_bytes(r.filter)) for r in index.filters.collect()]
    assert len(held) == 2 and all(room == f.table.size and not f.extra for room, f in held) and sum((f.table > 0).sum() for _, f in held) == 3000
    whole = [r for wave in rows for r in wave]
    assert result(index, documents(spark, whole)) == expected(whole)
    back = index.delete(documents(spark, rows[2]))
    assert result(back, documents(spark, rows[0] + rows[1])) == expected(rows[0] + rows[1])
    assert sum((CuckooFilter.from_bytes(r.filter).table > 0).sum() for r in back.filters.collect()) == 300

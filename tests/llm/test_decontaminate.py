import itertools
import math
import random
import tracemalloc

from helpers import CLASHING, documents

from rolescope.llm import decontaminate

ITEMS = "item_id long, text string"


def tables(seed=7):
    """Items; documents that hold whole items, parts, and items with some words replaced; and clean ones."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(15, 60)))) for i in range(25)]
    rows, truth = [], set()
    for d in range(120):
        text = [draw.choice(words) for _ in range(draw.randint(0, 150))]
        if d % 3 == 0:
            i, item = draw.choice(items)
            own = item.split()
            if d % 2:
                own = [w if k % 9 != 4 else "other" for k, w in enumerate(own)]  # every ninth word replaced
            elif d % 4 == 0 and len(own) > 40:
                own = own[10:35]
            at = draw.randint(0, len(text))
            text[at:at] = own
            truth.add((d, i))
        elif d % 3 == 1:
            i, item = draw.choice(items)
            text[5:5] = item.split()[3:8]  # too short to count
        rows.append((d, " ".join(text).upper() if d % 5 == 0 else ", ".join(text)))
    return items, rows, truth


def brute(items, rows, similarity=0.8, least=13):
    """All diagonals of all pairs that share six words in a row or under a mask, by the best span of each."""
    found = set()
    for d, text in rows:
        words = decontaminate.tokens(text)
        for i, item in items:
            test = decontaminate.tokens(item)
            for shift in range(-len(test), len(words)):
                same = [0 <= k + shift < len(words) and words[k + shift] == test[k] for k in range(len(test))]
                if not any(same):
                    continue
                for a in range(len(test)):
                    for b in range(a + min(least, len(test)), len(test) + 1):
                        if all(0 <= k + shift < len(words) for k in (a, b - 1)) and sum(same[a:b]) >= similarity * (b - a):
                            found.add((d, i))
    return found


def test_finds_planted_passages_and_nothing_else(spark):
    items, rows, truth = tables()
    docs, benchmark = documents(spark, rows, **CLASHING), spark.createDataFrame(items, ITEMS)
    got = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth == brute(items, rows)
    by_item = dict(items)
    for r in got:
        own = decontaminate.tokens(dict(rows)[r.doc_id])[r.doc_start : r.doc_start + r.n_tokens]
        test = decontaminate.tokens(by_item[r.item_id])[r.item_start : r.item_start + r.n_tokens]
        assert len(own) == len(test) == r.n_tokens >= 13 and sum(a == b for a, b in zip(own, test)) == r.n_matches >= 0.8 * r.n_tokens
    kept = decontaminate.without_leaks(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in truth} and kept.columns == docs.columns
    # The same in many small blocks of items.
    assert {tuple(r) for r in decontaminate.leaks(docs, benchmark, block_tokens=60).collect()} == {tuple(r) for r in got}
    assert decontaminate.without_leaks(docs, benchmark, block_tokens=300).count() == kept.count()


def test_short_items_nulls_repeats_long_and_empty(spark):
    items = [(1, "two words"), (2, None), (3, ""), (4, "..."), (None, "a b c d e f g"), (1, "two words")]
    rows = [(1, "here are TWO, words."), (1, "here are TWO, words."), (2, None), (3, ""), (None, "x a b c d e f g"), (4, "two other words"), (5, "y " * 100_000 + "two words")]
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    got = {tuple(r) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(1, 1, 2, 0, 2, 2), (5, 1, 100_000, 0, 2, 2), (None, None, 1, 0, 7, 7)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()) == [2, 3, 4]
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.without_leaks(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.leaks(documents(spark, []), benchmark).count() == 0 and decontaminate.without_leaks(documents(spark, []), benchmark).count() == 0


def test_every_allowed_difference_is_found():
    """All patterns of replaced tokens that leave 80 %, in items of 1 to 16 tokens and in spans of 20 and 25 tokens of a long item."""
    for n in [*range(1, 17), 20, 25]:
        item = [f"t{i}" for i in range(n)] if n <= 16 else [f"t{i}" for i in range(40)]
        seeds = decontaminate.TestSeeds([(7, " ".join(item))])
        low = 0 if n <= 16 else 6
        patterns = list(itertools.combinations(range(n), n - math.ceil(round(0.8 * n, 9))))
        texts = []
        for gone in patterns:
            own = item[low : low + n]
            for g in gone:
                own[g] = "other"
            texts.append("before " + " ".join(own) + " after")
        found = {row[0] for row in seeds.overlaps(texts, 0.8, 13)}
        assert found == set(range(len(patterns))), (n, [patterns[i] for i in set(range(len(patterns))) - found][:5])


def brute_best(items, rows, similarity=0.8, least=13):
    """The best overlap of all diagonals and spans: most matches above the similarity, as the docstring ranks them."""
    found = set()
    for d, text in rows:
        words = decontaminate.tokens(text)
        for i, item in items:
            test = decontaminate.tokens(item)
            for shift in range(-len(test), len(words)):
                same = [0 <= k + shift < len(words) and words[k + shift] == test[k] for k in range(len(test))]
                low, high = max(0, -shift), min(len(test), len(words) - shift)
                need = min(least, len(test))
                if any(sum(same[a:b]) >= similarity * (b - a) - 1e-9 for a in range(low, high) for b in range(a + need, high + 1)) and test:
                    found.add((d, i))
    return found


def test_repeated_words_and_phrases():
    draw = random.Random(3)
    items = [(0, "a " * 20), (1, "a b " * 10), (2, "a a a b"), (3, "b a a a a a a c c c c c c c d"), (4, "a")]
    rows = [(i, " ".join(draw.choices(["a", "b", "c", "d", "a a a a", "a b a b", "a a a b"], k=draw.randint(0, 25)))) for i in range(80)]
    rows += [(100, "a " * 60), (101, "a b " * 40), (102, "x " + "a " * 30 + "x")]
    seeds = decontaminate.TestSeeds(items)
    got = {(rows[d][0], i) for d, i, *_ in seeds.overlaps([t for _, t in rows], 0.8, 13)}
    assert got == brute_best(items, rows)


def test_one_word_over_and_over_needs_little_memory():
    seeds = decontaminate.TestSeeds([(0, "a " * 1000), (1, "a " * 999 + "b"), (2, "a b c " * 300)])
    tracemalloc.start()
    rows = seeds.overlaps(["a " * 400_000, "a b c " * 30_000], 0.8, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(0, 0, 0, 0, 1000, 1000), (1, 2, 0, 0, 900, 900)} <= set(rows) and {r[:2] for r in rows} == {(0, 0), (0, 1), (1, 2)}
    assert peak < 400 << 20, peak

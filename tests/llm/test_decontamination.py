import itertools
import random

import numpy as np
import pytest

from strandlake.llm import decontamination as d


def test_masks_hit_all_substitutions():
    for n, wrong in ((15, 3), (20, 4)):
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(a + o not in bad for o in m) for m in d.MASKS for a in range(n - m[-1])), bad


def test_items_of_all_lengths_are_found(spark):
    """Each item of 1 to 15 words, in each way that the rule allows, and in none that it doesn't."""
    rows, items, want, n = [], [], {}, 0
    for size in range(1, 16):
        item = [f"i{size}x{k}" for k in range(size)]
        items.append((size, " ".join(item)))
        most = size - next(k for k in range(size + 1) if 10 * k >= 8 * size)
        for wrong in (most, most + 1):
            for bad in itertools.islice(itertools.combinations(range(size), wrong), 0, None, 7 if size > 11 else 1):
                rows.append((n, "before it " + " ".join("other" if k in bad else w for k, w in enumerate(item)) + " after it"))
                want[n] = [size] if wrong == most else []
                n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items, (None, "no id at all")], "item_id long, text string")
    for most in (d.BROADCAST_WORDS, 0):
        got = {r.row.doc_id: r["items"] for r in d.annotate(docs, bench, most).collect()}
        assert got == want
    marked = spark.createDataFrame([(1, "x No id AT all y"), (2, "no id at")], "doc_id long, text string")
    for most in (d.BROADCAST_WORDS, 0):
        assert {r.row.doc_id: (r.contaminated, r["items"]) for r in d.annotate(marked, bench, most).collect()} == {1: (True, []), 2: (False, [])}


def _stretch(same, need):
    return max((j - i for i in range(len(same)) for j in range(i + need, len(same) + 1) if sum(same[i:j]) * 5 >= (j - i) * 4), default=0)


def test_overlap_against_brute_force():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.choice((8, 15, 16, 30))
        item = np.arange(n, dtype=np.uint64)
        doc = np.array([v if draw.random() < 0.75 else 999 for v in range(n)], np.uint64)
        shift = draw.randrange(-6, 6)
        part = doc[-shift:] if shift < 0 else np.concatenate([np.full(shift, 777, np.uint64), doc])
        low, high = max(0, -shift), n
        same = [bool(item[k] == part[k + shift]) for k in range(low, high)]
        assert d.overlap(part, item, shift)[0] == _stretch(same, min(15, n))


@pytest.fixture
def tables(spark):
    draw = random.Random(9)
    item = [f"q{draw.randrange(10**6)}" for _ in range(40)]
    other = [f"r{draw.randrange(10**6)}" for _ in range(15)]
    filler = lambda n: [f"f{draw.randrange(10**4)}" for _ in range(n)]
    swapped = [w if k % 6 else "swap" for k, w in enumerate(item)]
    rows = [
        (0, " ".join(filler(50) + item + filler(20))), (1, " ".join(filler(80))), (2, " ".join(filler(5) + swapped)), (3, " ".join(item[:14])), (4, " ".join(item[5:21])), (5, ""), (6, None),
        (7, " ".join(filler(3) + [w.upper() for w in other])), (8, " ".join(w if k % 2 else "no" for k, w in enumerate(item))), (9, " ".join(filler(9000) + other + item)), (0, " ".join(item)),
    ]
    docs = spark.createDataFrame([(*r, True, "c", 1) for r in rows], "doc_id long, text string, contaminated boolean, items string, n int")
    bench = spark.createDataFrame([(1, " ".join(item), 5), (2, " ".join(other), 5), (3, "never there", 5), (4, None, 5), (5, "", 5), (None, "x y", 5)], "item_id long, text string, n int")
    return docs, bench


def test_both_ways_find_the_overlaps(tables):
    docs, bench = tables
    for most in (d.BROADCAST_WORDS, 0):
        found = sorted((r.row.doc_id, r.contaminated, tuple(r["items"]), r.overlap_words) for r in d.annotate(docs, bench, most).collect())
        assert [(i, c) for i, c, _, _ in found] == [(0, True), (0, True), (1, False), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True), (8, False), (9, True)]
        assert found[-1][2:] == ((1, 2), 40) and found[8][2] == (2,)
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [1, 3, 5, 6, 8]
    assert d.clean(docs, bench).columns == docs.columns


def test_empty_tables(tables):
    docs, bench = tables
    for most in (d.BROADCAST_WORDS, -1):
        assert d.annotate(docs, bench.limit(0), most).where("contaminated").count() == 0
        assert d.annotate(docs.limit(0), bench, most).count() == 0


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "t", 1, 2, 3, 4)], ["doc_id", "text", "my col", "a-b", "a.b", "x:y`z"])
    bench = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert d.clean(docs, bench).columns == docs.columns and d.clean(docs, bench).collect() == docs.collect()

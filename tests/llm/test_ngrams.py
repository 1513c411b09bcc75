import itertools
import random

import numpy as np
import pytest

from strandlake.llm import ngrams
from strandlake.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def _sets(texts, width):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def _brute(rows, rule):
    sets = _sets([t for _, t in rows], rule.width)
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if x and y and rule.scale * len(x & y) >= rule.share * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(s), c) for (i, _), s, c in zip(rows, sets, label, strict=True)}


def _near_copies(draw, n, length, edits):
    base = [f"w{draw.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.choice(edits)):
            words[draw.randrange(length)] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rule", [ngrams.Rule(), ngrams.Rule(5, 80, 100), ngrams.Rule(1, 50, 100)], ids=str)
def test_against_all_pairs(spark, monkeypatch, rule):
    monkeypatch.setattr(ngrams, "FEW", 4)
    monkeypatch.setattr(ngrams, "HEAVY_COUNT", 5)
    draw = random.Random(7)
    texts = _near_copies(draw, 45, 100, (0, 1, 1, 2, 3, 4)) + _near_copies(draw, 12, 30, (0, 1)) + _near_copies(draw, 12, 12, (0, 1))
    shared = " ".join(f"s{k}" for k in range(20))
    texts += [f"{shared} {' '.join(f'u{draw.randrange(10**6)}' for _ in range(draw.randrange(1, 60)))}" for _ in range(15)]
    texts += ["a b c", "A B C", "a  b\nc", "a b", "", None, " \t\n", "a b c d", "A B C D", "é É", "é é", "a b c d e f g h i j", "b c d e f g h i j k"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.linked(df, rule).collect()}
    assert got == _brute(sorted(rows), rule)
    kept = {r.doc_id for r in ngrams.representatives(df, rule).collect()}
    assert kept == {i for i, (n, c) in got.items() if c == i}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert ngrams.linked(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e"), (None, None)], schema)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngrams.linked(rows).collect()) == [(0, 0), (0, 2), (2, 2), (4, 2), (4, 2)]
    assert sorted(str(r.doc_id) for r in ngrams.representatives(rows, ngrams.Rule()).collect()) == ["2", "None", "None"]


def test_a_row_without_an_id_links_others(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join(base[:92] + [f"x{k}" for k in range(8)]), " ".join([f"y{k}" for k in range(8)] + base[8:])]
    rows = [(7, texts[1]), (None, texts[0]), (5, texts[2])]
    rule = ngrams.Rule(1, 80, 100)
    got = ngrams.linked(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 5), (None, 5), (5, 5)}
    alone = ngrams.linked(spark.createDataFrame([(None, "a b c d e")] * 2, "doc_id long, text string"), rule).collect()
    assert [(r.n_shingles, r.component_id) for r in alone] == [(5, None)] * 2


def _thue_morse(n, a, b):
    return [(a, b)[k.bit_count() & 1] for k in range(n)]


def test_words_and_texts_of_much_structure(spark):
    """Polynomial fingerprints modulo a power of two are equal for these."""
    texts = ["".join(_thue_morse(n, *ab)) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    texts += [" ".join(_thue_morse(n, *ab)) for n in (1024, 4096) for ab in (("yes", "no"), ("no", "yes"))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (ngrams.Rule(), ngrams.Rule(1024, 80, 100)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.linked(df, rule).collect()} == _brute(rows, rule)


def test_documents_that_only_share_a_passage_do_not_meet(spark, monkeypatch):
    met = []
    monkeypatch.setattr(ngrams, "verified", lambda pairs, *rest, f=ngrams.verified: met.append(pairs.count()) or f(pairs, *rest))
    shared = " ".join(f"s{k}" for k in range(200))
    rows = [(i, shared + " " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(400)]
    got = ngrams.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got) and sum(met) <= 2 * len(rows)


def test_wide_sketches_bound_the_difference():
    draw = np.random.default_rng(4)
    for n, m, common in ((5, 5, 5), (900, 1000, 850), (4000, 4600, 3900), (3000, 9000, 10), (0, 7, 0)):
        pool = np.unique(draw.integers(0, 2**63, n + m, dtype=np.uint64))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
        real = len(np.setxor1d(x, y))
        assert ngrams.unlike(ngrams.wide_sketch(x), ngrams.wide_sketch(y)) <= real
        if 2 * common > n:
            assert ngrams.unlike(ngrams.wide_sketch(x), ngrams.wide_sketch(y)) >= real * 0.6


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    root = {}
    for _ in range(200):
        for a, b in edges:
            m = min(root.get(a, a), root.get(b, b))
            root[a] = root[b] = m
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_hold_each_pair_that_may_be_linked(spark, monkeypatch):
    """Nodes that meet at one shingle, dealt into many cells: each pair that is apart and allowed comes once, as one of another."""
    draw = random.Random(11)
    base = [draw.getrandbits(64) for _ in range(ngrams.SKETCH_WORDS)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(draw.randrange(12)):
            words[draw.randrange(len(words))] ^= 1 << draw.randrange(64)
        n = draw.randrange(95, 106)
        rows.append((7 if k else 8, draw.randrange(12), draw.random() < 0.7, [draw.randrange(40)], k // 2, k, n, k, -k, [w - (1 << 64) if w >> 63 else w for w in words], draw.randrange(40), False))
    schema = "shingle long, at int, short boolean, before array<long>, gid long, row long, n int, key long, tag long, sketch array<long>, root long, own boolean"
    want = set()
    for (s, at, short, before, gid, row, n, *_, sketch, root, _), (s2, at2, _, before2, gid2, row2, n2, *_, sketch2, root2, _) in itertools.product(rows, repeat=2):
        unlike = sum((a ^ b).bit_count() if a ^ b >= 0 else 64 - (~(a ^ b)).bit_count() for a, b in zip(sketch, sketch2, strict=True))
        fits = min(n, n2) * 100 >= 85 * max(n, n2) and min(n - at, n2 - at2) * 185 >= (n + n2) * 85 and unlike * 185 <= (n + n2) * 15
        if s == s2 and short and root != root2 and gid != gid2 and (n, gid) < (n2, gid2) and fits and not set(before) & set(before2):
            want.add((row, row2, row, -row, row2, -row2, min(root, root2), max(root, root2), unlike / (n + n2)))
    assert want
    for cell in (7, 1000):
        monkeypatch.setattr(ngrams, "CELL", cell)
        found = ngrams.crossed(spark.createDataFrame(rows, schema), ngrams.Rule()).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want

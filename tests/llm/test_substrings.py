import hashlib
import random

import numpy as np
import pytest

from strandlake.llm import recompression, substrings
from strandlake.llm._words import windows, words_of


def _brute(rows, width):
    least = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        out.append((i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest()))
    return out


def _texts(draw):
    words = [f"w{k}" for k in range(30)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    passage, other = prose(70), prose(50)
    texts = [prose(draw.randrange(0, 200)) for _ in range(20)]
    texts += [f"{prose(draw.randrange(60))} {passage} {prose(draw.randrange(60))}" for _ in range(15)]
    texts += [f"{prose(9)}\n{other}\t{prose(5)} {passage}" for _ in range(5)] + [passage, passage, other, prose(49), "a " * 200, "a " * 120 + "b", "a b " * 90, "a b " * 90, "x a b " * 60, "", None, " \n"]
    texts += ["z " + "a " * 60, "a b c " * 40 + other, "ü🙂 " * 60, "ü🙂 " * 60]
    return texts


@pytest.mark.parametrize("width", [50, 12, 3])
def test_against_all_windows(spark, width):
    draw = random.Random(width)
    rows = list(enumerate(_texts(draw))) + [(3, "own " * 80), (3, "own " * 80), (None, "own " * 80), (500, "own " * 80)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, sig string, starts int").repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, substrings.digests(df, width).collect()), key=key) == sorted(_brute(rows, width), key=key)


def test_rewritten_rows(spark):
    draw = random.Random(1)
    rows = list(enumerate(_texts(draw)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in substrings.deduplicated(df).collect()}
    want = {i: (n, gone, sha) for i, n, gone, sha in _brute(rows, 50)}
    assert set(got) == {i for i, (n, gone, _) in want.items() if n > gone or n == 0}
    for i, r in got.items():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[i][2]
        assert r.n_chars == len(r.text or "")
        if not want[i][1]:
            assert r.text == dict(rows)[i]
    empty = df.limit(0)
    assert substrings.digests(empty).count() == 0 and substrings.deduplicated(empty).count() == 0


def test_words_and_texts_of_much_structure(spark):
    """Polynomial fingerprints modulo a power of two are equal for these."""
    morse = lambda n, a, b: [(a, b)[k.bit_count() & 1] for k in range(n)]
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:20] + ["".join(morse(n, *ab))] + words[20:59]) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    texts += [" ".join(morse(n, *ab)) for n in (1024, 4096) for ab in (("yes", "no"), ("no", "yes"))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (50, 1024):
        assert sorted(map(tuple, substrings.digests(df, width).collect())) == sorted(_brute(rows, width))


def test_odd_column_names(spark):
    rows = [(1, "a " * 60, 1, "x", 2), (2, "b " + "a " * 60, 1, "y", 3), (3, None, 1, "z", 4), (3, None, 1, "z", 4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "my col", "a.b", "x:y`z"])
    got = substrings.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r[0], r[1], r[3], r[4]) for r in got.collect())[1:] == [(2, "b", "y", 3), (3, None, "z", 4), (3, None, "z", 4)]


def test_equal_windows_choose_equal_symbols():
    draw = random.Random(8)
    texts = [t for t in _texts(draw) if t]
    for width in (50, 20, 5):
        w = words_of(texts)
        found = recompression.anchors(w.hash, w.first, width)
        chosen = {}
        for k in range(len(texts)):
            h = windows(w.hash[w.first[k] : w.first[k + 1]], width)
            part = found[w.first[k] : w.first[k + 1]]
            assert (part[: len(h)] > 0).all() and not part[len(h) :].any()
            for a, b in zip(h.tolist(), part.tolist()):  # noqa: B905
                assert chosen.setdefault(a, b) == b


def test_rounds_shrink_and_keep_context():
    words = np.random.default_rng(2).integers(0, 50, 4000).astype(np.uint64)
    rounds = recompression.levels(words, np.array([0, 4000]), 50)
    assert len(rounds) == recompression.ROUNDS + 1
    for a, b in zip(rounds, rounds[1:]):  # noqa: B905
        assert len(b.name) < len(a.name)
        assert (np.diff(b.low) >= 0).all() and (np.diff(b.high) >= 0).all()

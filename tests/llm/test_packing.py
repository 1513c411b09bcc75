import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import packing


def _cost(position, penalty, cuts, most):
    total, before = 0.0, 0
    for j in cuts:
        size = int(position[j] - before)
        total += (0 if size & (size - 1) == 0 and size < most else most - size) + penalty[j] + packing.WINDOW_PENALTY
        before = position[j]
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 2.0, 12.0])), min_size=1, max_size=9))
def test_best_cuts_against_all_cuts(steps):
    position = np.concatenate(([0], np.cumsum([s for s, _ in steps])))
    penalty = np.array([0.0, *[p for _, p in steps]])
    got = packing.best_cuts(position, penalty, 16)
    n = len(steps)
    best = min(
        _cost(position, penalty, [*c, n], 16)
        for k in range(n) for c in itertools.combinations(range(1, n), k)
        if all(position[b] - position[a] <= 16 for a, b in itertools.pairwise([0, *c, n]))
    )
    assert got[-1] == n and abs(_cost(position, penalty, got, 16) - best) < 1e-9


def _check(rows, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in texts]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for (doc_id, _), want in zip(texts, ids, strict=True):
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(map(len, ids))


def test_pieces_hold_each_id_once(spark):
    draw = random.Random(2)
    words = ["alpha", "beta.", "gamma", "delta!", "ünï🙂", "x" * 40]
    texts = [(k, " ".join(draw.choices(words, k=draw.choice((0, 1, 5, 300, 4000))))) for k in range(60)] + [(60, None), (61, ""), (62, "y" * 9000), (63, "a\n" * 3000)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id long, text string, part string, start int").repartition(3)
    assert _check(packing.pack(df).collect(), texts) < 0.02


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], schema)).agg({"length": "sum"}).first()[0] == 8


def test_small_blocks_carry_on(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 2000)
    ends = np.zeros(300, bool)
    packer = packing.Packer(ends, 0)
    rows = []
    for k in range(50):
        rows += packer.add(k, np.full(200 + k, k % 7, np.uint32))
    rows += packer.finish()
    assert sum(r[2] for r in rows) == sum(200 + k for k in range(50))
    assert sum(p for _, p in {(r[5], r[8]) for r in rows}) < 0.05 * sum(r[2] for r in rows)


def test_added_tokens_have_their_own_ids(spark):
    texts = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "  <|endoftext|>  x<|endoftext|><|endoftext|>\n\ny <|endoftext"), (4, "<|endoftext|>" + "word. " * 2000 + "\n<|endoftext|>")]
    _check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect(), texts)


def test_long_white_space(spark):
    texts = [(1, "a" + " " * 1_100_000 + "b"), (2, "c" + "\n" * 1_100_000 + "<|endoftext|>d"), (3, "e")]
    _check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect(), texts)

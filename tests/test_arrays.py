import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators import arrays, fingerprint


def _lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=40) | st.text(alphabet="abcé🙂", max_size=25))
def test_arrays_against_brute_force(text):
    points = arrays.code_points(text)
    order, rank = arrays.suffix_array(points)
    want = sorted(range(len(text)), key=lambda i: [ord(c) for c in text[i:]])
    assert order.tolist() == want
    assert [rank[i] for i in want] == list(range(len(text)))
    lcp = arrays.lcp_array(points, order, rank)
    assert lcp.tolist() == [0 if r == 0 else _lcp(text[want[r - 1] :], text[want[r] :]) for r in range(len(text))]
    length, source = arrays.lpf_array(order, lcp)
    for i in range(len(text)):
        assert length[i] == max((_lcp(text[i:], text[j:]) for j in range(i)), default=0)
        if length[i]:
            assert source[i] < i and text[source[i] : source[i] + length[i]] == text[i : i + length[i]]
        else:
            assert source[i] == -1
    at = arrays.lz_phrases(length)
    assert "".join(text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)) == text if text else at == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_nearest_smaller_and_range_minimum(values):
    left, right = arrays.nearest_smaller(values)
    for i, v in enumerate(values):
        assert left[i] == max((j for j in range(i) if values[j] <= v), default=-1)
        assert right[i] == min((j for j in range(i + 1, len(values)) if values[j] <= v), default=-1)
    rmq = arrays.RangeMinimum(np.array(values))
    for i in range(len(values)):
        for j in range(i, len(values)):
            part = values[i : j + 1]
            assert rmq.query(i, j) == i + part.index(min(part))


@pytest.mark.parametrize("modulus", [fingerprint.P61, fingerprint.P107])
def test_poly_hash(modulus):
    data = random.Random(1).randbytes(300)
    h = 0
    for b in data:
        h = (h * 256 + b) % modulus
    assert fingerprint.poly_hash(data, modulus) == h
    assert fingerprint.poly_hash(b"", modulus) == 0


@pytest.mark.parametrize("width", [1, 7, 8, 9, 24])
def test_window_values(width):
    data = random.Random(2).randbytes(120) + b"\xff" * 30
    got = fingerprint.window_values(np.frombuffer(data, np.uint8), width).tolist()
    assert got == [fingerprint.poly_hash(data[i : i + width]) for i in range(len(data) - width + 1)]
    assert not len(fingerprint.window_values(np.frombuffer(data[:3], np.uint8), 4))


@pytest.mark.parametrize("width", [13, 24, 59, 1220])
def test_mirrored_bits(width):
    """Equal windows at misaligned places have equal slices and fingerprints, and different windows don't."""
    half = np.random.default_rng(4).integers(0, 2, 3000).astype(np.uint8)
    bits = np.concatenate([half, np.zeros(3, np.uint8), half])
    packed = np.packbits(bits, bitorder="little")
    shift = len(half) + 3
    values = fingerprint.bit_window_values(bits, width)
    assert (values[: len(half) - width + 1] == values[shift : shift + len(half) - width + 1]).all()
    for i in (0, 5, 63, 64, 1000, len(half) - 64):
        assert fingerprint.bit_slice(packed, i) == fingerprint.bit_slice(packed, i + shift) == int("".join(map(str, bits[i : i + 64][::-1])), 2)
    for i in range(0, 1500, 37):
        same = bool((bits[i : i + width] == bits[i + 1 : i + 1 + width]).all())
        assert (values[i] == values[i + 1]) == same

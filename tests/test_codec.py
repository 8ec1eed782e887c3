import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywire.operators.codec import arithmetic_decode, arithmetic_encode, decode_histogram, decode_packet, encode, decode, encode_histogram, encode_packet

N = 1024
rng = random.Random(3)
SHAPES = {
    "constant": [2048] * N,
    "ramp": list(range(N)),
    "alternating": [0, 4095] * (N // 2),
    "uniform": [rng.randrange(4096) for _ in range(N)],
    "gauss": [min(4095, max(0, int(rng.gauss(2048, 4)))) for _ in range(N)],
    "one overflow": [100] * 500 + [4000] + [100] * (N - 501),
    "symbols 31 and 32": [1000, 985, 1001, 985, 1001] * 200,
    "one": [7],
    "two": [7, 9],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    assert decode_packet(encode_packet(SHAPES[shape])) == SHAPES[shape]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4095), max_size=200))
def test_any(adcs):
    assert decode_packet(encode_packet(adcs)) == adcs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300))
def test_coder(symbols):
    counts = [symbols.count(i) for i in range(6)]
    assert arithmetic_decode(arithmetic_encode(symbols, counts), len(symbols), counts) == symbols


def test_histogram_header():
    counts = [0, 5, 3] + [0] * 28 + [1]
    assert decode_histogram(encode_histogram(counts, 7, 10, 77))[:4] == (counts, 7, 10, 77)


def test_near_entropy():
    import math

    adcs = SHAPES["gauss"]
    deltas = [b - a for a, b in zip(adcs, adcs[1:])]
    bits = sum(-math.log2(deltas.count(d) / len(deltas)) for d in deltas)
    assert len(encode_packet(adcs)) * 8 < bits + 300


def test_columns(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, None)], "id long, adcs array<long>")
    assert {r.id: r.adcs for r in decode(encode(df)).collect()} == {1: [5, 6, 7], 2: [], 3: None}

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessela.llm.splitting import PARAGRAPH, RangeMaximum, SplitParams, pieces, spans, split_spans, strengths

P = SplitParams(limit=60, least=30, overlap=10, slack=3)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n\r\té́😀", max_size=400))
def test_round_trip_and_strongest_cut(text):
    got = spans(text, P)
    assert got == [] if not text else got[0][0] == 0 and got[-1][1] == len(text)
    s = strengths(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - a <= P.limit and d > b and P.overlap - P.slack <= b - c <= P.overlap + P.slack
        window = range(a + P.least, a + P.limit + 1)
        assert b == max(window, key=lambda i: (s[i], i))
    assert "".join(text[(a if not i else got[i - 1][1]) : b] for i, (a, b) in enumerate(got)) == text


@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
def test_range_maximum(values, data):
    import numpy as np

    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    assert RangeMaximum(np.array(values, dtype=np.uint8), len(values)).best(a, b) == max(range(a, b + 1), key=lambda i: (values[i], i))


def test_strengths():
    t = "Um dois. Três,\n\nquatro\r\ncinco"
    s = strengths(t)
    assert s[t.index("quatro")] == PARAGRAPH and s[t.index("Três")] > s[t.index("dois")] > s[1] and s[t.index("\n", 17)] == 0


def test_rows(spark):
    df = spark.createDataFrame([("a", "x" * 61), ("b", "x" * 60), ("c", None), ("d", ""), ("e", "palavra " * 2000)], "k string, text string")
    assert {r["k"] for r in split_spans(df, ["k"], "text", P).collect()} == {"a", "e"}
    got = pieces(df, ["k"], "text", P).collect()
    assert {r["k"] for r in got} == {"a", "b", "e"} and all(len(r["piece"]) <= 60 and len(r["piece"]) == r["piece_end"] - r["piece_start"] for r in got)


def test_parameters():
    with pytest.raises(ValueError, match="longer"):
        SplitParams(limit=100, least=50, overlap=60)

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tessela.llm.mixing import allot, inclusion_rate, mix, share_report
from tessela.llm.packing import dominating_set, fill_report, pack, plan
from tessela.llm.tokens import encoding, token_sizes


def _bins(p):
    """Containers as lists of sizes, out of the plan's slots."""
    out: dict[int, list[int]] = {}
    for size, rank, base, each in p.slots:
        last = min((r for s, r, _, _ in p.slots if s == size and r > rank), default=p.used[size])
        for r in range(rank, last):
            out.setdefault(base + (r - rank) // each, []).append(size)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_packs_all_and_nothing_too_full(sizes):
    p = plan(Counter(sizes), 30)
    bins = _bins(p)
    assert sorted(x for b in bins.values() for x in b) == sorted(sizes)
    assert all(sum(b) <= 30 for b in bins.values()) and set(bins) == set(range(p.bins))


def _least_bins(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        def place(i, rooms):
            if i == len(sizes):
                return True
            seen = set()
            for k, room in enumerate(rooms):
                if room >= sizes[i] and room not in seen:
                    seen.add(room)
                    if place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]]):
                        return True
            return False

        if place(0, [capacity] * n):
            return n
    return 0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_dominating_sets_keep_an_optimum(sizes):
    counts = Counter(sizes)
    best = _least_bins(sizes, 12)
    found = dominating_set(max(sizes), sorted(counts), dict(counts), 12)
    if found:
        rest = Counter(sizes)
        rest.subtract(found)
        assert min(rest.values()) >= 0 and sum(found) <= 12
        assert 1 + _least_bins(list(rest.elements()), 12) == best


def test_size_out_of_range():
    with pytest.raises(ValueError, match="outside"):
        plan({31: 1}, 30)


def test_pack(spark):
    rng = random.Random(4)
    data = [(i, 7 if i % 3 else rng.randrange(1, 300)) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 512 * 3 + 5), (5003, 512)]
    df = spark.createDataFrame(data, "k bigint, n_tokens bigint")
    kinds = [("short", 512), ("tiny", 40)]
    got = pack(df, "k", kinds, bucket_rows=100).collect()
    fill = Counter()
    tokens = Counter()
    for r in got:
        fill[r["container"], r["bin_id"]] += r["n_tokens"]
        tokens[r["container"], r["k"]] += r["n_tokens"]
    assert all(n <= dict(kinds)[c] for (c, _), n in fill.items())
    assert all(tokens[c, k] == n for c, _ in kinds for k, n in data if n)
    assert all(n > 512 for k, n in data if n and sum(r["k"] == k and r["container"] == "short" for r in got) > 1)
    r = {x["container"]: x for x in fill_report(pack(df, "k", kinds), kinds).collect()}
    assert r["short"]["filled"] > 0.99 and r["short"]["bins"] >= r["short"]["least_bins"]


def test_tokens(spark):
    texts = ["Olá, mundo!", "", None, "a" * 3000, "x y\n\n z"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "k int, text string, extra string")
    got = {r["k"]: r["n_tokens"] for r in token_sizes(df, "text").collect()}
    assert got[1] == got[2] == 0
    enc = encoding()
    for i in (0, 3, 4):
        assert enc.decode(enc.encode_ordinary(texts[i])) == texts[i] and got[i] == len(enc.encode_ordinary(texts[i]))


def _targets(*t):
    return [Row(mix=m, source=s, target_share=w, max_repeats=r) for m, s, w, r in t]


def test_allot():
    t = _targets(("m", "a", 0.5, 2), ("m", "b", 0.5, 1), ("m", "none", 0.0, 1))
    a, b, n = allot(t, {"a": 100, "b": 1000})
    assert (a["want"], a["copies"], a["rest"]) == (200, 2, 0) and (b["want"], b["copies"]) == (200, 0) and n["want"] == 0
    a, b, _ = allot(t, {"a": 100, "b": 1000}, 1000)
    assert (a["want"], b["want"]) == (200, 500)
    assert inclusion_rate([(10, 100, 1000.0)], 50) == pytest.approx(0.05) and inclusion_rate([], 5) == 0


def test_shares_and_repeats(spark):
    rng = random.Random(6)
    data = [(s, i * 10 + k, rng.randrange(5, 60)) for k, (s, n) in enumerate((("big", 4000), ("mid", 400), ("tiny", 30))) for i in range(n)] + [("big", -1, 0), ("big", -2, None), ("other", -3, 9)]
    sizes = spark.createDataFrame(data, "source string, doc_id bigint, n_tokens bigint")
    t = _targets(("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 3), ("solo", "tiny", 1.0, 2), ("gone", "absent", 1.0, 2))
    once, again = mix(sizes, t), mix(sizes, t)
    assert sorted(once.collect()) == sorted(again.collect())
    rep = {(r["mix"], r["source"]): r for r in share_report(once, sizes, spark.createDataFrame(t)).collect()}
    assert all(abs(rep["m", s]["reached_share"] - w) < 0.01 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    assert rep["m", "tiny"]["most_copies"] == 3 and rep["gone", "absent"]["tokens"] == 0 and rep["solo", "tiny"]["most_copies"] == 2
    assert all(r["most_copies"] <= r["max_repeats"] for r in rep.values())
    assert once.select("mix", "doc_id").distinct().count() == once.count()


def test_larger_texts_are_likelier(spark):
    sizes = spark.createDataFrame([("s", i, 10 if i % 2 else 40) for i in range(4000)], "source string, doc_id bigint, n_tokens bigint")
    got = Counter(r["n_tokens"] for r in mix(sizes, _targets(("m", "s", 1.0, 1)), 20_000).collect())
    assert 3 < got[40] / got[10] < 5
    assert abs(40 * got[40] + 10 * got[10] - 20_000) <= 40


def test_combinations_are_seeded(spark):
    sizes = spark.createDataFrame([("s", i, 10) for i in range(500)], "source string, doc_id bigint, n_tokens bigint")
    t = _targets(("m", "s", 1.0, 1))
    picks = [{r["doc_id"] for r in mix(sizes, t, 1000, seed=k).collect()} for k in (1, 2)]
    assert len(picks[0]) == len(picks[1]) == 100 and picks[0] != picks[1] and not list(itertools.islice((x for x in picks[0] if x < 0), 1))

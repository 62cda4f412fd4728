from __future__ import annotations

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tessela.llm import neardup
from tessela.llm.neardup import duplicate_groups, duplicate_pairs, option_texts, similar_classes, word_classes
from tests.helpers import rows

SCHEMA = "id string, statement string, options_json string"


def _texts(seed: int, groups: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    common = [f"comum{i}" for i in range(40)]
    out = []
    for g in range(groups):
        base = rng.sample(common, 25) + [f"raro{g}x{i}" for i in range(15)]
        for c in range(rng.randrange(1, 4)):
            edited = [w if rng.random() > 0.12 * c else f"novo{rng.randrange(10**6)}" for w in base]
            rng.shuffle(edited)
            out.append((f"q{g:03}-{c}", " ".join(edited)))
    return out


def _brute(texts, at_least=0.6):
    sets = {i: set(t.split()) for i, t in texts if t and t.split()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= at_least}


def _found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, None) for i, t in texts], SCHEMA)
    sets, members = word_classes(df, "id", [F.col("statement"), option_texts(F.col("options_json"))])
    pairs = similar_classes(sets, 0.6, **kw)
    return {tuple(r) for r in duplicate_pairs(pairs, members).collect()}, pairs, members


def test_matches_brute_force(spark):
    texts = _texts(1, 60) + [("c1", "raro0x1 raro0x2"), ("c2", "raro0x2 raro0x1"), ("c3", "RARO0X1 ráro0x2"), ("n", None), ("e", ""), ("p", "...")]
    got, _, _ = _found(spark, texts)
    want = _brute([(i, "raro0x1 raro0x2" if i.startswith("c") else t) for i, t in texts if i != "p"])
    assert got == want and len(want) > 40


def test_records_of_common_words_only(spark):
    """No selective words at all: the exact way by prefixes finds every pair."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = [(f"t{i:03}", " ".join(sorted(rng.sample(words, 14)))) for i in range(120)]
    got, _, _ = _found(spark, texts, pairs=0)
    assert got == _brute(texts) and got


def test_copies_are_one_class(spark):
    texts = [(f"a{i:03}", "um dois três quatro") for i in range(200)] + [("b", "um dois três quatro cinco"), ("a000", "um dois três quatro")]
    got, pairs, members = _found(spark, texts)
    assert pairs.count() == 1 and len(got) == 200 * 199 // 2 + 200
    groups = duplicate_groups(pairs, members)
    assert groups.count() == 201 and groups.select("group_id").distinct().count() == 1


def test_options_of_any_shape(spark):
    data = ['[{"letter": "A", "text": "um"}]', '[{"LETRA": "A", "Texto": "d\\u00f3is"}]', "broken", None, "[]", '[{"letter": null, "text": null}]']
    df = spark.createDataFrame([(x,) for x in data], "j string")
    assert [r[0] for r in df.select(F.coalesce(option_texts(F.col("j")), F.lit(""))).collect()] == ["um", "dóis", "", "", "", ""]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    sets, members = word_classes(df, "id", [F.col("statement")])
    assert rows(duplicate_groups(similar_classes(sets, 0.6), members)) == []


def test_many_copies_with_other_selective_words(spark):
    """Copies whose own words are too common to be selective, and whose selective words are other ones each."""
    rng = random.Random(3)
    base = [f"grupo{i}" for i in range(60)]
    texts = []
    for i in range(150):
        kept = rng.sample(base, 53)
        texts.append((f"g{i:03}", " ".join(kept + [f"par{i // 2 if i % 2 else i // 2 + 100}x{k}" for k in range(4)])))
        texts.append((f"h{i:03}", " ".join([f"par{i // 2 if i % 2 else i // 2 + 100}x{k}" for k in range(4)] + [f"outro{i}x{k}" for k in range(20)])))
    got, _, _ = _found(spark, texts)
    assert got == _brute(texts) and len(got) > 5_000


def test_long_records_with_many_differing_selective_words(spark):
    """195 words of which 160 are shared: every word that differs is selective, and so are shared ones."""
    rng = random.Random(4)
    pool = [f"base{i}" for i in range(400)]
    texts = []
    for g in range(30):
        shared = rng.sample(pool, 160)
        texts += [(f"d{g:02}{c}", " ".join(shared + [f"unico{g}{c}{i}" for i in range(35)])) for c in "ab"]
        texts += [(f"x{g:02}", " ".join([f"unico{g}a{i}" for i in range(35)] + rng.sample(pool, 150)))]
    for pairs in (0, 5, 400):
        got, _, _ = _found(spark, texts, pairs=pairs)
        assert got == _brute(texts) and len(got) >= 30


def test_records_of_all_sizes(spark):
    """Frequent words only, of sizes from 1 to 80: several levels and size classes meet."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(120)]
    texts = []
    for g in range(150):
        base = rng.sample(pool, rng.randrange(1, 80))
        texts += [(f"s{g:03}{c}", " ".join(w for w in base if rng.random() > 0.15) or base[0]) for c in "ab"]
        texts.append((f"s{g:03}c", " ".join(base + [f"raro{g}x{i}" for i in range(rng.randrange(0, 12))])))
    for pairs in (0, 30):
        got, _, _ = _found(spark, texts, pairs=pairs)
        assert got == _brute(texts) and len(got) > 100


def test_frequency_by_the_pairs_that_meet(spark, monkeypatch):
    """Words that some records more than usual hold stay selective where segments without them would meet far more."""
    monkeypatch.setattr(neardup, "SAMPLE", 400, raising=False)
    rng = random.Random(9)
    usual, pool, texts = [f"w{i}" for i in range(16)], [f"p{i}" for i in range(400)], []
    for g in range(1200):
        words = rng.sample(usual, 13) + rng.sample(pool, 8)
        texts.append((f"f{g:04}a", " ".join(words)))
        if g % 10 == 0:
            texts.append((f"f{g:04}b", " ".join(words[:-2] + [f"novo{g}"])))
    got, _, _ = _found(spark, texts, pairs=40)
    assert got == _brute(texts) and len(got) >= 120
    sets = word_classes(spark.createDataFrame([(i, t, None) for i, t in texts], SCHEMA), "id", [F.col("statement")])[0]
    cut = neardup._plan_cuts(sets, 0.6, 40)
    met = Counter()
    for b in neardup._keys(iter(sets.drop("rep").toArrow().combine_chunks().to_batches()), cut, True, True):
        met.update(b["v"].to_pylist())
    ratio = sum(c * c for c in met.values()) / len(texts)
    assert ratio < 500, ratio  # 2149 with the fixed frequency

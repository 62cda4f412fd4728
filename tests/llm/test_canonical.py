from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessela.llm.canonical import clean, edits_allowed, map_terms, match_texts, _probes, _segments
from tests.helpers import rows

REFS = [(1, "Doença de pucafidu tipo 1", ["febre de mineiro tardio"]), (2, "Doença de pucafidu tipo 2", None), (3, "Insuficiência rinocesica direita", []), (4, "Insuficiência rinocesica esquerda", []), (5, "Bamumabrectomia total", []), (6, "Drucomucina 40 mg solução injetável", []), (7, "Migefubite crônica do cólon", [])]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "ref_id bigint, canonical_term string, synonyms array<string>")


@pytest.mark.parametrize(
    ("typed", "ref"),
    [
        ("Doença de pucafidu tipo 1", 1), ("HD: DOENCA DE PUCAFDIU TIPO II", 2), ("pucafidu, d. tp II", 2), ("dc. de pucafidus t. 1 - rever", 1), ("febre  de mineiro tardo", 1), ("insf. rinoces. E", 4), ("rinocesicaD, insuf.", 3),
        ("bam umabrect0mia tot. (ver)", 5), ("Totalbamumabrectomia", 5), ("drucomucin440MG sol.inj.", 6), ("crônica cólon - MIGEFUBITE cid?", 7), ("migefubites cca docolon", 7), ("doença de pucafidu tipo 3", None), ("insuficiência rinocesica", None),
        ("tosse de mineiro tardio", None), ("lote 4471", None), ("", None), (None, None), ("???", None), ("x" * 5000, None),
    ],
)
def test_typed_names(spark, refs, typed, ref):
    terms = spark.createDataFrame([(1, typed, None, None)], "id bigint, term string, normalized_term string, canonical_term string")
    assert map_terms(terms, refs).first()["ref_id"] == ref


def test_fields_in_turn_and_repeats(spark, refs):
    terms = spark.createDataFrame([(1, "zzz", None, "bamumabrectomia total"), (2, None, "bamumabrectomia total", "Doença de pucafidu tipo 1"), (2, None, "bamumabrectomia total", "Doença de pucafidu tipo 1")], "id bigint, term string, normalized_term string, canonical_term string")
    assert rows(map_terms(terms, refs).select("id", "ref_id", "field")) == sorted([("canonical_term", 1, 5), ("normalized_term", 2, 5)])


def test_pigeonhole_loses_nothing(spark):
    """Every pair within the edits allowed meets in the join."""
    rng = random.Random(1)
    refs = ["".join(rng.choice("abcd") for _ in range(rng.randrange(6, 24))) for _ in range(60)]
    typed = set()
    for r in refs:
        for _ in range(8):
            s = list(r)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(s))
                rng.choice((lambda: s.insert(at, "b"), lambda: s.pop(at), lambda: s.__setitem__(at, "c")))()
            typed.add("".join(s))
    s = spark.createDataFrame([(r,) for r in set(refs)], "s string")
    t = spark.createDataFrame([(x,) for x in typed if x], "t string")
    k = edits_allowed(F.length("s"))
    want = t.join(s, F.levenshtein("t", "s") <= k).select("t", "s").distinct()
    met = _probes(t).join(_segments(s), ["n", "i", "seg"]).select("t", "s").distinct()
    assert want.join(met, ["t", "s"], "left_anti").count() == 0 and want.count() > 100


def test_clean(spark):
    got = spark.range(1).select(clean(F.lit("Pcte c/ Z1nipanica 10MGsol. inj. !!")).alias("c")).first()["c"]
    assert got == "zinipanica 10 mg solucao injetavel"


def test_no_references(spark, refs):
    texts = spark.createDataFrame([("Bamumabrectomia total",)], "x string")
    assert match_texts(texts, "x", refs.limit(0)).count() == 0


def test_edits_in_short_names(spark):
    """A letter more, less or other and a swap are seen in short names too, unless two entries are as near."""
    refs = spark.createDataFrame([(1, "Asma", []), (2, "Gota", []), (3, "Dengue", []), (4, "Tosse", []), (5, "Posse", [])], "ref_id bigint, canonical_term string, synonyms array<string>")
    typed = {"Asmma": 1, "Gotaa": 2, "Dengeu": 3, "dengu": 3, "tose": 4, "Nosse": None, "Asno": None, "Goat": None}
    terms = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(typed)], "id bigint, term string, normalized_term string, canonical_term string")
    got = {r["id"]: r["ref_id"] for r in map_terms(terms, refs).collect()}
    assert [got[i] for i in range(len(typed))] == list(typed.values())

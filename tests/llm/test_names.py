from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessela.llm.names import bands_for, edits, name_classes, name_likeness, name_words, similar_names, star_clusters


def test_edits():
    assert [edits(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("", "ab"), ("abcd", "xbcy"))] == [0, 1, 1, 2, 2]


def test_bands_reach_the_recall():
    b = bands_for(0.42, 0.97, 3)
    assert 1 - (1 - 0.42**3) ** b >= 0.97 > 1 - (1 - 0.42**3) ** (b - 1)


@pytest.mark.parametrize(
    ("a", "b", "alike"),
    [
        ("otaviano lizoritri lucefedre", "lucefedre o l", True), ("otaviano lizoritri lucefedre", "otaviano lucefedre", True), ("otaviano lizoritri lucefedre", "lizoritir lucefedre otaviano", True),
        ("otaviano lizoritri lucefedre", "guilhermina lizoritri lucefedre", False), ("g lizoritri lucefedre", "otaviano lizoritri lucefedre", False), ("universidade estadual batipudri", "univ est batipudri", True),
        ("universidade estadual batipudri", "universidade federal batipudri", False), ("bca exam nitriimine", "banca examinadora nitrimine", True), ("o l", "otaviano lucefedre", False),
    ],
)
def test_likeness(a, b, alike):
    assert (name_likeness(a.split(), b.split()) >= 0.8) == alike == (name_likeness(b.split(), a.split()) >= 0.8)


def test_words(spark):
    df = spark.createDataFrame([("Profa. Dra. Tiãozinho de Souza (XYZ)",), ("N/A",), ("-",), (None,), ("BEPLEG - Banca Examinadora",), ("Tavinho Lima",)], "n string")
    assert [r[0] for r in df.select(name_words(F.col("n"), True)).collect()] == [["tiaozinho", "souza"], [], [], [], ["banca", "examinadora"], ["otaviano", "lima"]]


def test_clusters(spark):
    names = ["Inocêncio Vaplitruri Delibero"] * 3 + ["Prof. I. Vaplitruri Delibero", "DELIBERO, I. V.", "Vapliitruri Delibero Inocencio", "Bernadete Vaplitruri Delibero", "Bernadete V. Delibero", "Delibero, Bernadete Vaplitruri", None, "", "vários", "Inocêncio Vaplitruri Delibero "]
    df = spark.createDataFrame([(n, n) for n in names], "p string, o string")
    strings, classes = name_classes(df, {"p": True, "o": False})
    c = strings.join(star_clusters(classes, similar_names(classes)), ["field", "rep"]).where("field = 'p'").collect()
    groups = {}
    for r in c:
        groups.setdefault(r["centre"], set()).add(r["name"])
    assert sorted(map(len, groups.values())) == [3, 5]


def test_hot_word_and_no_links(spark):
    """A word that most names hold isn't enough to compare them all; names without a link are their own centre."""
    df = spark.createDataFrame([(f"Hospital Comum {a}{b}ra{b}{a}vo",) for a in "bcdfglmnprst" for b in "bcdfglmnprst"], "p string")
    _, classes = name_classes(df, {"p": False})
    links = similar_names(classes, most=20)
    assert links.count() < 144 * 10
    assert star_clusters(classes, links.limit(0)).where("rep = centre").count() == classes.count()


def test_common_words_with_a_typo_or_an_initial(spark):
    """Given name and surname are both held by more names than ``most``; their variants are candidates nevertheless."""
    names = [f"Maria {x}{y}lotrivu" for x in "bcdfg" for y in "aeiou"] + [f"{x}{y}pedrinque Santos" for x in "bcdfg" for y in "aeiou"] + ["Maria Santos", "Mraia Santos", "M. Santos", "Naria Santos", "Santos"]
    _, classes = name_classes(spark.createDataFrame([(n,) for n in names], "p string"), {"p": True})
    links = {(r["a"], r["b"]) for r in similar_names(classes, most=10).collect()}
    every = {r["rep"]: r["ws"] for r in classes.collect()}
    assert links == {(a, b) for a in every for b in every if a < b and name_likeness(every[a], every[b]) >= 0.8}
    assert {("m santos", "maria santos"), ("maria santos", "mraia santos"), ("maria santos", "naria santos")} <= links


def test_words_that_half_of_all_names_hold(spark):
    """A given name and a surname of 400 names each: spelling, swap, and initial are all linked."""
    syllables = [a + b for a in "bcdfglmnprst" for b in ("ava", "eto", "iru")]
    pick = [f"{x}{y}" for x in syllables for y in syllables][:800]
    names = [f"Maria {x}" for x in pick[:400]] + [f"{x} Silveira" for x in pick[400:]] + ["Maria Silveira", "Maria Silvera", "Mraia Silveira", "M. Silveira"]
    _, classes = name_classes(spark.createDataFrame([(n,) for n in names], "p string"), {"p": True})
    four = {"maria silveira", "maria silvera", "mraia silveira", "m silveira"}
    found = {(r["a"], r["b"]) for r in similar_names(classes).collect()}
    assert {(a, b) for a in four for b in four if a < b} - found == set()


def test_long_chain_of_names(spark):
    """Names linked in a row, each outranked by the next: as sequential star clustering decides."""
    n = 80
    classes = spark.createDataFrame([("f", f"nome{i:03}", ["abcd"], i) for i in range(n)], "field string, rep string, ws array<string>, uses long")
    links = spark.createDataFrame([("f", f"nome{i:03}", f"nome{i + 1:03}", 0.9) for i in range(n - 1)], "field string, a string, b string, likeness double")
    assert star_clusters(classes, links).select("centre").distinct().count() == 40

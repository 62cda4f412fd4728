from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessela.operators import textual
from tessela.operators import validity as v
from tests.helpers import rows


@pytest.mark.parametrize(("text", "ok"), [(t, False) for t in ("p030", "erbB", "dCb", "umP", "q-1234", "abc", "", None)] + [(t, True) for t in ("CERTO", "Bulbo.", "Ponte", "10 mg/dia", "120/80 mmHg")])
def test_option_text(spark, text, ok):
    assert spark.range(1).select(v.option_ok(F.lit(text).cast("string"))).first()[0] is ok


def _opts(*texts):
    return F.array(*[F.struct(F.lit("ABCDE"[i]).alias("letter"), F.lit(t).alias("text")) for i, t in enumerate(texts)])


def _one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_question_and_card(spark):
    good = _opts("Asma brônquica", "Bronquite", "Gripe forte", "Tosse seca")
    assert _one(spark, v.question_ok(F.lit("Qual o diagnóstico?"), good, F.lit("b")))
    assert not _one(spark, v.question_ok(F.lit("curto"), good, F.lit("b")))
    assert not _one(spark, v.question_ok(F.lit("Qual o diagnóstico?"), good, F.lit("E")))
    assert not _one(spark, v.question_ok(F.lit("Qual o diagnóstico?"), F.lit(None).cast("array<struct<letter:string,text:string>>"), F.lit("A")))
    assert _one(spark, v.card_ok(F.lit("O {{c1::rim}}"), F.lit("x"), F.lit("cloze"))) and not _one(spark, v.card_ok(F.lit("O rim"), F.lit("x"), F.lit("cloze"))) and not _one(spark, v.card_ok(F.lit(" "), F.lit("x"), F.lit("basic")))


def test_lengths_and_grounding(spark):
    o = _opts("aaaa", "bbbbbbbbbbbb", "cccccc")
    got = [_one(spark, v.varied_length(o, F.lit(k), F.lit(i))) for k, i in (("A", 0), ("B", 0), ("B", 1), ("A", 1), ("C", 2), ("Z", 1))]
    assert got == [True, False, True, False, True, True]
    src = F.lit("A insuficiência cardíaca aguda causa falta de ar ao deitar")
    assert _one(spark, v.grounded_share(src, F.lit("Cardiaca aguda xyzw"))) == pytest.approx(2 / 3) and _one(spark, v.grounded_share(src, F.lit("a b"))) == 1
    assert _one(spark, v.grounding_ok(F.lit("falta deitar"), F.lit(None).cast("string"), src, F.lit(0)))
    assert not _one(spark, v.grounding_ok(F.lit("zebra girafa leoa tigre urso lobo gato"), F.lit("pato"), src, F.lit(0)))


def test_context(spark):
    df = spark.createDataFrame([("a", "sem nada\n\ncom febre alta\n\nfebre e tosse\n\n" + "x" * 90), ("b", "um\n\ndois"), ("c", None)], "k string, t string")
    assert rows(v.blocks_in_budget(df, "k", "t", ["febre", "tosse"], 45)) == [("com febre alta\n\nfebre e tosse", "a"), ("um\n\ndois", "b")]


def test_balanced_letters(spark):
    df = spark.range(200).select(F.col("id"), F.lit("g").alias("g"))
    got = [r["target"] for r in v.balanced_letters(df, "g", "id").orderBy("id").collect()]
    assert all(got.count(x) == 40 for x in "ABCDE") and all(len({*got[i : i + 3]}) > 1 for i in range(198))


def test_small_rules(spark):
    assert [_one(spark, v.cycle_of(F.lit(a), F.lit(b))) for a, b in ((1, 1), (9, 1), (1, 9), (5, 5))] == ["mixed", "basic", "clinical", "mixed"]
    assert [_one(spark, v.bands(F.lit(x))) for x in (0.1, 0.3, 0.5, 0.7, 0.9)] == ["baixa", "media", None, "alta", "muito alta"]
    assert [_one(spark, v.skip_term(F.lit(x))) for x in ("ab", "123", "h2o", "Outros", "Fatores de risco", "asma")] == [True, True, True, True, True, False]
    assert _one(spark, v.anchoring(F.lit(0), F.lit(0))) == pytest.approx(0.3)


def test_adjacent_groups(spark):
    data = [("a", i, f"c{i}", vec, "x" * n) for i, (vec, n) in enumerate([([1.0, 0.0], 10), ([1.0, 0.1], 900), ([1.0, 0.0], 5), ([0.0, 1.0], 5), ([0.0, 0.0], 5)])]
    df = spark.createDataFrame(data, "g string, o int, k string, v array<double>, t string")
    got = {r["k"]: r["group_no"] for r in textual.adjacent_groups(df, "g", "o", "k", "v", "t").collect()}
    assert got == {"c0": 0, "c1": 0, "c2": 1, "c3": 2, "c4": 3}


def test_best_parent_ties_take_the_first(spark):
    t = spark.createDataFrame([("g", "dor torácica aguda")], "g string, theme string")
    p = spark.createDataFrame([("g", "dor aguda", 2), ("g", "aguda dor", 1), ("h", "dor torácica aguda", 0)], "g string, topic string, o int")
    assert rows(v.best_parent(t, "theme", p, "topic", "o", "g")) == [(2, "dor torácica aguda", "aguda dor")]


def test_notes_and_lines(spark):
    assert [_one(spark, v.note_unit(F.lit(x))) for x in ("Fonte: autor", "Tabela 1: valores", "  ", "Texto comum", "Referências")] == [True, True, True, False, True]
    assert [_one(spark, v.furniture_line(F.lit(x))) for x in ("Página 3 de 10", "- 4 -", "CARTÃO RESPOSTA", "01 A B C D E", "1234567", "A página em branco")] == [True, True, True, True, True, False]
    assert [_one(spark, v.third_party(F.lit(x))) for x in ("Banco Local", " ", "Editora X")] == [False, False, True]

"""Value tests of the operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessela.functions import clean, vector
from tessela.functions.text import fold, squeeze
from tessela.operators import exams, filters, joins, ner, ordering, review, textual
from tessela.operators.components import connected_components
from tests.helpers import rows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<double>")


def test_cosine(spark):
    r = one(spark, same=vector.cosine(arr(1.0, 2.0, 3.0), arr(1.0, 2.0, 3.0)), right=vector.cosine(arr(1.0, 0.0), arr(0.0, 1.0)), other=vector.cosine(arr(1.0, 2.0, 3.0), arr(1.0, 2.0)), none=vector.cosine(F.lit(None).cast("array<double>"), arr(1.0)), empty=vector.cosine(arr(), arr()))
    assert r["same"] == pytest.approx(1) and (r["right"], r["other"], r["none"], r["empty"]) == (0, 0, 0, 0)


def test_lexical_and_hybrid(spark):
    t = F.lit("Paciente com infarto agudo do miocárdio")
    r = one(spark, all=vector.lexical_score(F.lit("infarto agudo miocárdio"), t), two=vector.lexical_score(F.lit("infarto agudo asma"), t), none=vector.lexical_score(F.lit("de o a"), t), h=vector.hybrid(F.lit(0.8), F.lit(0.5)))
    assert (r["all"], r["none"]) == (1.0, 0.0) and r["two"] == pytest.approx(2 / 3) and r["h"] == pytest.approx(0.71)


def test_clean(spark):
    r = one(spark, f=fold(F.lit("ÁÉÎõç é")), s=squeeze(F.lit("  a   b\n")), t=clean.token_estimate(F.lit("12345678")), n=clean.token_estimate(F.lit(None).cast("string")), c=clean.truncate(F.lit("x" * 800), 600), k=clean.canonical_key(F.lit("CID-10"), F.lit("E11"), F.lit("x")), a=clean.canonical_key(F.lit(None), F.lit(None), F.lit("Asma")), i=clean.icd_code(F.lit("a001")), m=clean.mojibake(F.lit("ação".encode().decode("latin-1"))), d=clean.document(F.lit("a \r\n\r\n\r\n\r\nb\x07")), j=clean.loose_json(F.lit('x ```json {"a": [1]} ```')))
    assert (r["f"], r["s"], r["t"], r["n"], len(r["c"])) == ("aeioc e", "a b", 2, 0, 601)
    assert (r["k"], r["a"], r["i"], r["m"], r["d"], r["j"]) == ("CID-10:E11", "asma", "A00.1", "ação", "a\n\nb", '{"a": [1]}')


def test_cloze(spark):
    t = F.lit("O {{c2::rim::órgão}} e o {{c1::baço}}")
    assert tuple(one(spark, p=clean.strip_cloze(t), n=clean.next_cloze(t), z=clean.next_cloze(F.lit("x")))) == ("O rim e o baço", 3, 1)


def test_chunks():
    assert textual.chunks_of("  ") == [] and textual.chunks_of(None) == [] and textual.chunks_of("curto") == ["curto"]
    pars = "\n\n".join(f"Parágrafo {i} com algum texto." for i in range(20))
    got = textual.chunks_of(pars, 50, 10)
    assert len(got) > 1 and all(b.startswith(a[-40:]) for a, b in zip(got, got[1:]))
    long = " ".join(f"Frase número {i}." for i in range(200))
    assert all(len(c) <= 200 for c in textual.chunks_of(long, 50, 10))


def test_common_run():
    assert textual.longest_common_run("a b c d".split(), "x b c y".split()) == (2, "b c")
    assert textual.longest_common_run([], ["a"]) == (0, "")


def test_coverage_units():
    assert textual.coverage_units("") == []
    head = "Título da aula de hoje\n1. Primeiro item com texto\n2. Segundo item com texto\n3. Terceiro"
    assert [k for k, _, _ in textual.coverage_units(head)] == ["numbered"] * 3
    big = [("paragraph", " ".join(f"Uma frase de seis palavras {i}." for i in range(60)), 360)]
    parts = textual.balance_units(big)
    assert sum(n for *_, n in parts) == 360 and all(n <= 150 for *_, n in parts)


def test_risk_and_legible(spark):
    r = one(spark, a=filters.is_risky(F.lit("usar em dose de 500mg")), b=filters.is_risky(F.lit("texto calmo")), c=filters.is_risky(F.lit(None).cast("string")), d=filters.is_legible(F.lit("palavras legíveis em quantidade suficiente para que o texto conte como bom")), e=filters.is_legible(F.lit("�" * 80)))
    assert tuple(r) == (True, False, False, True, False)


def test_search_predicates(spark):
    df = spark.createDataFrame([(1, "Ação 100%", ["x"]), (2, None, ["Ácido"]), (3, "b", None)], "id int, t string, tags array<string>")
    ids = lambda c: sorted(r["id"] for r in df.where(c).collect())
    assert ids(filters.text_search("100%", [F.col("t")], [F.col("tags")])) == [1]
    assert ids(filters.text_search(" ", [F.col("t")])) == [1, 2, 3]
    assert ids(filters.folded_search("ACIDO", [F.col("t")], [F.col("tags")])) == [2]


def test_batch_lookup_keeps_order_and_misses(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    got = [(r["ordinal"], r["k"], r["v"]) for r in filters.batch_lookup(df, "k", ["b", "z", "a", "b"]).orderBy("ordinal").collect()]
    assert got == [(0, "b", 2), (1, "z", None), (2, "a", 1), (3, "b", 2)]


def test_tree(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", " "), ("x", "y"), ("y", "x")], "k string, p string")
    assert rows(filters.tree_levels(df, "k", "p")) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]


def test_windows(spark):
    day = dt.date(2024, 1, 10)
    df = spark.createDataFrame([("u", day - dt.timedelta(days=i)) for i in (1, 2, 3, 5)] + [("v", day - dt.timedelta(days=4)), ("w", None)], "g string, d date")
    assert rows(ordering.current_streak(df, ["g"], "d", "2024-01-10")) == [("u", 3), ("v", 0)]
    costs = spark.createDataFrame([(i, 400) for i in range(15)], "i int, c int")
    assert ordering.budget_prefix(costs.withColumn("g", F.lit(1)), ["g"], [F.asc("i")], F.col("c"), 4500).count() == 11
    assert ordering.budget_prefix(costs.withColumn("g", F.lit(1)), ["g"], [F.asc("i")], F.col("c"), 10).count() == 1
    tied = spark.createDataFrame([("k", 5, i) for i in range(100)], "k string, v int, i int")
    assert ordering.best_per_key(tied, ["k"], [F.desc("v"), F.asc("i")], 3).agg(F.sum("i")).first()[0] == 3


def test_graph_both_directions_and_filter(spark):
    e = spark.createDataFrame([("1", "captopril", "trata", "has", 2), ("2", "captopril", "causa", "tosse", 1), ("3", "x", "trata", "captopril", None)], "id string, source_code string, predicate string, target_code string, occurrence_count int")
    n = spark.createDataFrame([("has", "Hipertensão", "DOENCA")], "canonical_code string, display_text string, type string")
    assert joins.neighbours(e, n, "captopril").count() == 3
    got = {(r["direction"], r["label"], r["weight"]) for r in joins.neighbours(e, n, "captopril", "trata").collect()}
    assert got == {("out", "Hipertensão", 2), ("in", "x", 1)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)], "a long, b long")
    c = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    assert {c[i] for i in (1, 2, 3, 4)} == {1} and c[9] == c[8] == 8 and c[150] == 100 and c[240] == 200 and 5 not in c
    assert connected_components(e.limit(0), "a", "b").count() == 0


def test_spans(spark):
    items = spark.createDataFrame([("d", "i1", 0, 10), ("d", "i2", 5, 30)], "doc string, item string, istart int, iend int")
    spans = spark.createDataFrame([("d", 6, 9), ("d", 12, 20), ("e", 1, 2)], "doc string, start int, end int")
    assert {(r["start"], r["item"]) for r in joins.contained(spans, items, "doc").collect()} == {(6, "i1"), (12, "i2")}
    m = spark.createDataFrame([("d", 8, 11)], "doc string, mstart int, mend int")
    assert rows(joins.gaps(spans, m, "doc").select("doc", "start")) == [("d", 12), ("e", 1)]
    local = spark.createDataFrame([("d", 0, 8, "diabetes", None)], "doc string, start int, end int, text string, code string")
    ai = spark.createDataFrame([("d", 0, 8, "diabetes", "E11"), ("d", 20, 31, "hipertensao", "I10")], "doc string, start int, end int, text string, code string")
    assert {(r["text"], r["code"]) for r in joins.enrich_or_append(local, ai, "doc").collect()} == {("diabetes", "E11"), ("hipertensao", "I10")}


def test_fuzzy(spark):
    w = spark.createDataFrame([(1, "musculu"), (2, "cefaleya"), (3, "asma"), (4, "zzzzzz")], "i int, word string")
    t = spark.createDataFrame([("musculo",), ("cefaleia",), ("has",)], "term string")
    assert {(r["i"], r["term"]) for r in joins.fuzzy_lookup(w, t, "i", "word", "term").collect()} == {(1, "musculo"), (2, "cefaleia")}


def test_upsert_and_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("o", F.lit(None).cast("int"))
    ch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "n", 1)], "k int, v string, o int")
    once = joins.upsert(base, ch, "k", "o")
    assert rows(once) == [(1, "a"), (2, "y"), (3, "n")]
    assert rows(joins.upsert(once.withColumn("o", F.lit(None).cast("int")), ch, "k", "o")) == rows(once)
    assert {tuple(r) for r in joins.snapshot_changes(base, once, "k", ["v"]).collect()} == {(2, "update"), (3, "create")}


def state(spark, **kw):
    full = dict(status="new", interval=0, ease_factor=2.5, repetitions=0, lapses=0, learning_step=0, relearning_step=0) | kw
    return F.struct(*[F.lit(v).alias(k) for k, v in full.items()])


@pytest.mark.parametrize(
    ("start", "rating", "want"),
    [
        ({}, 1, ("learning", 0, 2.5, 1)), ({}, 2, ("learning", 0, 2.5, 6)), ({}, 3, ("learning", 0, 2.5, 10)), ({}, 4, ("review", 4, 2.5, 0)),
        ({"status": "learning", "learning_step": 1}, 3, ("review", 1, 2.5, 0)),
        ({"status": "review", "interval": 10, "repetitions": 3}, 1, ("relearning", 0, 2.3, 10)), ({"status": "review", "interval": 10}, 2, ("review", 12, 2.35, 0)),
        ({"status": "review", "interval": 10}, 3, ("review", 25, 2.5, 0)), ({"status": "review", "interval": 10}, 4, ("review", 34, 2.65, 0)),
        ({"status": "review", "interval": 36500}, 4, ("review", 36500, 2.65, 0)), ({"status": "review", "interval": 5, "ease_factor": 1.3}, 1, ("relearning", 0, 1.3, 10)),
        ({"status": "relearning", "interval": 0}, 3, ("review", 1, 2.5, 0)), ({"status": "relearning", "interval": 10}, 4, ("review", 13, 2.5, 0)),
    ],
)
def test_scheduler(spark, start, rating, want):
    s = spark.range(1).select(review.next_state(state(spark, **start), F.lit(rating)).alias("s")).first()["s"]
    assert (s["status"], s["interval"], s["ease_factor"], s["minutes"]) == want


def test_kpis_of_nothing(spark):
    df = spark.createDataFrame([], "rating int, seconds double, d date")
    assert tuple(review.study_kpis(df, "rating", "seconds", F.col("d") == F.current_date()).first()) == (0, 100.0, 0.0)


def test_ner_forms_agree(spark):
    d = ner.dictionary(spark.createDataFrame([("Infarto",), ("infarto agudo do miocárdio",), ("Miocárdio",), (None,), (" ",)], "t string"), "t")
    texts = spark.createDataFrame([(1, "Paciente com INFARTO agudo do miocárdio grave."), (2, None), (3, ""), (4, "infartos")], "id int, text string")
    a, b = ner.ngram_matches(texts, "id", "text", d), ner.automaton_matches(texts, "id", "text", d)
    assert rows(a) == rows(b) and a.count() == 3
    kept = ner.resolve_overlaps(a, "id").collect()
    assert [(r["first"], r["last"]) for r in kept] == [(2, 5)]


def test_stems_hide_no_trigger():
    """The stems that a sentence is first searched for are in every match of their pattern."""
    said = "pode causar e podem levar a x; o tratamento consiste em y; fatores de risco para z; manifesta-se com; age sobre; reduz o risco de; e classificada como; tipos de dor e sua classificacao; prevalencia em; evolui para; complicacao de; prognostico bom; faz parte de; compoe a; mais comum em; de escolha para; contraindicado em"
    hits = [(name, m.group()) for name, pattern, stems in ner._TRIGGERS for m in pattern.finditer(said) if any(x in m.group() for x in stems)]
    assert hits == [(name, m.group()) for name, pattern, _ in ner._TRIGGERS for m in pattern.finditer(said)] and len({n for n, _ in hits}) > 10


def _spans(sentence, *names):
    words = sentence.replace(",", " ").replace(".", " ").split()
    out = []
    for name in names:
        n = len(name.split())
        out += [(i, i + n - 1, name) for i in range(len(words)) if " ".join(words[i : i + n]) == name]
    return sorted(out)


def test_relations():
    def found(sentence, *names):
        return [r[:3] for r in ner.relations_in(sentence, _spans(sentence, *names))]

    s = "a hipertensao e o diabetes tipo 2 sao fatores de risco para o avc, que causa dispneia."
    assert found(s, "hipertensao", "diabetes tipo 2", "avc", "dispneia") == [("hipertensao", "FATOR_DE_RISCO", "avc"), ("diabetes tipo 2", "FATOR_DE_RISCO", "avc"), ("avc", "CAUSA", "dispneia")]
    assert found("a febre causa febre e asma", "febre", "asma") == [("febre", "CAUSA", "asma")]
    assert found("a metformina nao causa hipoglicemia", "metformina", "hipoglicemia") == [("metformina", "NEGACAO_CAUSA", "hipoglicemia")]
    assert found("nao se sabe se a febre causa asma e tosse", "febre", "asma", "tosse") == [("febre", "CAUSA", "asma"), ("febre", "CAUSA", "tosse")]
    assert found("o choque apresenta prognostico reservado no infarto", "choque", "infarto") == [("choque", "PROGNOSTICO", "infarto")]
    assert found("o diabetes pode evoluir para insuficiencia", "diabetes", "insuficiencia") == [("diabetes", "COMPLICACAO", "insuficiencia")]
    assert found("a febre e a tosse", "febre", "tosse") == found("causa febre", "febre") == []


def test_relations_of_texts(spark):
    entries = ner.dictionary(spark.createDataFrame([("Febre",), ("tosse seca",), ("Asma",), ("paciente",)], "t string"), "t")
    texts = spark.createDataFrame([(1, "A febre causa tosse seca. A asma não causa febre! O paciente causa asma."), (2, None), (3, "Febre.\nCausa asma.")], "id int, t string")
    got = {tuple(r) for r in ner.relations(texts, "id", "t", entries).collect()}
    assert got == {(1, 0, "febre", "CAUSA", "tosse seca", "causa"), (1, 1, "asma", "NEGACAO_CAUSA", "febre", "causa")}


def test_long_entries_in_both_forms(spark):
    name = " ".join(f"palavra{i}" for i in range(12))
    entries = ner.dictionary(spark.createDataFrame([(name,), ("asma",)], "t string"), "t")
    texts = spark.createDataFrame([(1, f"antes {name} depois asma"), (2, "")], "id int, t string")
    a, b = ner.ngram_matches(texts, "id", "t", entries), ner.automaton_matches(texts, "id", "t", entries)
    assert rows(a) == rows(b) and a.count() == 2
    assert rows(ner.coverage_ratio(texts, "id", "t", a).select("id", "ratio"))[1] == (2, 0.0)


def test_budget_of_a_hot_group(spark):
    """A third of all rows in one group, single rows over the budget in between: as a running sum says."""
    costs = [(i, "hot" if i % 3 else f"g{i % 5}", (i * 37) % 90 + (5_000 if i % 211 == 7 else 0)) for i in range(3_000)]
    df = spark.createDataFrame(costs, "i int, g string, c int")
    want, used = set(), {}
    for i, g, c in costs:
        before = used.get(g)
        used[g] = (before or 0) + c
        if before is None or used[g] <= 2_500:
            want.add((i, used[g]))
    assert {(r["i"], r["used"]) for r in ordering.budget_prefix(df, ["g"], [F.asc("i")], F.col("c"), 2_500).collect()} == want


def test_even_split(spark):
    df = spark.createDataFrame([(i, None if i < 3 else "a" if i < 300 else "b") for i in range(310)], "i int, g string")
    got = {r["i"]: r["quota"] for r in ordering.even_split(df, ["g"], ["i"], [F.asc("i")], 100).collect()}
    assert [got[i] for i in range(3)] == [34, 33, 33] and [got[i] for i in (300, 309)] == [10, 10]
    assert sum(got[i] for i in range(3, 300)) == 100 and got[3] == got[102] == 1 and got[103] == 0


def test_common_run_as_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in "ab")
        best = max((n, -i) for i in range(len(a) + 1) for n in range(len(a) - i + 1) if n == 0 or any(a[i : i + n] == b[j : j + n] for j in range(len(b))))
        n, at = best[0], -best[1]
        assert textual.longest_common_run(a, b) == (n, " ".join(a[at : at + n]))


def test_deep_tree(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x")], "k string, p string")
    assert filters.tree_levels(df, "k", "p").count() == 40


def test_exam_split():
    text = "1. Qual o diagnóstico mais provável?\nA) Asma\nB) Bronquite\nC) Gripe\nD) Tosse\nE) Febre\n\nGABARITO: 1-A"
    ((n, s, o, k),) = exams.split_exam(text)
    assert (n, len(o), k) == (1, 5, "A") and s.startswith("Qual")
    ((n, _, o, k),) = exams.split_exam("QUESTÃO 12 Assinale\n(O) um\n( ) dois\n(O) três\n(O) quatro")
    assert (n, [x for x, _ in o], k) == (12, list("ABCD"), None)
    assert exams.split_exam(None) == [] and exams.split_exam("sem questões") == []


def test_grade(spark):
    def g(statement, *texts):
        opts = F.array(*[F.struct(F.lit("ABCDEFG"[i]).alias("letter"), F.lit(t).alias("text")) for i, t in enumerate(texts)]) if texts else F.array().cast("array<struct<letter:string,text:string>>")
        return one(spark, g=exams.grade(F.lit(statement), opts))["g"]

    long = "Um enunciado de tamanho bastante"
    assert [g("curto", "a", "b"), g(long), g(long, "CERTO", "ERRADO"), g(long, "a", "b"), g(long, "a", "b", "c"), g(long, *"abcd"), g(long, *"abcdef"), g(long, "a", "b", "c", ""), g(long, "a", "b", "c", "x" * 100)] == ["low", "low", "high", "low", "medium", "high", "low", "low", "low"]


def test_layout(spark):
    items = spark.createDataFrame([(1, "mundo", 50.0, 10.5), (1, "Olá", 5.0, 10.0), (1, "fim", 5.0, 30.0)], "page int, text string, x double, y double")
    assert [r["text"] for r in exams.lines_from_items(items, ["page"]).orderBy("line_no").collect()] == ["Olá mundo", "fim"]
    boxes = items.withColumn("height", F.lit(8.0))
    assert [r["text"] for r in exams.lines_from_boxes(boxes, ["page"]).orderBy("line_no").collect()] == ["Olá mundo", "fim"]


def test_relettered(spark):
    o = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(t).alias("text")) for x, t in zip("ABC", ("certa", "x", "y"))])
    assert [(p["letter"], p["text"]) for p in one(spark, o=exams.relettered(o, F.lit("A"), F.lit(2)))["o"]] == [("A", "x"), ("B", "y"), ("C", "certa")]


def test_signals(spark):
    now = dt.datetime(2024, 6, 1)
    df = spark.createDataFrame([("a", now, 1.0), ("a", now, 1.0), ("b", now, 1.5), ("b", now, 1.5), ("c", dt.datetime(2023, 1, 1), 9.0)], "k string, at timestamp, w double")
    assert rows(review.fired_signals(df, "k", F.lit(now), "at", F.col("w"))) == [("b", 3.0)]


def test_greatest_similarity_in_blocks(spark):
    import numpy as np

    from tessela.operators.similarity import greatest_similarity

    rng = np.random.default_rng(5)
    new = [(i, "hot" if i % 3 else f"g{i % 5}", rng.normal(size=4).tolist()) for i in range(300)] + [(900, "hot", None), (901, "hot", [0.0] * 4), (902, "hot", [1.0]), (903, None, [1.0] * 4), (904, "alone", [1.0] * 4)]
    old = [("hot" if i % 2 else f"g{i % 5}", rng.normal(size=4).tolist()) for i in range(200)]
    got = {r["k"]: r["top"] for r in greatest_similarity(spark.createDataFrame(new, "k long, g string, v array<double>"), spark.createDataFrame(old, "g string, v array<double>"), "k", "g", "v", block=16).collect()}
    for k, g, v in new[:300]:
        mine = [np.dot(v, o) / np.linalg.norm(v) / np.linalg.norm(o) for h, o in old if h == g]
        assert got[k] == pytest.approx(max(mine))
    assert got[900] == got[901] == got[902] == 0 and 903 not in got and 904 not in got


def test_gap_recovery(spark):
    entries = ner.dictionary(spark.createDataFrame([("Pneumonia",), ("febre alta",), ("asma",)], "t string"), "t")
    texts = spark.createDataFrame([(1, "Pneumomia com febre alta e qualquer coisa"), (2, "pneumonia"), (3, None)], "id int, t string")
    got = {(r["id"], r["first"], r["last"], r["norm"], r["recovered"]) for r in ner.gap_recovery(texts, "id", "t", entries).collect()}
    assert got == {(1, 0, 0, "pneumonia", True), (1, 2, 3, "febre alta", False), (2, 0, 0, "pneumonia", False)}


def test_confusion_candidates(spark):
    sets = spark.createDataFrame([("s1", "Cardiologia", ["arritmia"], ["Fibrilação", "Flutter"]), ("s2", "", ["tosse seca"], ["Asma", "Bronquite", None]), ("s3", "Pediatria", ["arritmia"], ["Outro"])], "set_id string, specialty string, context array<string>, members array<string>")
    asked = spark.createDataFrame([(1, "FIBRILACAO", None, None), (2, "x", "Cardiologia Clínica", ["Arritmias"]), (3, None, "", ["tosse"]), (4, "nada", "", ["nada"])], "id int, answer string, specialty string, topics array<string>")
    got = {(r["id"], r["member"], r["set_id"]) for r in joins.confusion_candidates(asked, sets, "id").collect()}
    assert got == {(1, "flutter", "s1"), (2, "fibrilacao", "s1"), (2, "flutter", "s1"), (3, "asma", "s2"), (3, "bronquite", "s2")}


def test_shuffled_options(spark):
    df = spark.createDataFrame([(i, [("A", "um"), ("B", "dois"), ("C", "três"), ("D", "quatro")], {"A": "a", "C": "c"}) for i in range(40)], "i int, o array<struct<letter:string,text:string>>, c map<string,string>")
    placed = df.withColumn("p", exams.shuffled_options(F.col("o"), F.lit("C"), F.lit(1), F.col("i"))).withColumn("m", exams.moved_comments(F.col("p"), F.col("c")))
    seen = set()
    for r in placed.collect():
        assert [x["letter"] for x in r["p"]] == list("ABCD") and r["p"][1]["text"] == "três" and {(x["was"], x["text"]) for x in r["p"]} == {tuple(x) for x in r["o"]}
        assert r["m"] == {x["letter"]: r["c"][x["was"]] for x in r["p"] if x["was"] in r["c"]}
        seen.add(tuple(x["was"] for x in r["p"]))
    assert len(seen) == 6


def test_boxes_with_corners(spark):
    boxes = spark.createDataFrame([(1, "um", 10.0, 100.0, 20.0, 10.0, 0.9), (1, "dois", 40.0, 101.0, 30.0, 10.0, 0.7), (1, "abaixo", 10.0, 140.0, 50.0, 12.0, 1.0)], "page int, text string, x double, y double, width double, height double, confidence double")
    got = [(r["text"], r["x2"], r["y2"], r["confidence"]) for r in exams.lines_from_boxes(boxes, ["page"]).orderBy("line_no").collect()]
    assert got == [("um dois", 70.0, 111.0, 0.8), ("abaixo", 60.0, 152.0, 1.0)]


def test_versions(spark):
    r = one(spark, a=review.folded_mean(F.array(F.lit(1.0), F.lit(None), F.lit(2.0), F.lit(6.0))), b=review.folded_mean(F.array().cast("array<double>")), c=review.merged_cycle(F.array(F.lit("basic"), F.lit(None), F.lit("basic"))), d=review.merged_cycle(F.array(F.lit("basic"), F.lit("clinical"))))
    assert (r["a"], r["b"], r["c"], r["d"]) == (3.0, None, "basic", "mixed")


def test_question_numbers():
    n = exams.question_number
    assert [n("5"), n("O5"), n("1", 11), n("lá", 14), n("l2"), n("I3"), n("la"), n("2", 22), n("9", 12), n("??", 7), n("400", 0), n("12", 12)] == [5, 5, 11, 14, 12, 13, 14, 22, 9, 7, None, 12]
    text = "QUESTÃO O1 Qual o agente?\nE. coli é comum aqui\nA) E. coli\nB) S. aureus\nQUESTÃO 2 Julgue\nCERTO\nERRADO"
    (a, s, o, _), (b, _, v, _) = exams.split_exam(text)
    assert (a, b) == (1, 2) and s.endswith("aqui") and [x for _, x in o] == ["E. coli", "S. aureus"] and [x for x, _ in v] == ["A", "B"]


def _page(doc, questions, columns):
    """Items of a made page: questions one below the other, in one or two columns."""
    out, half = [], (len(questions) + 1) // 2
    for i, (n, s, options) in enumerate(questions):
        right = columns == 2 and i >= half
        x, y = (330.0 if right else 20.0), 40.0 + 80 * (i - half if right else i) + (7.0 if right else 0.0)
        for k, line in enumerate([f"{n}. {s}", *(f"{'ABCDE'[j]}) {t}" for j, t in enumerate(options))]):
            words = line.split()
            out += [(doc, 1, w, x + (230.0 if columns == 2 else 520.0) * j / max(1, len(words)), y + 14 * k + 0.5 * (j % 2), 20.0, 10.0) for j, w in enumerate(words)]
    return out


@pytest.mark.parametrize("columns", [1, 2])
def test_exam_from_layout(spark, columns):
    """An exact round trip over pages in one and in two columns."""
    questions = [(n, f"enunciado da questao numero {n} com algumas palavras", [f"texto {n}{c}" for c in "abcd"]) for n in range(1, 9)]
    items = spark.createDataFrame(_page("d", questions, columns), "doc string, page int, text string, x double, y double, width double, height double")
    assert exams.in_columns(items, ["doc", "page"]).agg(F.max("column")).first()[0] == columns - 1
    got = [(r["number"], r["statement"], [o["text"] for o in r["options"]]) for r in exams.split_pages(items, "doc", "page").orderBy("number").collect()]
    assert got == questions


def test_sought_texts_of_any_number(spark, monkeypatch):
    """Broadcast only within the bounds, whatever the files' sizes; the same pairs on each way."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 7))) for _ in range(40)]
    names = [(f" {' '.join(rng.choices(words, k=rng.randrange(1, 4))).title()} ",) for _ in range(60)] + [(" ",), (None,)]
    texts = [(i, " ".join(rng.choices(words, k=6)), rng.choice([None, "", rng.choice(words).upper()])) for i in range(150)] + [(999, None, None)]
    left, right = spark.createDataFrame(names, "name string"), spark.createDataFrame(texts, "id long, t string, c string")
    want = {(n, i) for (n,) in names if n and n.strip() for i, *ts in texts if any(t and n.strip().lower() in t.lower() for t in ts)}
    assert len(want) > 50
    for bounds in ({}, {"BROADCAST_ROWS": 5}, {"BROADCAST_BYTES": 5}, {"BROADCAST_ROWS": 5, "KEYS": 5}):
        with monkeypatch.context() as m:
            for k, v in bounds.items():
                m.setattr(joins, k, v, raising=False)
            got = joins.substring_join(left, "name", "name", right, "id", ["t", "c"])
            pairs = [tuple(r) for r in got.collect()]
            assert len(pairs) == len(set(pairs)) and set(pairs) == want, bounds
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == ("KEYS" not in bounds), bounds

from __future__ import annotations

import random

import pytest

from tessela.llm import scanned as s

SENTENCES = ["O paciente costuma apresentar febre baixa vespertina e tosse seca persistente nas primeiras semanas.", "Recomenda-se a reposição hormonal quando o valor de creatinina ultrapassa vinte unidades.", "A recém-descrita doença afeta o intestino e exige diagnóstico bem-sucedido.", "Durante a aula prática os alunos discutiram a conduta inicial com medicamentos comuns.", "O seguimento pós-alta inclui a dosagem de hemoglobina a cada trinta dias de tratamento."]


@pytest.fixture(scope="module")
def models():
    known = {w.lower() for x in SENTENCES for w in s.WORD.findall(x)}
    rng = random.Random(0)
    pseudo = ["".join(rng.choice("bdfgmnprstvz") + rng.choice("aeiou") for _ in range(3)) + rng.choice(("ite", "oma", "ina", "ose")) for _ in range(1500)]
    return s.fit([" ".join(rng.sample(SENTENCES, 3)) for _ in range(60)], pseudo, known)


def test_page(models):
    page = "\n".join(["Caderno de Pediatria · bofade    4", "O paciente costuma apresentar fcbre baixa ves¬", "pertina e t0sse seca persistente nas primeiras", "semanas.", "", "A recém-", "descrita doença afeta o infestino e exige dia-", "- 4 -", "Caderno de Pediatria · bofade    5", "gnóstico bem-", "sucedido.", "", "- 5 -"])
    r = s.repair(page, models)
    assert set(r.kinds) == {(1, "furniture"), (2, "char"), (2, "hyphen"), (3, "char"), (7, "char"), (7, "hyphen"), (8, "furniture"), (9, "furniture"), (13, "furniture")}
    assert r.text == "O paciente costuma apresentar febre baixa vespertina e tosse seca persistente nas primeiras semanas.\n\nA recém-descrita doença afeta o intestino e exige diagnóstico bem-sucedido."


def test_held_out_accuracy(models):
    """Pages that the models haven't seen: damage is found, and clean words are left alone."""
    rng = random.Random(99)
    right = wrong = missed = 0
    for _ in range(300):
        w = rng.choice(sorted(x for x in models.known if len(x) > 5 and x.isalpha()))
        d = s._damage(w, rng)
        if d and d[0] not in models.known:
            right += bool(s.edit_word(d[0], models))
            missed += not s.edit_word(d[0], models)
        p = "".join(rng.choice("bdfgmnprstvz") + rng.choice("aeiou") for _ in range(3)) + "ite"
        wrong += bool(s.edit_word(p, models))
    assert right / (right + missed) > 0.9 and wrong / 300 < 0.05
    hits = total = 0
    for _ in range(60):
        lines, mine = s.training_page([rng.choice(SENTENCES) for _ in range(4)], ["gubavo", "medira"], rng)
        for f, y in zip(s.page_features(lines, models.known), mine):
            if f:
                b, p = models.pages.scores([("body", f), ("furniture", f)])
                hits += (p > b) == y
                total += 1
    assert hits / total > 0.97


def test_nothing_to_do(models):
    assert s.repair("", models).kinds == [] and s.repair("\n \n", models).text == ""
    clean = "O paciente costuma apresentar febre baixa\nvespertina e tosse seca persistente nas primeiras\nsemanas."
    r = s.repair(clean, models)
    assert r.kinds == [] and r.text == clean.replace("\n", " ")
    assert s.repair(clean.replace("\n", "\r\n"), models).text == r.text


def test_only_paged_texts(spark, models):
    df = spark.createDataFrame([("t", "1", "uma linha\noutra linha"), ("t", "2", "x" * 400 + "\ny"), ("t", "3", None), ("t", "4", "  "), ("t", "5", "uma linha só")], "src_table string, row_id string, text string")
    got = s.repair_texts(df, ["src_table", "row_id"], "text", models).collect()
    assert {r["row_id"] for r in got} == {"1"}


def test_very_long_text(models):
    text = "\n".join(SENTENCES[i % 5][:60] for i in range(4000))
    assert len(s.repair(text, models).text) > 100_000


def test_one_long_line_on_a_page(spark, models):
    page = "\n".join(["O paciente costuma apresentar fcbre baixa ves-", "pertina e t0sse seca persistente nas primeiras", "semanas. " + "Durante a aula prática os alunos " * 4, "Recomenda-se a reposição hormonal quando o valor de", "creatinina ultrapassa vinte unidades."])
    assert max(map(len, page.split("\n"))) > s.WIDEST
    got = s.repair_texts(spark.createDataFrame([("1", page)], "row_id string, text string"), ["row_id"], "text", models).first()
    assert {(x["line_no"], x["kind"]) for x in got["damage"]} == {(1, "char"), (1, "hyphen"), (2, "char")}
    assert "febre baixa vespertina e tosse" in got["repaired"]


def test_a_word_with_many_errors(models):
    """Edits go on as long as one gains."""
    w = "h0spita1iza¢ã0"
    edits = s.edit_word(w, models)
    assert len(edits) <= len(w) and len({at for at, _, _ in edits}) == len(edits)

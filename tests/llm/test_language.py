from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessela.llm.language import ByteNet, accuracy, fit, label_code, main_language, segments, windows_of

LEXICON = {
    "pt": "o a os as um uma não você também coração paciente com dor de cabeça e febre apresenta melhora depois da medicação são avaliação muito",
    "es": "el la los las un una no usted también corazón paciente con dolor de cabeza y fiebre presenta mejoría después del medicamento son evaluación mucho",
    "en": "the a an not you also heart patient with headache and fever shows improvement after the medication are assessment very",
    "fr": "le la les un une ne vous aussi coeur patient avec mal de tête et fièvre présente une amélioration après le médicament sont évaluation très",
    "it": "il lo la i gli un una non lei anche cuore paziente con mal di testa e febbre presenta un miglioramento dopo il farmaco sono valutazione molto",
}


def _line(rng, lang, n=16):
    return " ".join(rng.choice(LEXICON[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(700):
        lang = rng.choices(list(LEXICON), (8, 1, 1, 1, 1))[0]
        texts.append("\n".join(_line(rng, lang) for _ in range(2)))
        labels.append(lang if rng.random() > 0.1 else rng.choice(list(LEXICON)))  # wrong labels
    return fit(texts, labels)


def test_held_out_accuracy(net):
    rng = random.Random(2)
    cases = [(_line(rng, lang), lang) for lang in LEXICON for _ in range(60)]
    assert accuracy(net, [t for t, _ in cases], [y for _, y in cases]) >= 0.97
    assert accuracy(net, [t.upper() for t, _ in cases], [y for _, y in cases]) >= 0.97


def test_segments(spark, net):
    rng = random.Random(3)
    mixed = "\n".join([_line(rng, "pt"), "  ", "", _line(rng, "en"), _line(rng, "pt", 300)])
    df = spark.createDataFrame([(1, mixed), (2, None), (3, " \n "), (4, _line(rng, "fr"))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in segments(df, net, "doc_id", "text").withColumn("main", main_language(F.col("segs"))).collect()}
    assert [(x["seg_no"], x["lang"]) for x in got[1]["segs"]] == [(1, "pt"), (2, "en"), (3, "pt")] and got[1]["main"] == "pt"
    assert got[2]["segs"] == got[3]["segs"] == [] and got[2]["main"] is None
    assert all(0 < x["confidence"] <= 1 for x in got[1]["segs"])


def test_labels(spark):
    names = ["pt_BR", "Português", "POR", "es-419", "Español", "eng", "English", "FR", "Français", "ita", "Italiano", "??", "", None, "n/d", "unknown", "de"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(label_code(F.col("n"))).collect()] == ["pt", "pt", "pt", "es", "es", "en", "en", "fr", "fr", "it", "it"] + [None] * 6


def test_whole_text_is_read():
    assert windows_of(b"x" * 300, 128).shape == (3, 128) and windows_of(b"", 128).shape == (1, 128)


def test_gradients():
    """The training step follows the loss: a few steps on one batch lower it."""
    import numpy as np

    rng = np.random.default_rng(0)
    net = ByteNet()
    x, y = rng.integers(1, 255, (64, 128)).astype(np.uint8), rng.integers(0, 5, 64)

    def loss():
        z = net.logits(x)
        return float(-(z[np.arange(64), y] - np.log(np.exp(z).sum(1))).mean())

    before = loss()
    net.train(x, y, 64, rng)
    assert loss() < before / 2


def test_ties_by_code(spark):
    segs = "array<struct<seg_no:bigint,lang:string,confidence:double,n:int>>"
    df = spark.createDataFrame([([(1, "es", 0.9, 10), (2, "en", 0.9, 10)],), ([(1, "it", 0.9, 9), (2, "pt", 0.9, 5), (3, "pt", 0.9, 5)],)], f"segs {segs}")
    assert [r[0] for r in df.select(main_language(F.col("segs"))).collect()] == ["en", "pt"]


def test_short_windows_read_as_filled_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    net, x = ByteNet(), np.zeros((700, 128), np.uint8)
    for i, row in enumerate(x):
        row[: i % 129] = rng.integers(1, 255, i % 129)
    patches = net._patches(x)
    h = (patches.reshape(-1, patches.shape[2]) @ net.w).reshape(len(x), patches.shape[1], -1).max(axis=1) + net.b
    assert np.allclose(net.logits(x), np.maximum(h, 0) @ net.u + net.c, atol=1e-5)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessela.operators import library as lib
from tests.helpers import rows


def _sum(raw: bytes) -> str:
    low = high = 0xFFFF
    for b in raw:
        low = (low + b) % 65535
        high = (high + low) % 65535
    return f"{(high << 16 | low) & 0xFFFFFFFF:08x}"


def test_checksum(spark):
    data = [b"", b"a", b"abc" * 70_000, bytes(range(256)), b"\xff" * 131_073, None]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, c binary").select("i", lib.checksum(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == [None if d is None else _sum(d) for d in data]


def _packed(xs, most):
    out, now = [], ""
    for x in xs:
        if len(now) + 2 + len(x) > most:
            out += [now.strip()] if now.strip() else []
            now = x
        else:
            now = f"{now}\n\n{x}" if now else x
    return out + ([now.strip()] if now.strip() else [])


@pytest.mark.parametrize("sizes", [[], [5], [4, 4, 4], [20, 3, 3], [0, 0], [6, 2, 20, 1, 1]])
def test_packed_excerpts(spark, sizes):
    xs = [chr(97 + i) * n for i, n in enumerate(sizes)]
    got = spark.createDataFrame([(xs,)], "xs array<string>").select(lib.packed_excerpts(F.col("xs"), 12).alias("p")).first()["p"]
    assert got == _packed(xs, 12)


def test_professor_cascade(spark):
    p = spark.createDataFrame([("p1", "Ana", ["d1"], None), ("p2", "Bia", [], ["x"]), ("p3", "Cleo", None, ["Prova.PDF"]), ("p4", None, None, None)], "profile string, name string, documents array<string>, files array<string>")
    q = spark.createDataFrame([("q1", "d1"), ("q2", "p1"), ("q3", "p2"), ("q4", "notas-prova.pdf-2"), ("q5", "aula-cleo"), ("q6", None)], "question string, asset string")
    assert rows(lib.professor_questions(p, q)) == [("p1", "q1"), ("p2", "q3"), ("p3", "q4"), ("p3", "q5")]


def test_orders_by_title(spark):
    d = spark.createDataFrame([("1", "Zebra", True), ("2", "ética", False), ("3", "Abc", None), ("4", "abc", False)], "id string, title string, favorite boolean").withColumn("total", F.lit(0)).withColumn("due", F.lit(0))
    order = lambda mode: [r["id"] for r in d.orderBy(*lib.deck_order(mode)).collect()]
    assert order("title") == ["4", "3", "2", "1"] and order("title_desc") == ["1", "2", "3", "4"] and order("favorite")[0] == "1" and order("none") == ["1", "2", "3", "4"]


def test_categories(spark):
    names = ["Meu Livro", "Prova ENARE", "Banca X", "caso clínico", "nada", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(lib.name_category(F.col("n"))).collect()] == ["book", "residencyExam", "professorExam", "clinicalCase", "other", "other"]
    assert [r[0] for r in df.select(lib.file_category(F.col("n"))).collect()] == ["book", "residencyExam", "other", "other", "other", "other"]


def test_copy_is_the_same_again(spark):
    decks = spark.createDataFrame([("d", "Um", None, None)], "id string, title string, created_at timestamp, updated_at timestamp")
    cards = spark.createDataFrame([("a", "d", None, None), ("b", "d", None, None), ("b", "d", None, None), ("c", "e", None, None)], "id string, deck_id string, created_at timestamp, updated_at timestamp")
    now = F.to_timestamp(F.lit("2025-01-01"))
    (deck, made), (again, _) = lib.copy_deck(decks, cards, "d", now), lib.copy_deck(decks, cards, "d", now)
    r = deck.first()
    assert (r["title"], r["total_cards"]) == ("Um (Cópia)", 2) and r == again.first() and {x["deck_id"] for x in made.collect()} == {r["id"]}

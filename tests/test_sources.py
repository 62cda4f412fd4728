from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessela.sources import readers, sinks
from tessela.streaming import streams
from tests.helpers import rows


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Código TUSS;Termo;Domínio\n1;"a ""b"" ; c";X\n2;d;\n')
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["codigo_tuss", "termo", "dominio"]
    got = readers.resolve(df, {"code": ["codigo", "codigo_tuss"], "text": ["termo"], "none": ["zz"]})
    assert [tuple(r) for r in got.collect()] == [("1", 'a "b" ; c', None), ("2", "d", None)]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert readers.read_delimited(spark, str(tmp_path / "b.csv")).columns == ["x", "y"]
    (tmp_path / "c.csv").write_text("")
    assert readers.read_delimited(spark, str(tmp_path / "c.csv")).count() == 0


def test_positional_latin1(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("SUB;C;D;DESC\nA000;;;Cólera\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_positional(spark, str(tmp_path / "p.csv"), {"code": 0, "name": 3}).collect()] == [("A000", "Cólera")]


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Asma</String></DescriptorName><TreeNumberList><TreeNumber>C08.1</TreeNumber><TreeNumber>A01</TreeNumber></TreeNumberList>"
        "<ConceptList><Concept><TermList><Term><String>Asma</String></Term><Term><String>Asma brônquica</String></Term></TermList></Concept></ConceptList></DescriptorRecord></Set>"
    )
    d = readers.read_descriptors(spark, str(tmp_path / "d.xml"))
    r = d.first()
    assert (r["ui"], r["name"], r["terms"]) == ("D1", "Asma", ["Asma", "Asma brônquica"])
    assert readers.tree_category(d, "ui", "tree_numbers", [("C", "DOENCA"), ("A", "ANATOMIA")]).first()["category"] == "DOENCA"


def test_bundle(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump([{"id": "x", "n": 1}, {"id": "y"}], f)
    assert readers.read_bundle(spark, str(tmp_path / "a.json.gz"), "id string, n int").count() == 2
    (tmp_path / "p.json").write_text(readers.POINTER + "v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        readers.read_bundle(spark, str(tmp_path / "p.json"), "id string")
    assert readers.read_bundle(spark, str(tmp_path / "none.json"), "id string", required=False).count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"decks": [{"id": "d"}], "cards": [{"id": "c", "n": 2}]}))
    back = readers.read_backup(spark, str(tmp_path / "b.json"), {"decks": "id:string", "cards": "id:string,n:int"})
    assert back["cards"].first()["n"] == 2 and back["decks"].count() == 1


def test_texts_and_blobs(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>um\ndois</p>")
    assert readers.read_texts(spark, str(tmp_path / "a.html")).first()["text"] == "<p>um\ndois</p>"
    b = readers.read_blobs(spark, str(tmp_path / "a.html")).first()
    assert b["bytes"] == 14 and len(b["sha256"]) == 64


def test_scan_summary_and_dictionary(spark):
    items = spark.createDataFrame([("a", 1, "x" * 200), ("b", 1, ""), ("b", 2, None)], "doc string, page int, text string")
    assert {(r["doc"], r["is_scanned"]) for r in readers.scan_summary(items, "doc", "page", "text").collect()} == {("a", False), ("b", True)}
    d = spark.createDataFrame([(2, "Asma", None, "J45"), (1, "ásma ", ["Bronquite"], None)], "id int, name string, syn array<string>, code string")
    got = {r["norm"]: (r["canonical"], r["code"]) for r in readers.flatten_dictionary(d, "id", "name", "syn", "code").collect()}
    assert got == {"asma": ("ásma ", "J45"), "bronquite": ("ásma ", None)}
    assert spark.range(1).select(readers.category_of(F.lit("Cirurgía Geral"), [("cirurgia", "CIR")])).first()[0] == "CIR"


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    sinks.replace_partitions(a, str(tmp_path / "t"), ["p"])
    sinks.replace_partitions(spark.createDataFrame([("b", 9)], "p string, v int"), str(tmp_path / "t"), ["p"])
    assert {(r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 9)}
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, o int")
    sinks.put_rows(spark, str(tmp_path / "u"), new, "k", "o")
    v = sinks.put_rows(spark, str(tmp_path / "u"), spark.createDataFrame([(2, "z", 1)], "k int, v string, o int"), "k", "o")
    assert rows(v) == [(1, "y"), (2, "z")]
    assert sinks.write_bundle({"a": a}, str(tmp_path / "j")).first()["rows"] == 2
    assert rows(sinks.delete_rows(a, a.where("v = 1"), "p")) == [("b", 2)]


def test_streams(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    rows_ = [("a", now, 1.0), ("a", now + dt.timedelta(hours=1), 1.0), ("a", now + dt.timedelta(hours=2), 1.5), ("b", now, 1.0)]
    df = spark.createDataFrame(rows_, "k string, at timestamp, w double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema)
    fired = streams.run_to_table(streams.signal_states(stream, "k", "at", "w"), str(tmp_path / "fired"), str(tmp_path / "c1"))
    assert [(r["key"], r["total"]) for r in fired.collect()] == [("a", 3.5)]
    counts = streams.run_to_table(streams.sliding_counts(stream, "at", ["k"], "2 hours", "1 hour"), str(tmp_path / "counts"), str(tmp_path / "c2"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 8
    q = streams.drain_queue(stream.withColumnRenamed("k", "id"), str(tmp_path / "table"), "id", "at", str(tmp_path / "c3"))
    q.awaitTermination()
    assert {(r["id"], r["w"]) for r in spark.read.parquet(str(tmp_path / "table/v1")).collect()} == {("a", 1.5), ("b", 1.0)}


def test_late_rows_in_append_mode(spark, tmp_path):
    """Days are written once the watermark has passed them; rows later than it are dropped."""
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    folder = tmp_path / "days"
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    schema = "at timestamp, k string"
    for rows_ in ([(day(1), "a"), (day(1, 5), "a"), (day(2), "b")], [(day(10), "a")], [(day(1, 9), "a"), (day(9), "b"), (day(20), "c")]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = streams.file_stream(spark, str(folder), spark.createDataFrame([], schema).schema)
        got = streams.run_to_table(streams.daily_counts(stream, "at", ["k"], "2 days"), out, state)
    assert rows(got) == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1), ("2024-01-09", "b", 1), ("2024-01-10", "a", 1)]

"""Entities, relations and exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.operators import exams as x
from tessela.operators import ner as n
from tessela.session import table

catalog = Catalog()
_OPTS = "array<struct<letter:string,text:string>>"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary: what the backs of cards list."""
    parts = table(spark, d, "cards").select(F.explode(F.split("back", ";")).alias("t")).where("length(trim(t)) > 4")
    return n.dictionary(parts, "t")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


_KW = r"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@catalog.add("ner_ngram_join", f"""with e as (select distinct {_KW.format(c='t')} norm from (select unnest(string_split(back, ';')) t from cards) where length(trim(t)) > 4),
    w as (select doc_id, string_split({_KW.format(c="coalesce(text, '')")}, ' ') w from documents),
    g as (select doc_id, (i - 1)::int first, (i + k - 2)::int last, array_to_string(w[i : i + k - 1], ' ') norm from (select doc_id, w, unnest(range(1, len(w) + 1)) i from w), range(1, 9) r(k) where i + k - 1 <= len(w))
    select doc_id, first, last, norm from g join e using (norm) where norm <> ''""")  # fmt: skip
def ner_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return n.ngram_matches(_texts(spark, d), "doc_id", "text", _entries(spark, d)).drop("code")


@catalog.add("ner_automaton")
def ner_automaton(spark: SparkSession, d: str) -> DataFrame:
    return n.resolve_overlaps(n.automaton_matches(_texts(spark, d), "doc_id", "text", _entries(spark, d)), "doc_id").drop("code")


@catalog.add("ner_coverage")
def ner_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = n.resolve_overlaps(n.ngram_matches(_texts(spark, d), "doc_id", "text", _entries(spark, d)), "doc_id")
    return n.coverage_ratio(_texts(spark, d), "doc_id", "text", m)


@catalog.add("ner_audit", f"""with e as (select distinct {_KW.format(c='t')} norm from (select unnest(string_split(back, ';')) t from cards) where length(trim(t)) > 4),
    h as (select doc_id, bool_or(contains(' ' || {_KW.format(c="coalesce(text, '')")} || ' ', ' ' || norm || ' ')) hit from documents cross join e where norm <> '' group by 1)
    select source, count(*) chunks, round(1 - count(*) filter (hit) / count(*), 4) empty_ratio, (count(*) >= 5 and 1 - count(*) filter (hit) / count(*) > 0.8) or count(*) filter (hit) = 0 suspicious from documents join h using (doc_id) group by 1""")  # fmt: skip
def ner_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    hit = n.ngram_matches(_texts(spark, d), "doc_id", "text", _entries(spark, d)).select("doc_id", F.lit(True).alias("hit")).distinct()
    empty = 1 - F.count_if(F.col("hit")) / F.count("*")
    return docs.join(hit, "doc_id", "left").groupBy("source").agg(F.count("*").alias("chunks"), F.round(empty, 4).alias("empty_ratio"), (((F.count("*") >= 5) & (empty > 0.8)) | (F.count_if(F.col("hit")) == 0)).alias("suspicious"))


@catalog.add("ner_gaps")
def ner_gaps(spark: SparkSession, d: str) -> DataFrame:
    return n.gap_recovery(_texts(spark, d), "doc_id", "text", _entries(spark, d)).drop("code")


@catalog.add("relations")
def relations(spark: SparkSession, d: str) -> DataFrame:
    return n.relations(_texts(spark, d), "doc_id", "text", _entries(spark, d))


@catalog.add("relation_rollup")
def relation_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = n.relations(_texts(spark, d), "doc_id", "text", _entries(spark, d))
    return r.groupBy("subject", n.named(F.col("relation"), n.PREDICATES).alias("predicate"), "object").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@catalog.add("graph_names", "select distinct category, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in n.ENTITY_TYPES.items()) + "}[upper(category)], lower(upper(category))) as type from terms")
def graph_names(spark: SparkSession, d: str) -> DataFrame:
    """The graph's names of the categories of terms."""
    return table(spark, d, "terms").select("category").distinct().select("category", n.named(F.upper("category"), n.ENTITY_TYPES).alias("type"))


def _options(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose options are written with the usual names."""
    q = table(spark, d, "extracted_questions").dropDuplicates(["id"])
    return q.withColumn("options", F.from_json("options_json", _OPTS))


def _exams(spark: SparkSession, d: str) -> DataFrame:
    """One exam text for each asset, made of its questions and a key."""
    q = _options(spark, d).where("source_asset_id is not null and question_number between 1 and 300 and statement is not null and size(options) > 1")
    body = F.concat(F.lit("QUESTÃO "), F.col("question_number"), F.lit("\n"), F.col("statement"), F.lit("\n"), F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(") "), F.coalesce(o["text"], F.lit("")))), "\n"))
    one = q.groupBy("source_asset_id", "question_number").agg(F.min_by(F.struct(body.alias("b"), F.col("correct_letter").alias("k")), "id").alias("q"))
    exam = one.groupBy("source_asset_id").agg(F.array_sort(F.collect_list(F.struct("question_number", "q"))).alias("qs"))
    key = F.array_join(F.transform("qs", lambda x_: F.concat(x_["question_number"], F.lit("-"), F.coalesce(x_["q"]["k"], F.lit("")))), " ")
    return exam.select("source_asset_id", F.concat(F.array_join(F.transform("qs", lambda x_: x_["q"]["b"]), "\n\n"), F.lit("\n\nGABARITO: "), key).alias("text"))


@catalog.add("exam_split")
def exam_split(spark: SparkSession, d: str) -> DataFrame:
    s = x.split_exams(_exams(spark, d), ["source_asset_id"], "text")
    return s.select("source_asset_id", "number", F.length("statement").alias("chars"), F.size("options").alias("options"), "correct_letter", x.grade(F.col("statement"), F.col("options")).alias("confidence"))


@catalog.add("exam_answer_key", """with q as (select source_asset_id, question_number number, correct_letter l, row_number() over (partition by source_asset_id, question_number order by id) rn from (select distinct id, source_asset_id, question_number, correct_letter, options_json, statement from extracted_questions)
    where source_asset_id is not null and question_number between 1 and 300 and statement is not null and len(json_extract(options_json, '$[*]')) > 1) select source_asset_id, number, upper(l) letter from q where rn = 1 and upper(l) in ('A', 'B', 'C', 'D', 'E')""")  # fmt: skip
def exam_answer_key(spark: SparkSession, d: str) -> DataFrame:
    return x.answer_key(_exams(spark, d), "source_asset_id", "text")


@catalog.add("exam_grade", """with q as (select distinct id, statement s, case when json_valid(options_json) then options_json end j from extracted_questions),
    o as (select id, s, list_transform(json_extract(j, '$[*]'), lambda e: json_extract_string(e, '$.text')) t, list_transform(json_extract(j, '$[*]'), lambda e: json_extract_string(e, '$.letter')) l from q),
    n as (select id, coalesce(s, '') s, coalesce(len(t), 0) n, list_transform(t, lambda x: trim(x)) t, list_distinct(l) d, list_contains(list_transform(l, lambda x: x is null), true) nl from o),
    m as (select *, list_sort(list_transform(list_filter(t, lambda x: x is not null), lambda x: length(x))) z from n), g as (select *, z[n // 2 + 1] median, list_max(z) longest from m)
    select id, case when length(trim(s)) < 15 or n = 0 then 'low'
    when n = 2 and (list_has_any(list_transform(t, lambda x: upper(x)), ['CERTO', 'ERRADO', 'VERDADEIRO', 'FALSO', 'V', 'F', 'SIM', 'NÃO']) or regexp_matches(lower(s), 'julgue\\s+os\\s+itens|certo\\s+ou\\s+errado|verdadeiro\\s+ou\\s+falso')) then 'high'
    when n <= 2 or n > 5 or len(d) + nl::int <> n or list_contains(t, '') then 'low' when longest > 2.5 * greatest(median, 25) then 'low' when n = 3 then 'medium' when longest > 2.0 * greatest(median, 30) then 'medium' else 'high' end grade from g""")  # fmt: skip
def exam_grade(spark: SparkSession, d: str) -> DataFrame:
    return _options(spark, d).select("id", x.grade(F.col("statement"), F.col("options")).alias("grade"))


@catalog.add("exam_stats", """with q as (select distinct id, source_asset_id g, coalesce(statement, '') s, upper(correct_letter) l from extracted_questions)
    select g source_asset_id, count(*) questions, """ + ", ".join(f"case when count(*) filter (l in ('A','B','C','D','E')) > 0 then round(count(*) filter (l = '{c}') / count(*) filter (l in ('A','B','C','D','E')), 2) else 0.2 end share_{c.lower()}" for c in "ABCDE") + f""",
    floor(sum(length(s)) / count(*) + 0.5)::bigint mean_chars, round(count(*) filter ((a and p) or (p and c) or (a and c)) / count(*), 2) case_ratio, round(count(*) filter (regexp_matches(s, '(?i){x.TRICK}')) / count(*), 2) trick_ratio
    from (select *, regexp_matches(s, '(?i){x.AGE}') a, regexp_matches(s, '(?i){x.PATIENT}') p, regexp_matches(s, '(?i){x.CLINICAL}') c from q) group by 1""")  # fmt: skip
def exam_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").select("id", "source_asset_id", "statement", "correct_letter").distinct()
    return x.stats(q, "source_asset_id", "statement", "correct_letter")


@catalog.add("options_relettered")
def options_relettered(spark: SparkSession, d: str) -> DataFrame:
    q = _options(spark, d).where("size(options) between 2 and 5 and exists(options, o -> o.letter = correct_letter)")
    return q.select("id", x.relettered(F.col("options"), F.col("correct_letter"), F.pmod(F.crc32("id"), F.size("options")).cast("int")).alias("options"))


@catalog.add("options_shuffled")
def options_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Options shuffled by the id of their question, the right one in a place of its own, and where each came from."""
    q = _options(spark, d).where("size(options) between 2 and 5 and exists(options, o -> o.letter = correct_letter)")
    placed = x.shuffled_options(F.col("options"), F.col("correct_letter"), F.pmod(F.crc32("id"), F.size("options")).cast("int"), F.col("id"))
    return q.select("id", placed.alias("options"))

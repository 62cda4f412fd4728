"""Checks of content, spans, context selection and the remaining joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.functions.text import fold
from tessela.operators import joins as j
from tessela.operators import textual as t
from tessela.operators import validity as v
from tessela.operators.ordering import best_per_key
from tessela.session import table

catalog = Catalog()
_OPTS = "array<struct<letter:string,text:string>>"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_questions").dropDuplicates(["id"]).withColumn("options", F.from_json("options_json", _OPTS))


@catalog.add("card_validity", "select id, coalesce(trim(front), '') <> '' and coalesce(trim(back), '') <> '' and (coalesce(type, '') <> 'cloze' or regexp_matches(coalesce(front, ''), '\\{\\{c\\d+::')) ok from (select distinct id, front, back, type from cards)")
def card_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("id", "front", "back", "type").distinct().select("id", v.card_ok(F.col("front"), F.col("back"), F.col("type")).alias("ok"))


@catalog.add("question_validity")
def question_validity(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", v.question_ok(F.col("statement"), F.col("options"), F.col("correct_letter")).alias("ok"))


@catalog.add("option_length_rule")
def option_length_rule(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).where("size(options) > 1").select("id", v.varied_length(F.col("options"), F.col("correct_letter"), F.col("question_number")).alias("ok"))


@catalog.add("distractor_grounding", r"""with q as (select distinct id, statement, correct_letter l from extracted_questions where statement is not null and specialty is not null),
    w as (select id, strip_accents(lower(statement)) s, list_filter(regexp_split_to_array(strip_accents(lower(specialty)), '[^a-z0-9]+'), lambda x: length(x) > 3) ws from (select distinct id, statement, specialty from extracted_questions where statement is not null and specialty is not null))
    select id, round(case when len(ws) = 0 or s = '' then 1.0 else len(list_filter(ws, lambda x: contains(s, x))) / len(ws) end, 6) share from w""")  # fmt: skip
def distractor_grounding(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").where("statement is not null and specialty is not null").select("id", "statement", "specialty").distinct()
    return q.select("id", F.round(v.grounded_share(F.col("statement"), F.col("specialty")), 6).alias("share"))


@catalog.add("skipped_terms", "select id from (select id, trim(regexp_replace(strip_accents(lower(term)), '\\s+', ' ', 'g')) t from terms) where t is null or length(t) < 3 or regexp_matches(t, '^[0-9]+$') or t in (" + ", ".join(f"'{x}'" for x in v.GENERIC_TERMS) + f") or regexp_matches(t, '{v.GENERIC}') or regexp_matches(t, '{v.SYMBOLS}')")
def skipped_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").where(v.skip_term(F.col("term"))).select("id")


@catalog.add("furniture_lines")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "asset_texts").select("asset_id", F.posexplode(F.split("conteudo_texto", "\n")).alias("line", "t"))
    return lines.where(v.furniture_line(F.col("t"))).select("asset_id", "line")


@catalog.add("content_units")
def content_units(spark: SparkSession, d: str) -> DataFrame:
    u = t.coverage(table(spark, d, "asset_texts"), ["asset_id"], "conteudo_texto")
    return u.where(~v.note_unit(F.col("unit"))).groupBy("asset_id").agg(F.count("*").alias("units"), F.sum("words").alias("words"))


@catalog.add("relevant_context")
def relevant_context(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks_in_budget(table(spark, d, "asset_texts"), "asset_id", "conteudo_texto", ["tratamento", "gestantes", "febre"], 3_500)


@catalog.add("span_containment", """with li as (select distinct l_orderkey doc, l_linenumber s, l_linenumber + 1 e from lineitem), it as (select o_orderkey doc, 'a' item, 1 a, 4 b from orders union all select o_orderkey, 'b', 3, 9 from orders)
    select doc, s "start", item from (select li.doc, s, item, row_number() over (partition by li.doc, s order by a, item) rn from li join it on li.doc = it.doc and s >= a and e <= b) where rn = 1""")  # fmt: skip
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end")).distinct()
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"))
    items = o.select("doc", F.lit("a").alias("item"), F.lit(1).alias("istart"), F.lit(4).alias("iend")).unionByName(o.select("doc", F.lit("b").alias("item"), F.lit(3).alias("istart"), F.lit(9).alias("iend")))
    return j.contained(li, items, "doc").select("doc", "start", "item")


@catalog.add("span_gaps", "with li as (select distinct l_orderkey doc, l_linenumber s from lineitem) select doc, s \"start\" from li where not (s < 5 and 3 < s + 1)")
def span_gaps(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end")).distinct()
    m = li.select("doc", F.lit(3).alias("mstart"), F.lit(5).alias("mend")).distinct()
    return j.gaps(li, m, "doc").select("doc", "start")


@catalog.add("manifest_difference", "select asset_id id, 'new' side from asset_texts where asset_id not in (select id from knowledge_assets) union all select distinct id, 'orphan' from knowledge_assets where id not in (select asset_id from asset_texts)")
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "asset_texts").select(F.col("asset_id").alias("id")).distinct()
    listed = table(spark, d, "knowledge_assets").select("id").distinct()
    return files.join(listed, "id", "left_anti").withColumn("side", F.lit("new")).unionByName(listed.join(files, "id", "left_anti").withColumn("side", F.lit("orphan")))


@catalog.add("not_yet_exported", "select distinct id from extracted_questions where confidence = 'low' and id not in (select replace(t, 'prova', 'exq-00-0000001') from (select unnest(tags) t from cards))")
def not_yet_exported(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "cards").select(F.explode("tags").alias("t")).select(F.replace("t", F.lit("prova"), F.lit("exq-00-0000001")).alias("id")).distinct()
    return table(spark, d, "extracted_questions").where("confidence = 'low'").select("id").distinct().join(done, "id", "left_anti")


@catalog.add("reuse_split", """with q as (select distinct id, specialty, confidence from extracted_questions where specialty is not null), r as (select *, row_number() over (partition by specialty order by id) rn from q where confidence = 'high')
    select q.id, case when r.rn <= 5 then 'reuse' else 'adapt' end use_as from q left join r using (id)""")  # fmt: skip
def reuse_split(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").where("specialty is not null").select("id", "specialty", "confidence").distinct()
    first = best_per_key(q.where("confidence = 'high'"), ["specialty"], [F.asc("id")], 5).select("id", F.lit("reuse").alias("u"))
    return q.join(first, "id", "left").select("id", F.coalesce("u", F.lit("adapt")).alias("use_as"))


@catalog.add("theme_parent", r"""with w as (select distinct a.ref_id, a.category, a.canonical_term theme, unnest(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(a.canonical_term)), '[^a-z0-9]+'), lambda x: length(x) > 2))) w from canonical_terms a),
    p as (select * from w where len(string_split(theme, ' ')) <= 3), s as (select a.theme, p.theme topic, p.ref_id o, count(*) score from w a join p on a.category = p.category and a.w = p.w group by all)
    select theme, arg_max(topic, (score, -o)) topic, max(score) score from s group by 1""")  # fmt: skip
def theme_parent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_terms")
    topics = c.where("size(split(canonical_term, ' ')) <= 3").select("category", F.col("canonical_term").alias("topic"), "ref_id")
    return v.best_parent(c.select("category", F.col("canonical_term").alias("theme")), "theme", topics, "topic", "ref_id", "category")


@catalog.add("confusion_candidates", r"""with s as (select category || ':' || regexp_extract(strip_accents(lower(canonical_term)), '^(\w+)', 1) set_id, strip_accents(lower(trim(canonical_term))) m from canonical_terms where category is not null),
    a as (select id, strip_accents(lower(trim(coalesce(canonical_term, '')))) m from terms) select a.id, b.m "member", min(b.set_id) set_id from a join s on a.m = s.m join s b on b.set_id = s.set_id and b.m <> a.m group by all""")  # fmt: skip
def confusion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sets are the terms of a category that begin alike; what can be taken for the term that each row means."""
    c = table(spark, d, "canonical_terms").where("category is not null")
    head = F.concat("category", F.lit(":"), F.regexp_extract(fold(F.col("canonical_term")), r"^(\w+)", 1))
    none = F.array().cast("array<string>")
    sets = c.groupBy(head.alias("set_id")).agg(F.collect_list("canonical_term").alias("members")).withColumn("specialty", F.lit("")).withColumn("context", none)
    asked = table(spark, d, "terms").select("id", F.col("canonical_term").alias("answer"), F.lit("").alias("specialty"), none.alias("topics"))
    return j.confusion_candidates(asked, sets, "id")


@catalog.add("confusion_sets", """with s as (select category, regexp_extract(strip_accents(lower(canonical_term)), '^(\\w+)', 1) head, ref_id, canonical_term from canonical_terms) select a.ref_id, count(*) others from s a join s b on a.category = b.category and a.head = b.head and a.ref_id <> b.ref_id group by 1""")
def confusion_sets(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are easily taken for each other share their category and first word; counted, not paired."""
    s = table(spark, d, "canonical_terms").withColumn("head", F.regexp_extract(fold(F.col("canonical_term")), r"^(\w+)", 1))
    n = s.groupBy("category", "head").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return s.join(n, ["category", "head"]).select("ref_id", "others")


@catalog.add("balanced_answers")
def balanced_answers(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).where("source_asset_id is not null").select("id", "source_asset_id")
    return v.balanced_letters(q, "source_asset_id", "id").select("id", "target")


@catalog.add("cycle_class", "select source, case when b + c < 5 then 'mixed' when b >= 0.65 * (b + c) then 'basic' when c >= 0.65 * (b + c) then 'clinical' else 'mixed' end \"cycle\" from (select source, count(*) filter (kind in ('book', 'card')) b, count(*) filter (kind in ('exam', 'guideline')) c from documents group by 1)")
def cycle_class(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("kind").isin("book", "card")).alias("b"), F.count_if(F.col("kind").isin("exam", "guideline")).alias("c"))
    return c.select("source", v.cycle_of(F.col("b"), F.col("c")).alias("cycle"))


@catalog.add("dna_bands", "select user_id, case when m between 0.4 and 0.6 then null when m >= 0.75 then 'muito alta' when m >= 0.5 then 'alta' when m >= 0.25 then 'media' when m >= 0 then 'baixa' end band from (select user_id, round(avg(least(1, value / 100)), 5) m from events group by 1)")
def dna_bands(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.least(F.lit(1.0), F.col("value") / 100)), 5).alias("m"))
    return m.select("user_id", v.bands(F.col("m")).alias("band"))


@catalog.add("anchoring_confidence", "select doc_id, round(greatest(0.2, least(1.0, coalesce(n / nullif(w, 0), 0) * 0.5 + 0.3)), 6) confidence from (select doc_id, len(regexp_extract_all(text, 'febre|tosse|dor')) n, len(string_split(text, ' ')) w from documents)")
def anchoring_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(v.anchoring(F.regexp_count("text", F.lit("febre|tosse|dor")), F.size(F.split("text", " "))), 6).alias("confidence"))


@catalog.add("text_metadata", "select asset_id, regexp_extract(titulo, '^([^:]+)', 1) author, regexp_extract(titulo, ':\\s*(.*)$', 1) title, greatest(1, ceil(coalesce(length(conteudo_texto), 0) / 1800.0))::bigint pages from asset_texts where titulo is not null")
def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "asset_texts").where("titulo is not null")
    return a.select("asset_id", F.regexp_extract("titulo", r"^([^:]+)", 1).alias("author"), F.regexp_extract("titulo", r":\s*(.*)$", 1).alias("title"), F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("conteudo_texto"), F.lit(0)) / 1800)).alias("pages"))


@catalog.add("adjacent_groups")
def adjacent_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_vectors").where("size(vector) = 384 and content is not null and asset_id is not null").dropDuplicates(["id"])
    return t.adjacent_groups(c, "asset_id", "chunk_index", "id", "vector", "content")

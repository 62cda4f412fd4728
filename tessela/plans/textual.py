"""Retrieval and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.functions import clean as c
from tessela.functions import vector as v
from tessela.functions.text import fold, squeeze
from tessela.operators import textual as t
from tessela.operators.similarity import greatest_similarity
from tessela.session import table

catalog = Catalog()
QUERY = "tratamento com reposição hormonal em gestantes"
_TERMS = "['tratamento', 'com', 'reposição', 'hormonal', 'gestantes']"
_LEX = f"len(list_filter({_TERMS}, lambda q: contains(lower(text), q))) / 5.0"


@catalog.add("vector_topk", "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) score from embeddings order by score desc, vec_id limit 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@catalog.add("vector_topk_minscore", "select vec_id, score from (select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)), 6) score from embeddings) where score >= 0.2 order by score desc, vec_id limit 20")
def vector_topk_minscore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).where("size(embedding) = size(q)").select("vec_id", F.round(v.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).where("score >= 0.2").orderBy(F.desc("score"), "vec_id").limit(20)


@catalog.add("lexical_score_topk", f"select doc_id, round({_LEX}, 6) score from documents order by score desc, doc_id limit 20")
def lexical_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(v.lexical_score(F.lit(QUERY), F.col("text")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@catalog.add("hybrid_topk")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk_vectors").where("size(vector) = 384").dropDuplicates(["id"])
    q = chunks.orderBy("id").limit(1).select(F.col("vector").alias("q"), F.col("content").alias("qt"))
    s = chunks.join(F.broadcast(q)).select("id", v.cosine(F.col("vector"), F.col("q")).alias("cos"), v.lexical_score(F.lit(QUERY), F.col("content")).alias("lex"))
    return s.select("id", F.round(v.hybrid(F.col("cos"), F.col("lex")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)


@catalog.add("near_duplicate_max_sim", "select a.vec_id, round(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) top from embeddings a join embeddings b on a.label = b.label and b.vec_id % 5 = 0 where a.vec_id % 5 <> 0 group by 1")
def near_duplicate_max_sim(spark: SparkSession, d: str) -> DataFrame:
    """Each new vector's greatest similarity to the stored ones of its topic."""
    e = table(spark, d, "embeddings")
    top = greatest_similarity(e.where("vec_id % 5 != 0"), e.where("vec_id % 5 = 0"), "vec_id", "label", "embedding")
    return top.select("vec_id", F.round("top", 6).alias("top"))


@catalog.add("dedup_drop_similar", "select vec_id from embeddings a where vec_id % 5 <> 0 and not exists (select 1 from embeddings b where b.vec_id % 5 = 0 and a.label = b.label and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3)")
def dedup_drop_similar(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    new = e.where("vec_id % 5 != 0")
    close = greatest_similarity(new, e.where("vec_id % 5 = 0"), "vec_id", "label", "embedding").where("top >= 0.3")
    return new.join(close, "vec_id", "left_anti").select("vec_id")


@catalog.add("accent_fold", "select doc_id, length(f) chars, md5(f) folded from (select doc_id, strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) f from documents)")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", fold(squeeze(F.col("text"))).alias("f"))
    return f.select("doc_id", F.length("f").cast("bigint").alias("chars"), F.md5("f").alias("folded"))


@catalog.add("keyword_form", "select id, trim(regexp_replace(regexp_replace(strip_accents(lower(front)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) words from (select distinct id, front from cards)")
def keyword_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("id", "front").distinct().select("id", c.keywords(F.col("front")).alias("words"))


@catalog.add("clean_document", r"select asset_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(conteudo_texto, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) h from asset_texts where conteudo_texto is not null")
def clean_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_texts").where("conteudo_texto is not null").select("asset_id", F.md5(c.document(F.col("conteudo_texto"))).alias("h"))


@catalog.add("token_estimate", "select id, ceil(length(coalesce(content, '')) / 4.0)::bigint tokens from (select distinct id, content from chunk_vectors)")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").select("id", "content").distinct().select("id", c.token_estimate(F.col("content")).alias("tokens"))


@catalog.add("truncated_context", "select doc_id, case when length(text) > 600 then substr(text, 1, 600) || '…' else text end head from documents")
def truncated_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", c.truncate(F.col("text"), 600).alias("head"))


@catalog.add("key_terms")
def key_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_questions").where("statement is not null").select("id", "statement").distinct().select("id", c.key_terms(F.col("statement")).alias("terms"))


@catalog.add("cloze_parts", r"select id, regexp_replace('{{c1::' || front || '::dica}} e {{c3::' || type || '}}', '\{\{c\d+::(.*?)(::.*?)?\}\}', '\1', 'g') plain, 4 nxt from (select distinct id, front, type from cards) where front is not null and type is not null")
def cloze_parts(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "cards").where("front is not null and type is not null").select("id", "front", "type").distinct()
    text = F.concat(F.lit("{{c1::"), F.col("front"), F.lit("::dica}} e {{c3::"), F.col("type"), F.lit("}}"))
    return cards.select("id", c.strip_cloze(text).alias("plain"), c.next_cloze(text).alias("nxt"))


@catalog.add("canonical_keys", "select id, coalesce(nullif(trim(system), '') || ':' || nullif(trim(code), ''), trim(regexp_replace(regexp_replace(strip_accents(lower(term)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) \"key\" from terms")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").select("id", c.canonical_key(F.col("system"), F.col("code"), F.col("term")).alias("key"))


@catalog.add("edit_distance", "select a.ref_id, count(*) near from canonical_terms a join canonical_terms b on a.category = b.category and a.ref_id <> b.ref_id and levenshtein(lower(a.canonical_term), lower(b.canonical_term)) <= 3 group by 1")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "canonical_terms").select("ref_id", "category", F.lower("canonical_term").alias("n"))
    b = a.select(F.col("ref_id").alias("r2"), "category", F.col("n").alias("m"))
    return a.join(b, "category").where("ref_id != r2 and levenshtein(n, m, 3) >= 0").groupBy("ref_id").agg(F.count("*").alias("near"))


@catalog.add("icd_format", "select id, case when regexp_full_match(upper(trim(c)), '[A-Z][0-9]{3}') then substr(upper(trim(c)), 1, 3) || '.' || substr(upper(trim(c)), 4, 1) else upper(trim(c)) end code from (select id, 'a' || (id % 1000)::varchar c from terms)")
def icd_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").select("id", c.icd_code(F.concat(F.lit("a"), (F.col("id") % 1000).cast("string"))).alias("code"))


@catalog.add("byte_sizes", "select asset_id, case when n < 1024 then printf('%d B', n) when n < 1048576 then printf('%.1f KB', n / 1024.0) else printf('%.1f MB', n / 1048576.0) end size from (select asset_id, coalesce(length(conteudo_texto), 0)::bigint n from asset_texts)")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_texts").select("asset_id", c.byte_size(F.coalesce(F.length("conteudo_texto"), F.lit(0)).cast("bigint")).alias("size"))


@catalog.add("json_props", "select event_id, (props->>'k')::int k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@catalog.add("content_hash_dedup", "select sha256(conteudo_texto) h, count(*) n, min(asset_id) keeper from asset_texts where conteudo_texto is not null group by 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_texts").where("conteudo_texto is not null").groupBy(F.sha2("conteudo_texto", 256).alias("h")).agg(F.count("*").alias("n"), F.min("asset_id").alias("keeper"))


@catalog.add("chunk_text")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return t.chunk_texts(table(spark, d, "asset_texts"), ["asset_id"], "conteudo_texto")


@catalog.add("coverage_units")
def coverage_units(spark: SparkSession, d: str) -> DataFrame:
    u = t.coverage(table(spark, d, "asset_texts"), ["asset_id"], "conteudo_texto")
    return t.assign_quota(u, "asset_id", "pos", "words", 20).select("asset_id", "pos", "kind", "words", "quota")


@catalog.add("longest_word_overlap")
def longest_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of words that a question shares with a chunk of its own asset, for each question."""
    q = table(spark, d, "extracted_questions").where("statement is not null").select(F.col("id").alias("qid"), F.col("source_asset_id").alias("asset_id"), "statement").distinct()
    ch = table(spark, d, "chunk_vectors").where("content is not null").select("id", "asset_id", "content").distinct()
    runs = t.common_runs(q.join(ch, "asset_id"), ["qid", "id"], "statement", "content")
    return runs.groupBy("qid").agg(F.max("length").alias("length"), F.max_by("run", F.struct("length", "run")).alias("run"))


@catalog.add("hash_vectors")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("id", "front").distinct().select("id", F.transform(v.hash_vector(F.col("front")), lambda x: F.round(x, 6)).alias("vector"))

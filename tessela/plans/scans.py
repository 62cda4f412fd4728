"""Scans, filters, sorts and paging over the application's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.operators import filters as f
from tessela.operators import ordering as o
from tessela.operators.validity import third_party
from tessela.session import table

catalog = Catalog()
NOW = "2025-01-01 00:00:00"
_NOW = "timestamptz '2025-01-01 00:00:00+00'"


@catalog.add("full_scan", "select region.r_regionkey, r_name from region")
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region")


@catalog.add("point_lookup", "select id, title, category from decks where id = 'dck-00-000003'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return f.point_lookup(table(spark, d, "decks").select("id", "title", "category"), "id", "dck-00-000003")


_ASKED = ["dck-00-000005", "dck-00-000001", "nothing", "dck-00-000005"]


@catalog.add("batch_lookup", f"select a.ordinal, a.id, title from (select unnest({_ASKED}) id, unnest(range(4))::int ordinal) a left join decks using (id)")
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return f.batch_lookup(table(spark, d, "decks").select("id", "title"), "id", _ASKED).select("ordinal", "id", "title")


@catalog.add("index_scan", "select id, type from cards where deck_id = 'dck-00-000004' and high_yield group by all")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").where("deck_id = 'dck-00-000004' and high_yield").select("id", "type").distinct()


@catalog.add("index_in_scan", "select distinct id, predicate from graph_edges where predicate in ('trata', 'causa') and confidence > 0.8")
def index_in_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges").where(F.col("predicate").isin("trata", "causa") & (F.col("confidence") > 0.8)).select("id", "predicate").distinct()


@catalog.add("index_range_scan", "select distinct id from chunk_vectors where professor > ''")
def index_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").where(F.col("professor") > "").select("id").distinct()


@catalog.add("schema_version_check", "select coalesce(bool_or(schema_version is distinct from 'v2'), false) outdated from chunk_vectors")
def schema_version_check(spark: SparkSession, d: str) -> DataFrame:
    return f.any_outdated(table(spark, d, "chunk_vectors"), "schema_version", "v2")


@catalog.add("row_view_defaults", "select distinct id, coalesce(nullif(discipline, ''), 'Geral') discipline, coalesce(nullif(year, 0), 1900)::int \"year\" from knowledge_assets")
def row_view_defaults(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "knowledge_assets")
    filled = lambda c, empty, by: F.when(F.col(c).isNull() | (F.col(c) == empty), by).otherwise(F.col(c))
    return a.select("id", filled("discipline", "", "Geral").alias("discipline"), filled("year", 0, 1900).cast("int").alias("year")).distinct()


@catalog.add("text_search_multi", "select distinct id from cards where contains(lower(coalesce(front, '')), 'conduta') or contains(lower(coalesce(back, '')), 'conduta') or coalesce(len(list_filter(tags, lambda t: contains(lower(t), 'conduta'))) > 0, false)")
def text_search_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").where(f.text_search("Conduta", [F.col("front"), F.col("back")], [F.col("tags")])).select("id").distinct()


@catalog.add("smart_filter_favorites", "select id from decks where deleted_at is null and category = 'Cardiologia' and folder_id is not null")
def smart_filter(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "decks")
    return decks.where(F.col("deleted_at").isNull() & f.equals_or_all(F.col("category"), "Cardiologia") & f.equals_or_all(F.col("title"), "all") & F.col("folder_id").isNotNull()).select("id")


@catalog.add("category_expand", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def category_expand(spark: SparkSession, d: str) -> DataFrame:
    expansion = {"Industry": ["BUILDING", "MACHINERY"], "Home": ["HOUSEHOLD"]}
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin(expansion["Industry"] + expansion["Home"])).select("c_custkey")


@catalog.add("category_contains", "select distinct id from knowledge_assets where contains(lower(specialty), 'card')")
def category_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_assets").where(f.contains_ci(F.col("specialty"), "CARD")).select("id").distinct()


@catalog.add("prefix_search", "select normalized_term, id from terms where starts_with(normalized_term, 'sindrome') order by normalized_term, id limit 60")
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return f.prefix_search(table(spark, d, "terms").select("normalized_term", "id"), "normalized_term", "sindrome", 60)


@catalog.add("due_items", f"select distinct id from cards where sm2.due_date is null or sm2.due_date <= {_NOW}")
def due_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").where(f.is_due(F.col("sm2.due_date"), F.to_timestamp(F.lit(NOW)))).select("id").distinct()


@catalog.add("retry_queue", "select event_id from events where event_type = 'view' or (event_type = 'error' and event_id % 9 < 5) order by ts, event_id limit 50")
def retry_queue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("status", F.expr("case event_type when 'view' then 'pending' when 'error' then 'failed' else 'synced' end")).withColumn("retries", F.col("event_id") % 9)
    return e.where(f.is_retryable(F.col("status"), F.col("retries"))).orderBy("ts", "event_id").limit(50).select("event_id")


@catalog.add("bidirectional_match", "select distinct id from extracted_questions where trim(specialty) <> '' and (contains(lower(trim(specialty)), 'clínica médica cardiologia') or contains('clínica médica cardiologia', lower(trim(specialty)))) order by id limit 200")
def bidirectional_match(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").where(f.either_contains(F.col("specialty"), F.lit("Clínica Médica Cardiologia")))
    return q.select("id").distinct().orderBy("id").limit(200)


@catalog.add("source_filter", "select distinct id from chunk_vectors where contains(lower(exam_board), 'banca') and contains(lower(professor), 'a') and schema_version = 'v2'")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").where(f.contains_ci(F.col("exam_board"), "banca") & f.contains_ci(F.col("professor"), "a") & (F.col("schema_version") == "v2")).select("id").distinct()


@catalog.add("third_party_sources", "select distinct source from documents where trim(coalesce(source, '')) <> '' and not contains(lower(source), 'acervo') and not contains(lower(source), 'forum')")
def third_party_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(third_party(F.col("source"), ("acervo", "forum"))).select("source").distinct()


@catalog.add("risk_flags", "select doc_id from documents where " + " or ".join(f"regexp_matches(lower(trim(text)), '{p}')" for p in f.RISK_PATTERNS))
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(f.is_risky(F.col("text"))).select("doc_id")


@catalog.add("legible_text", """select doc_id from documents where length(trim(text)) >= 50
    and len(regexp_extract_all(text, '[a-zA-Z0-9\\s.,;:!?()"''/\\\\–—%º°ªáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ-]')) >= 0.85 * length(text)
    and len(regexp_extract_all(text, '[a-zA-ZáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ]{3,}')) >= 5""")  # fmt: skip
def legible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(f.is_legible(F.col("text"))).select("doc_id")


@catalog.add("folded_search", "select distinct id from graph_nodes where contains(strip_accents(lower(coalesce(display_text, ''))), 'ite') order by id limit 20")
def folded_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").where(f.folded_search("Íte", [F.col("display_text")])).select("id").distinct().orderBy("id").limit(20)


@catalog.add("file_validation", """select asset_id, list_filter([case when coalesce(length(conteudo_texto), 0) <= 0 then 'EMPTY_FILE' end, case when length(conteudo_texto) > 20000 then 'TOO_LARGE' end,
    case when model = 'book' then 'BAD_EXTENSION' end], lambda x: x is not null) errors from asset_texts""")  # fmt: skip
def file_validation(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "asset_texts").withColumn("name", F.concat("asset_id", F.expr("case model when 'book' then '.xyz' else '.txt' end")))
    return a.select("asset_id", f.file_errors(F.coalesce(F.length("conteudo_texto"), F.lit(0)), F.col("name"), F.lit("text/plain"), 20_000, ["txt", "pdf"], ["text/plain"]).alias("errors"))


@catalog.add("format_detection", """select asset_id, case model when 'book' then 'epub' when 'exam' then 'pdf' else 'txt' end format from asset_texts""")
def format_detection(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "asset_texts")
    name = F.concat("asset_id", F.expr("case model when 'book' then '.EPUB' when 'exam' then '.pdf' else '.md' end"))
    return a.select("asset_id", f.detect_format(name, F.lit(None).cast("string")).alias("format"))


@catalog.add("folder_tree", "select r_regionkey::varchar node, 0 \"level\" from region union all select (100 + n_nationkey)::varchar, 1 from nation")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("node"), F.lit("").alias("parent"))
    leaves = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("string").alias("node"), F.col("n_regionkey").cast("string").alias("parent"))
    return f.tree_levels(roots.unionByName(leaves), "node", "parent")


@catalog.add("paged_listing", "select o_orderkey, o_totalprice, (select count(*) from orders) total from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return o.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", "o_totalprice", "total")


@catalog.add("multi_mode_sort", "select id, row_number() over (order by category = 'Cardiologia' desc, title, id)::int pos from decks order by category = 'Cardiologia' desc, title, id limit 40")
def multi_mode_sort(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "decks").withColumn("favorite", F.coalesce(F.col("category") == "Cardiologia", F.lit(False)))
    order = [F.desc("favorite"), F.asc("title"), F.asc("id")]
    top = decks.orderBy(*order).limit(40)
    return top.select("id", F.expr("row_number() over (order by favorite desc, title, id)").alias("pos"))


@catalog.add("history_desc", "select id, updated from (select id, max(strftime(updated_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S')) updated, max(updated_at) u from cards group by id) order by u desc, id limit 100")
def history_desc(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "cards").groupBy("id").agg(F.max("updated_at").alias("u")).orderBy(F.desc("u"), "id").limit(100)
    return h.select("id", F.date_format("u", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@catalog.add("case_order_limit", "select id from terms order by case category when 'DOENCA' then 1 when 'MEDICAMENTO' then 2 else 3 end, length(term) desc, id limit 50")
def case_order_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").orderBy(F.expr("case category when 'DOENCA' then 1 when 'MEDICAMENTO' then 2 else 3 end"), F.desc(F.length("term")), "id").limit(50).select("id")


@catalog.add("numbered_in_asset", "select id, row_number() over (partition by source_asset_id order by question_number, id)::int pos from (select distinct id, source_asset_id, question_number from extracted_questions where source_asset_id is not null)")
def numbered_in_asset(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").where("source_asset_id is not null").select("id", "source_asset_id", "question_number").distinct()
    return q.select("id", F.expr("row_number() over (partition by source_asset_id order by question_number nulls last, id)").alias("pos"))


@catalog.add("best_per_key", """select question_number, id from (select id, question_number, row_number() over (partition by question_number order by n desc, len desc, id) rn
    from (select distinct id, question_number, len(json_extract(options_json, '$[*]')) n, length(statement) len from extracted_questions where question_number is not null and options_json is not null and statement is not null)) where rn = 1""")  # fmt: skip
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").where("question_number is not null and options_json is not null and statement is not null")
    q = q.select("id", "question_number", F.json_array_length("options_json").alias("n"), F.length("statement").alias("len")).distinct()
    return o.best_per_key(q, ["question_number"], [F.desc("n"), F.desc("len"), F.asc("id")]).select("question_number", "id")


@catalog.add("budget_prefix", """select doc_id, used::bigint used from (select doc_id, sum(cost) over (partition by source order by doc_id rows unbounded preceding) used, row_number() over (partition by source order by doc_id) rn
    from (select doc_id, source, ceil(length(text) / 4.0) cost from documents)) where used <= 6000 or rn = 1""")  # fmt: skip
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return o.budget_prefix(docs, ["source"], [F.asc("doc_id")], F.ceil(F.col("n") / 4), 6000).select("doc_id", "used")


@catalog.add("streak_of_three", "select event_id from (select event_id, event_type, lag(event_type) over w a, lag(event_type, 2) over w b from events window w as (partition by user_id order by ts, event_id)) where event_type = a and a = b")
def streak_of_three(spark: SparkSession, d: str) -> DataFrame:
    return o.repeated_run(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type").select("event_id")


@catalog.add("quota_split", "select id, (100 // n + case when i <= 100 % n then 1 else 0 end)::bigint quota from (select id, count(*) over (partition by category) n, row_number() over (partition by category order by id) i from decks)")
def quota_split(spark: SparkSession, d: str) -> DataFrame:
    return o.even_split(table(spark, d, "decks"), ["category"], ["id"], [F.asc("id")], 100).select("id", "quota")


@catalog.add("adaptive_top_k", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) rn, least(30, 5 + ceil(count(*) over (partition by source) / 300.0)) k from documents) where rn <= k")
def adaptive_top_k(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    k = docs.groupBy("source").agg(F.least(F.lit(30), F.lit(5) + F.ceil(F.count("*") / 300)).alias("k"))
    top = o.best_per_key(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 30)
    return top.join(k, "source").withColumn("rn", F.expr("row_number() over (partition by source order by n_chars desc, doc_id)")).where("rn <= k").select("doc_id", "source")

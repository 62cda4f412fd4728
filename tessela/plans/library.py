"""The library: smart filters, orders of decks, question sets, profiles, categories, links, copies, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.operators import library as lib
from tessela.session import table

catalog = Catalog()
NOW = "2025-01-01 00:00:00"
_D = f"""c as (select deck_id, count(*) total, count(*) filter (sm2.due_date is null or sm2.due_date <= timestamptz '{NOW}+00') due from (select distinct id, deck_id, sm2 from cards) group by 1),
    d as (select id, title, category, folder_id, created_at, coalesce(category = 'Cardiologia', false) favorite, coalesce(total, 0) total, coalesce(due, 0) due from decks left join c on deck_id = id)"""


def _decks(spark: SparkSession, d: str) -> DataFrame:
    """Decks with the numbers of their cards and of those due."""
    due = F.col("sm2.due_date").isNull() | (F.col("sm2.due_date") <= F.to_timestamp(F.lit(NOW)))
    c = table(spark, d, "cards").select("id", "deck_id", "sm2").distinct().groupBy(F.col("deck_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(due).alias("due"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return table(spark, d, "decks").join(c, "id", "left").select("id", "title", "category", "folder_id", "created_at", F.coalesce(F.col("category") == "Cardiologia", F.lit(False)).alias("favorite"), zero("total"), zero("due"))


@catalog.add("smart_filters", f"""with {_D} select id, 'due' kind from d where due > 0 union all select id, 'favorites' from d where favorite union all select id, 'root' from d where coalesce(folder_id, '') = ''
    union all select id, 'highYield' from d where contains(lower(title), 'high yield') or contains(lower(title), 'highyield') or due > 10 union all select id, 'all' from d""")  # fmt: skip
def smart_filters(spark: SparkSession, d: str) -> DataFrame:
    decks = _decks(spark, d)
    hit = lambda kind: lib.smart_filter(kind, F.col("due"), F.col("favorite"), F.col("folder_id"), F.array("title"))
    kinds = F.array_compact(F.array(*[F.when(hit(k), k) for k in ("due", "favorites", "root", "highYield", "all")]))
    return decks.select("id", F.explode(kinds).alias("kind"))


@catalog.add("deck_orders", f"""with {_D}, o as (select id, 'favorite' "mode", row_number() over (order by favorite desc, strip_accents(lower(title)), id) pos from d union all select id, 'dueCards', row_number() over (order by due desc, id) from d
    union all select id, 'totalCards', row_number() over (order by total desc, id) from d union all select id, 'createdAt', row_number() over (order by created_at desc nulls last, id) from d
    union all select id, 'retention', row_number() over (order by case when total > 0 then (total - due) / total else 0 end desc, id) from d) select id, "mode", pos::int pos from o where pos <= 50 and "mode" <> 'favorite'""")  # fmt: skip
def deck_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 decks of each order by a number."""
    decks = _decks(spark, d)
    out = None
    for mode in ("dueCards", "totalCards", "createdAt", "retention"):
        top = decks.orderBy(*lib.deck_order(mode)).limit(50).agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("pos", "id"))
        part = top.select("id", F.lit(mode).alias("mode"), (F.col("pos") + 1).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


@catalog.add("deck_titles")
def deck_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 decks by title as a reader sorts them, up and down, favourites first or not."""
    decks = _decks(spark, d)
    out = None
    for mode in ("favorite", "title", "title_desc"):
        top = decks.orderBy(*lib.deck_order(mode)).limit(50).agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("pos", "id"))
        part = top.select("id", F.lit(mode).alias("mode"), (F.col("pos") + 1).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


@catalog.add("library_totals", f"with {_D} select count(*) decks, sum(total)::bigint cards, sum(due)::bigint due, count(distinct category) categories, count(distinct nullif(folder_id, '')) folders from d")
def library_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _decks(spark, d).agg(F.count("*").alias("decks"), F.sum("total").alias("cards"), F.sum("due").alias("due"), F.countDistinct("category").alias("categories"), F.countDistinct(F.nullif("folder_id", F.lit(""))).alias("folders"))
    return t


@catalog.add("mastery_labels", f"""with {_D}, m as (select id, case when total > 0 then 100.0 * (total - due) / total else 0 end p from d) select id, case when p >= 80 then 'Excelente' when p >= 60 then 'Bom' when p >= 40 then 'Regular' else 'Precisa Melhorar' end "label" from m""")
def mastery_labels(spark: SparkSession, d: str) -> DataFrame:
    pct = F.when(F.col("total") > 0, 100.0 * (F.col("total") - F.col("due")) / F.col("total"))
    return _decks(spark, d).select("id", lib.mastery_label(pct).alias("label"))


_SETS = """q as (select distinct id, source_asset_id s, correct_letter l, confidence c from extracted_questions where source_asset_id is not null), k as (select s, count(*) questions, count(*) filter (l is not null) answered, count(*) filter (l in ('A', 'B')) correct from q group by 1)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Question sets as they are kept: an asset's questions, with what is answered and right, nested."""
    q = table(spark, d, "extracted_questions").where("source_asset_id is not null").select("id", "source_asset_id", "correct_letter", "confidence").distinct()
    one = F.struct(F.col("correct_letter").isNotNull().alias("is_answered"), F.coalesce(F.col("correct_letter").isin("A", "B"), F.lit(False)).alias("is_correct"))
    return q.groupBy(F.col("source_asset_id").alias("set_id")).agg(F.collect_list(one).alias("questions"))


@catalog.add("question_sets", f"with {_SETS} select s set_id, questions, answered, correct, questions = answered completed from k")
def question_sets(spark: SparkSession, d: str) -> DataFrame:
    answered, correct, completed = lib.answer_counts(F.col("questions"))
    return _sets(spark, d).select("set_id", F.size("questions").cast("bigint").alias("questions"), answered.cast("bigint").alias("answered"), correct.cast("bigint").alias("correct"), completed.alias("completed"))


@catalog.add("set_totals", f"with {_SETS} select sum(questions)::bigint questions, sum(answered)::bigint answered, sum(correct)::bigint correct, floor(sum(correct) * 100.0 / sum(answered) + 0.5)::bigint accuracy from k")
def set_totals(spark: SparkSession, d: str) -> DataFrame:
    return lib.set_totals(question_sets(spark, d))


_W = r"len(regexp_extract_all(coalesce(statement, ''), '\S+'))"


@catalog.add("anchored_profiles", f"""with s as (select source_asset_id asset, avg({_W}) w, count(*) filter (confidence = 'high') / count(*) cases, count(*) filter (confidence = 'low') / count(*) tricks from (select distinct id, source_asset_id, statement, confidence from extracted_questions) group by 1)
    select asset, floor((0.3 * 0.4 + 0.7 * cases) * 100 + 0.5) / 100 context, floor((0.3 * 0.5 + 0.7 * case when w < 35 then 0.25 when w < 65 then 0.5 when w < 110 then 0.75 else 0.95 end) * 100 + 0.5) / 100 long_cases,
    floor((0.4 * 0.2 + 0.6 * least(1.0, tricks * 3.5)) * 100 + 0.5) / 100 tricks from s""")  # fmt: skip
def anchored_profiles(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").select("id", "source_asset_id", "statement", "confidence").distinct()
    words = F.size(F.regexp_extract_all(F.coalesce("statement", F.lit("")), F.lit(r"(\S+)")))
    share = lambda x: F.count_if(F.col("confidence") == x) / F.count("*")
    s = q.groupBy(F.col("source_asset_id").alias("asset")).agg(F.avg(words).alias("w"), share("high").alias("cases"), share("low").alias("traps"))
    context, long_cases, tricks = lib.anchored(F.lit(0.4), F.lit(None).cast("double"), F.lit(0.2), F.col("cases"), F.col("w"), F.col("traps"))
    return s.select("asset", context.alias("context"), long_cases.alias("long_cases"), tricks.alias("tricks"))


_FOLDED = "strip_accents(lower(coalesce(system, '') || ' ' || coalesce(term, '')))"


@catalog.add("service_categories", f"""select id, case when contains(lower(coalesce(system, '')), 'medicamento') or contains(lower(coalesce(system, '')), 'tuss-20') then 'MEDICAMENTO' when {" or ".join(f"contains({_FOLDED}, '{w}')" for w in lib.EXAM_WORDS)} then 'EXAME' else 'PROCEDIMENTO' end category from terms""")
def service_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").select("id", lib.service_category(F.col("system"), F.col("term")).alias("category"))


def _case(c: str, words: tuple) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({c}, '{w}')" for w in ws) + f" then '{k}'" for ws, k in words) + " else 'other' end"


@catalog.add("material_categories", f"""select distinct id, title, case when coalesce(category, '') <> '' then {_case("lower(trim(category))", lib.NAME_WORDS)} when coalesce(subcategory, '') <> '' then {_case("lower(trim(subcategory))", lib.NAME_WORDS)}
    when coalesce(title, '') <> '' then {_case("lower(title)", lib.FILE_WORDS)} else 'other' end kind from knowledge_assets""")  # fmt: skip
def material_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_assets").select("id", "title", lib.metadata_category(F.col("category"), F.col("subcategory"), F.col("title")).alias("kind")).distinct()


@catalog.add("like_questions", """with q as (select distinct id, lower(trim(coalesce(specialty, ''))) s, lower(trim(coalesce(confidence, ''))) t, lower(coalesce(correct_letter, '')) g from extracted_questions)
    select id from q where (contains(s, 'cardiologia') or contains('cardiologia', s)) and (contains(t, 'high') or contains('high', t) or contains(g, 'high') or contains(t, 'b') or contains('b', t) or contains(g, 'b')) order by id limit 200""")  # fmt: skip
def like_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").select("id", "specialty", F.col("confidence").alias("topic"), F.col("confidence").alias("subtopic"), F.array("correct_letter").alias("tags")).distinct()
    return lib.like_questions(q, "Cardiologia", "high", "b", "id", 200)


@catalog.add("linked_cards", """with k as (select distinct unnest(asset_ids) asset, source_code "key" from graph_edges), l as (select distinct deck_id "key", id card from cards where deck_id is not null)
    select distinct asset, card from (select asset, card from k join l using ("key") union all select asset, card from k join (select id card, unnest(canonical_keys) "key" from cards) using ("key"))""")  # fmt: skip
def linked_cards(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "graph_edges").select(F.explode("asset_ids").alias("asset"), F.col("source_code").alias("key")).distinct()
    cards = table(spark, d, "cards")
    return lib.linked_cards(keys, cards.select(F.col("deck_id").alias("key"), F.col("id").alias("card")).distinct(), cards.select(F.col("id").alias("card"), F.col("canonical_keys").alias("keys")))


@catalog.add("deck_copy", """select d.id is not null copied, title || ' (Cópia)' title, (select count(distinct id) from cards where deck_id = d.id) total_cards from decks d where id = 'dck-00-000002'""")
def deck_copy(spark: SparkSession, d: str) -> DataFrame:
    deck, _ = lib.copy_deck(table(spark, d, "decks"), table(spark, d, "cards"), "dck-00-000002", F.to_timestamp(F.lit(NOW)))
    return deck.select(F.col("id").isNotNull().alias("copied"), "title", "total_cards")


@catalog.add("professor_questions", """with p as (select id profile, max(nullif(trim(professor), '')) name from knowledge_assets where professor is not null group by 1), q as (select distinct id question, source_asset_id asset from extracted_questions where source_asset_id is not null),
    a as (select profile, question from p join q on asset = profile) select * from a""")  # fmt: skip
def professor_questions(spark: SparkSession, d: str) -> DataFrame:
    """Profiles are assets with a professor, their documents are themselves; their names are in no asset id."""
    p = table(spark, d, "knowledge_assets").where("professor is not null").groupBy(F.col("id").alias("profile")).agg(F.max(F.nullif(F.trim("professor"), F.lit(""))).alias("name"))
    q = table(spark, d, "extracted_questions").where("source_asset_id is not null").select(F.col("id").alias("question"), F.col("source_asset_id").alias("asset")).distinct()
    return lib.professor_questions(p.withColumn("documents", F.array("profile")).withColumn("files", F.array().cast("array<string>")), q)


@catalog.add("authors_and_institutions", """with a as (select distinct id, professor, institution from knowledge_assets) select 'author' kind, professor as name, count(*) n from a group by 2 union all select 'institution', institution, count(*) from a group by 2""")
def authors_and_institutions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "knowledge_assets").select("id", "professor", "institution").distinct()
    count = lambda c, kind: a.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count("professor", "author").unionByName(count("institution", "institution"))


@catalog.add("packed_excerpts")
def packed_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The statements of an asset's questions, in order, packed into pieces."""
    q = table(spark, d, "extracted_questions").where("statement is not null and source_asset_id is not null").select("source_asset_id", "id", "statement").distinct()
    ordered = q.groupBy("source_asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "statement"))), lambda x: x["statement"]).alias("xs"))
    return ordered.select("source_asset_id", F.posexplode(lib.packed_excerpts(F.col("xs"))).alias("pos", "piece")).select("source_asset_id", "pos", F.length("piece").alias("chars"), F.md5("piece").alias("piece"))


@catalog.add("file_hashes", """with t as (select asset_id, sha256(conteudo_texto) h, case when model = 'exam' then sha256(conteudo_texto) when model = 'book' then 'x' end e from asset_texts), n as (select h, count(*) c from t where h is not null group by 1)
    select asset_id, coalesce(n.c > 1, false) duplicate, coalesce(e, '') <> '' and coalesce(t.h, '') <> e mismatch from t left join n on n.h = t.h""")  # fmt: skip
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files: those with equal contents, and those of another hash than is expected (books here)."""
    t = table(spark, d, "asset_texts").withColumn("expected", F.when(F.col("model") == "exam", F.sha2(F.col("conteudo_texto"), 256)).when(F.col("model") == "book", "x"))
    e = lib.hash_errors(t, "asset_id", "conteudo_texto", "expected")
    return e.select("asset_id", F.array_contains("errors", "DUPLICATE").alias("duplicate"), F.array_contains("errors", "HASH_MISMATCH").alias("mismatch"))


@catalog.add("file_checksums")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_texts").where("conteudo_texto is not null").select("asset_id", lib.checksum(F.encode("conteudo_texto", "UTF-8")).alias("checksum"))

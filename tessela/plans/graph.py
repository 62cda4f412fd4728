"""Knowledge graph, referential clean-up, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.functions.text import fold
from tessela.operators import joins as j
from tessela.operators import review, rollups
from tessela.operators.components import connected_components
from tessela.session import table

catalog = Catalog()
_E = "(select distinct id, source_code, target_code, predicate, occurrence_count, confidence, asset_ids from graph_edges)"
_N = "(select distinct canonical_code, display_text, type, deleted_at from graph_nodes)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges").dropDuplicates(["id"])


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").dropDuplicates(["id"])


def _neighbour_sql(where: str) -> str:
    return f"""with l as (select canonical_code code, min(display_text) label, min(type) "type" from {_N} group by 1),
    u as (select 'out' direction, target_code code, predicate, occurrence_count from {_E} where source_code = 'CIX:00000001' {where}
      union all select 'in', source_code, predicate, occurrence_count from {_E} where target_code = 'CIX:00000001' {where})
    select direction, u.code, coalesce(label, u.code) as "label", coalesce(l."type", 'desconhecido') "type", predicate, coalesce(occurrence_count, 1) weight from u left join l on u.code = l.code"""


@catalog.add("graph_neighbors", _neighbour_sql(""))
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return j.neighbours(_edges(spark, d), _nodes(spark, d), "CIX:00000001")


@catalog.add("graph_neighbors_predicate", _neighbour_sql("and predicate = 'trata'"))
def graph_neighbors_predicate(spark: SparkSession, d: str) -> DataFrame:
    return j.neighbours(_edges(spark, d), _nodes(spark, d), "CIX:00000001", "trata")


@catalog.add("two_hop_siblings", f"""with m as (select b.source_code sibling from {_E} a join {_E} b on a.target_code = b.target_code and b.predicate in ('trata', 'causa') and b.source_code <> a.source_code where a.source_code = 'CIX:00000001'
    union select source_code from {_E} where target_code = 'CIX:00000001' and predicate in ('trata', 'causa') and source_code <> 'CIX:00000001')
    select distinct sibling from m join {_N} n on n.canonical_code = sibling where n.type = (select min(type) from graph_nodes where canonical_code = 'CIX:00000001')""")  # fmt: skip
def two_hop_siblings(spark: SparkSession, d: str) -> DataFrame:
    return j.two_hop_siblings(_edges(spark, d), _nodes(spark, d), "CIX:00000001", ["trata", "causa"])


@catalog.add("category_siblings", "select distinct b.canonical_term sibling from canonical_terms a join canonical_terms b on a.category = b.category and a.ref_id <> b.ref_id where a.ref_id = 2 order by 1 limit 25")
def category_siblings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "canonical_terms")
    own = t.where("ref_id = 2").select("category")
    return t.where("ref_id != 2").join(F.broadcast(own), "category", "left_semi").select(F.col("canonical_term").alias("sibling")).distinct().orderBy("sibling").limit(25)


@catalog.add("edge_rollup", f"""with e as (select * from {_E}), r as (select source_code, predicate, target_code, sum(occurrence_count)::bigint n, max(coalesce(confidence, 0.8)) confidence from e group by all),
    a as (select source_code, predicate, target_code, count(distinct x)::bigint assets from (select source_code, predicate, target_code, unnest(asset_ids) x from e) group by all)
    select r.*, coalesce(assets, 0)::bigint assets from r left join a on r.source_code is not distinct from a.source_code and r.predicate is not distinct from a.predicate and r.target_code is not distinct from a.target_code""")  # fmt: skip
def edge_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    by = ["source_code", "predicate", "target_code"]
    # two levels: first by asset, so that no set of assets is gathered in one task
    n = e.groupBy(*by).agg(F.sum("occurrence_count").alias("n"), F.max(F.coalesce("confidence", F.lit(0.8))).alias("confidence"))
    a = e.select(*by, F.explode("asset_ids").alias("a")).groupBy(*by, "a").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.sum("one").alias("assets"))
    on = [F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by]
    return n.alias("n").join(a.alias("a"), on, "left").select(*[F.col(f"n.{c}") for c in by], "n", "confidence", F.coalesce("assets", F.lit(0)).alias("assets"))


@catalog.add("entity_rollup", """with s as (select distinct id, trim(display_text) t, canonical_code, type, strftime(created_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f') at_ from graph_nodes where display_text is not null)
    select strip_accents(lower(t)) "key", count(*) n, min(id) first_id, count(distinct canonical_code) codes, arg_max(t, (at_, id)) display from s group by 1""")  # fmt: skip
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = _nodes(spark, d).where("display_text is not null").select("id", F.trim("display_text").alias("t"), "canonical_code", "created_at")
    return s.groupBy(fold(F.col("t")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.countDistinct("canonical_code").alias("codes"), F.max_by("t", F.struct("created_at", "id")).alias("display"))


@catalog.add("rollup_merge", "select l_partkey, count(*) n, max(l_discount) top, count(distinct l_suppkey) suppliers from lineitem group by 1")
def rollup_merge(spark: SparkSession, d: str) -> DataFrame:
    """Partial roll-ups that merge to the whole: by supplier first, so that no set of suppliers is gathered anywhere."""
    part = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("top"))
    return part.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.count("l_suppkey").alias("suppliers"))


@catalog.add("obsolete_edges", f"""select id from {_E} e where not exists (select 1 from knowledge_assets a where list_contains(e.asset_ids, a.id))
    and not exists (select 1 from (select unnest(canonical_keys) k from cards) c where c.k = e.source_code or c.k = e.target_code)""")  # fmt: skip
def obsolete_edges(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "cards").select(F.explode("canonical_keys").alias("k")).distinct()
    return j.obsolete_edges(_edges(spark, d), table(spark, d, "knowledge_assets"), links)


@catalog.add("orphan_links", "select distinct id from chunk_vectors where asset_id is not null and asset_id not in (select id from knowledge_assets)")
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").where("asset_id is not null").join(table(spark, d, "knowledge_assets").select(F.col("id").alias("asset_id")), "asset_id", "left_anti").select("id").distinct()


@catalog.add("semi_existing", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_existing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@catalog.add("anti_missing", "select distinct canonical_key from (select unnest(canonical_keys) canonical_key from cards) where canonical_key not in (select display_text from graph_nodes where display_text is not null)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "cards").select(F.explode("canonical_keys").alias("canonical_key"))
    return j.missing(keys, table(spark, d, "graph_nodes").select(F.col("display_text").alias("canonical_key")), "canonical_key")


@catalog.add("array_overlap_join", "select distinct a.id, q.asset from (select id, unnest(asset_ids) m from graph_edges) a join (select id asset from knowledge_assets where deleted_at is null) q on a.m = q.asset")
def array_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges")
    a = table(spark, d, "knowledge_assets").where("deleted_at is null").select(F.col("id").alias("asset"), F.array("id").alias("own"))
    return j.overlapping_arrays(e, "id", "asset_ids", a, "asset", "own")


@catalog.add("fallback_cascade", """with a as (select distinct id, asset_id, professor from chunk_vectors), s1 as (select distinct q.id qid, a.id cid, 1 s from extracted_questions q join a on a.asset_id = q.source_asset_id),
    s2 as (select distinct id qid, specialty cid, 2 s from extracted_questions where specialty is not null), u as (select * from s1 union all select * from s2)
    select qid, cid from u where s = (select min(s) from u v where v.qid = u.qid)""")  # fmt: skip
def fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions")
    c = table(spark, d, "chunk_vectors").select(F.col("id").alias("cid"), F.col("asset_id").alias("source_asset_id"))
    by_asset = q.join(c, "source_asset_id").select(F.col("id").alias("qid"), "cid").distinct()
    by_field = q.where("specialty is not null").select(F.col("id").alias("qid"), F.col("specialty").alias("cid")).distinct()
    return j.first_non_empty([by_asset, by_field], "qid")


@catalog.add("substring_theta_join", "select distinct c.canonical_term as name, t.id from canonical_terms c join terms t on contains(lower(t.term), lower(trim(c.canonical_term))) or contains(lower(coalesce(t.canonical_term, '')), lower(trim(c.canonical_term)))")
def substring_theta_join(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "canonical_terms").select(F.col("canonical_term").alias("name"))
    return j.substring_join(names, "name", "name", table(spark, d, "terms"), "id", ["term", "canonical_term"])


@catalog.add("priority_union", """with u as (select category grp, canonical_term t, 0 p from canonical_terms union all select category, term, 1 from terms where category is not null),
    n as (select grp, t, p, strip_accents(lower(trim(t))) k from u where t is not null and trim(t) <> ''), b as (select grp, k, min((p, t)) m from n group by all),
    r as (select grp, m[1] prio, m[2] as "text", row_number() over (partition by grp order by m[1], m[2])::int pos from b) select grp, "text", prio, pos from r where pos <= 300""")  # fmt: skip
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "canonical_terms").select(F.col("category").alias("grp"), F.col("canonical_term").alias("text"))
    b = table(spark, d, "terms").where("category is not null").select(F.col("category").alias("grp"), F.col("term").alias("text"))
    return j.priority_union([a, b], "grp", "text", fold(F.trim(F.col("text"))), None, 300).select("grp", "text", "prio", "pos")


@catalog.add("union_distinct", "select distinct source_code code from graph_edges where source_code is not null union select target_code from graph_edges where target_code is not null")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges")
    return e.select(F.col("source_code").alias("code")).union(e.select("target_code")).where("code is not null").distinct()


@catalog.add("except_keys", "select canonical_code code from graph_nodes except select source_code from graph_edges")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").select(F.col("canonical_code").alias("code")).subtract(table(spark, d, "graph_edges").select("source_code"))


@catalog.add("tag_set_merge", "select id, list_sort(list_distinct(list_concat(tags, canonical_keys))) merged from (select distinct id, tags, canonical_keys from cards)")
def tag_set_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards").select("id", "tags", "canonical_keys").distinct()
    return c.select("id", F.array_sort(F.array_distinct(F.concat(F.col("tags"), F.col("canonical_keys")))).alias("merged"))


@catalog.add("array_intersection", "select id, list_sort(list_intersect(tags, ['revisar', 'prova', 'alto rendimento'])) kept from (select distinct id, tags from cards)")
def array_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("id", "tags").distinct().select("id", F.array_sort(F.array_intersect("tags", F.array(*map(F.lit, ["revisar", "prova", "alto rendimento"])))).alias("kept"))


@catalog.add("first_claim_wins", "select strip_accents(lower(title)) topic, min((category, id))[1] claimed_by from decks where category is not null group by 1")
def first_claim_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decks").where("category is not null").groupBy(fold(F.col("title")).alias("topic")).agg(F.min(F.struct("category", "id")).alias("m")).select("topic", F.col("m.category").alias("claimed_by"))


@catalog.add("bag_difference", "select l_returnflag, l_linestatus from lineitem where l_quantity > 40 except all select l_returnflag, l_linestatus from lineitem where l_quantity > 41")
def bag_difference(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pick = lambda q: li.where(f"l_quantity > {q}").select("l_returnflag", "l_linestatus")
    return pick(40).exceptAll(pick(41))


@catalog.add("snapshot_upsert", "select n_nationkey, case when n_regionkey = 1 then 'changed' else n_name end n_name from nation union all select 99, 'new'")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("int").alias("seq"))
    old = base.join(table(spark, d, "nation").where("n_regionkey = 1"), "n_nationkey", "left_semi").select("n_nationkey", F.lit("first").alias("n_name"), F.lit(1).alias("seq"))
    last = old.withColumn("n_name", F.lit("changed")).withColumn("seq", F.lit(2))
    new = spark.range(1).select(F.lit(99).alias("n_nationkey"), F.lit("new").alias("n_name"), F.lit(3).alias("seq"))
    return j.upsert(base, old.unionByName(last).unionByName(new), "n_nationkey", "seq")


@catalog.add("latest_wins", "select user_id, arg_max(event_type, (ts, event_id)) last_type, count(*) n from events group by 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@catalog.add("change_feed", """with o as (select s_suppkey k, s_name, s_acctbal from supplier where s_suppkey % 7 <> 0), n as (select s_suppkey k, s_name, case when s_suppkey % 5 = 0 then s_acctbal + 1 else s_acctbal end s_acctbal from supplier where s_suppkey % 11 <> 0)
    select k, case when o_k is null then 'create' when n_k is null then 'delete' else 'update' end event from (select coalesce(o.k, n.k) k, o.k o_k, n.k n_k, o.s_acctbal a, n.s_acctbal b from o full join n on o.k = n.k) where o_k is null or n_k is null or a <> b""")  # fmt: skip
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", "s_acctbal")
    new = s.where("k % 11 != 0").withColumn("s_acctbal", F.expr("case when k % 5 = 0 then s_acctbal + 1 else s_acctbal end"))
    return j.snapshot_changes(s.where("k % 7 != 0"), new, "k", ["s_name", "s_acctbal"])


@catalog.add("term_merge", """with e as (select id::varchar k, code, category from terms), n as (select id::varchar k, 'C' || id code, 'X' category from terms where id % 3 = 0 union all select 'new' || n_nationkey, 'N', 'Y' from nation)
    select e.k, coalesce(nullif(e.code, ''), n.code) code, coalesce(nullif(e.category, ''), n.category) category from e left join n using (k) union all select k, code, category from n where k not in (select k from e)""")  # fmt: skip
def term_merge(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms")
    e = t.select(F.col("id").cast("string").alias("k"), "code", "category")
    n = t.where("id % 3 = 0").select(F.col("id").cast("string").alias("k"), F.concat(F.lit("C"), F.col("id")).alias("code"), F.lit("X").alias("category"))
    new = table(spark, d, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey")).alias("k"), F.lit("N").alias("code"), F.lit("Y").alias("category"))
    return j.merge_terms(e, n.unionByName(new), "k", ["code", "category"])


@catalog.add("fuzzy_lookup", """with w as (select distinct id, unnest(string_split(strip_accents(lower(coalesce(normalized_term, ''))), ' ')) word from terms), t as (select distinct unnest(string_split(strip_accents(lower(canonical_term)), ' ')) term from canonical_terms),
    p as (select id, word, term, levenshtein(word, term)::int distance from w join t on length(word) >= 5 and length(term) >= 4 and case when length(word) <= 5 then left(word, 3) else left(word, 4) end in (left(term, 3), left(term, 4)) and abs(length(word) - length(term)) <= 1)
    select id, word, min((distance, abs(length(word) - length(term)), term))[3] term, min(distance) distance from p where distance <= case when length(word) < 7 then 1 else 2 end group by all""")  # fmt: skip
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "terms").select("id", F.explode(F.split(fold(F.coalesce("normalized_term", F.lit(""))), " ")).alias("word")).distinct()
    names = table(spark, d, "canonical_terms").select(F.explode(F.split(fold(F.col("canonical_term")), " ")).alias("term"))
    return j.fuzzy_lookup(words, names, "id", "word", "term")


@catalog.add("graph_components")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges")
    return connected_components(e, "source_code", "target_code")


@catalog.add("cascading_delete", "select distinct id from cards where deck_id is null or deck_id not in (select id from decks where deleted_at is not null)")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the cards when deleted decks take theirs with them."""
    gone = table(spark, d, "decks").where("deleted_at is not null").select(F.col("id").alias("deck_id"))
    return table(spark, d, "cards").join(gone, "deck_id", "left_anti").select("id").distinct()


@catalog.add("insert_select_copy", "select md5('copy' || id) id, 'dck-copy' deck_id, type from (select distinct id, type from cards where deck_id = 'dck-00-000002')")
def insert_select_copy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards").where("deck_id = 'dck-00-000002'").select("id", "type").distinct()
    return c.select(F.md5(F.concat(F.lit("copy"), F.col("id"))).alias("id"), F.lit("dck-copy").alias("deck_id"), "type")


@catalog.add("left_join_empty_list", """with b as (select asset_id, list_sort(list(distinct exam_board)) boards from chunk_vectors where exam_board is not null group by 1)
    select a.id, coalesce(b.boards, []) boards from (select distinct id from knowledge_assets) a left join b on a.id = b.asset_id""")  # fmt: skip
def left_join_empty_list(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "chunk_vectors").where("exam_board is not null").groupBy("asset_id").agg(F.array_sort(F.collect_set("exam_board")).alias("boards"))
    a = table(spark, d, "knowledge_assets").select("id").distinct()
    return a.join(b, F.col("id") == F.col("asset_id"), "left").select("id", F.coalesce("boards", F.array().cast("array<string>")).alias("boards"))


@catalog.add("card_relations", """with c as (select distinct id, deck_id from cards), q as (select d.category, count(distinct a.id) assets from decks d join knowledge_assets a on a.specialty = d.category group by 1),
    n as (select specialty, count(distinct id) questions from extracted_questions group by 1)
    select d.id deck_id, count(distinct c.id) cards, coalesce(max(q.assets), 0) assets, coalesce(max(n.questions), 0) questions from decks d left join c on c.deck_id = d.id left join q on q.category = d.category left join n on n.specialty = d.category group by 1""")  # fmt: skip
def card_relations(spark: SparkSession, d: str) -> DataFrame:
    """What belongs to a deck: its cards, and the assets and questions of its field; each side is aggregated before it is joined."""
    decks = table(spark, d, "decks").select(F.col("id").alias("deck_id"), "category")
    cards = table(spark, d, "cards").groupBy("deck_id").agg(F.countDistinct("id").alias("cards"))
    assets = table(spark, d, "knowledge_assets").groupBy(F.col("specialty").alias("category")).agg(F.countDistinct("id").alias("assets"))
    questions = table(spark, d, "extracted_questions").groupBy(F.col("specialty").alias("category")).agg(F.countDistinct("id").alias("questions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return decks.join(cards, "deck_id", "left").join(assets, "category", "left").join(questions, "category", "left").select("deck_id", zero("cards"), zero("assets"), zero("questions"))


@catalog.add("code_resolution", """select ref_id, coalesce(list_filter(c, lambda x: starts_with(x, 'CIX'))[1], list_filter(c, lambda x: starts_with(x, 'TUX'))[1], c[1]) code from (select ref_id, [system || ':' || code, 'ZZZ:' || ref_id] c from canonical_terms)""")
def code_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_terms").select("ref_id", F.array(F.concat_ws(":", "system", "code"), F.concat(F.lit("ZZZ:"), F.col("ref_id"))).alias("c"))
    return c.select("ref_id", j.first_code(F.col("c"), ["CIX", "TUX"]).alias("code"))


@catalog.add("interval_text", "select case when d > 0 then case when d < 30 then printf('%d dias', d) when d < 365 then printf('%.1f meses', d / 30.0) else printf('%.1f anos', d / 365.0) end else '< 1 min' end shown, count(*) n from (select coalesce(any_value(sm2).interval, 0) d from cards group by id) group by 1")
def interval_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards").dropDuplicates(["id"])
    return c.groupBy(review.interval_text(F.coalesce("sm2.interval", F.lit(0)), F.lit(0)).alias("shown")).agg(F.count("*").alias("n"))


def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations as they may be read from the chunks of assets: the ends of the edges, and the edges."""
    nodes = table(spark, d, "graph_nodes").groupBy(F.col("canonical_code").alias("c")).agg(F.min("display_text").alias("t"), F.min("type").alias("type"), F.min("code_system").alias("code_system"))
    e = _edges(spark, d).select("id", "source_code", "target_code", "predicate", "confidence", F.explode(F.array_distinct("asset_ids")).alias("asset"))
    end = lambda code, mark: e.select("asset", F.concat("id", F.lit(mark)).alias("seq"), F.col(code).alias("c"), "confidence").join(nodes, "c")
    both = end("source_code", "#0").unionByName(end("target_code", "#1"))
    entities = both.select("asset", "seq", F.coalesce("t", "c").alias("text"), "type", "code_system", F.when(F.col("code_system").isNotNull(), F.col("c")).alias("code"), "confidence")
    name = lambda code, out: nodes.select(F.col("c").alias(code), F.coalesce("t", "c").alias(out))
    relations = e.join(name("source_code", "s"), "source_code", "left").join(name("target_code", "o"), "target_code", "left")
    return entities, relations.select("asset", F.col("id").alias("seq"), F.coalesce("s", "source_code").alias("subject"), "predicate", F.coalesce("o", "target_code").alias("object"), "confidence")


_MENTIONS = """n as (select canonical_code c, min(display_text) t, min(type) ty, min(code_system) cs from graph_nodes group by 1),
    e as (select id, source_code, target_code, predicate, confidence, unnest(list_distinct(asset_ids)) chunk from (select distinct id, source_code, target_code, predicate, confidence, asset_ids from graph_edges)),
    m as (select chunk, id || '#0' seq, c, t, ty, cs, confidence from e join n on c = source_code union all select chunk, id || '#1', c, t, ty, cs, confidence from e join n on c = target_code),
    k as (select chunk, seq, coalesce(t, c) txt, strip_accents(lower(trim(coalesce(t, c)))) norm, coalesce(ty, 'finding') "type", cs, case when cs is not null then c end code, coalesce(confidence, 0.8) conf from m),
    d as (select chunk, norm, "type", arg_min(txt, seq) "text", arg_min(cs, seq) filter (code is not null) cs1, arg_min(cs, seq) cs0, arg_min(code, seq) filter (code is not null) code, max(conf) confidence, min(seq) seq from k where norm <> '' group by all),
    x as (select chunk, norm, "type", "text", case when code is not null then cs1 else cs0 end code_system, code, coalesce(case when code is not null then cs1 || ':' || code end, trim(regexp_replace(regexp_replace(norm, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) canonical_key, confidence, seq from d)"""


@catalog.add("chunk_entities", f"with {_MENTIONS} select * from x")
def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    return rollups.dedup_entities(_mentions(spark, d)[0], "asset", "seq")


@catalog.add("chunk_relations", f"""with {_MENTIONS}, r as (select chunk, strip_accents(lower(trim(coalesce(a.t, source_code)))) subject, predicate, strip_accents(lower(trim(coalesce(b.t, target_code)))) "object", max(coalesce(confidence, 0.8)) confidence
    from e left join n a on a.c = source_code left join n b on b.c = target_code where source_code is not null and target_code is not null and predicate <> '' group by all),
    l as (select chunk, norm, arg_max(canonical_key, (seq, "type")) "key" from x group by all)
    select r.chunk, subject, predicate, "object", s."key" subject_key, o."key" object_key, confidence from r join l s on s.chunk = r.chunk and s.norm = subject join l o on o.chunk = r.chunk and o.norm = "object" """)  # fmt: skip
def chunk_relations(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = _mentions(spark, d)
    return rollups.dedup_relations(relations, "asset", "seq", rollups.dedup_entities(entities, "asset", "seq"))


def _index_sql(by: str) -> str:
    return f"""select {by}canonical_key, count(*) n, coalesce(arg_max("text", (chunk, seq, "type")) filter (confidence > 0.85), arg_min("text", (chunk, seq, "type"))) display, arg_min("type", (chunk, seq, "type")) "type",
    arg_max(code_system, (chunk, seq, "type")) filter (code_system is not null) code_system, arg_max(code, (chunk, seq, "type")) filter (code is not null) code,
    list_distinct(list(chunk order by chunk, seq, "type")) assets, list_distinct(list("text" order by chunk, seq, "type")) texts from x group by all"""


def _sizes(df: DataFrame) -> DataFrame:
    """Sets by their size and their members in the order of the alphabet."""
    show = lambda c: F.md5(F.array_join(F.array_sort(c), "|")).alias(c)
    return df.select("canonical_key", "n", "display", "type", "code_system", "code", F.size("assets").cast("bigint").alias("n_assets"), show("assets"), show("texts"))


_SIZES = """canonical_key, n, display, "type", code_system, code, len(assets) n_assets, md5(array_to_string(list_sort(assets), '|')) assets, md5(array_to_string(list_sort(texts), '|')) texts"""


@catalog.add("entity_index", f"with {_MENTIONS}, i as ({_index_sql('')}) select {_SIZES} from i")
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(rollups.entity_index(rollups.dedup_entities(_mentions(spark, d)[0], "asset", "seq")))


@catalog.add("index_merge", f"""with {_MENTIONS}, i as ({_index_sql("right(chunk, 1) part, ")}), g as (select canonical_key, sum(n)::bigint n, arg_min(display, part) display, arg_min("type", part) "type", arg_min_null(code_system, part) code_system, arg_min_null(code, part) code,
    list_distinct(flatten(list(assets))) assets, list_distinct(flatten(list(texts))) texts from i group by 1) select {_SIZES} from g""")  # fmt: skip
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    """The index of each part of the assets (by the last digit of their ids), and these merged."""
    entities = rollups.dedup_entities(_mentions(spark, d)[0], "asset", "seq").withColumn("part", F.right("chunk", F.lit(1)))
    return _sizes(rollups.merge_indexes(rollups.entity_index(entities, ["part"]), "part"))

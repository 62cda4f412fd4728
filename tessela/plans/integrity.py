"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessela.catalog import Catalog
from tessela.operators.references import orphan_report, orphans, parents, references
from tessela.session import table

catalog = Catalog()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "graph_edges")
    refs = (
        references(table(spark, d, "cards"), "cards", "deck_id", "id", "created_at", "decks")
        .unionByName(references(table(spark, d, "chunk_vectors"), "chunk_vectors", "asset_id", "id", "created_at", "knowledge_assets"))
        .unionByName(references(edges, "graph_edges", "source_code", "id", "updated_at", "graph_nodes"))
        .unionByName(references(edges, "graph_edges", "target_code", "id", "updated_at", "graph_nodes"))
    )
    targets = (
        parents(table(spark, d, "decks"), "decks", "id", updated="updated_at")
        .unionByName(parents(table(spark, d, "knowledge_assets"), "knowledge_assets", "id", updated="updated_at"))
        .unionByName(parents(table(spark, d, "graph_nodes"), "graph_nodes", "canonical_code"))
    )
    return orphans(refs, targets)


_KEY = r"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


def _ref(t: str, f: str, at: str, parent: str) -> str:
    return f"select '{t}' src_table, '{f}' field, id row_id, '{parent}' parent, {_KEY.format(c=f)} k, {at} ref_at from {t}"


def _parent(t: str, key: str, latest: str) -> str:
    return f"select '{t}' parent, k, created_at valid_from, deleted_at from (select *, {_KEY.format(c=key)} k, row_number() over (partition by {_KEY.format(c=key)} order by {latest} desc, (deleted_at is null) desc) rn from {t}) where rn = 1 and k is not null"


_FOUND = f"""
with refs as ({' union all '.join([_ref('cards', 'deck_id', 'created_at', 'decks'), _ref('chunk_vectors', 'asset_id', 'created_at', 'knowledge_assets'), _ref('graph_edges', 'source_code', 'updated_at', 'graph_nodes'), _ref('graph_edges', 'target_code', 'updated_at', 'graph_nodes')])}),
parents as ({' union all '.join([_parent('decks', 'id', 'updated_at desc, created_at'), _parent('knowledge_assets', 'id', 'updated_at desc, created_at'), _parent('graph_nodes', 'canonical_code', 'created_at')])}),
found as (select distinct src_table, field, row_id, r.k ref_key, strftime(ref_at at time zone 'UTC', '%Y-%m') as "month",
  case when p.k is null then 'missing' when p.deleted_at is not null then 'deleted' when p.valid_from > r.ref_at then 'late' end reason
  from refs r left join parents p on r.parent = p.parent and r.k = p.k where r.k is not null)
"""


@catalog.add("p3_found", _FOUND + "select distinct src_table, field, row_id from found where reason is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "field", "row_id").distinct()


@catalog.add("p3_report", _FOUND + 'select src_table, field, "month", reason, count(*) orphans, count(distinct ref_key) missing_keys from found where reason is not null group by all')
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))

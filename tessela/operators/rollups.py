"""Entities and relations as read from chunks: deduplicated within a chunk, rolled up over all, merged from parts.

Counts, minima and picks are aggregated partially before the shuffle.  Sets (assets, texts) are first made distinct by an
aggregate of their own, so that only distinct members are gathered, in the order in which they were first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions.clean import canonical_key
from tessela.functions.text import fold, squeeze

# What is taken for missing parts, and from which confidence a text is shown.
KIND, CONFIDENCE, SHOWN = "finding", 0.8, 0.85


def entity_norm(c: Column) -> Column:
    """Folded, with single blanks; blank is null."""
    return F.nullif(squeeze(fold(c)), F.lit(""))


def dedup_entities(df: DataFrame, chunk: str, seq: str) -> DataFrame:
    """(chunk, norm, type, text, code_system, code, canonical_key, confidence, seq): an entity of a chunk once.

    ``df`` has text, type, code_system, code and confidence.  An entity is its normal text and type; of its mentions the
    first gives the text, the first that has a code its code and system, the surest the confidence.  Blank texts are none.
    """
    m = df.select(F.col(chunk).alias("chunk"), F.col(seq).alias("seq"), F.trim("text").alias("text"), entity_norm(F.col("text")).alias("norm"), F.coalesce("type", F.lit(KIND)).alias("type"), "code_system", F.nullif(F.trim("code"), F.lit("")).alias("code"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))
    coded = F.col("code").isNotNull()
    g = m.where("norm is not null").groupBy("chunk", "norm", "type").agg(
        F.min_by("text", "seq").alias("text"), F.min_by(F.struct("code_system", "code"), F.when(coded, F.col("seq"))).alias("c"), F.min_by("code_system", "seq").alias("s"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq")
    )
    g = g.withColumn("code", F.col("c.code")).withColumn("code_system", F.when(F.col("code").isNotNull(), F.col("c.code_system")).otherwise(F.col("s")))
    return g.select("chunk", "norm", "type", "text", "code_system", "code", canonical_key(F.col("code_system"), F.col("code"), F.col("norm")).alias("canonical_key"), "confidence", "seq")


def dedup_relations(df: DataFrame, chunk: str, seq: str, entities: DataFrame) -> DataFrame:
    """(chunk, subject, predicate, object, subject_key, object_key, confidence): a relation of a chunk once.

    ``df`` has subject, predicate, object and confidence; ``entities`` are those of ``dedup_entities``.  Both ends must be
    entities of the same chunk; of entities with the same normal text the one seen last holds.
    """
    r = df.select(F.col(chunk).alias("chunk"), entity_norm(F.col("subject")).alias("subject"), F.nullif("predicate", F.lit("")).alias("predicate"), entity_norm(F.col("object")).alias("object"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))
    once = r.dropna().groupBy("chunk", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))
    known = entities.groupBy("chunk", "norm").agg(F.max_by("canonical_key", F.struct("seq", "type")).alias("key"))
    end = lambda name: known.select("chunk", F.col("norm").alias(name), F.col("key").alias(f"{name}_key"))
    return once.join(end("subject"), ["chunk", "subject"]).join(end("object"), ["chunk", "object"]).select("chunk", "subject", "predicate", "object", "subject_key", "object_key", "confidence")


def _in_order(df: DataFrame, by: list[str], member: str, order: Column, name: str) -> DataFrame:
    """The distinct members of each group, in the order in which they were first seen."""
    first = df.where(F.col(member).isNotNull()).groupBy(*by, member).agg(F.min(order).alias("o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(member).alias("m")))), lambda x: x["m"]).alias(name))


def entity_index(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, canonical_key, n, display, type, code_system, code, assets, texts): entities over all chunks, by their order.

    The last sure text is shown, else the first; code and system are the last ones known; the chunk is the asset.
    """
    keys = [*(by or []), "canonical_key"]
    e = entities.withColumn("o", F.struct("chunk", "seq", "type"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c)
    sure = F.max_by("text", F.when(F.col("confidence") > SHOWN, F.col("o")))
    n = e.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(sure, F.min_by("text", "o")).alias("display"), F.min_by("type", "o").alias("kind"), last("code_system"), last("code"))
    sets = _in_order(e, keys, "chunk", F.col("o"), "assets").join(_in_order(e, keys, "text", F.col("o"), "texts"), keys, "left")
    return n.join(sets, keys, "left").select(*keys, "n", "display", F.col("kind").alias("type"), "code_system", "code", "assets", "texts")


def merge_indexes(parts: DataFrame, part: str) -> DataFrame:
    """One index of the indexes of parts: counts add up, sets unite in the order of the parts, the first part gives the rest."""
    key = ["canonical_key"]
    first = [F.min_by(c, part).alias(c) for c in ("display", "type", "code_system", "code")]
    n = parts.groupBy(*key).agg(F.sum("n").alias("n"), *first)
    for name in ("assets", "texts"):
        each = parts.select(*key, F.col(part).alias("p"), F.posexplode(name).alias("at", "m"))
        n = n.join(_in_order(each, key, "m", F.struct("p", "at"), name), key, "left")
    return n.select(*key, "n", "display", "type", "code_system", "code", "assets", "texts")

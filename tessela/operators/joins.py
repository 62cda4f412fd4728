"""Joins that are more than an equality of two columns.

Sides are broadcast only after a check of their size; beyond it the same result comes from a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions.text import fold
from tessela.session import cut_lineage

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text up to which sought texts are broadcast.
BROADCAST_BYTES = 32_000_000
#: Hashes that are broadcast, at most, to spare rows without a partner a shuffle.
KEYS = 1_000_000


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most ``most`` rows; counted without reading more than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def neighbours(edges: DataFrame, nodes: DataFrame, code: str, predicate: str | None = None) -> DataFrame:
    """(direction, code, label, predicate, weight): what a node is linked with, both ways; unknown nodes show their code.

    A predicate narrows both directions, as its meaning is: (source or target) and predicate.
    """
    e = edges.where(F.col("predicate") == predicate) if predicate else edges
    out = e.where(F.col("source_code") == code).select(F.lit("out").alias("direction"), F.col("target_code").alias("code"), "predicate", "occurrence_count")
    back = e.where(F.col("target_code") == code).select(F.lit("in").alias("direction"), F.col("source_code").alias("code"), "predicate", "occurrence_count")
    labels = nodes.groupBy(F.col("canonical_code").alias("code")).agg(F.min("display_text").alias("label"), F.min("type").alias("type"))
    return out.unionByName(back).join(labels, "code", "left").select("direction", "code", F.coalesce("label", "code").alias("label"), F.coalesce("type", F.lit("desconhecido")).alias("type"), "predicate", F.coalesce("occurrence_count", F.lit(1)).alias("weight"))


def two_hop_siblings(edges: DataFrame, nodes: DataFrame, source: str, predicates: list[str]) -> DataFrame:
    """(sibling): other sources of the targets of a source, and sources that point to it, by the given predicates; of the
    source's own type.
    """
    kind = nodes.where(F.col("canonical_code") == source).agg(F.min("type").alias("type"))
    targets = edges.where(F.col("source_code") == source).select("target_code").distinct()
    second = edges.where(F.col("predicate").isin(predicates) & (F.col("source_code") != source)).select("source_code", "target_code")
    direct = second.where(F.col("target_code") == source).select(F.col("source_code").alias("sibling"))
    met = second.join(targets, "target_code", "left_semi").select(F.col("source_code").alias("sibling")).unionByName(direct).distinct()
    typed = nodes.join(F.broadcast(kind), "type", "left_semi").select(F.col("canonical_code").alias("sibling")).distinct()
    return met.join(typed, "sibling", "left_semi")


def obsolete_edges(edges: DataFrame, assets: DataFrame, links: DataFrame, edge_key: str = "id") -> DataFrame:
    """Keys of the edges none of whose assets lives and neither of whose ends is linked to content."""
    live = edges.select(edge_key, F.explode("asset_ids").alias("asset")).join(assets.select(F.col("id").alias("asset")), "asset", "left_semi").select(edge_key)
    ends = edges.select(edge_key, F.explode(F.array("source_code", "target_code")).alias("k")).join(links.select("k"), "k", "left_semi").select(edge_key)
    return edges.select(edge_key).distinct().join(live.distinct(), edge_key, "left_anti").join(ends.distinct(), edge_key, "left_anti")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The distinct wanted keys that are not present; null is none."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(present.select(key), key, "left_anti")


def overlapping_arrays(left: DataFrame, lk: str, la: str, right: DataFrame, rk: str, ra: str) -> DataFrame:
    """(lk, rk): pairs of rows whose arrays share a member; exploded to an equality join, so no row meets every other."""
    a = left.select(F.col(lk).alias("_l"), F.explode(F.array_distinct(la)).alias("m"))
    b = right.select(F.col(rk).alias("_r"), F.explode(F.array_distinct(ra)).alias("m"))
    return a.join(b, "m").select(F.col("_l").alias(lk), F.col("_r").alias(rk)).distinct()


def first_non_empty(stages: list[DataFrame], key: str) -> DataFrame:
    """A cascade of fallbacks: for each key only the rows of the first stage that has any."""
    tagged = None
    for i, s in enumerate(stages):
        s = s.withColumn("_stage", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    first = tagged.groupBy(key).agg(F.min("_stage").alias("_first"))
    return tagged.join(first, key).where("_stage = _first").drop("_stage", "_first")


def priority_union(stages: list[DataFrame], group: str, text: str, norm: Column, exclude: DataFrame | None, n: int) -> DataFrame:
    """(group, text, prio, pos): sources in order, each text once by its normal form, without excluded ones, first n of a group."""
    both = None
    for i, s in enumerate(stages):
        s = s.select(group, text).withColumn("prio", F.lit(i))
        both = s if both is None else both.unionByName(s)
    both = both.withColumn("norm", norm).where("norm != ''")
    if exclude is not None:
        both = both.join(exclude.select(group, "norm"), [group, "norm"], "left_anti")
    once = both.groupBy(group, "norm").agg(F.min(F.struct("prio", text)).alias("b")).select(group, "b.*")
    pos = F.row_number().over(Window.partitionBy(group).orderBy("prio", text))
    return once.withColumn("pos", pos).where(F.col("pos") <= n)


def contained(spans: DataFrame, items: DataFrame, doc: str) -> DataFrame:
    """Spans with the first item of their document that contains them: equality on the document, then a range.

    Spans are (doc, start, end, ...), items (doc, item, istart, iend).
    """
    hit = spans.join(items, doc).where("start >= istart and end <= iend")
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy(doc, "start", "end").orderBy("istart", "item"))).where("_r = 1").drop("_r")


def gaps(tokens: DataFrame, matches: DataFrame, doc: str) -> DataFrame:
    """Tokens (doc, start, end, ...) that overlap no match (doc, mstart, mend)."""
    m = matches.select(F.col(doc).alias("_d"), "mstart", "mend")
    return tokens.join(m, (F.col(doc) == F.col("_d")) & (F.col("start") < F.col("mend")) & (F.col("mstart") < F.col("end")), "left_anti")


def enrich_or_append(local: DataFrame, other: DataFrame, doc: str) -> DataFrame:
    """Local spans take the code of an overlapping other span where they have none; other spans that overlap none are added."""
    o = other.select(F.col(doc).alias("_d"), F.col("start").alias("ostart"), F.col("end").alias("oend"), F.col("code").alias("ocode"), F.col("text").alias("otext"))
    on = (F.col(doc) == F.col("_d")) & (F.col("start") < F.col("oend")) & (F.col("ostart") < F.col("end"))
    kept = local.join(o, on, "left").groupBy(doc, "start", "end", "text").agg(F.coalesce(F.max("code"), F.min_by("ocode", F.when(F.col("ocode").isNotNull(), F.col("ostart")))).alias("code"))
    l = local.select(F.col(doc).alias("_d"), F.col("start").alias("ostart"), F.col("end").alias("oend"))
    new = other.join(l, on, "left_anti").select(doc, "start", "end", "text", "code")
    return kept.unionByName(new)


def fuzzy_lookup(words: DataFrame, terms: DataFrame, key: str, word: str, term: str) -> DataFrame:
    """(key, word, term, distance): the best entry for a misspelt word of at least five letters.

    Both share a prefix (3 letters up to length 5, else 4), differ in length by one at most, and are one edit apart, or two
    from seven letters on.  An equality join on the prefix comes first.
    """
    w = words.where(F.length(word) >= 5).select(key, F.col(word).alias("w")).withColumn("p", F.when(F.length("w") <= 5, F.substring("w", 1, 3)).otherwise(F.substring("w", 1, 4)))
    t = terms.select(F.col(term).alias("t")).where("t not like '% %' and length(t) >= 4").distinct()
    t = t.withColumn("p", F.explode(F.array_distinct(F.array(F.substring("t", 1, 3), F.substring("t", 1, 4)))))
    d = w.join(t, "p").where("abs(length(w) - length(t)) <= 1").withColumn("distance", F.levenshtein("w", "t", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.when(F.length("w") < 7, 1).otherwise(2)))
    best = d.groupBy(key, "w").agg(F.min(F.struct("distance", F.abs(F.length("w") - F.length("t")).alias("dl"), "t")).alias("b"))
    return best.select(key, F.col("w").alias(word), F.col("b.t").alias(term), F.col("b.distance").alias("distance"))


def substring_join(left: DataFrame, lk: str, part: str, right: DataFrame, rk: str, texts: list[str], gram: int = 8) -> DataFrame:
    """(lk, rk): rows of the right side one of whose texts contains the left side's text, in any case.

    Each sought text is known by the rarest of its pieces of ``gram`` characters, or by itself if it is shorter; texts are
    cut into pieces of these lengths, so that candidates meet in an equality join and are verified.  Blank ones are in none.
    The sought texts are broadcast up to ``BROADCAST_ROWS`` of them and ``BROADCAST_BYTES``, so that no piece of a text is
    shuffled; beyond that only pieces that some sought text is known by are, as long as these are at most ``KEYS``.
    """
    l = left.select(F.col(lk).alias("_l"), F.lower(F.trim(F.col(part))).alias("_p")).where("_p != ''").distinct()
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n))
    grams = l.withColumn("n", F.least(F.length("_p"), F.lit(gram))).withColumn("g", F.explode(F.array_distinct(pieces(F.col("_p"), F.col("n")))))
    # Sizes are estimated from the files, without what is exploded: unless told otherwise, Spark broadcasts all the pieces.
    counts = grams.groupBy("g").agg(F.count("*").alias("c")).hint("merge")
    keyed = cut_lineage(grams.join(counts, "g").groupBy("_l", "_p").agg(F.min(F.struct("c", "g")).alias("m")).select("_l", "_p", F.col("m.g").alias("g")))
    octets = F.octet_length("_p") + F.coalesce(F.octet_length(F.col("_l").cast("string")), F.lit(0))
    size = keyed.agg(F.count("*").alias("rows"), F.sum(octets.cast("long")).alias("bytes"), F.collect_set(F.length("g")).alias("lengths")).first()  # at most ``gram`` lengths
    lengths = sorted(size["lengths"])
    lowered = F.array(*[F.lower(F.col(t)) for t in texts])
    long = right.select(F.col(rk).alias("_r"), F.explode(F.array_distinct(lowered)).alias("_t")).where("_t is not null")
    cut = F.array_distinct(F.flatten(F.array(*[pieces(F.col("_t"), F.lit(n)) for n in lengths]))) if lengths else F.array().cast("array<string>")
    met = long.select("_r", "_t", F.explode(cut).alias("g"))
    if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        met = met.join(F.broadcast(keyed), "g")
    else:
        keys = keyed.select(F.xxhash64("g").alias("_h")).distinct()
        if keys.limit(KEYS + 1).count() <= KEYS:
            met = met.withColumn("_h", F.xxhash64("g")).join(F.broadcast(keys), "_h", "left_semi").drop("_h")
        met = met.join(keyed.hint("merge"), "g")
    return met.where(F.contains("_t", F.col("_p"))).select(F.col("_l").alias(lk), F.col("_r").alias(rk)).distinct()


def merge_terms(existing: DataFrame, new: DataFrame, key: str, fills: list[str]) -> DataFrame:
    """Existing rows with empty columns filled from a new row of the same key, and the new rows of unknown keys."""
    n = new.groupBy(key).agg(*[F.min(c).alias(c) for c in fills])
    filled = existing.join(n.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fills]), F.col(key) == F.col("_k"), "left").select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in fills])
    return filled.unionByName(n.join(existing.select(key), key, "left_anti"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, event): create, update or delete, by comparing two snapshots; unchanged rows have none."""
    side = lambda df, n: df.select(F.col(key).alias(key), F.struct(*columns).alias(n), F.lit(True).alias(f"in_{n}"))
    both = side(old, "o").join(side(new, "n"), key, "full")
    event = F.when(F.col("in_o").isNull(), "create").when(F.col("in_n").isNull(), "delete").when(~F.col("o").eqNullSafe(F.col("n")), "update")
    return both.withColumn("event", event).where("event is not null").select(key, "event")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Base with changed rows put in their place: whole rows, the last change of a key wins over the base and other changes."""
    cols = [c for c in base.columns if c != order]
    both = base.select(*cols, F.lit(0).alias("_src"), F.lit(None).cast(dict(changes.dtypes)[order]).alias("_o")).unionByName(changes.select(*cols, F.lit(1).alias("_src"), F.col(order).alias("_o")))
    rest = [c for c in cols if c != key]
    return both.groupBy(key).agg(F.max(F.struct("_src", "_o", *rest)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def first_code(codes: Column, systems: list[str]) -> Column:
    """The code of the first system, in order, that has one; else the first code; null without codes."""
    found = [F.try_element_at(F.filter(codes, _starts(s)), F.lit(1)) for s in systems]
    return F.coalesce(*found, F.try_element_at(codes, F.lit(1)))


def _starts(system: str):
    return lambda c: F.startswith(c, F.lit(f"{system}:"))


def confusion_candidates(asked: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(key, member, set_id): what is easily taken for an answer: the other members of the sets that fit it.

    ``asked`` has (key, answer, specialty, topics), ``sets`` (set_id, specialty, context, members).  A set fits if the
    answer is one of its members, or if a topic and a context of it contain one another and the specialties do so too (an
    empty one fits all).  Texts are compared folded; a member comes out once, with the least set.
    """
    form = lambda c: F.trim(fold(F.coalesce(c, F.lit(""))))
    members = sets.select("set_id", F.explode("members").alias("m")).select("set_id", form(F.col("m")).alias("member")).where("member != ''").distinct()
    a = asked.select(key, form(F.col("answer")).alias("answer"), form(F.col("specialty")).alias("specialty"), "topics")
    by_member = a.join(members.withColumnRenamed("member", "answer"), "answer").select(key, "set_id")
    topics = a.select(key, "specialty", F.explode("topics").alias("t")).select(key, "specialty", form(F.col("t")).alias("topic")).where("topic != ''")
    context = sets.select("set_id", form(F.col("specialty")).alias("of"), F.explode("context").alias("c")).select("set_id", "of", form(F.col("c")).alias("ctx")).where("ctx != ''")
    t, c = topics.select("topic").distinct(), context.select("ctx").distinct()
    near = substring_join(c, "ctx", "ctx", t, "topic", ["topic"]).select("topic", "ctx").unionByName(substring_join(t, "topic", "topic", c, "ctx", ["ctx"]).select("topic", "ctx")).distinct()
    fits = (F.col("specialty") == "") | (F.col("of") == "") | F.contains("specialty", F.col("of")) | F.contains("of", F.col("specialty"))
    by_context = topics.join(near, "topic").join(context, "ctx").where(fits).select(key, "set_id")
    met = by_member.unionByName(by_context).distinct().join(members, "set_id").join(a.select(key, "answer"), key).where("member != answer")
    return met.groupBy(key, "member").agg(F.min("set_id").alias("set_id"))

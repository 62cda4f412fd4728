"""Scans, look-ups and predicates.

Predicates are Columns, so that they reach the scan; null never matches unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions.text import fold
from tessela.session import cut_lineage


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """At most one row with this key; of repeated rows any one."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def batch_lookup(df: DataFrame, key: str, ids: list) -> DataFrame:
    """A row for each id in the order asked (``ordinal``), with nulls where there is none; repeated rows of a key count once."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"ordinal int, `{key}` {dict(df.dtypes)[key]}")
    hits = df.join(F.broadcast(asked.select(key).distinct()), key, "left_semi").dropDuplicates([key])
    return F.broadcast(asked).join(hits, key, "left")


def any_outdated(df: DataFrame, version: str, current: str) -> DataFrame:
    """(outdated): whether any row has another version, null included; false for no rows."""
    return df.agg(F.coalesce(F.bool_or(~F.col(version).eqNullSafe(F.lit(current))), F.lit(False)).alias("outdated"))


def contains_ci(c: Column, part: str) -> Column:
    """Substring without regard to case; wildcards have no meaning."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def text_search(query: str | None, texts: Iterable[Column], lists: Iterable[Column] = ()) -> Column:
    """Any text, or any member of a list, contains the query in any case; a blank query matches all."""
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    hits = [contains_ci(F.coalesce(c, F.lit("")), q) for c in texts] + [F.coalesce(F.exists(c, lambda x: contains_ci(x, q)), F.lit(False)) for c in lists]
    return reduce(or_, hits)


def folded_search(query: str, texts: Iterable[Column], lists: Iterable[Column] = ()) -> Column:
    """As ``text_search``, without regard to accents."""
    q = F.lit(query)
    hits = [F.contains(fold(F.coalesce(c, F.lit(""))), fold(q)) for c in texts] + [F.coalesce(F.exists(c, lambda x: F.contains(fold(x), fold(q))), F.lit(False)) for c in lists]
    return reduce(or_, hits)


def equals_or_all(c: Column, value: str | None, everything: str = "all") -> Column:
    """Equality, or no condition for the word that stands for everything."""
    return F.lit(True) if value in (None, everything) else c == F.lit(value)


def is_due(due: Column, now: Column) -> Column:
    """Due by now; without a date always."""
    return due.isNull() | (due <= now)


def is_retryable(status: Column, retries: Column, most: int = 5) -> Column:
    return (status == "pending") | ((status == "failed") & (F.coalesce(retries, F.lit(0)) < most))


def either_contains(a: Column, b: Column) -> Column:
    """One of two texts is part of the other, in any case; blank texts match nothing."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def prefix_search(df: DataFrame, column: str, prefix: str, n: int = 60) -> DataFrame:
    """The first n rows by the column whose value starts with the prefix."""
    return df.where(F.startswith(F.col(column), F.lit(prefix))).orderBy(column, *[c for c in df.columns if c != column and dict(df.dtypes)[c] in ("bigint", "int", "string")]).limit(n)


# Kinds of text that name a dose, a risk or a conduct (patterns on lower-case text).
RISK_PATTERNS = (
    r"\b(doses?|dosag(em|ens)|posologi(a|as))\b",
    r"\b\d+\s*(mg|ml|mcg|ui|g|meq)\b",
    r"\b(contraindicaç(ão|ões)|contraindicad[oa]s?|contraindica|não\s+(deve\s+ser\s+)?usar|evitar\s+em|contra-indicad[oa]s?)\b",
    r"\b(alergi(a|as)|alergênic[oa]s?|hipersensibilidad[ee]s?|anafilaxi(a|as))\b",
    r"\b(via\s+oral|intravenos[aa]|subcutâne[aa]|endovenos[aa]|intramuscular)\b",
    r"\b(iv|im)\b",
    r"\b(interaç(ão|ões)|superdosag(em|ens)|overdose|toxicidad[ee]s?)\b",
    r"\b(gestantes?|gravid[ee]z|lactantes?|amamentaç(ão|ões)|insuficiênci(a|as)\s+(renal|hepática)|ajuste\s+de\s+dose)\b",
    r"\b(beta-bloqueador(es)?|anticoagulantes?|antiagregantes?|ieca|bras?|inibidor(es)?\s+da\s+eca|trombolíticos?|vasopressor(es)?|inotrópicos?|diuréticos?\s+de\s+alça|estatinas?|corticoides?|imunossupressores?)\b",
    r"\b(meia-vida(\s+de\s+eliminação)?|janela\s+terapêutica|clearance|biodisponibilidad[ee]|metabolizaçã[oo]\s+hepática|eliminaçã[oo]\s+renal|pico\s+plasmático)\b",
    r"\b(primeira\s+linha|segunda\s+linha|droga\s+de\s+escolha|protocolo\s+de|conduta\s+imediata|manejo\s+inicial|esquema\s+terapêutico|linha\s+de\s+tratamento)\b",
    r"\b(escores?\s+de\s+risco|critérios?\s+de\s+gravidade|sina(l|is)\s+de\s+alarme|red\s+flags?|estratificaçã[oo]\s+de\s+risco)\b",
    r"\b(punçã[oo]|cateterismo|intubaçã[oo]|sondagem|traqueostomia|toracocentese|paracentese|arteriografia)\b",
)


#: Where an ASCII letter, digit or _ and another sign meet, as in the patterns' own dialect; letters with accents are others.
ASCII_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def is_risky(c: Column) -> Column:
    """Whether a text names a dose, a risk or a conduct; null doesn't."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return reduce(or_, [low.rlike(p.replace(r"\b", ASCII_BOUND)) for p in RISK_PATTERNS])


def is_legible(c: Column, least_chars: int = 50, least_words: int = 5) -> Column:
    """Long enough, hardly any control characters, mostly printable letters, and some words of three letters."""
    t = F.coalesce(c, F.lit(""))
    dense = F.length(F.regexp_replace(t, r"\s", ""))
    bad = F.regexp_count(t, F.lit(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"))
    good = F.regexp_count(t, F.lit(r"[a-zA-Z0-9\s.,;:!?()\"'/\-\\–—%º°ªáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ]"))
    words = F.regexp_count(t, F.lit(r"[a-zA-ZáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ]{3,}"))
    return (F.length(F.trim(t)) >= least_chars) & (dense > 0) & (bad <= 0.05 * dense) & (good >= 0.85 * F.length(t)) & (words >= least_words)


def file_errors(size: Column, name: Column, mime: Column, most_bytes: int, extensions: list[str], mimes: list[str], head: Column | None = None) -> Column:
    """The rules a file breaks, as codes in a fixed order; empty if it is sound."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rules = [
        F.when(F.coalesce(size, F.lit(0)) <= 0, "EMPTY_FILE"),
        F.when(size > most_bytes, "TOO_LARGE"),
        F.when(~F.coalesce(ext.isin(extensions), F.lit(False)), "BAD_EXTENSION"),
        F.when(mime.isNotNull() & (mime != "") & ~mime.isin(mimes), "BAD_MIME"),
    ]
    if head is not None:
        rules.append(F.when((ext == "pdf") & ~F.startswith(head, F.lit("%PDF")), "CORRUPT"))
    return F.array_compact(F.array(*rules))


def tree_levels(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, level): 0 for roots (no or blank parent), then by descent; a node under none of the roots has no row.

    A loop of joins, one for each level of the tree, until no node is left below; lineage is cut each time.  Nodes with two
    parents have their least level.  A circle hangs under no root, so the loop ends.
    """
    nodes = cut_lineage(df.select(F.col(key).alias("k"), F.nullif(F.trim(F.col(parent)), F.lit("")).alias("p")).distinct())
    out = level = cut_lineage(nodes.where("p is null").select("k", F.lit(0).alias("level")).distinct())
    n = 0
    while not level.isEmpty():
        n += 1
        below = nodes.join(level.select(F.col("k").alias("p")), "p").select("k").distinct()
        level = cut_lineage(below.join(out.select("k"), "k", "left_anti").withColumn("level", F.lit(n)))
        out = out.unionByName(level)
    return out.select(F.col("k").alias(key), "level")


def detect_format(name: Column, mime: Column) -> Column:
    """The kind of a document by its MIME type, else by its extension."""
    ext, m = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lower(F.coalesce(mime, F.lit("")))
    kinds = (("pdf", "pdf", ["pdf"]), ("docx", "wordprocessingml", ["docx"]), ("pptx", "presentationml", ["pptx"]), ("epub", "epub", ["epub"]), ("html", "html", ["html", "htm"]), ("image", "image/", ["png", "jpg", "jpeg", "webp"]), ("txt", "text/plain", ["txt", "md"]))
    out = F.lit("unknown")
    for kind, part, exts in reversed(kinds):
        out = F.when(F.contains(m, F.lit(part)) | ext.isin(exts), kind).otherwise(out)
    return out

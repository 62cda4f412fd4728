"""Vector and retrieval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the two scores are mixed.
WEIGHT_COSINE, WEIGHT_LEXICAL = 0.7, 0.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a null, empty, zero or differently long vector."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def query_terms(query: Column) -> Column:
    """The terms of a query of at least three characters; repeated terms count again."""
    clean = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[^\w\sÀ-ɏ]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) >= 3)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's terms that the text contains; 0 without terms."""
    terms = query_terms(query)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))


def hybrid(cos: Column, lex: Column) -> Column:
    return WEIGHT_COSINE * cos + WEIGHT_LEXICAL * lex


def hash_vector(text: Column, size: int = 16) -> Column:
    """A deterministic vector of a text: character codes folded into ``size`` places, of unit length."""
    codes = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.ascii(c))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(F.transform(codes, lambda c, i: F.when(i % size == k, c).otherwise(0)), lambda x: x > 0), F.lit(0.0), lambda s, x: s + x))
    n = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0))

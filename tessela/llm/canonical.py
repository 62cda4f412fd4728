"""Mapping freely typed values to the entries of a reference list.

A partition-based pigeonhole join: a reference string is cut into k + 1 segments, of which k edits leave
at least one whole, so a string within k edits has that segment near its place.  Segments are equality-joined
with the substrings of the typed string at the places the edits allow, and candidates are verified with
``levenshtein``.  Unmatched values come out of an anti-join.  Everything is built-in SQL; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions.text import fold
from tessela.session import cut_lineage

# Words that carry no meaning in a name.
STOP_WORDS = ("de", "do", "da", "dos", "das", "com", "em", "e")

# Notes that typists put before or after a name (patterns on folded text).
NOTES_BEFORE = (r"[?*\-.:!\s]+", r"hd\s*:?\s+", r"hx\s+(de\s+)?", r"obs\s*:?\s+", r"pcte\s+(c/|com)\s*", r"suspeita\s*(de\s+)?", r"hip\s*:\s*", r"ap\s*:\s*")
NOTES_AFTER = (r"[?*!:\s\-]+", r"\(ver\)", r"-\s*rever", r"\bcid\s*\?*", r"\(\?\)")

# Abbreviations of the words that names are made of (patterns on folded text, and the word); blanks before or
# behind an abbreviation may be missing where no name has these letters.
ABBREVIATIONS = (
    (r"(?<=[a-z])(parc|benig|malig|insuf|insf|tot|inj|dir|esq)\.", " $1. "),
    (r"\b(insuf|insf|insfic)\.?(?!iciencia)", " insuficiencia "),
    (r"\b(sindr?|sd)\.(?!ome)|\bsind(?!ro)|\bsd\b", " sindrome "),
    (r"\bdca?\b\.?|\bdca(?=d[aeo]|t)|\bdoe\b\.?", " doenca "),
    (r"^d\b\.?\s*|\bd\b\.?(?=\s*(de\b|tipo|tp|t\b|(\d|i{1,3})\W*$))", " doenca "),
    (r"tp\.?\s*-?\s*(?=\d|i{1,3}\b)|t\.\s*-?\s*(?=\d\W*$|i{1,3}\W*$)|\bt\s+(?=\d|i{1,3}\b)", " tipo "),
    (r"\btot\b\.?", " total "),
    (r"\bparc\b\.?", " parcial "),
    (r"\bdir\b\.?", " direita "),
    (r"\besq\b\.?", " esquerda "),
    (r"bng\.?|\bbenig\b\.?", " benigno "),
    (r"mlg\.?|\bmalig\b\.?", " maligno "),
    (r"agda|\bag\b\.?", " aguda "),
    (r"\bcca(?=d[aeo]\b)|\b(cr|cca|cron)\b\.?", " cronica "),
    (r"\bsol\b\.?", " solucao "),
    (r"\binj\b\.?", " injetavel "),
    (r"\b(comp|cp|cpr)\b\.?", " comprimido "),
    (r"\b(dos|dosag)\b\.?", " dosagem "),
    (r"\b(cint|cintilo)\b\.?", " cintilografia "),
    (r"\bc/\s*", "com "),
    (r"\bd\b\.?(?=.*insuf)|(?<=insuf.{0,80})\bd\b\.?|\bd\.?$", " direita "),
    (r"\be\b\.?(?=.*insuf)|(?<=insuf.{0,80})\be\b\.?|\be\.?$", " esquerda "),
)
# Digits that stand for letters of a similar shape.
SHAPES = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"))
#: Edits that separate a typed name from the entry it means, at most: more would reach other names.
MOST_EDITS = 2
#: Letters to which typists cut a long word; a letter more or less is an edit.
CUT = 7


def clean(c: Column) -> Column:
    """Folded text without notes, with numbers set apart, abbreviations written out and digits in words made letters."""
    c = F.regexp_replace(F.trim(c), r"(?<=\p{Ll})([DE])(?=\W|$)", " $1")
    c = F.regexp_replace(F.trim(fold(c)), r"(?U)\s+", " ")
    for _ in range(2):
        c = F.regexp_replace(c, "^(" + "|".join(NOTES_BEFORE) + ")", "")
        c = F.regexp_replace(c, "(" + "|".join(NOTES_AFTER) + ")$", "")
    for digit, letter in SHAPES:  # a digit for a letter, before a dose
        c = F.regexp_replace(c, rf"(?<=[a-z]){digit}(?=\d{{2}}\s*mg)", letter)
    c = F.regexp_replace(c, r"(\d+)\s*mg(s(?![a-z]))?", " $1 mg ")
    c = F.regexp_replace(c, r"tipos?\s*(\d|i{1,3}\b)", " tipo $1 ")
    c = F.regexp_replace(c, r"(?<![a-z])(\d)(\d*)(?=(comprimido|solucao|mg))", "$1$2 ")
    c = F.regexp_replace(c, r"(?<=[a-z])(\d{2,})|(\d{2,})(?=[a-z])", " $1$2 ")
    for digit, letter in SHAPES:
        c = F.regexp_replace(c, rf"(?<=[a-z]){digit}(?!\d)|(?<!\d){digit}(?=[a-z])", letter)
    for pattern, word in ABBREVIATIONS:
        c = F.regexp_replace(c, pattern, word)
    for roman, digit in (("iii", "3"), ("ii", "2"), ("i", "1")):
        c = F.regexp_replace(c, rf"\btipo\W+{roman}\b|(?<=(doenca|tipo).{{0,80}})\b{roman}(?=\W*$)", f"tipo {digit}")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z])-(?=[a-z])", ""), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(c, r"(?<=[a-z]{4})s\b", ""))  # plurals


def edits_allowed(length: Column) -> Column:
    """Edits by the length of the reference string; from 5 letters on a swap of neighbours is one of them."""
    return F.when(length < 3, 0).when(length < 9, 1).otherwise(MOST_EDITS)


def _cuts(length: Column) -> Column:
    """k, where a reference string is cut into k + 1 segments: a swap is two edits here."""
    return F.when(length < 3, 0).when(length < 5, 1).otherwise(MOST_EDITS)


def _swapped(a: Column, b: Column) -> Column:
    """Whether strings of at least 5 letters at a distance of 2 differ by a swap of neighbours."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.length(b) >= 5) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _without_stops(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS))


def reference_strings(refs: DataFrame, ref_id: str = "ref_id", name: str = "canonical_term", synonyms: str = "synonyms", cut: int = CUT) -> DataFrame:
    """(ref_id, words, s): the names and synonyms as they may be typed, without blanks.

    Rotations of the words and each word moved to the front, with and without stop words, and with one long
    word cut short.  Their number is a fixed multiple of the list's.
    """
    names = refs.select(F.col(ref_id).alias("ref_id"), F.explode(F.concat(F.array(name), F.coalesce(F.col(synonyms), F.array().cast("array<string>")))).alias("n"))
    toks = names.select("ref_id", _tokens(clean(F.col("n"))).alias("words")).where(F.size("words") > 0)
    plain = toks.withColumn("w", F.explode(F.array("words", _without_stops(F.col("words")))))
    long_at = F.expr(f"filter(sequence(0, size(w) - 1), i -> length(w[i]) > {cut})")
    shortened = F.transform(long_at, lambda i: F.transform("w", lambda x, at: F.when(at == i, F.substring(x, 1, cut)).otherwise(x)))
    short = plain.where(F.size("w") > 0).withColumn("w", F.explode(F.concat(F.array("w"), shortened)))
    n = F.size("w")
    rotations = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice("w", i + 1, n), F.slice("w", F.lit(1), i)))
    fronted = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("w", i, F.lit(1)), F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, n)))
    return short.select("ref_id", "words", F.explode(F.concat(rotations, fronted)).alias("w")).select("ref_id", "words", F.array_join("w", "").alias("s")).distinct()


def typed_strings(texts: DataFrame, text: str) -> DataFrame:
    """(text, words, t): each distinct text cleaned, without blanks, with and without stop words."""
    cores = texts.sparkSession.sparkContext.defaultParallelism  # few bytes, but dear to clean: over all cores
    toks = texts.select(F.col(text).alias("text")).where("text is not null").repartition(cores, "text").distinct().select("text", _tokens(clean(F.col("text"))).alias("words"))
    both = F.array_distinct(F.array(F.array_join("words", ""), F.array_join(_without_stops(F.col("words")), "")))
    return toks.select("text", "words", F.explode(both).alias("t")).where("t != ''")


def _segments(strings: DataFrame) -> DataFrame:
    """(s, n, i, seg): the k + 1 segments of each reference string."""
    step = "int(floor(n / (k + 1)))"
    return (
        strings.select("s").distinct().withColumn("n", F.length("s")).withColumn("k", _cuts(F.col("n")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .select("s", "n", "k", "i", F.expr(f"substring(s, i * {step} + 1, case when i = k then n else {step} end)").alias("seg"))
    )


def _probes(typed: DataFrame) -> DataFrame:
    """(t, n, i, seg): the substrings of a typed string that may be a whole segment of a string of length n."""
    widest = MOST_EDITS
    return (
        typed.select("t").distinct().withColumn("m", F.length("t"))
        .withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - widest), F.col("m") + widest)))
        .withColumn("k", _cuts(F.col("n"))).where("abs(n - m) <= k")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("shift", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        .where("abs(shift) + abs(m - n - shift) <= k")
        .withColumn("step", F.expr("int(floor(n / (k + 1)))"))
        .withColumn("from", F.expr("i * step + 1 + shift")).where("from >= 1")
        .select("t", "n", "i", F.expr("substring(t, from, case when i = k then n - i * step else step end)").alias("seg"))
        .distinct()
    )


def match_texts(texts: DataFrame, text: str, refs: DataFrame) -> DataFrame:
    """(text, ref_id, distance): the one entry that each text means; texts that mean none are absent.

    A candidate must hold every word of the text that is a common word of the list (one of at least three
    entries), and the same digits.  The nearest entry holds, of ties the smallest ``ref_id``; but a string of fewer than
    six letters with an edit must be nearest to one entry only.
    """
    strings = cut_lineage(reference_strings(refs))
    typed = cut_lineage(typed_strings(texts, text))
    common = strings.select("ref_id", F.explode("words").alias("w")).distinct().groupBy("w").count().where("count >= 3").where(~F.col("w").isin(*STOP_WORDS))
    exact = typed.join(strings, typed["t"] == strings["s"]).select("text", typed["words"], strings["words"].alias("ref_words"), "ref_id", "t", "s", F.lit(0).alias("distance"))
    rest = typed.join(exact.select("text").distinct(), "text", "left_anti").repartition(typed.sparkSession.sparkContext.defaultParallelism, "t")
    pairs = (
        _probes(rest).join(_segments(strings), ["n", "i", "seg"]).select("t", "s", "k").distinct()
        .withColumn("distance", F.levenshtein("t", "s", MOST_EDITS)).where("distance >= 0")
        .where((F.col("distance") <= edits_allowed(F.length("s"))) | ((F.col("distance") == 2) & _swapped(F.col("t"), F.col("s"))))
    )
    near = pairs.join(rest, "t").join(strings.withColumnRenamed("words", "ref_words"), "s").select("text", "words", "ref_words", "ref_id", "t", "s", "distance")
    known = typed.select("text", "words").distinct().select("text", F.explode("words").alias("w")).join(common.select("w"), "w").groupBy("text").agg(F.collect_set("w").alias("known"))
    digits = lambda c: F.regexp_replace(c, r"\D+", "")
    return (
        exact.unionByName(near).where(digits(F.col("t")) == digits(F.col("s")))
        .join(known, "text", "left")
        .where(F.coalesce(F.size(F.array_except("known", "ref_words")) == 0, F.lit(True)))
        .groupBy("text", "distance").agg(F.min("ref_id").alias("ref_id"), F.max("ref_id").alias("last"), F.min(F.length("s")).alias("n"))
        .groupBy("text").agg(F.min(F.struct("distance", "ref_id", "last", "n")).alias("best"))
        .where("best.distance = 0 or best.n >= 6 or best.ref_id = best.last")
        .select("text", "best.ref_id", "best.distance")
    )


def map_terms(terms: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, ref_id, distance, field): each row of terms with the entry it means, by the first field that has one.

    The fields are tried in the order term, normalized_term, canonical_term.  A row that matches nothing has a
    null ``ref_id``.  Null, blank and note-only texts match nothing; repeated rows come out once each by id.
    """
    fields = ("term", "normalized_term", "canonical_term")
    long = terms.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])).alias("x")).select("id", "x.*")
    matched = match_texts(long, "text", refs)
    best = long.join(matched, "text").groupBy("id").agg(F.min(F.struct("rank", "distance", "ref_id", "field")).alias("b")).select("id", "b.ref_id", "b.distance", "b.field")
    missed = terms.select("id").distinct().join(best, "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("string").alias("field"))
    return best.unionByName(missed)

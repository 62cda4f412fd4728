"""The library: decks and their filters and orders, question sets, categories of material, links, copies, files."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessela.functions.clean import round_half_up
from tessela.functions.text import fold

# Words of examinations in a service list.
EXAM_WORDS = (
    "exame", "laborator", "diagnost", "imagem", "tomograf", "ressonanc", "ultrasson", "radiolog", "biopsia", "sangue", "urina", "dosagem", "pesquisa de", "analise", "teste", "cultura",
    "ecocardiograma", "eletrocardiograma", "endoscopia", "colonoscopia", "mamografia", "cintilografia", "mapa", "holter", "gasometria",
)
# Words of a display name, and of a file name, and the category they stand for, in order.
NAME_WORDS = (
    (("livro", "book"), "book"), (("prova", "residencia", "residency", "questoes", "question", "banco"), "residencyExam"), (("professor", "banca"), "professorExam"),
    (("diretriz", "guideline", "sbc", "amb"), "guideline"), (("artigo", "article", "paper"), "article"), (("slide", "apresentacao"), "slide"), (("resumo", "summary"), "summary"),
    (("protocolo", "protocol"), "protocol"), (("caso", "clinical"), "clinicalCase"), (("flashcard", "anki"), "flashcard"), (("manual",), "manual"), (("apostila",), "apostila"),
)
FILE_WORDS = (
    (("harrison", "goldman", "sabiston", "netter", "livro", "book"), "book"), (("enare", "residência", "residencia", "usp", "unifesp", "revalida", "prova", "exam", "questoes"), "residencyExam"),
    (("sbc", "diretriz", "guideline", "protocolo"), "guideline"), (("artigo", "nejm", "lancet", "jama"), "article"), (("apostila", "manual"), "manual"),
)


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def smart_filter(kind: str, due: Column, favorite: Column, folder: Column, tags: Column) -> Column:
    """Whether a deck passes one of the filters due, favorites, root, highYield; any other name lets all pass."""
    due = F.coalesce(due, F.lit(0))
    marked = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(_has(F.lower(t), ("highyield", "high yield")), F.lit(False)))
    rules = {"due": due > 0, "favorites": F.coalesce(favorite, F.lit(False)), "root": F.coalesce(folder, F.lit("")) == "", "highYield": marked | (due > 10)}
    return rules.get(kind, F.lit(True))


def deck_order(mode: str, key: str = "id") -> list[Column]:
    """The order of decks by favorite, title, title_desc, dueCards, totalCards, createdAt or retention; ends in the key.

    Decks have favorite, title, due, total and created_at.  Titles are compared as a reader would, by a collation.
    """
    title = F.collate(F.col("title"), "UNICODE")
    kept = F.when(F.col("total") > 0, (F.col("total") - F.col("due")) / F.col("total")).otherwise(0.0)
    modes = {
        "favorite": [F.desc(F.coalesce("favorite", F.lit(False))), title.asc()], "title": [title.asc()], "title_desc": [title.desc()], "dueCards": [F.desc(F.coalesce("due", F.lit(0)))],
        "totalCards": [F.desc(F.coalesce("total", F.lit(0)))], "createdAt": [F.desc("created_at")], "retention": [kept.desc()],
    }
    return [*modes.get(mode, []), F.asc(key)]


def mastery_label(pct: Column) -> Column:
    p = F.coalesce(pct, F.lit(0))
    return F.when(p >= 80, "Excelente").when(p >= 60, "Bom").when(p >= 40, "Regular").otherwise("Precisa Melhorar")


def answer_counts(answers: Column) -> tuple[Column, Column, Column]:
    """(answered, correct, completed) of a set, from its array of (is_answered, is_correct); an empty set is complete."""
    a = F.coalesce(answers, F.array().cast("array<struct<is_answered:boolean,is_correct:boolean>>"))
    n = lambda name: F.size(F.filter(a, lambda q: F.coalesce(q[name], F.lit(False))))
    return n("is_answered"), n("is_correct"), n("is_answered") == F.size(a)


def set_totals(sets: DataFrame) -> DataFrame:
    """(questions, answered, correct, accuracy): over all sets; accuracy in whole per cent, 0 where nothing is answered."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = sets.agg(total("questions").alias("questions"), total("answered").alias("answered"), total("correct").alias("correct"))
    return t.withColumn("accuracy", F.when(F.col("answered") > 0, round_half_up(F.col("correct") / F.col("answered") * 100)).otherwise(0).cast("bigint"))


def anchored(context: Column, long: Column, tricks: Column, case_ratio: Column, words: Column, trick_ratio: Column) -> tuple[Column, Column, Column]:
    """A profile's clinical context, long cases and tricks, blended with what was counted: 0.3 and 0.7, tricks 0.4 and 0.6."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    scale = F.when(words < 35, 0.25).when(words < 65, 0.5).when(words < 110, 0.75).otherwise(0.95)
    two = lambda c: round_half_up(c * 100) / 100
    return two(0.3 * half(context) + 0.7 * case_ratio), two(0.3 * half(long) + 0.7 * scale), two(0.4 * half(tricks) + 0.6 * F.least(F.lit(1.0), trick_ratio * 3.5))


def service_category(domain: Column, description: Column) -> Column:
    """MEDICAMENTO, EXAME or PROCEDIMENTO, of a row of a service list."""
    d, t = F.coalesce(domain, F.lit("")), F.coalesce(description, F.lit(""))
    return F.when(_has(F.lower(d), ("medicamento", "tuss-20")), "MEDICAMENTO").when(_has(fold(F.concat_ws(" ", d, t)), EXAM_WORDS), "EXAME").otherwise("PROCEDIMENTO")


def _first(c: Column, words: tuple) -> Column:
    out = F.lit("other")
    for ws, category in reversed(words):
        out = F.when(_has(c, ws), category).otherwise(out)
    return out


def name_category(name: Column) -> Column:
    return _first(F.trim(F.lower(F.coalesce(name, F.lit("")))), NAME_WORDS)


def file_category(name: Column) -> Column:
    return _first(F.lower(F.coalesce(name, F.lit(""))), FILE_WORDS)


def metadata_category(category: Column, kind: Column, filename: Column) -> Column:
    """By the category, else the kind, else the file name, whichever is given first."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(category), name_category(category)).when(given(kind), name_category(kind)).when(given(filename), file_category(filename)).otherwise("other")


def like_questions(questions: DataFrame, specialty: str, topic: str, subtopic: str, key: str, n: int = 5) -> DataFrame:
    """(key): the first n questions by key whose specialty matches and whose topic, subtopic or a tag does.

    Two texts match if either contains the other, an empty one matches all; a tag must contain the sought text.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s, t, u = (x.lower().strip() for x in (specialty, topic, subtopic))
    either = lambda c, x: F.contains(low(c), F.lit(x)) | F.contains(F.lit(x), low(c))
    tag = lambda x: F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda g: F.coalesce(F.contains(F.lower(F.trim(g)), F.lit(x)), F.lit(False)))
    arm = lambda c, x: either(F.col(c), x) | tag(x) if x else F.lit(True)
    hit = (either(F.col("specialty"), s) if s else F.lit(True)) & (arm("topic", t) | arm("subtopic", u))
    return questions.where(hit).select(key).distinct().orderBy(key).limit(n)


def linked_cards(keys: DataFrame, links: DataFrame, cards: DataFrame) -> DataFrame:
    """(asset, card): cards that a link or a shared key ties to an asset.

    ``keys`` has (asset, key), ``links`` (key, card), ``cards`` (card, keys).
    """
    direct = keys.join(links, "key").select("asset", "card")
    shared = keys.join(cards.select("card", F.explode("keys").alias("key")), "key").select("asset", "card")
    return direct.unionByName(shared).distinct()


def copy_deck(decks: DataFrame, cards: DataFrame, deck: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """A copy of a deck, with its cards counted, and copies of its cards; ids are derived, so a second run makes the same."""
    new = F.concat(F.lit("deck_"), F.substring(F.sha2(F.lit(f"copy of {deck}"), 256), 1, 16))
    mine = cards.where(F.col("deck_id") == deck).dropDuplicates(["id"])
    made = mine.withColumn("id", F.concat(F.lit("card_"), F.substring(F.sha2(F.concat(F.lit("copy of "), F.col("id")), 256), 1, 16))).withColumn("deck_id", new).withColumn("created_at", now).withColumn("updated_at", now)
    counts = mine.agg(F.count("*").alias("total_cards"))
    copied = decks.where(F.col("id") == deck).withColumn("id", new).withColumn("title", F.concat("title", F.lit(" (Cópia)"))).withColumn("created_at", now).withColumn("updated_at", now)
    return copied.join(F.broadcast(counts)), made


def professor_questions(profiles: DataFrame, questions: DataFrame) -> DataFrame:
    """(profile, question): questions of a profile's documents, else of itself, else those whose asset id contains its name
    or the name of one of its files.

    ``profiles`` has (profile, name, documents, files), ``questions`` (question, asset).  The profiles that reach the last
    step are joined by containment, for which ``substring_join`` is there.
    """
    from tessela.operators.joins import first_non_empty, substring_join

    by_document = profiles.select("profile", F.explode("documents").alias("asset")).join(questions, "asset").select("profile", "question").distinct()
    own = profiles.select("profile", F.col("profile").alias("asset")).join(questions, "asset").select("profile", "question").distinct()
    left = profiles.join(by_document.select("profile"), "profile", "left_anti").join(own.select("profile"), "profile", "left_anti")
    sought = left.select("profile", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("files", F.array().cast("array<string>"))))).alias("sought"))
    by_name = substring_join(sought, "profile", "sought", questions, "question", ["asset"])
    return first_non_empty([by_document, own, by_name], "profile")


def packed_excerpts(excerpts: Column, most: int = 3_500) -> Column:
    """Excerpts in order packed into pieces of at most ``most`` characters, a longer one alone; blank pieces are left out."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    add = lambda done, now: F.when(F.trim(now) != "", F.concat(done, F.array(F.trim(now)))).otherwise(done)

    def step(acc: Column, x: Column) -> Column:
        full = F.length(acc["now"]) + 2 + F.length(x) > most
        grown = F.when(acc["now"] != "", F.concat(acc["now"], F.lit("\n\n"), x)).otherwise(x)
        return F.when(full, F.struct(add(acc["done"], acc["now"]).alias("done"), x.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), grown.alias("now")))

    return F.aggregate(F.filter(excerpts, lambda x: x.isNotNull()), start, step, lambda acc: add(acc["done"], acc["now"]))


@F.pandas_udf(T.StringType())
def checksum(content: pd.Series) -> pd.Series:
    """Two running sums of the bytes modulo 65,535, as eight hexadecimal digits; null stays null."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        if not raw:
            return "ffffffff"
        low = high = 0
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        for at in range(0, len(b), 65_536):
            part = b[at : at + 65_536]
            high = (high + low * len(part) + int((part * np.arange(len(part), 0, -1)).sum())) % 65_535
            low = (low + int(part.sum())) % 65_535
        return f"{high << 16 | low:08x}"

    return content.map(one)


def hash_errors(files: DataFrame, key: str, content: str, expected: str) -> DataFrame:
    """(key, errors): DUPLICATE where another file has the same content, HASH_MISMATCH where another hash is expected."""
    h = files.select(key, F.sha2(F.col(content), 256).alias("_h"), F.lower(F.col(expected)).alias("_e"))
    twice = h.where("_h is not null").groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h", F.lit(True).alias("_d"))
    errors = F.array_compact(F.array(F.when(F.col("_d"), "DUPLICATE"), F.when((F.coalesce("_e", F.lit("")) != "") & (F.coalesce("_h", F.lit("")) != F.col("_e")), "HASH_MISMATCH")))
    return h.join(twice, "_h", "left").select(key, errors.alias("errors"))

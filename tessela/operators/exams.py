"""Exams: splitting text into questions, answer keys, grading of what was split, statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_START = re.compile(r"^\s*(?:QUEST[ÃA]O|Quest[ãa]o)\s*(?:N[ºo°.]*\s*)?(\d{1,3}|[Oo]\d{1,2}|l[áa4\d]|I\d)(?![\wÀ-ÿ])[\s.:)\-–]*(.*)$|^\s*(\d{1,3})\s*[.)\-–]\s+(\S.*)$")
_OPTION = re.compile(r"^\s*[(\[]?([A-Ea-e])\s*[)\].\-–]\s*(\S.*)?$")
# What follows a capital letter and a dot in the names of germs, which are no options.
GERMS = ("coli", "aeruginosa", "faecalis", "pneumoniae", "aureus", "sp", "spp", "difficile", "albicans", "histolytica", "cruzi", "mansoni")
_GERM = re.compile(r"^\s*[A-E]\.\s+(?:" + "|".join(GERMS) + r")\b", re.I)
_VERDICT = re.compile(r"^\s*(?:(CERTO|VERDADEIRO)|(ERRADO|FALSO))\b", re.I)
_CIRCLE = re.compile(r"^\s*\(\s*[Oo0 ]?\s*\)\s*(\S.*)$")
_KEY_HEAD = re.compile(r"^\s*(?:GABARITO|RESPOSTAS)\b", re.I)
_KEY_ITEM = re.compile(r"(?:QUEST[ÃA]O\s*)?(\d{1,3})\s*[:\-–=.]*\s*([A-Ea-e])\b")

QUESTION = "number int, statement string, options array<struct<letter:string,text:string>>, correct_letter string"


def question_number(raw: str, expected: int = 1) -> int | None:
    """The number of a question, from 1 to 300, as recognition may have left it.

    A lone digit that is part of a greater expected number stands for it; O before a number is noise, l and I are ones, a
    an a four, o a zero; what can't be read at all is the number expected.
    """
    raw = raw.strip()
    if expected == 11 and re.fullmatch(r"1|[lIN]", raw, re.I) or expected == 14 and re.fullmatch(r"[lIN]á4?", raw, re.I):
        return expected
    whole = re.match(r"\d+", raw)
    if whole and 0 < int(whole.group()) <= 300:
        n = int(whole.group())
        return expected if expected >= 10 and n < expected - 3 and n in (expected % 10, expected // 10) else n
    if re.fullmatch(r"[Oo]\d{1,2}", raw):
        return int(raw[1:])
    guess = re.match(r"\d+", re.sub("[oO]", "0", re.sub("[áa]", "4", re.sub("^[lI]", "1", raw), count=1), count=1))
    if guess and 0 < int(guess.group()) <= 300:
        return int(guess.group())
    return expected if 0 < expected <= 300 else None


def split_exam(text: str | None) -> list[tuple[int, str, list[tuple[str, str]], str | None]]:
    """(number, statement, options, key letter) of an exam's questions, in order.

    A question begins at ``QUESTÃO n`` or at ``n.`` where n is the number expected next (or the first one); a lettered line,
    or a line with an empty circle, is an option, at most five; other lines go on with what came last.  The first answer a
    key gives for a number holds.  Of questions with the same number that with the most options holds, then the longest.
    """
    found: list[tuple[int, list[str], list[list[str]]]] = []
    keys: dict[int, str] = {}
    in_key = False
    expected = None
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if _KEY_HEAD.match(line):
            in_key = True
        if in_key:
            for n, letter in _KEY_ITEM.findall(line):
                if 0 < int(n) <= 300:
                    keys.setdefault(int(n), letter.upper())
            continue
        m = _START.match(line)
        n = question_number(m.group(1) or m.group(3), expected or 1) if m else None
        named = bool(m and m.group(1))
        if m and (named or expected is None or n == expected) and 0 < n <= 300:
            found.append((n, [m.group(2) or m.group(4) or ""], []))
            expected = n + 1
            continue
        if not found or not line.strip():
            continue
        _, statement, options = found[-1]
        o, c, v = None if _GERM.match(line) else _OPTION.match(line), _CIRCLE.match(line), _VERDICT.match(line)
        if o and len(options) < 5 and o.group(1).upper() == "ABCDE"[len(options)]:
            options.append([o.group(1).upper(), o.group(2) or ""])
        elif v and len(options) == (0 if v.group(1) else 1):
            options.append(["A" if v.group(1) else "B", line.strip()])
        elif c and len(options) < 5:
            options.append(["ABCDE"[len(options)], c.group(1)])
        elif options:
            options[-1][1] += " " + line.strip()
        else:
            statement.append(line.strip())
    best: dict[int, tuple[int, str, list[tuple[str, str]], str | None]] = {}
    for n, s, o in found:
        q = (n, " ".join(" ".join(s).split()), [(a, " ".join(b.split())) for a, b in o], keys.get(n))
        if n not in best or (len(q[2]), len(q[1])) > (len(best[n][2]), len(best[n][1])):
            best[n] = q
    return [best[n] for n in sorted(best)]


def split_exams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, number, statement, options, correct_letter) of each exam text; null texts have no questions."""
    types = dict(df.dtypes)
    opts = pa.list_(pa.struct([("letter", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for q in split_exam(t):
                    rows.append(i)
                    out.append(q)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(len(keys))), pa.array([q[0] for q in out], pa.int32()), pa.array([q[1] for q in out], pa.string()), pa.array([[{"letter": a, "text": x} for a, x in q[2]] for q in out], opts), pa.array([q[3] for q in out], pa.string())],
                [*keys, "number", "statement", "options", "correct_letter"],
            )

    return df.select(*keys, text).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), QUESTION]))


def answer_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, letter): the first letter given for each number from 1 to 300 behind a key's heading."""
    tail = F.regexp_extract(F.col(text), r"(?i)((?:GABARITO|RESPOSTAS)[\s\S]*)", 1)
    pairs = F.regexp_extract_all(tail, F.lit(r"(\d{1,3}\s*[:\-–=.]*\s*[A-Ea-e])\b"), F.lit(1))
    each = df.select(key, F.posexplode(pairs).alias("at", "p")).select(key, "at", F.regexp_extract("p", r"(\d+)", 1).cast("int").alias("number"), F.upper(F.regexp_extract("p", r"([A-Ea-e])$", 1)).alias("letter"))
    return each.where("number between 1 and 300").groupBy(key, "number").agg(F.min_by("letter", "at").alias("letter"))


def grade(statement: Column, options: Column) -> Column:
    """high, medium or low: how sure it is that a question was split right."""
    texts = F.transform(options, lambda o: F.trim(o["text"]))
    n = F.coalesce(F.size(F.filter(options, lambda o: F.lit(True))), F.lit(0))
    lens = F.array_sort(F.transform(texts, lambda x: F.length(x)))
    median, longest = F.try_element_at(lens, F.floor(n / 2).cast("int") + 1), F.array_max(lens)
    yes_no = (n == 2) & (F.exists(texts, lambda x: F.upper(x).isin("CERTO", "ERRADO", "VERDADEIRO", "FALSO", "V", "F", "SIM", "NÃO")) | F.coalesce(F.lower(statement).rlike(r"julgue\s+os\s+itens|certo\s+ou\s+errado|verdadeiro\s+ou\s+falso"), F.lit(False)))
    twice = F.size(F.array_distinct(F.transform(options, lambda o: o["letter"]))) != n
    empty = F.exists(texts, lambda x: F.length(x) == 0)
    return (
        F.when(F.length(F.trim(F.coalesce(statement, F.lit("")))) < 15, "low")
        .when(n <= 0, "low")
        .when(yes_no, "high")
        .when((n <= 2) | (n > 5) | twice | empty, "low")
        .when(longest > 2.5 * F.greatest(median, F.lit(25)), "low")
        .when(n == 3, "medium")
        .when(longest > 2.0 * F.greatest(median, F.lit(30)), "medium")
        .otherwise("high")
    )


# Wordings of clinical cases and of tricks (patterns), between signs that are no ASCII letters or digits.
_HEAD, _TAIL = r"(?:^|[^0-9A-Za-z_])", r"(?:$|[^0-9A-Za-z_])"
AGE = _HEAD + r"\d{1,3}\s*(?:anos?|meses?|dias?|semanas?)" + _TAIL
PATIENT = _HEAD + r"(?:paciente|homem|mulher|lactente|crian[çc]a|idoso|idosa|gestante|primigesta|mult[ií]para|neonato|rec[eé]m-nascido|menino|menina|jovem|adulto|senhor|senhora)" + _TAIL
CLINICAL = _HEAD + r"(?:d[aá]\s+entrada|procura|queixando-se|apresenta|atendido|admitido|trazido|internado|ao\s+exame|exame\s+f[ií]sico|laborat[oó]rio|eletrocardiograma|tomografia|radiografia|evoluindo)" + _TAIL
TRICK = _HEAD + r"(?:EXCETO|INCORRETA?|ERRAD[AO]|N[ÃA]O\s+(?:CORRESPONDE|SE\s+APLICA|DEVE|CONSTITUI)|FALS[AO]|ASSINALE\s+A\s+INCORRETA)" + _TAIL


def stats(questions: DataFrame, group: str, statement: str, letter: str) -> DataFrame:
    """Per exam: questions, share of each answer letter (0.2 each where none is known), lengths, shares of cases and tricks."""
    s = F.coalesce(F.col(statement), F.lit(""))
    ok = F.upper(F.col(letter)).isin("A", "B", "C", "D", "E")
    age, pat, cli, trick = (s.rlike("(?iu)" + p) for p in (AGE, PATIENT, CLINICAL, TRICK))
    n, known = F.count("*"), F.count_if(ok)
    share = lambda x: F.when(known > 0, F.round(F.count_if(F.upper(F.col(letter)) == x) / known, 2)).otherwise(0.2).alias(f"share_{x.lower()}")
    return questions.groupBy(group).agg(
        n.alias("questions"), *[share(x) for x in "ABCDE"], F.floor(F.sum(F.length(s)) / n + 0.5).alias("mean_chars"),
        F.round(F.count_if((age & pat) | (pat & cli) | (age & cli)) / n, 2).alias("case_ratio"), F.round(F.count_if(trick) / n, 2).alias("trick_ratio"),
    )


def in_columns(items: DataFrame, page: list[str], tolerance: float = 3.5) -> DataFrame:
    """Items (text, x, y, width) with ``column``: 0, or 1 for the right half of a page that is set in two columns.

    Such a page has at least 30 items over a width of 300, 20 in each half, neither with less than 0.35 of the other's, few
    in the middle, and hardly any line across it.  All is counted by page; no page is gathered in Python.
    """
    full = items.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    size = full.groupBy(*page).agg(F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi")).withColumn("_mid", (F.col("_lo") + F.col("_hi")) / 2)
    w = Window.partitionBy(*page).orderBy("y", "x", "text")
    new = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    on = full.join(size, page)
    counts = on.groupBy(*page).agg(F.count_if(F.col("x") < F.col("_mid") - 30).alias("_l"), F.count_if(F.col("x") > F.col("_mid") + 30).alias("_r"), F.count_if(F.abs(F.col("x") - F.col("_mid")) <= 30).alias("_c"))
    lines = on.withColumn("_line", new).withColumn("_line", F.sum("_line").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wide = lines.groupBy(*page, "_line").agg((F.min(F.col("x") - F.col("_mid")) < -40).alias("a"), (F.max(F.col("x") + F.coalesce("width", F.lit(0)) - F.col("_mid")) > 40).alias("b"))
    across = wide.groupBy(*page).agg(F.count_if(F.col("a") & F.col("b")).alias("_across"), F.count("*").alias("_lines"))
    two = (
        (F.col("_n") >= 30) & (F.col("_hi") - F.col("_lo") >= 300) & (F.least("_l", "_r") >= 20) & (F.least("_l", "_r") >= 0.35 * F.greatest("_l", "_r"))
        & (F.col("_c") <= 0.2 * (F.col("_l") + F.col("_r"))) & (F.col("_across") < 3) & (F.col("_across") <= 0.15 * F.col("_lines"))
    )
    pages = size.join(counts, page).join(across, page).where(two).select(*page, "_mid")
    return full.join(pages, page, "left").withColumn("column", F.when(F.col("x") >= F.col("_mid"), 1).otherwise(0)).drop("_mid")


def lines_from_items(items: DataFrame, page: list[str], tolerance: float = 3.5) -> DataFrame:
    """(*page, line_no, text): items (text, x, y) whose heights differ by no more than the tolerance from their neighbour's form a line, left to right."""
    w = Window.partitionBy(*page).orderBy("y", "x", "text")
    new = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    lined = items.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lined.groupBy(*page, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ").alias("text"))


def split_pages(items: DataFrame, doc: str, page: str, boxes: bool = False) -> DataFrame:
    """(doc, number, statement, options, correct_letter): the questions of exams given as items with their places.

    With ``boxes`` items are recognised words with a height, else those of a text layer; pages in two columns are read
    column by column.  The lines of an exam are joined in the order of reading and split as text.
    """
    keys = [doc, page, "column"]
    placed = in_columns(items, [doc, page])
    lines = lines_from_boxes(placed, keys) if boxes else lines_from_items(placed, keys)
    ordered = F.array_sort(F.collect_list(F.struct(page, "column", "line_no", "text")))
    texts = lines.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))
    return split_exams(texts, [doc], "text")


def lines_from_boxes(boxes: DataFrame, page: list[str], overlap: float = 0.35, centre: float = 6.0) -> DataFrame:
    """As ``lines_from_items`` for recognised words (text, x, y, height): a word joins the line of the word above in reading
    order if their heights overlap by a share or their centres are near.

    Where words have a width and a confidence, the line's far corner (x2, y2) and mean confidence come out too.
    """
    mid = F.col("y") + F.col("height") / 2
    b = boxes.withColumn("_mid", mid)
    w = Window.partitionBy(*page).orderBy("_mid", "x", "text")
    py, ph, pm = F.lag("y").over(w), F.lag("height").over(w), F.lag("_mid").over(w)
    shared = F.least(F.col("y") + F.col("height"), py + ph) - F.greatest(F.col("y"), py)
    near = (shared >= overlap * F.least(F.col("height"), ph)) | (F.abs(F.col("_mid") - pm) <= centre)
    lined = b.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = F.array_sort(F.collect_list(F.struct("x", "text")))
    more = []
    if {"width", "confidence"} <= set(boxes.columns):
        more = [F.max(F.col("x") + F.col("width")).alias("x2"), F.max(F.col("y") + F.col("height")).alias("y2"), F.round(F.avg("confidence"), 4).alias("confidence")]
    return lined.groupBy(*page, "line_no").agg(F.array_join(F.transform(out, lambda s: s["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), *more)


def relettered(options: Column, correct: Column, target: Column) -> Column:
    """Options with the correct one moved to the target place (from 0) and letters given anew; the others keep their order."""
    right = F.filter(options, lambda o: o["letter"] == correct)
    rest = F.filter(options, lambda o: o["letter"] != correct)
    placed = F.concat(F.slice(rest, F.lit(1), target), right, F.slice(rest, target + 1, F.size(rest)))
    return F.transform(placed, lambda o, i: F.struct(F.substring(F.lit("ABCDE"), i + 1, F.lit(1)).alias("letter"), o["text"].alias("text")))


def shuffled_options(options: Column, correct: Column, target: Column, seed: Column) -> Column:
    """As ``relettered``, with the other options in an order that the seed decides."""
    right = F.filter(options, lambda o: o["letter"] == correct)
    rest = F.filter(options, lambda o: o["letter"] != correct)
    order = F.array_sort(F.transform(rest, lambda o: F.struct(F.xxhash64(seed, o["letter"]).alias("h"), o["letter"].alias("letter"), o["text"].alias("text"))))
    mixed = F.transform(order, lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text")))
    placed = F.concat(F.slice(mixed, F.lit(1), target), right, F.slice(mixed, target + 1, F.size(mixed)))
    return F.transform(placed, lambda o, i: F.struct(F.substring(F.lit("ABCDE"), i + 1, F.lit(1)).alias("letter"), o["text"].alias("text"), o["letter"].alias("was")))


def moved_comments(placed: Column, comments: Column) -> Column:
    """The comments of options, by their new letters; ``placed`` is of ``shuffled_options``, comments a map by old letters."""
    kept = F.filter(placed, lambda o: F.map_contains_key(comments, o["was"]))
    return F.map_from_arrays(F.transform(kept, lambda o: o["letter"]), F.transform(kept, lambda o: F.try_element_at(comments, o["was"])))

"""Checks of generated and extracted content, and the selection of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions.text import fold, squeeze

# Short answers that are sound (folded), and units that make numbers sound.
SHORT_ANSWERS = (
    "certo", "errado", "verdadeiro", "falso", "sim", "nao", "v", "f", "bulbo", "ponte", "mesencefalo", "cerebelo", "talamo", "hipotalamo", "cortex", "medula", "figado", "rim", "rins", "baco", "timo",
    "linfonodo", "coracao", "pulmao", "pulmoes", "estomago", "pancreas", "duodeno", "ileo", "jejuno", "colon", "reto", "anus", "apendice", "utero", "ovario", "ovarios", "testiculo", "testiculos",
    "prostata", "bexiga", "uretra", "ureter", "tireoide", "paratireoide", "hipofise", "adrenal", "supra-renal", "pleura", "pericardio", "peritonio", "diafragma", "traqueia", "laringe", "faringe",
    "esofago", "aorta", "veia cava", "grau i", "grau ii", "grau iii", "grau iv", "tipo 1", "tipo 2", "estagio i", "estagio ii", "estagio iii", "estagio iv", "classe i", "classe ii", "classe iii", "classe iv",
)
UNITS = r"(?i)(?:^|[^\p{L}\d])\d+(?:[.,/]\d+)*\s*(?:mg|g|mcg|ml|dl|l|mmhg|bpm|meq|mmol|ui|%|anos|meses|dias|horas|minutos|grau|tipo|estagio|classe|ecg|tc|rm|x|vezes)(?:[^\p{L}]|$)|^\d+[.,/]\d+(?:\s*(?:mmhg|bpm|mg|g))?(?:/\p{L}+)?$"
_LETTERS = r"[A-Za-zÁÀÂÃÉÊÍÓÔÕÚÇáàâãéêíóôõúç]"


def option_ok(c: Column) -> Column:
    """Whether the text of an option reads like an answer; null and blank don't."""
    t = F.trim(F.coalesce(c, F.lit("")))
    bare = F.trim(F.regexp_replace(fold(t), r"[.:;!?,()\[\]{}'\"]", ""))
    unit = t.rlike(UNITS)
    digits, letters = F.regexp_count(t, F.lit(r"\d")), F.regexp_count(t, F.lit(_LETTERS))
    mixed = ~unit & (letters > 0) & (digits > 0) & (digits > 0.3 * F.length(t))
    mute = ~t.rlike(r"(?iu)[aeiouáéíóúâêîôûãõy]") & ~unit & (F.length(t) < 15)
    shuffled = ~F.contains(t, F.lit(" ")) & (F.length(t) <= 8) & t.rlike("[a-z][A-Z]")
    wordless = ~t.rlike(_LETTERS + "{2,}") & ~unit
    return F.when(t == "", False).when(bare.isin(*SHORT_ANSWERS), True).otherwise((F.length(t) >= 4) & ~mixed & ~mute & ~shuffled & ~wordless)


def question_ok(statement: Column, options: Column, letter: Column) -> Column:
    """A statement of ten characters, four or five sound options, and a key among their letters."""
    n = F.coalesce(F.size(F.filter(options, lambda o: o.isNotNull())), F.lit(0))
    return (F.length(F.trim(F.coalesce(statement, F.lit("")))) >= 10) & n.isin(4, 5) & F.coalesce(F.forall(options, lambda o: option_ok(o["text"])), F.lit(False)) & F.coalesce(F.exists(options, lambda o: F.upper(o["letter"]) == F.upper(F.trim(letter))), F.lit(False))


def card_ok(front: Column, back: Column, kind: Column) -> Column:
    """Both sides filled, and a cloze card with a gap."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return filled(front) & filled(back) & (~(F.coalesce(kind, F.lit("")) == "cloze") | F.coalesce(front, F.lit("")).rlike(r"\{\{c\d+::"))


def grounded_share(source: Column, text: Column) -> Column:
    """Share of the words of over three letters that the source holds; 1 without such words or without a source."""
    src = fold(F.coalesce(source, F.lit("")))
    ws = F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) > 3)
    return F.when((F.size(ws) == 0) | (src == ""), 1.0).otherwise(F.size(F.filter(ws, lambda w: F.contains(src, w))) / F.size(ws))


def varied_length(options: Column, letter: Column, index: Column) -> Column:
    """The length rule of a series: the right option is not above the mean in one question, not below it in the next, and neither extreme in the third."""
    lens = F.transform(options, lambda o: F.length(F.coalesce(o["text"], F.lit(""))))
    mean = F.aggregate(lens, F.lit(0.0), lambda a, x: a + x) / F.size(lens)
    own = F.try_element_at(F.transform(F.filter(options, lambda o: o["letter"] == letter), lambda o: F.length(F.coalesce(o["text"], F.lit("")))), F.lit(1))
    third = (F.abs(own - mean) <= 0.4 * mean) | (F.exists(lens, lambda x: x > own) & F.exists(lens, lambda x: x < own))
    third = F.coalesce(third, F.lit(True))
    return F.when(own.isNull(), True).when(F.pmod(index, F.lit(3)) == 0, own <= mean).when(F.pmod(index, F.lit(3)) == 1, own >= mean).otherwise(third)


def grounding_ok(statement: Column, answer: Column, context: Column, run: Column) -> Column:
    """Refused only if fewer than two words match, no run of two words is shared and below 15 % of the words match; short contexts pass."""
    src = fold(F.coalesce(context, F.lit("")))
    ws = F.filter(F.split(fold(F.concat_ws(" ", statement, answer)), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    hits = F.size(F.filter(ws, lambda w: F.contains(src, w)))
    return (F.length(F.trim(src)) < 30) | (F.size(ws) == 0) | (hits >= 2) | (run >= 2) | (hits >= 0.15 * F.size(ws))


# Terms that say nothing (folded), as words and as patterns.
GENERIC_TERMS = (
    "humanos", "animais", "masculino", "feminino", "adulto", "idoso", "idosos", "lactente", "crianca", "criancas", "recem-nascido", "gravidez", "estudo", "estudos", "artigo", "relato de caso",
    "ensaio clinico", "tecnica", "metodos", "anos", "meses", "pacientes", "paciente", "tratamento", "diagnostico", "resultado", "resultados", "pesquisa", "fator de risco", "fatores de risco",
    "fator de risco para", "fatores de risco para", "risco", "riscos", "causa", "causas",
)
GENERIC = r"^(outros|outra|outras|nao especificado|nao especificada|sem outra especificacao|outras formas|outros tipos)$"
SYMBOLS = r"^(na|k|o2|h2o|co2|fe|ca|mg|zn|cl|i|p|s|k\+)$"


def skip_term(c: Column) -> Column:
    """Dictionary terms that are left out: null, too short, numbers, chemical symbols and words that say nothing."""
    t = squeeze(fold(c))
    return F.coalesce((F.length(t) < 3) | t.isin(*GENERIC_TERMS) | t.rlike(GENERIC) | t.rlike(SYMBOLS) | t.rlike(r"^\d+$"), F.lit(True))


# Beginnings of units that are notes, and marks of headers, footers and answer cards.
NOTES = r"(?iu)^(material elaborado a partir|fonte:\s*|tabela\s+\d+[:\s-]|figura\s+\d+[:\s-]|refer[êe]ncias?\s*(bibliogr[áa]ficas?)?[:\s-]*$)"
PAGE_MARKS = r"(?iu)página.*\d+\s*(de|/)\s*\d+|cart[ãa]o\s*resposta|^processo seletivo|^concurso público|^folha de prova|todos os direitos reservados|^\d+\s+\d{6,}$|^\d{7,}$|^-\s*\d+\s*-$"
BUBBLE_ROW = r"^(?:[Oo0]?\d{1,2}|N|NA|\d{1,2}º)\s+[A-Ea-e]\s+[A-Ea-e]"


def note_unit(c: Column) -> Column:
    """Units that are notes and no content: blank ones, and short ones that begin like a note."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | (t.rlike(NOTES) & (F.length(t) < 120))


def furniture_line(c: Column) -> Column:
    """Lines that are headers, footers or rows of an answer card; null is none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return t.rlike(PAGE_MARKS) | t.rlike(BUBBLE_ROW)


def third_party(c: Column, own: tuple[str, ...] = ("manual", "próprio", "proprio", "ia local", "banco local")) -> Column:
    """Whether a source is known and none of one's own."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    mine = F.lit(False)
    for word in own:
        mine = mine | F.contains(t, F.lit(word))
    return (t != "") & ~mine


def blocks_in_budget(df: DataFrame, key: str, text: str, terms: list[str], budget: int, extra: int = 8) -> DataFrame:
    """(key, context): the paragraphs of a text with most of the terms, up to the budget of characters, in their own order.

    Paragraphs without a term count only if none has one; the best paragraph is always in.
    """
    blocks = df.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("pos", "b")).where("trim(b) != ''")
    low = fold(F.col("b"))
    score = sum((F.when(F.contains(low, fold(F.lit(t))), 1).otherwise(0) for t in terms), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    ranked = blocks.withColumn("score", score).withColumn("used", F.sum(F.length("b") + extra).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(w)).withColumn("top", F.max("score").over(Window.partitionBy(key)))
    kept = ranked.where("(r = 1 or used <= %d) and (score > 0 or top = 0)" % budget)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("context"))


def best_parent(themes: DataFrame, theme: str, topics: DataFrame, topic: str, order: str, group: str) -> DataFrame:
    """(theme, topic, score): for each theme the topic of its group with most words in common, of ties the first; an equality join on words."""
    cut = lambda df, c: df.select(group, c, *([order] if order in df.columns else []), F.explode(F.array_distinct(F.filter(F.split(fold(F.col(c)), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))).alias("w"))
    met = cut(themes.select(group, theme), theme).join(cut(topics, topic), [group, "w"]).groupBy(theme, topic, order).agg(F.count("*").alias("score"))
    return met.groupBy(theme).agg(F.max_by(F.struct(topic, "score"), F.struct("score", (-F.col(order)).alias("o"))).alias("m")).select(theme, f"m.{topic}", "m.score")


def balanced_letters(questions: DataFrame, group: str, order: str, seed: int = 1, letters: str = "ABCDE") -> DataFrame:
    """Adds ``target``: answer letters in cycles, each cycle a seeded order of all letters; so shares are even and no letter comes three times in a row."""
    n = len(letters)
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    cycle = F.floor(i / n)
    perm = F.array_sort(F.transform(F.array(*map(F.lit, letters)), lambda x: F.struct(F.xxhash64(F.lit(seed), F.col(group), F.col("_c"), x).alias("h"), x.alias("l"))))
    return questions.withColumn("_c", cycle).withColumn("_p", perm).withColumn("target", F.element_at(F.col("_p"), (F.pmod(i, F.lit(n)) + 1).cast("int"))["l"]).drop("_c", "_p")


def cycle_of(basic: Column, clinical: Column, least: int = 5, share: float = 0.65) -> Column:
    """basic, clinical or mixed by counts of entities; few entities are mixed."""
    n = basic + clinical
    return F.when(n < least, "mixed").when(basic >= share * n, "basic").when(clinical >= share * n, "clinical").otherwise("mixed")


def bands(c: Column, names: tuple[str, str, str, str] = ("baixa", "media", "alta", "muito alta")) -> Column:
    """A share from 0 to 1 in words; the neutral middle, and null, have none."""
    return F.when(c.between(0.4, 0.6), None).when(c >= 0.75, names[3]).when(c >= 0.5, names[2]).when(c >= 0.25, names[1]).when(c >= 0, names[0])


def anchoring(matches: Column, words: Column) -> Column:
    """How well a text is tied to known entities: density x 0.5 + 0.3, within 0.2 and 1."""
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.coalesce(matches / F.nullif(words, F.lit(0)), F.lit(0.0)) * 0.5 + 0.3))

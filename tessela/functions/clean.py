"""Cleaning, normal forms and small parsers, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessela.functions.text import fold, squeeze

# Words that are no key terms.
STOP_WORDS = (
    "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "por", "pela", "pelo", "com", "sem", "para", "que", "qual", "quais", "uma", "um", "umas", "uns", "o", "a",
    "os", "as", "se", "esta", "este", "estao", "paciente", "anos", "quadro", "apresenta", "relata", "refere", "exame", "sobre", "como", "mais", "menos", "entre", "após", "apos",
    "sua", "seu", "suas", "seus", "onde", "quando", "deve", "ser", "sao", "tem", "tinha",
)
# Folded variants and the term that is preferred.
SYNONYMS = {
    "falta de ar": "dispneia", "dor no peito": "dor toracica", "inchaco": "edema", "pressao alta": "hipertensao", "pressao baixa": "hipotensao", "acucar no sangue alto": "hiperglicemia",
    "infarto": "infarto agudo do miocardio", "derrame": "acidente vascular cerebral", "ave": "acidente vascular cerebral",
}


def document(c: Column) -> Column:
    """One kind of line end, no control characters, no blanks at line ends, at most one blank line."""
    steps = ((r"\r\n?", "\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[ \t]+(?=\n|$)", ""), (r"\n{3,}", "\n\n"))
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def keywords(c: Column) -> Column:
    """Folded words of a to z and digits, single blanks between."""
    return squeeze(F.regexp_replace(fold(c), r"[^a-z0-9\s]", " "))


def automaton_form(c: Column) -> Column:
    """The form in which dictionary and text are matched: folded, with only letters, digits, _ - . / kept."""
    return squeeze(F.regexp_replace(fold(c), r"[^\w\s\-./]", " "))


def token_estimate(c: Column) -> Column:
    """A token for every four characters begun; 0 for null."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def truncate_sentence(c: Column, n: int) -> Column:
    """The text up to its last sentence end within n characters, if that is past the 50th, else its first n characters."""
    head = F.substring(c, 1, n)
    cut = F.regexp_extract(head, r"^([\s\S]*[.!?])", 1)
    return F.when(F.length(c) <= n, c).when(F.length(cut) > 50, cut).otherwise(head)


def key_terms(c: Column, most: int = 5) -> Column:
    """The first distinct terms that are no stop words; the answer of a cloze counts as plain text."""
    plain = F.regexp_replace(c, r"\{\{c\d+::(.*?)(::.*?)?\}\}", "$1")
    ws = F.split(F.lower(F.regexp_replace(plain, r"[^\w\sÀ-ɏ-]", " ")), r"\s+")
    return F.array_join(F.slice(F.array_distinct(F.filter(ws, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))), 1, most), " ")


def strip_cloze(c: Column) -> Column:
    return F.regexp_replace(c, r"\{\{c\d+::(.*?)(::.*?)?\}\}", "$1")


def next_cloze(c: Column) -> Column:
    """One more than the highest cloze number of a text."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"\{\{c(\d+)::"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0)) + 1


def canonical_key(system: Column, code: Column, text: Column) -> Column:
    """system:code where both are known, else the folded text or the term preferred to it."""
    preferred = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(blank(system), F.lit(":"), blank(code)), preferred[keywords(text)], keywords(text))


def mojibake(c: Column) -> Column:
    """Repairs UTF-8 read as Latin-1 for the letters of Portuguese."""
    pairs = [(ch.encode().decode("latin-1"), ch) for ch in "áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇºª"]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def loose_json(c: Column) -> Column:
    """The JSON inside a fenced or chatty answer: from the first bracket to the last."""
    return F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"([\[{][\s\S]*[\]}])", 1)


def round_half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def byte_size(c: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(c < kb, F.format_string("%d B", c)).when(c < mb, F.format_string("%.1f KB", c / kb)).when(c < gb, F.format_string("%.1f MB", c / mb)).otherwise(F.format_string("%.1f GB", c / gb))


def icd_code(c: Column) -> Column:
    """A letter and two digits, with a dot before further digits; other codes stay."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike(r"^[A-Z]\d{3}$"), F.concat(F.substring(u, 1, 3), F.lit("."), F.substring(u, 4, 1))).otherwise(u)

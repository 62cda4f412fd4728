"""Dictionary entities and relations in text.

Two forms give the same matches: a join of n-grams with the dictionary, which stays in the JVM and scales with
the dictionary, and an automaton over whole texts, for dictionaries of a bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions.clean import STOP_WORDS, keywords
from tessela.functions.text import fold, squeeze
from tessela.operators.joins import fuzzy_lookup, small_or_shuffled
from tessela.session import cut_lineage, spread

#: Entries up to which the dictionary is sent to the executors.
MOST_ENTRIES = 500_000


def dictionary(df: DataFrame, term: str, code: str | None = None, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(norm, term, code): one row for each normal form, the least term and code; blank ones and stop words are left out."""
    d = df.select(F.trim(F.col(term)).alias("term"), (F.col(code) if code else F.lit(None).cast("string")).alias("code"))
    d = d.withColumn("norm", keywords(F.col("term"))).where("norm != ''").where(~F.col("norm").isin(*stop_words))
    return d.groupBy("norm").agg(F.min("term").alias("term"), F.min("code").alias("code"))


def ngram_matches(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, first, last, norm, code): dictionary entries in the texts by word places, overlapping ones included.

    Word groups of the lengths that the entries have are joined with them, however long these are.
    """
    entries = cut_lineage(entries.select("norm", "code"))
    lengths = sorted(r["n"] for r in entries.select(F.size(F.split("norm", " ")).alias("n")).distinct().collect())  # no more than the longest entry has words
    toks = spread(texts.select(key, text)).select(F.col(key), F.split(keywords(F.coalesce(F.col(text), F.lit(""))), " ").alias("w"))
    if lengths == list(range(1, len(lengths) + 1)):
        sizes = f"sequence(1, least({len(lengths)}, size(w) - i))"
    else:
        sizes = f"filter(array({', '.join(map(str, lengths or [1]))}), n -> n <= size(w) - i)"
    grams = toks.select(key, F.posexplode(F.expr(f"transform(w, (x, i) -> transform({sizes}, n -> struct(int(i) as first, int(i + n - 1) as last, array_join(slice(w, i + 1, n), ' ') as norm)))")).alias("p", "gs"))
    flat = grams.select(key, F.explode("gs").alias("g")).select(key, "g.*").where("norm != ''")
    return flat.join(small_or_shuffled(entries), "norm").select(key, "first", "last", "norm", "code")


def _sorted_matches() -> Column:
    """The matches of a group, the longest first, of equals the leftmost."""
    return F.array_sort(F.collect_list(F.struct((F.col("first") - F.col("last")).alias("short"), "first", "last", "norm", "code")))


def _greedy(lists: pa.ListArray) -> tuple[list[int], list[int], pa.StructArray]:
    """(rows, places, matches): of sorted matches those that overlap none before, by row and by place in the flat array.

    The word places taken are marked, so a text takes time in proportion to its words.
    """
    flat = lists.flatten()
    first, last = flat.field("first").to_pylist(), flat.field("last").to_pylist()
    ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
    rows, kept, begin = [], [], 0
    for i, end in enumerate(ends):
        taken = bytearray(max(last[begin:end], default=-1) + 1)
        for m in range(begin, end):
            f, e = first[m], last[m] + 1
            if taken.find(1, f, e) < 0:
                taken[f:e] = b"\x01" * (e - f)
                rows.append(i)
                kept.append(m)
        begin = end
    return rows, kept, flat


def resolve_overlaps(matches: DataFrame, key: str) -> DataFrame:
    """Of matches that overlap the longest stay, of equals the leftmost: taken greedily over each text's sorted matches."""
    kind = dict(matches.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept, flat = _greedy(b.column(1))
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(flat.field(c).take(take) for c in ("first", "last", "norm", "code"))], [key, "first", "last", "norm", "code"])

    return matches.groupBy(key).agg(_sorted_matches().alias("ms")).mapInArrow(run, f"`{key}` {kind}, first int, last int, norm string, code string")


_automata: dict[str, object] = {}


def automaton_matches(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """As ``ngram_matches``, by one automaton; the dictionary is checked to be small enough to send."""
    import ahocorasick

    if entries.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        return ngram_matches(texts, key, text, entries)
    rows = [(r["norm"], r["code"]) for r in entries.select("norm", "code").collect()]
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    kind = dict(texts.dtypes)[key]
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _automata:  # one for all tasks of a worker
            a = ahocorasick.Automaton()
            for norm, code in shared.value:
                a.add_word(f" {norm} ", (norm, code))
            a.make_automaton()
            _automata.clear()
            _automata[mark] = a
        auto = _automata[mark]
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = f" {t} "
                if not len(auto):
                    continue
                starts: dict[int, int] = {}
                n = 0
                for i, ch in enumerate(s):
                    if ch == " ":
                        starts[i] = n
                        n += 1
                for end, (norm, code) in auto.iter(s):
                    first = starts[end - len(norm) - 1]
                    out.append((k, first, first + norm.count(" "), norm, code))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], [key, "first", "last", "norm", "code"])

    return spread(texts.select(key, text)).select(key, keywords(F.coalesce(F.col(text), F.lit(""))).alias("t")).mapInArrow(run, f"`{key}` {kind}, first int, last int, norm string, code string")


def coverage_ratio(texts: DataFrame, key: str, text: str, matches: DataFrame) -> DataFrame:
    """(key, chars, covered, ratio): share of the characters of each normal text that lie in a match; 0 for empty ones.

    Matches should not overlap (``resolve_overlaps``); a match has the characters of its entry.
    """
    n = texts.select(key, F.length(keywords(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
    c = matches.groupBy(key).agg(F.sum(F.length("norm")).alias("covered"))
    covered = F.coalesce("covered", F.lit(0))
    return n.join(c, key, "left").select(key, "chars", covered.alias("covered"), F.round(F.coalesce(covered / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0)), 6).alias("ratio"))


# How relations are worded (patterns on folded text), and their names.
TRIGGERS = (
    ("CAUSA", r"\bcausa(m)?\b"), ("CAUSA", r"\bpode causar\b"), ("CAUSA", r"\bprovoca(m)?\b"), ("CAUSA", r"\blevam? a\b"), ("CAUSA", r"\bresulta(m)? em\b"), ("CAUSA", r"\bdesencadeia(m)?\b"),
    ("CAUSA", r"\bpode levar a\b|\bpodem levar a\b"), ("CAUSA", r"\bé responsável por\b|\bsão responsáveis por\b"), ("CAUSA", r"\bocasiona(m)?\b"),
    ("TRATAMENTO", r"\btrata(m)?\b|\btratamento (para|de|inclui)\b"), ("TRATAMENTO", r"\bindicado (para|em)\b|\bindicados? (para|em)\b"), ("TRATAMENTO", r"\bo tratamento consiste em\b"),
    ("TRATAMENTO", r"\butilizado(a)? (no|na|para o|para a) tratamento\b"), ("TRATAMENTO", r"\badministra(-se)?\b"), ("TRATAMENTO", r"\bprescrito(a)? (para|em)\b"),
    ("TRATAMENTO", r"\bde escolha (para|no tratamento de)\b"), ("TRATAMENTO", r"\bterapia (para|de|com)\b"),
    ("FATOR_DE_RISCO", r"\bfator(es)? de risco (para|de)\b"), ("FATOR_DE_RISCO", r"\baumenta(m)? o risco de\b"), ("FATOR_DE_RISCO", r"\bpredisp(õe|õem) a\b|\bpredispõe a\b"),
    ("FATOR_DE_RISCO", r"\bfavorece(m)? o (desenvolvimento|aparecimento) de\b"),
    ("CONTRAINDICACAO", r"\bcontraindicad[oa]s? (em|para)\b"), ("CONTRAINDICACAO", r"\bnão deve(m)? ser (usado|administrado|utilizado)s? (em|com|na presença de)\b"), ("CONTRAINDICACAO", r"\bevitar (o uso de|em)\b"),
    ("MANIFESTACAO", r"\bsintoma(s)? de\b|\bmanifesta-se com\b|\bapresenta-se com\b"), ("MANIFESTACAO", r"\bcaracteriza(-se)? por\b"), ("MANIFESTACAO", r"\bcursa(m)? com\b"),
    ("MANIFESTACAO", r"\bmanifesta(m)?-se por\b"), ("MANIFESTACAO", r"\bpode(m)? apresentar\b"),
    ("ASSOCIACAO", r"\bassociad[oa]s? (a|com)\b|\brelacionad[oa]s? (a|com)\b"), ("ASSOCIACAO", r"\bcorrelaciona(-se)? com\b"),
    ("DIAGNOSTICO_POR", r"\bdiagnosticad[oa]s? (por|com|através de)\b"), ("DIAGNOSTICO_POR", r"\bconfirmado(a)? (por|com|através de)\b"), ("DIAGNOSTICO_POR", r"\bdetectad[oa]s? (por|com|através de)\b"),
    ("DIAGNOSTICO_POR", r"\bo exame de escolha (é|para)\b"),
    ("MECANISMO_DE_ACAO", r"\bage(m)? (sobre|em|no|na)\b|\batua(m)? (sobre|em|no|na)\b"), ("MECANISMO_DE_ACAO", r"\binibe(m)?\b"), ("MECANISMO_DE_ACAO", r"\bestimula(m)?\b"), ("MECANISMO_DE_ACAO", r"\bbloqueia(m)?\b"),
    ("MECANISMO_DE_ACAO", r"\bativa(m)?\b"), ("MECANISMO_DE_ACAO", r"\breduz(em)?\b"), ("MECANISMO_DE_ACAO", r"\baumenta(m)? a (produção|secreção|liberação) de\b"),
    ("EFEITO_ADVERSO", r"\befeito(s)? colateral(is)? (de|do|da)\b"), ("EFEITO_ADVERSO", r"\befeito(s)? adverso(s)? (de|do|da)\b"), ("EFEITO_ADVERSO", r"\bpode(m)? causar como efeito colateral\b"),
    ("EFEITO_ADVERSO", r"\breação(ões)? adversa(s)? (a|ao|à)\b"),
    ("PREVENCAO", r"\bprevine(m)?\b"), ("PREVENCAO", r"\breduz(em)? o risco de\b"), ("PREVENCAO", r"\bprofilaxia (para|de|do|da)\b"),
    ("IRRIGACAO", r"\birriga(m)?\b"), ("IRRIGACAO", r"\bsuprido(a)? por\b|\bsupre(m)?\b"), ("IRRIGACAO", r"\bvasculariza(m|do|da)?\b"),
    ("INERVACAO", r"\bineva(m)?\b|\binerva(m)?\b"), ("INERVACAO", r"\binervado(a)? por\b"),
    ("DRENAGEM", r"\bdrena(m)?\b"), ("DRENAGEM", r"\bdrenado(a)? por\b"),
    ("LOCALIZACAO", r"\blocaliza(-se)? (em|no|na)\b|\bsitua(-se)? (em|no|na)\b"), ("LOCALIZACAO", r"\bencontra(-se)? (em|no|na)\b"),
    ("COMPOSICAO", r"\bcompõe(m)?\b|\bcompo[e|õe] (o|a)\b"), ("COMPOSICAO", r"\bfaz(em)? parte (de|do|da)\b|\bconstitui(em)?\b"),
    ("REGULACAO", r"\bregula(m)?\b"), ("REGULACAO", r"\bcontrola(m)?\b"), ("REGULACAO", r"\bmodula(m)?\b"),
    ("CLASSIFICACAO", r"\bclassifica(-se)? em\b|\b[eé] classificad[oa] como\b"), ("CLASSIFICACAO", r"\bsubdivide(-se)? em\b|\bdivide(-se)? em\b"),
    ("CLASSIFICACAO", r"\btipos? de\b(?=.{0,40}\b(classifica[cç][aã]o|classificam)\b)"),
    ("EPIDEMIOLOGIA", r"\bmais comum (em|no|na)\b|\bmais frequente (em|no|na)\b"), ("EPIDEMIOLOGIA", r"\bacomete(m)? principalmente\b|\bacomete(m)? predominantemente\b"),
    ("EPIDEMIOLOGIA", r"\bprevalente (em|no|na)\b|\bpreval[eê]ncia (em|no|na)\b"), ("EPIDEMIOLOGIA", r"\bincide(m)? (em|sobre)\b"),
    ("COMPLICACAO", r"\bevolui(em)? para\b|\bpode(m)? evoluir para\b"), ("COMPLICACAO", r"\bcomplica(-se)? com\b|\bcomplica[cç][aã]o(ões|oes)? (de|do|da)\b"), ("COMPLICACAO", r"\bpode(m)? progredir para\b"),
    ("PROGNOSTICO", r"\bprogn[oó]stico (reservado|favor[aá]vel|desfavor[aá]vel|bom|ruim)\b"), ("PROGNOSTICO", r"\btaxa(s)? de (mortalidade|sobrevida) (de|em|para)\b"),
)
# What negates a relation (folded).
NEGATIONS = ("nao", "nunca", "jamais", "nenhum", "nenhuma", "sem", "ausencia de", "raramente", "dificilmente", "nao costuma", "nao deve ser confundido com")
# How kinds of entities and relations are named in the graph.
ENTITY_TYPES = {"DOENCA": "disease", "MEDICAMENTO": "medication", "SINTOMA": "symptom", "ESTRUTURA_ANATOMICA": "anatomy", "EXAME": "exam", "PROCEDIMENTO": "procedure"}
PREDICATES = {
    "CAUSA": "causa", "TRATAMENTO": "trata", "FATOR_DE_RISCO": "causa", "CONTRAINDICACAO": "contraindica", "MANIFESTACAO": "é_sintoma_de", "ASSOCIACAO": "associado_a", "DIAGNOSTICO_POR": "diagnostica",
    "MECANISMO_DE_ACAO": "mecanismo_de_acao", "EFEITO_ADVERSO": "complica", "PREVENCAO": "previne", "IRRIGACAO": "irriga", "INERVACAO": "inerva", "DRENAGEM": "drena", "LOCALIZACAO": "localizado_em",
    "COMPOSICAO": "compoe", "REGULACAO": "regula", "CLASSIFICACAO": "classifica_como", "COMPLICACAO": "complica", "EPIDEMIOLOGIA": "associado_a", "PROGNOSTICO": "associado_a",
}



def _stems(pattern: str) -> tuple[str, ...]:
    """Letters with which each alternative of a pattern begins; a sentence without any of them can't match."""
    found = [re.match(r"(?:\\b)?([^\W\d_ -]+)([?*]?)", part) for part in pattern.split(r"\b|\b")]
    return tuple("" if m is None else m.group(1)[: -1 if m.group(2) else None] for m in found)


_TRIGGERS = [(name, re.compile(pattern, re.ASCII), _stems(pattern)) for name, pattern in TRIGGERS]
_NEGATED = re.compile(r"\b(?:" + "|".join(NEGATIONS) + r")\b", re.ASCII)
_ALNUM = re.compile("[a-z0-9]+")


def named(c: Column, names: dict[str, str]) -> Column:
    """The graph's name of a kind; unknown ones in lower case, null stays null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], F.lower(c))


def relations_in(sentence: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, str, str, str]]:
    """(subject, relation, object, trigger) of a folded sentence; ``spans`` are word places and names of its entities.

    A trigger relates every entity that ends between the trigger before and itself with every one that starts between
    itself and the next trigger, except an entity with itself.  A negation within the five words before the trigger that
    stand behind the subject marks the relation.
    """
    hits = sorted(((m.start(), m.end(), name) for name, pattern, stems in _TRIGGERS if any(x in sentence for x in stems) for m in pattern.finditer(sentence)), key=lambda h: h[:2])
    if not hits:
        return []
    words = [m.span() for m in _ALNUM.finditer(sentence)]
    places = [(words[a][0], words[z][1], name) for a, z, name in spans if z < len(words)]
    starts = [h[0] for h in hits] + [len(sentence)]
    out, before = [], 0
    for (start, end, name), following in zip(hits, starts[1:]):
        subjects = [p for p in places if before < p[1] <= start]
        objects = [p for p in places if end <= p[0] < following]
        for s in subjects if objects else ():
            near = sentence[max(before, s[1]) : start].split()[-5:]
            kind = f"NEGACAO_{name}" if _NEGATED.search(" ".join(near)) else name
            out += [(s[2], kind, o[2], sentence[start:end]) for o in objects if o[2] != s[2]]
        before = end
    return out


def relations(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, sentence_no, subject, relation, object, trigger), each once a sentence; a sentence ends at . ! or ?"""
    sentences = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])")).alias("sentence_no", "s"))
    sentences = sentences.withColumn("s", squeeze(fold(F.col("s")))).where("s != ''")
    sentences = sentences.withColumn("sid", F.concat_ws("\x01", F.col(key).cast("string"), "sentence_no"))
    grouped = ngram_matches(sentences, "sid", "s", entries).groupBy("sid").agg(_sorted_matches().alias("ms")).where("size(ms) > 1")
    ready = sentences.join(grouped, "sid").select(key, "sentence_no", "s", "ms")
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept, flat = _greedy(b.column(3))
            names, first, last = (flat.field(c).to_pylist() for c in ("norm", "first", "last"))
            spans: dict[int, list[tuple[int, int, str]]] = {}
            for i, m in zip(rows, kept):
                spans.setdefault(i, []).append((first[m], last[m], names[m]))
            keys, numbers, said = (b.column(i).to_pylist() for i in range(3))
            out = []
            for i, s in spans.items():
                if len(s) > 1:
                    out += [(keys[i], numbers[i], *r) for r in dict.fromkeys(relations_in(said[i], sorted(s)))]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], [key, "sentence_no", "subject", "relation", "object", "trigger"])

    return ready.mapInArrow(run, f"`{key}` {kind}, sentence_no int, subject string, relation string, object string, trigger string")


def neighbours_of_trigger(matches: DataFrame, key: str) -> DataFrame:
    """Each match with the names of the matches before and after it in its text."""
    w = Window.partitionBy(key).orderBy("first", "last", "norm")
    return matches.select(key, "first", "norm", F.lag("norm").over(w).alias("previous"), F.lead("norm").over(w).alias("next"))


def gap_recovery(texts: DataFrame, key: str, text: str, entries: DataFrame, most: int = 30) -> DataFrame:
    """(key, first, last, norm, code, recovered): the matches of each text, and misspelt words between them.

    Words of at least five letters that lie in no match and are no stop words are looked up as ``fuzzy_lookup`` does; of
    each text the ``most`` longest, of equals the first ones, as a text with more is not misread but about something else.
    """
    found = resolve_overlaps(ngram_matches(texts, key, text, entries), key)
    words = spread(texts.select(key, text)).select(key, F.posexplode(F.split(keywords(F.coalesce(F.col(text), F.lit(""))), " ")).alias("place", "w"))
    words = words.where((F.length("w") >= 5) & F.col("w").rlike("[a-z]") & ~F.col("w").isin(*STOP_WORDS))
    covered = found.select(key, F.explode(F.sequence("first", "last")).alias("place"))
    gaps = words.join(covered, [key, "place"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("w")), "place"))
    gaps = gaps.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
    best = fuzzy_lookup(gaps.select(F.col("w").alias("id"), "w").distinct(), entries, "id", "w", "norm").select("w", "norm")
    codes = entries.select("norm", "code")
    new = gaps.join(best, "w").join(codes, "norm").select(key, F.col("place").cast("int").alias("first"), F.col("place").cast("int").alias("last"), "norm", "code", F.lit(True).alias("recovered"))
    return found.withColumn("recovered", F.lit(False)).unionByName(new)

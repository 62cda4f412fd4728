"""Variant spellings of the names of people and organisations.

The words of each name are hashed by MinHash over padded q-grams; the number of bands comes from the collision curve
and the recall wanted for words one edit apart.  Names that share a similar selective word, or a similar common word
and the initial of a second word, are verified by a Monge-Elkan similarity that knows initials, abbreviations and nicknames, and
linked names are clustered by star clustering: the fullest, most used name of a neighbourhood is its centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessela.functions.text import fold
from tessela.session import cut_lineage

# Words that stand for no name.
FILLERS = ("nao informado", "nao informada", "varios", "varias", "n a", "na", "n d", "nd", "a definir", "sem informacao", "desconhecido", "desconhecida", "diversos", "outros", "nenhum", "null", "none", "sem nome", "ignorado", "x", "xx", "xxx", "teste", "indefinido", "nao consta", "em branco", "unknown")
# Titles and particles.
TITLES = ("dr", "dra", "prof", "profa", "professor", "professora", "doc", "docente", "doutor", "doutora", "sr", "sra", "me", "msc", "phd")
PARTICLES = ("de", "da", "do", "das", "dos", "e", "di", "del")
# Brazilian nicknames and the given names that they stand for.
NICKNAMES = {
    "beto": "norberto", "belinho": "umbelino", "celina": "marcelina", "cencinho": "inocencio", "detinha": "bernadete", "dina": "leopoldina", "dora": "teodora",
    "duda": "eduarda", "lininha": "durvalina", "mina": "guilhermina", "miro": "valdomiro", "moninha": "jeronima", "mundinha": "raimunda", "nilinha": "petronilia",
    "quico": "quirino", "selmo": "anselmo", "tavinho": "otaviano", "tiao": "sebastiao", "tovinho": "cristovao", "valdo": "florisvaldo", "vecinho": "helvecio", "zozo": "zoraide",
}

#: Letters of an abbreviation, at most.
SHORT = 5
#: Likeness of a word and its initial or abbreviation; no 1 - edits / length is equal to it.
SHORTENED = 0.891
#: Names that may hold a selective word; names alike in commoner words only must agree in a second word or its initial.
MOST = 200
Q = 3
ROWS = 3
#: Share of q-grams that two words one edit apart have in common, and the recall wanted for them.
EDIT_OVERLAP = 0.42
RECALL = 0.97


def bands_for(similarity: float = EDIT_OVERLAP, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands whose collision curve 1 - (1 - s^rows)^bands reaches the recall at s."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def name_words(c: Column, person: bool) -> Column:
    """The words of a name, without acronym, titles and particles, nicknames written out; empty for fillers and null."""
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"^\s*\p{Lu}{3,}\s+[-–]\s+|\s+[-–]\s+\p{Lu}{3,}\s*$", " ")
    c = F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))
    drop = (*TITLES, *PARTICLES) if person else PARTICLES
    toks = F.filter(F.split(c, " "), lambda w: (w != "") & (~w.isin(*[d for d in drop if len(d) > 1])))
    if person:
        nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
        toks = F.transform(toks, lambda w: F.coalesce(nick[w], w))
    return F.when(c.isNull() | (c == "") | c.isin(*FILLERS), F.array().cast("array<string>")).otherwise(toks)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    if a == b:
        return 0
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        two, one = one, now
    return one[-1]


def word_likeness(a: str, b: str) -> float:
    """1 for equal words, SHORTENED for an initial or an abbreviation, 1 - edits / length for near words, else 0."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short[0] == long[0] and (len(short) == 1 or len(short) <= SHORT and len(long) - len(short) >= 2 and _inside(short, long)):
        return SHORTENED
    if len(short) < 4 or len(long) - len(short) > 2:
        return 0.0
    s = 1 - edits(a, b) / len(long)
    return s if s >= 0.78 else 0.0


def _inside(short: str, long: str) -> bool:
    """Whether the letters of short come in long in this order."""
    it = iter(long)
    return all(ch in it for ch in short)


def name_likeness(a: list[str], b: list[str]) -> float:
    """Monge-Elkan: the mean of the best likeness of each word of the shorter name, each word used once; 0 unless all
    words have a partner and a full word of at least four letters agrees.
    """
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 0.0
    scores = sorted(((word_likeness(x, y), len(x) + len(y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda t: (-(t[0] > 0.93), -(t[0] > 0) * t[1], -t[0], t[2], t[3]))
    left, right, total, full = set(range(len(a))), set(range(len(b))), 0.0, False
    for s, _, i, j in scores:
        if s and i in left and j in right:
            left.discard(i)
            right.discard(j)
            total += s
            full |= min(len(a[i]), len(b[j])) >= 4 and s != SHORTENED
    if left or not full:
        return 0.0
    return total / len(a)


def _band_keys(tokens: DataFrame, rows: int, bands: int) -> DataFrame:
    """(w, key): the band keys of each word, and one of its letters in order of the alphabet."""
    rng = np.random.default_rng(11)
    mul = rng.integers(1, 2**61, rows * bands, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**61, rows * bands, dtype=np.uint64)
    mix = rng.integers(1, 2**61, rows, dtype=np.uint64) | np.uint64(1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_w, out_k = [], []
            for w in b.column(0).to_pylist():
                s = "^" * (Q - 1) + w + "$" * (Q - 1)
                grams = np.array([int.from_bytes(s[i : i + Q].encode()[:8], "little") for i in range(len(s) - Q + 1)], dtype=np.uint64)
                h = (grams[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ (grams[:, None] >> np.uint64(13))) * mul + add
                h ^= h >> np.uint64(29)
                low = h.min(axis=0).reshape(bands, rows)
                key = (low * mix).sum(axis=1, dtype=np.uint64) ^ np.arange(bands, dtype=np.uint64)
                swapped = xxhash.xxh64_intdigest("".join(sorted(w)))  # words with neighbours swapped have the same letters
                out_k.append(np.append(key, np.uint64(swapped)).view(np.int64))
                out_w += [w] * (bands + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.string()), pa.array(np.concatenate(out_k) if out_k else np.zeros(0, np.int64))], ["w", "key"])

    return tokens.select("w").mapInArrow(keys, "w string, key long")


@F.pandas_udf(T.DoubleType())
def _word_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_likeness(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _name_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_likeness(list(x), list(y)) for x, y in zip(a, b)], dtype=float)


def name_classes(df: DataFrame, columns: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """(field, name, rep) of each distinct string, and (field, rep, ws, uses) of each distinct bag of words.

    ``columns`` says of each column whether it names people.  Null, blank and fillers have no rows.
    """
    names = None
    for c, person in columns.items():
        part = df.select(F.lit(c).alias("field"), F.col(c).alias("name")).groupBy("field", "name").agg(F.count("*").alias("uses")).withColumn("ws", name_words(F.col("name"), person))
        names = part if names is None else names.unionByName(part)
    names = names.where(F.size("ws") > 0).withColumn("rep", F.array_join(F.array_sort("ws"), " "))
    names = cut_lineage(names)
    classes = names.groupBy("field", "rep").agg(F.first("ws").alias("ws"), F.sum("uses").alias("uses"))
    return names.select("field", "name", "rep"), classes.withColumn("ws", F.split("rep", " "))


def similar_names(classes: DataFrame, threshold: float = 0.8, most: int = MOST, rows: int = ROWS, bands: int | None = None) -> DataFrame:
    """(field, a, b, likeness): pairs of classes of one field that are alike, a < b."""
    bands = bands or bands_for(rows=rows)
    words_ = classes.select("field", "rep", F.explode(F.array_distinct("ws")).alias("w")).where("length(w) > 1")
    uses = words_.groupBy("field", "w").agg(F.count("*").alias("df"))
    held = words_.join(uses, ["field", "w"])
    rare = held.where(F.col("df") <= most).select("field", "rep", "w")
    keys = _band_keys(uses.select("w").distinct(), rows, bands)
    x, y = keys.alias("x"), keys.alias("y")
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.w") < F.col("y.w"))).select(F.col("x.w").alias("w"), F.col("y.w").alias("v")).where("abs(length(w) - length(v)) <= 2").distinct()
    near = cut_lineage(near.where(_may_be_alike(F.col("w"), F.col("v"))).where(_word_likeness("w", "v") > 0))
    same = uses.select("w").distinct().withColumn("v", F.col("w"))
    alike = cut_lineage(near.unionByName(near.select(F.col("v").alias("w"), F.col("w").alias("v"))).unionByName(same))
    met = rare.join(alike, "w").select("field", F.col("rep").alias("a"), F.col("v").alias("w")).join(rare.select("field", F.col("rep").alias("b"), "w"), ["field", "w"]).where("a < b").select("field", "a", "b")
    met2 = _by_common_word(classes, uses, alike, most)
    pairs = met.unionByName(met2).distinct()
    left = classes.select("field", F.col("rep").alias("a"), F.col("ws").alias("wa"))
    right = classes.select("field", F.col("rep").alias("b"), F.col("ws").alias("wb"))
    compared = pairs.join(left, ["field", "a"]).join(right, ["field", "b"]).repartition(classes.sparkSession.sparkContext.defaultParallelism)  # few bytes, but dear to compare
    return compared.withColumn("likeness", _name_likeness("wa", "wb")).where(F.col("likeness") >= threshold).select("field", "a", "b", "likeness")


def _may_be_alike(w: Column, v: Column) -> Column:
    """False only where ``word_likeness`` is 0: built-in, so that few pairs leave the JVM.  A swap is two edits here."""
    few = F.levenshtein(w, v) <= 2 * F.floor(0.22 * F.greatest(F.length(w), F.length(v)) + 1e-9)
    return few | ((F.substring(w, 1, 1) == F.substring(v, 1, 1)) & (F.least(F.length(w), F.length(v)) <= SHORT))


def _by_common_word(classes: DataFrame, uses: DataFrame, alike: DataFrame, most: int) -> DataFrame:
    """(field, a, b): names alike in a word of at least four letters that is in more than ``most`` names on one side.

    All words of the shorter name have a partner, so unless it has one word only, a second word agrees: with a word
    like it, or, if one of the two is short enough to be an initial or an abbreviation, in the first letter.
    """
    at = classes.select("field", F.col("rep").alias("r"), F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    long = at.where("length(w) >= 4")
    df, dv = uses.select("field", "w", "df"), uses.select("field", F.col("w").alias("v"), F.col("df").alias("dv"))
    hot = alike.where("length(w) >= 4 and length(v) >= 4").join(df, "w").join(dv, ["field", "v"]).where(F.greatest("df", "dv") > most).select("field", "w", "v")
    left = long.join(hot, ["field", "w"]).select("field", "r", "n", "i", "v")
    right = long.join(hot.select("field", F.col("v").alias("w")).distinct(), ["field", "w"]).select("field", "r", "i", F.col("w").alias("v"))
    initial, short = F.substring("w", 1, 1), F.length("w") <= SHORT
    key = lambda kind, c: F.concat(F.lit(kind), c)
    initials = lambda mine, others: at.select("field", "r", F.col("i").alias("j"), F.explode(F.when(short, F.array(key(mine, initial), key(others, initial))).otherwise(F.array(key(others, initial)))).alias("k"))
    own = at.select("field", "r", F.col("i").alias("j"), key("w", F.col("w")).alias("k")).unionByName(initials("r", "l"))
    wide = at.join(alike, "w").select("field", "r", F.col("i").alias("j"), key("w", F.col("v")).alias("k")).unionByName(initials("l", "r"))
    second = lambda side, keys, name: side.join(keys, ["field", "r"]).where("i != j").select("field", "v", "k", F.col("r").alias(name)).distinct()
    two = second(left.drop("n"), wide, "x").join(second(right, own, "y"), ["field", "v", "k"]).select("field", "x", "y")
    one = left.where("n = 1").select("field", "v", F.col("r").alias("x")).join(right.select("field", "v", F.col("r").alias("y")), ["field", "v"]).select("field", "x", "y")
    return two.unionByName(one).where("x != y").select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def star_clusters(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(field, rep, centre): each class with the centre of its star.

    In each round the undecided names that outrank all undecided neighbours become centres and their undecided
    neighbours satellites, as sequential star clustering would decide.  Rank: words written out, uses, spelling.
    A satellite of several centres goes to the most alike one.  Rounds go on until every name is decided.
    """
    full = F.size(F.filter("ws", lambda w: F.length(w) >= 4))
    rank = classes.select("field", "rep", F.struct(full.alias("full"), "uses", F.col("rep").alias("r")).alias("rank"))
    both = links.select("field", "a", "b", "likeness").unionByName(links.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    ra, rb = rank.select("field", F.col("rep").alias("a"), F.col("rank").alias("ra")), rank.select("field", F.col("rep").alias("b"), F.col("rank").alias("rb"))
    arcs = cut_lineage(both.join(ra, ["field", "a"]).join(rb, ["field", "b"]))
    open_ = arcs.select("field", "a").distinct()
    centres = arcs.select("field", "a").limit(0)
    live = arcs
    while True:  # each round decides at least the highest of the undecided names
        beaten = live.where("rb > ra").select("field", "a").distinct()
        won = cut_lineage(open_.join(beaten, ["field", "a"], "left_anti"))
        if won.isEmpty():
            break
        centres = centres.unionByName(won)
        taken = arcs.join(won, ["field", "a"]).select("field", F.col("b").alias("a")).unionByName(won).distinct()
        open_ = cut_lineage(open_.join(taken, ["field", "a"], "left_anti"))
        live = arcs.join(open_, ["field", "a"]).join(open_.select("field", F.col("a").alias("b")), ["field", "b"])
    centres = cut_lineage(centres)
    own = arcs.join(centres.select("field", F.col("a").alias("b")), ["field", "b"]).groupBy("field", "a").agg(F.max(F.struct("likeness", "rb")).alias("m")).select("field", F.col("a").alias("rep"), F.col("m.rb.r").alias("centre"))
    own = own.join(centres.select("field", F.col("a").alias("rep")), ["field", "rep"], "left_anti")
    return classes.select("field", "rep").join(own, ["field", "rep"], "left").select("field", "rep", F.coalesce("centre", "rep").alias("centre"))

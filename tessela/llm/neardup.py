"""Near-duplicate records by common selective words, and by deletion variants of segments where there are none.

A record is its set of distinct words.  Words that few records hold are selective: pairs that hold one in common meet in
an equality join on it.  All selective words of the other pairs differ, so these can differ in few of their frequent words
only: the frequent words are cut into segments, so few that one of them differs by at most one word, and the segments with
no word or one word left out meet in the same join.  Together this loses no pair.  Candidates are verified twice: by a
parity sketch, whose Hamming distance never exceeds the number of differing words and so loses nothing, and by the exact
share of common words.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.llm.blocks import pairs_within
from tessela.operators.components import connected_components
from tessela.session import cut_lineage

#: Pairs that meet on selective words, for each record: it decides from how many records on a word counts as frequent, at
#: least; where there are more records than SAMPLE, a higher frequency is taken if fewer pairs meet at it in all.
PAIRS = 400
#: Records, their words, and the words of the longest of them, from which the pairs that meet on segments are estimated.
SAMPLE, SAMPLE_WORDS, SAMPLE_LONGEST = 8_000, 2_000_000, 4_096
#: Frequent words, at most: they are sent to the executors.
MOST_FREQUENT = 1_000_000
#: Share of the records of a size that may need more segments than the others of this size are cut into.
UPPER = 0.1
#: Ratio of the numbers of segments of records that need more than others of their size.
STEP = 1.2
#: Keys of the records with more segments that are sent to the executors, at most, to spare the others' rows a shuffle.
MOST_KEYS = 2_000_000
LONGS = 3
SKETCH = [f"k{j}" for j in range(LONGS)]
#: Numbers of segments that records are cut into.
LEVELS = np.array(sorted({*range(1, 13), *(math.ceil(12 * 1.15**i) for i in range(100))}))

# Names that the letter of an option may have in JSON.
LETTER_NAMES = ("letter", "letra", "label", "id", "key", "opcao", "alternativa", "option")

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_SPACED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def option_texts(options_json: Column) -> Column:
    """The texts of an options array, whatever its objects call them; broken JSON has none."""
    parsed = F.from_json(options_json, "array<map<string,string>>")
    return F.array_join(F.transform(parsed, lambda m: F.array_join(F.map_values(F.map_filter(m, lambda k, v: ~F.lower(k).isin(*LETTER_NAMES) & v.isNotNull())), " ")), " ")


_hashes: dict[bytes, int] = {}


def _words(text: str) -> set[bytes]:
    """The distinct words in lower case without accents."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFD", low))
    if low.isascii():
        return set(low.encode().translate(_SPACED).split())
    return {w.encode() for w in _WORD.findall(unicodedata.normalize("NFC", low))}


def word_hashes(text: str) -> np.ndarray:
    """The hashes of the distinct words of a text, in order."""
    ws = _words(text)
    if len(_hashes) > 500_000:
        _hashes.clear()
    new = [w for w in ws if w not in _hashes]
    if new:
        _hashes.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    out = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    out.sort()
    return out


def _parity(hs: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x LONGS longs: the parity of the words of each record at each of their bits."""
    bits = LONGS * 64
    odd = np.bincount(doc * bits + ((hs >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def _read(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """(id, rep), or with ``whole`` (rep, d, n, sketch, hs); rows without a word are left out."""
    for big in batches:
        for at in range(0, len(big), 2048):
            b = big.slice(at, 2048)
            sets = [word_hashes(t or "") for t in b.column(1).to_pylist()]
            live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            sets = [sets[i] for i in live]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            rep = pa.array(marks, pa.binary())
            if not whole:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(live)), rep], ["id", "rep"])
                continue
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            sketch = _parity(flat, np.repeat(np.arange(len(sets)), n), len(sets))
            hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(flat.view(np.int64)))
            d = np.array([int.from_bytes(m[:8], "little", signed=True) for m in marks], np.int64)
            yield pa.RecordBatch.from_arrays([rep, pa.array(d), pa.array(n), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(LONGS)), hs], ["rep", "d", "n", *SKETCH, "hs"])


def word_classes(records: DataFrame, key: str, text: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rep, d, n, sketch, hs), one row for each distinct word set, and (id, rep), one row for each record.

    ``rep`` is a hash of the whole set (128 bits), d the first half of it, hs the hashes of the words.  Rows without a
    key or without any word are in no class.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.concat_ws(" ", *text).alias("t"))
    kind = dict(rows.dtypes)["id"]
    members = cut_lineage(rows.mapInArrow(functools.partial(_read, whole=False), f"id {kind}, rep binary").distinct())
    sets = rows.mapInArrow(functools.partial(_read, whole=True), "rep binary, d long, n long, " + ", ".join(f"{k} long" for k in SKETCH) + ", hs array<long>")
    return sets.dropDuplicates(["rep"]), members


class _Cut:
    """How records are cut: the frequent words, and the numbers of segments that records of a size meet on."""

    def __init__(self, frequent: np.ndarray, slack: float, similarity: float) -> None:
        order = np.argsort(frequent, kind="stable")  # frequent is ordered by frequency: a word's place is its rank there
        self.frequent, self.places = frequent[order], order
        self.slack, self.similarity = slack, similarity
        self.base: dict[int, int] = {}
        self.groups: list[tuple[int, int, int, float]] = []  # level, least n, greatest n, greatest e of the records of it

    def parts(self, b: pa.RecordBatch):
        """Words as (record, hash, place or -1), and for each record n and e: the frequent words that may differ."""
        hs = b.column("hs")
        n = b.column("n").to_numpy()
        doc = np.repeat(np.arange(len(b)), hs.value_lengths().to_numpy())
        h = hs.flatten().to_numpy()
        place = np.full(len(h), -1, np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            hit = self.frequent[at] == h
            place[hit] = self.places[at[hit]]
        kept = np.bincount(doc[place >= 0], minlength=len(b))
        return doc, h, place, n, n * self.slack + 1e-6 - (n - kept), kept

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(n) / -math.log(self.similarity) + 1e-9).astype(np.int64)

    def own(self, e: np.ndarray) -> np.ndarray:
        return LEVELS[np.minimum(np.searchsorted(LEVELS, e, side="right"), len(LEVELS) - 1)]

    def native(self, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The level of a record: the base of its size, or the first of few steps above it that is enough."""
        base = np.array([self.base.get(x, 1) for x in c.tolist()], np.float64)
        steps = np.ceil(np.log(np.maximum(own / base, 1)) / math.log(STEP) - 1e-9)
        return np.maximum(np.ceil(base * STEP**steps - 1e-9).astype(np.int64), own)


def _sizes(batches: Iterator[pa.RecordBatch], cut: _Cut) -> Iterator[pa.RecordBatch]:
    """(c, m, records, least, greatest, top): the records of a batch by size class and segments needed."""
    for b in batches:
        _, _, _, n, e, kept = cut.parts(b)
        n, e = n[kept > 0], e[kept > 0]
        c, m = cut.size_class(n), cut.own(e)
        both, of = np.unique(np.stack([c, m]), axis=1, return_inverse=True)
        of = of.ravel()
        rows = [(int(both[0, i]), int(both[1, i]), int((of == i).sum()), int(n[of == i].min()), int(n[of == i].max()), float(e[of == i].max())) for i in range(both.shape[1])]
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.float64())], ["c", "m", "records", "least", "greatest", "top"])


def _keys(batches: Iterator[pa.RecordBatch], cut: _Cut, native: bool, short: bool) -> Iterator[pa.RecordBatch]:
    """(v, short, d, n, sketch): a row for each key that a record meets others on.

    With ``native`` its selective words and its segments of its own level, else those of the higher levels that it can
    meet others of.  With ``short`` also the segments with one word left out.  A segment is known by the sum of its
    words, so that a word is left out by subtraction.
    """
    for big in batches:
        for start in range(0, len(big), 1024):
            b = big.slice(start, 1024)
            doc, h, place, n, e, kept = cut.parts(b)
            home = cut.native(cut.size_class(n), cut.own(e))
            rows, vs, shorts = [], [], []
            if native:
                rare = place < 0
                rows.append(doc[rare])
                vs.append(h[rare])
                shorts.append(np.zeros(int(rare.sum()), bool))
            for level in sorted({g[0] for g in cut.groups}):
                if native:
                    take = home == level
                else:
                    take = np.zeros(len(n), bool)
                    for m, least, greatest, top in cut.groups:
                        if m == level:
                            take |= (home < m) & (n >= least * cut.similarity - 1e-9) & (n * cut.similarity - 1e-9 <= greatest) & (e + top >= 0)
                take &= kept > 0
                if not take.any():
                    continue
                docs = np.flatnonzero(take)
                nth = np.full(len(n), -1, np.int64)
                nth[docs] = np.arange(len(docs))
                mine = (place >= 0) & take[doc]
                hd, at = h[mine].view(np.uint64), place[mine] % level
                slot = nth[doc[mine]] * level + at
                v = np.zeros(len(docs) * level, np.uint64)
                np.add.at(v, slot, hd)
                v += (np.tile(np.arange(level, dtype=np.uint64), len(docs)) + np.uint64(level << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                rows.append(np.repeat(docs, level))
                vs.append(v.view(np.int64))
                shorts.append(np.zeros(len(v), bool))
                if short:
                    # e + the others' e < e + level, so this many segments need no variants
                    spare = np.floor(level - e[doc[mine]]).astype(np.int64)
                    some = at >= spare
                    rows.append(doc[mine][some])
                    vs.append((v[slot[some]] - hd[some]).view(np.int64))
                    shorts.append(np.ones(int(some.sum()), bool))
            if not rows:
                continue
            row = np.concatenate(rows)
            cols = b.select(["d", "n", *SKETCH]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(vs), pa.int64()), pa.array(np.concatenate(shorts)), *cols.columns], ["v", "short", "d", "n", *SKETCH])


_KEYED = "v long, short boolean, d long, n long, " + ", ".join(f"{k} long" for k in SKETCH)


def _levels(cut: _Cut, sizes: list[dict]) -> None:
    """Sets how records are cut, from their numbers by size class and segments needed."""
    for c in {r["c"] for r in sizes}:
        own = sorted((r["m"], r["records"]) for r in sizes if abs(r["c"] - c) <= 1)  # those of sizes that can be alike
        rest = sum(x for _, x in own)
        limit = UPPER * rest
        for m, x in own:
            rest -= x
            if rest <= limit:
                cut.base[c] = m
                break
    merged: dict[tuple[int, int], tuple[int, int, float]] = {}
    for r in sizes:
        key = (r["c"], int(cut.native(np.array([r["c"]]), np.array([r["m"]]))[0]))
        least, greatest, top = merged.get(key, (r["least"], r["greatest"], r["top"]))
        merged[key] = (min(least, r["least"]), max(greatest, r["greatest"]), max(top, r["top"]))
    cut.groups = [(m, *x) for (_, m), x in sorted(merged.items())]


def _met(keys: np.ndarray, short: np.ndarray) -> float:
    """Pairs that meet on equal keys, one of each pair without a word left out."""
    _, of = np.unique(keys, return_inverse=True)
    whole, left = np.bincount(of, ~short), np.bincount(of, short)
    return float((whole * (whole - 1) / 2 + whole * left).sum())


def _segment_pairs(some: pa.RecordBatch, cut: _Cut) -> float:
    """Pairs of these records that meet on segments; it estimates cost and decides nothing else."""
    _levels(cut, [r for b in _sizes(iter([some]), cut) for r in b.to_pylist()])
    keyed = pa.Table.from_batches(list(_keys(iter([some]), cut, True, True))).select(["v", "short"])
    _, h, place, _, _, _ = cut.parts(some)
    rare = h[place < 0]
    return _met(keyed["v"].to_numpy(), keyed["short"].to_numpy()) - _met(rare, np.zeros(len(rare), bool))


def _cheapest(sets: DataFrame, common: pa.Table, steps: dict[int, tuple[float, int]], k: int, total: int, cut_at: Callable[[np.ndarray], _Cut]) -> int:
    """The frequency, as a power of two from ``k`` on, at which the fewest pairs meet on words and segments.

    Pairs on words are counted exactly; those on segments are estimated from records drawn by a hash.
    """
    words = sum(m * 2 / 2**j for j, (m, _) in steps.items())  # at most twice as many
    share = min(1.0, SAMPLE / max(total, 1), SAMPLE_WORDS / max(words, 1.0))
    if share == 1:
        return k
    drawn = sets.where((F.pmod(F.xxhash64("rep"), F.lit(2**30)) < int(share * 2**30)) & (F.col("n") <= SAMPLE_LONGEST)).drop("rep").toArrow().combine_chunks().to_batches()
    if not drawn:
        return k
    some, df = drawn[0], common["df"].to_numpy()
    h = common["h"].to_numpy()
    best, least = k, math.inf
    while k < 62:
        on_words = sum(m for j, (m, _) in steps.items() if 0 < j < k)
        if on_words >= least:
            break
        cost = on_words + _segment_pairs(some, cut_at(h[df >= 2**k])) / share**2
        if cost < least:
            best, least = k, cost
        if not (df >= 2**k).any():
            break
        k += 1
    return best


def _plan_cuts(sets: DataFrame, similarity: float, pairs: int) -> _Cut:
    """What is frequent and how records are cut, from counts over all records."""
    counts = cut_lineage(sets.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df")))
    steps = {r["k"]: (float(r["met"]), r["words"]) for r in counts.groupBy(F.floor(F.log2("df")).alias("k")).agg((F.sum(F.col("df").cast("double") * F.col("df")) / 2).alias("met"), F.count("*").alias("words")).collect()}
    total = sets.count()
    k = 1
    while k < 62 and (sum(m for j, (m, _) in steps.items() if 0 < j <= k) <= pairs * total or sum(w for j, (_, w) in steps.items() if j >= k) > MOST_FREQUENT):
        k += 1
    common = counts.where(F.col("df") >= 2**k).orderBy("df", "h").select("h", "df").toArrow()  # MOST_FREQUENT at most
    cut_at = lambda h: _Cut(h, (1 - similarity) / (1 + similarity), similarity)
    k = _cheapest(sets, common, steps, k, total, cut_at)
    cut = cut_at(common["h"].to_numpy()[common["df"].to_numpy() >= 2**k])
    found = sets.select("n", "hs").mapInArrow(functools.partial(_sizes, cut=cut), "c long, m long, records long, least long, greatest long, top double")
    sizes = found.groupBy("c", "m").agg(F.sum("records").alias("records"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("top").alias("top")).collect()  # a row a size class and level
    _levels(cut, sizes)
    return cut


def similar_classes(sets: DataFrame, similarity: float, pairs: int = PAIRS) -> DataFrame:
    """(a, b, similarity): pairs of classes with at least this share of common words; a < b."""
    cut = _plan_cuts(sets, similarity, pairs)
    keyed = lambda native, short: sets.drop("rep").mapInArrow(functools.partial(_keys, cut=cut, native=native, short=short), _KEYED)
    distance = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in SKETCH), F.lit(0))
    nx, ny = F.col("x.n"), F.col("y.n")
    near = (distance <= F.floor((nx + ny) * cut.slack + 1e-9)) & (F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-9)
    once = (F.col("x.d") != F.col("y.d")) & (F.col("y.short") | (F.col("x.d") < F.col("y.d")))
    whole, either = keyed(True, False).drop("short"), keyed(True, True)
    others = len({g[0] for g in cut.groups}) > 1
    if others:
        # Records of lower levels meet those of higher ones on the keys of these only.
        upper = cut_lineage(sets.drop("rep").mapInArrow(functools.partial(_upper_keys, cut=cut), _KEYED))
        known = upper.select("v").distinct()
        known = F.broadcast(known) if known.count() <= MOST_KEYS else known
        low_whole, low_either = (keyed(False, s).join(known, "v", "left_semi") for s in (False, True))
        met = whole.alias("x").join(either.unionByName(low_either).alias("y"), (F.col("x.v") == F.col("y.v")) & once & near).select(F.col("x.d").alias("p"), F.col("y.d").alias("q"))
        back = (F.col("x.v") == F.col("y.v")) & (F.col("x.d") != F.col("y.d")) & near
        met = met.unionByName(low_whole.drop("short").alias("x").join(upper.alias("y"), back).select(F.col("x.d").alias("p"), F.col("y.d").alias("q")))
    else:
        met = whole.alias("x").join(either.alias("y"), (F.col("x.v") == F.col("y.v")) & once & near).select(F.col("x.d").alias("p"), F.col("y.d").alias("q"))
    met = met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    side = lambda d, r, h: sets.select(F.col("d").alias(d), F.col("rep").alias(r), F.col("hs").alias(h))
    common = F.size(F.array_intersect("hp", "hq"))
    exact = met.join(side("p", "rp", "hp"), "p").join(side("q", "rq", "hq"), "q").withColumn("common", common)
    return exact.select(F.least("rp", "rq").alias("a"), F.greatest("rp", "rq").alias("b"), (F.col("common") / (F.size("hp") + F.size("hq") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= similarity)


def _upper_keys(batches: Iterator[pa.RecordBatch], cut: _Cut) -> Iterator[pa.RecordBatch]:
    """The keys of the records above the lowest level, which are few where the sizes are alike."""
    for b in batches:
        _, _, _, n, e, _ = cut.parts(b)
        above = cut.native(cut.size_class(n), cut.own(e)) > min(g[0] for g in cut.groups)
        yield from _keys(iter([b.filter(pa.array(above))]), cut, True, True)


def duplicate_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): the pairs of classes, and the copies within each class, written out by record."""
    across = pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    within = pairs_within(members, ["rep"], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return across.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).unionByName(within)


def duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, links): one row for each record; the group is named by its least id, links counts the similar
    classes of its class.
    """
    found = connected_components(pairs, "a", "b").select(F.col("node").alias("rep"), F.col("component"))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    placed = members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = placed.groupBy("component").agg(F.min("id").alias("group_id"))
    return placed.join(names, "component").join(links, "rep", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))

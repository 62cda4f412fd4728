"""Text operators that need order within a text: chunks, common runs, adjacent groups, coverage units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def chunks_of(text: str | None, tokens: int = 500, overlap: int = 50) -> list[str]:
    """Paragraphs packed into chunks of ``tokens`` x 4 characters.

    A full chunk is closed and the next starts with its tail; a paragraph that is too long for an empty chunk is cut at
    sentences, without overlap, one that meets a filled chunk is kept whole.
    """
    limit, tail = 4 * tokens, 4 * overlap
    out: list[str] = []
    now = ""
    for par in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
        if not par:
            continue
        if len(now) + 2 + len(par) <= limit:
            now = f"{now}\n\n{par}" if now else par
        elif now:
            out.append(now)
            now = f"{now[-tail:] if tail else ''}\n\n{par}"
        else:
            for s in _SENTENCE.split(par):
                if len(now) + 1 + len(s) <= limit:
                    now = f"{now} {s}" if now else s
                else:
                    if now:
                        out.append(now)
                    now = s
    return [*out, now] if now else out


def _flat(df: DataFrame, keys: list[str], text: str, fn, kinds: str, names: list[str]) -> DataFrame:
    """Rows that fn makes of each text, numbered from 0 as ``pos``."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "pos int", kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 128):
                b = whole.slice(start, 128)
                rows, pos, cols = [], [], [[] for _ in names]
                for i, t in enumerate(b.column(len(keys)).to_pylist()):
                    for k, made in enumerate(fn(t)):
                        rows.append(i)
                        pos.append(k)
                        for c, v in zip(cols, made if isinstance(made, tuple) else (made,)):
                            c.append(v)
                take = pa.array(rows, pa.int64())
                arrays = [b.column(i).take(take) for i in range(len(keys))] + [pa.array(pos, pa.int32())] + [pa.array(c, pa.string() if not c or isinstance(c[0], str) or c[0] is None else pa.int32()) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "pos", *names])

    return df.select(*keys, text).mapInArrow(run, schema)


def chunk_texts(df: DataFrame, keys: list[str], text: str, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """(*keys, pos, chunk); null and blank texts have none."""
    return _flat(df, keys, text, lambda t: chunks_of(t, tokens, overlap), "chunk string", ["chunk"])


def longest_common_run(a: list[str], b: list[str]) -> tuple[int, str]:
    """The longest run of words that both have, the first one in a.

    A common run of n words holds one of n - 1, so the length is found by halving; runs of a length are compared as sets.
    """
    runs = lambda ws, n: list(zip(*(ws[i:] for i in range(n))))
    low, high, at = 0, min(len(a), len(b)), 0
    while low < high:
        n = (low + high + 1) // 2
        known = set(runs(b, n))
        found = next((i for i, r in enumerate(runs(a, n)) if r in known), None)
        if found is None:
            high = n - 1
        else:
            low, at = n, found
    return low, " ".join(a[at : at + low])


def overlap_words(t: str | None) -> list[str]:
    plain = "".join(ch for ch in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(ch))
    return [w for w in re.sub(r"[^\w\s]", " ", plain).split() if len(w) > 1]


def common_runs(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(*keys, length, run): the longest common run of words of two texts in each row."""
    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "length int, run string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_common_run(overlap_words(x), overlap_words(y)) for x, y in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], [*keys, "length", "run"])

    return pairs.select(*keys, a, b).mapInArrow(run, schema)


_NUMBERED = re.compile(r"^\s*\d+[.)]\s+\S")
_MARKDOWN = re.compile(r"^\s*#{1,6}\s+\S")
_CAPS = re.compile(r"^\s*(?:[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-ZÁÀÂÃÉÊÍÓÔÕÚÇ\s\d-]{4,80}|[^.!?\n]{3,80}:)\s*$")
_BULLET = re.compile(r"^\s*[-*•]\s+\S")


def coverage_units(text: str | None) -> list[tuple[str, str, int]]:
    """(kind, unit, words): the parts of a text by the first kind of mark that occurs at least twice, else its paragraphs.

    The kinds are tried in the order numbered, markdown, caps, bullet.  Text below 50 characters is one unit; what stands
    before the first mark belongs to none but is kept as a unit of its own where it is long enough to matter (50 characters).
    """
    t = (text or "").strip()
    if not t:
        return []
    if len(t) < 50:
        return [("single", t, len(t.split()))]
    lines = t.split("\n")
    for kind, mark in (("numbered", _NUMBERED), ("markdown", _MARKDOWN), ("caps", _CAPS), ("bullet", _BULLET)):
        at = [i for i, ln in enumerate(lines) if mark.match(ln)]
        if len(at) >= 2:
            cuts = [*at, len(lines)]
            parts = ["\n".join(lines[a:b]).strip() for a, b in zip(cuts, cuts[1:])]
            lead = "\n".join(lines[: at[0]]).strip()
            return [(kind, p, len(p.split())) for p in ([lead] if len(lead) >= 50 else []) + parts if p]
    return [("paragraph", p.strip(), len(p.split())) for p in re.split(r"\n\s*\n", t) if p.strip()]


def balance_units(units: list[tuple[str, str, int]], most: int = 150, target: int = 120, least: int = 30) -> list[tuple[str, str, int]]:
    """Units over ``most`` words are cut at sentences into about ``target``; a rest below ``least`` joins the unit before."""
    out: list[tuple[str, str, int]] = []
    for kind, text, n in units:
        if n <= most:
            out.append((kind, text, n))
            continue
        now: list[str] = []
        parts: list[list[str]] = []
        for s in _SENTENCE.split(text):
            if now and sum(len(x.split()) for x in now) + len(s.split()) > target:
                parts.append(now)
                now = []
            now.append(s)
        if now:
            if parts and sum(len(x.split()) for x in now) < least:
                parts[-1] += now
            else:
                parts.append(now)
        out += [(kind, " ".join(p), sum(len(x.split()) for x in p)) for p in parts]
    return out


def coverage(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, pos, kind, unit, words): balanced coverage units."""
    return _flat(df, keys, text, lambda t: balance_units(coverage_units(t)), "kind string, unit string, words int", ["kind", "unit", "words"])


def assign_quota(units: DataFrame, group: str, order: str, size: str, total: int) -> DataFrame:
    """Adds ``quota`` to units: ``total`` spread evenly, extras to the largest; with fewer than units, evenly spaced ones get 1."""
    w = Window.partitionBy(group)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    big = F.row_number().over(w.orderBy(F.desc(size), order))
    few = (F.floor((i + 1) * total / n) > F.floor(i * total / n)).cast("bigint")
    many = (F.floor(F.lit(total) / n) + F.when(big <= F.lit(total) % n, 1).otherwise(0)).cast("bigint")
    return units.withColumn("quota", F.when(n > total, few).otherwise(many))


def adjacent_groups(df: DataFrame, group: str, order: str, key: str, vector: str, text: str, similarity: float = 0.75, most: int = 800) -> DataFrame:
    """(key, group_no): neighbours in order join the group before if they are similar to its first member and it is below ``most`` characters.

    Sequential within a group by nature; a group is the parts of one text.
    """
    types = dict(df.dtypes)

    def fold_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key])
        no, first, size, out = -1, None, 0, []
        for vec, n in zip(pdf[vector], pdf["n"]):
            v = np.asarray(vec, dtype=float)
            scale = np.linalg.norm(v) * (np.linalg.norm(first) if first is not None else 0)
            near = scale > 0 and float(v @ first) / scale >= similarity
            if not near or size >= most:
                no, first, size = no + 1, v, 0
            size += n
            out.append(no)
        return pd.DataFrame({key: pdf[key], "group_no": out})

    slim = df.select(group, order, key, vector, F.length(text).alias("n"))
    return slim.groupBy(group).applyInPandas(fold_, f"`{key}` {types[key]}, group_no int")

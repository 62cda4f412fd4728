"""Splitting oversized texts at natural boundaries.

Each place between two characters has a boundary strength.  A sparse table over the strengths answers, in
constant time, which is the strongest place of a window, the rightmost of equals; cuts are taken greedily in
the window of permissible lengths, and the next piece begins at a boundary about ``overlap`` before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitParams:
    """limit: characters of a piece at most.  least: of a piece but the last, at least.  overlap, slack: characters
    repeated from the piece before, give or take slack."""

    limit: int = 2_000
    least: int = 1_000
    overlap: int = 200
    slack: int = 40

    def __post_init__(self) -> None:
        if not 0 <= self.overlap or self.slack < 0 or not self.overlap + self.slack < self.least <= self.limit:
            raise ValueError("a piece must be longer than what it repeats, and not longer than the limit")


# Boundary strengths.
NEVER, ANY, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_PAUSES = np.zeros(0x3000, dtype=np.uint8)
_PAUSES[[ord(c) for c in ",;:)–—"]] = CLAUSE
_PAUSES[[ord(c) for c in ".!?…"]] = SENTENCE
_BLANK = np.zeros(0x3001, dtype=bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True
_MARK = np.zeros(0x3000, dtype=bool)
_MARK[0x300:0x370] = True
_MARK[[0x200C, 0x200D]] = True


def strengths(text: str) -> np.ndarray:
    """For each i from 0 to len(text): how well the text can be cut before its i-th character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    s = np.full(n + 1, ANY, dtype=np.uint8)
    if not n:
        return s
    low = np.minimum(c, 0x2FFF)
    blank = _BLANK[np.minimum(c, 0x3000)]
    newline = c == 10
    # the strength behind a run of blanks is that of what the run holds and of the mark before it
    ends = np.flatnonzero(blank & ~np.append(blank[1:], False))
    starts = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
    lines = np.add.reduceat(newline, np.column_stack([starts, ends + 1]).ravel().clip(max=n - 1))[::2] if len(starts) else np.array([], int)
    if len(starts) and ends[-1] + 1 >= n:  # reduceat can't take an end behind the array
        lines[-1] = newline[starts[-1] :].sum()
    before = np.where(starts > 0, _PAUSES[low[np.maximum(starts - 1, 0)]], 0)
    s[ends + 1] = np.maximum(np.maximum(before, SPACE), np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, LINE, 0)))
    inside = blank[:-1] & blank[1:]
    s[1:n][inside] = NEVER
    s[1:n][_MARK[low[1:]] | ((c[1:] >= 0xFE00) & (c[1:] <= 0xFE0F)) | ((c[1:] >= 0x1F3FB) & (c[1:] <= 0x1F3FF))] = NEVER
    s[1:n][(c[:-1] == 13) & (c[1:] == 10)] = NEVER
    return s


class RangeMaximum:
    """A sparse table: the strongest place of any window in constant time, the rightmost of equals."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        base = (values.astype(np.int64) << 40) | np.arange(len(values), dtype=np.int64)
        self.levels = [base]
        width = 1
        while 2 * width <= min(widest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, first: int, last: int) -> int:
        """The place of the maximum in first..last, both included."""
        k = (last - first + 1).bit_length() - 1
        k = min(k, len(self.levels) - 1)
        level = self.levels[k]
        return int(max(level[first], level[last - (1 << k) + 1])) & ((1 << 40) - 1)


def spans(text: str, p: SplitParams = SplitParams()) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece if it isn't over the limit, none if it is empty."""
    n = len(text)
    if n <= p.limit:
        return [(0, n)] if n else []
    s = strengths(text)
    table = RangeMaximum(s, p.limit - p.least + 1)
    out, start = [], 0
    while n - start > p.limit:
        end = table.best(start + p.least, start + p.limit)
        out.append((start, end))
        start = table.best(end - p.overlap - p.slack, end - p.overlap + p.slack) if p.overlap else end
    return [*out, (start, n)]


def _cut(df: DataFrame, keys: list[str], text: str, p: SplitParams, whole_too: bool) -> DataFrame:
    """(*keys, piece_no, piece_start, piece_end) and, with ``whole_too``, the piece itself, made where the text is read."""
    long = df.where(F.length(text) > p.limit).select(*keys, F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    names = [*keys, "piece_no", "piece_start", "piece_end", *(["piece"] if whole_too else [])]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "piece_no int, piece_start int, piece_end int", *(["piece string"] if whole_too else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                b = whole.slice(at, 64)
                texts = b.column(len(keys)).to_pylist()
                found = [spans(t, p) for t in texts]
                rows = np.repeat(np.arange(len(b)), [len(x) for x in found])
                flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
                no = np.concatenate([np.arange(1, len(f) + 1, dtype=np.int32) for f in found]) if found else np.zeros(0, np.int32)
                cols = [*(b.column(i).take(pa.array(rows)) for i in range(len(keys))), pa.array(no), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
                if whole_too:
                    cols.append(pa.array([t[x:y] for t, f in zip(texts, found) for x, y in f], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return long.mapInArrow(cut, schema)


def split_spans(df: DataFrame, keys: list[str], text: str, p: SplitParams = SplitParams()) -> DataFrame:
    """(*keys, piece_no, piece_start, piece_end), counted from 1 and 0: the pieces of the texts over the limit.

    Null and short texts have no rows.  Whole texts are processed, and only those over the limit leave the JVM.
    """
    return _cut(df, keys, text, p, False)


def pieces(df: DataFrame, keys: list[str], text: str, p: SplitParams = SplitParams()) -> DataFrame:
    """The spans with the text of each piece; texts within the limit come whole as piece 1, null and empty ones not."""
    body = df.select(*keys, F.col(text).alias("text"))
    short = body.where((F.length("text") <= p.limit) & (F.col("text") != "")).select(*keys, F.lit(1).alias("piece_no"), F.lit(0).alias("piece_start"), F.length("text").alias("piece_end"), F.col("text").alias("piece"))
    return _cut(df, keys, text, p, True).unionByName(short).dropDuplicates([*keys, "piece_no"])

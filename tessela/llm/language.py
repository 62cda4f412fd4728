"""The language of texts and of their segments, by a byte convolutional network.

Filters of several widths run over the embedded bytes of fixed-length windows; the maxima over each window
go into a softmax.  The network is trained here, in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions.text import fold

LANGUAGES = ("pt", "es", "en", "fr", "it")
# How labels name the languages (folded), beside a code with a region.
LABELS = {
    "pt": ("pt", "por", "portugues", "portuguese", "portugais", "portoghese"),
    "es": ("es", "spa", "esp", "espanol", "spanish", "espanhol", "castellano", "espagnol", "spagnolo"),
    "en": ("en", "eng", "english", "ingles", "anglais", "inglese"),
    "fr": ("fr", "fra", "fre", "francais", "french", "frances", "francese"),
    "it": ("it", "ita", "italiano", "italian", "italien"),
}


def label_code(c: Column) -> Column:
    """The language that a label names by code, code with region or name; null if none of ours."""
    name = F.regexp_extract(fold(c), r"^\s*([a-z]+)", 1)
    pairs = [F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)]
    return F.create_map(*pairs)[name]


@dataclass(frozen=True)
class NetParams:
    """window: bytes that the network sees at once.  widths, filters: convolution widths, and filters of each.
    sample: labelled rows that it is trained on, at most; windows: of each of them, at most.
    steps: batches of 64 windows of the first round; further rounds have half as many.
    relabel: confidence from which a window takes the language read, before each further round."""

    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 16
    embedding: int = 6
    sample: int = 5_000
    windows: int = 4
    steps: int = 512
    relabel: tuple[float, ...] = (0.5, 0.5, 0.5)
    rate: float = 0.004
    seed: int = 5
    languages: tuple[str, ...] = field(default=LANGUAGES)


class ByteNet:
    """Embedding, convolutions, max pooling over the window, softmax."""

    def __init__(self, p: NetParams = NetParams()) -> None:
        self.p = p
        rng = np.random.default_rng(p.seed)
        self.wide = max(p.widths)
        n = len(p.widths) * p.filters
        self.emb = rng.normal(0, 0.3, (256, p.embedding)).astype(np.float32)
        self.emb[0] = 0
        self.mask = np.zeros((self.wide * p.embedding, n), dtype=np.float32)
        for i, w in enumerate(p.widths):
            self.mask[: w * p.embedding, i * p.filters : (i + 1) * p.filters] = 1
        self.w = (rng.normal(0, 0.2, self.mask.shape) * self.mask).astype(np.float32)
        self.b = np.zeros(n, dtype=np.float32)
        self.u = rng.normal(0, 0.1, (n, len(p.languages))).astype(np.float32)
        self.c = np.zeros(len(p.languages), dtype=np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        at = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), self.wide * self.p.embedding, axis=1)
        return np.ascontiguousarray(at[:, :: self.p.embedding])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: windows of bytes, zero-filled; a row of logits for each.

        Windows of like length go together, cut behind the first place that sees zeros only: all later ones see the same.
        """
        out = np.empty((len(x), len(self.c)), dtype=np.float32)
        ends = x.shape[1] - (x[:, ::-1] != 0).argmax(axis=1)
        ends[~x.any(axis=1)] = 0
        order = np.argsort(ends, kind="stable")
        for s in range(0, len(x), 512):
            rows = order[s : s + 512]
            patches = self._patches(x[rows, : min(x.shape[1], int(ends[rows[-1]]) + self.wide)])
            b, t, k = patches.shape
            h = (patches.reshape(-1, k) @ self.w).reshape(b, t, -1).max(axis=1) + self.b
            out[rows] = np.maximum(h, 0) @ self.u + self.c
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rng: np.random.Generator, even: bool = False) -> None:
        """Adam on the cross entropy, in drawn batches; ``even`` draws all labels alike often."""
        names = ("emb", "w", "b", "u", "c")
        if not hasattr(self, "moments"):
            self.moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
            self.steps = 0
        odds = 1 / np.bincount(y, minlength=len(self.c)).clip(1)[y] if even else np.ones(len(y))
        odds = odds / odds.sum()
        for _ in range(max(1, steps // 64)):
            order = rng.choice(len(x), (64, 64), p=odds)
            for take in order:
                xb, yb = x[take], y[take]
                patches = self._patches(xb)
                b, t, k = patches.shape
                conv = (patches.reshape(-1, k) @ self.w).reshape(b, t, -1)
                at = conv.argmax(axis=1)
                h = np.take_along_axis(conv, at[:, None], 1)[:, 0] + self.b
                a = np.maximum(h, 0)
                z = a @ self.u + self.c
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(b), yb] -= 1
                q /= b
                gh = (q @ self.u.T) * (h > 0)
                best = patches[np.arange(b)[:, None], at]  # b, filters, k
                gw = np.einsum("bf,bfk->kf", gh, best) * self.mask
                ge = np.zeros_like(self.emb)
                flow = (gh[:, :, None] * self.w.T[None]).reshape(b, -1, self.wide, self.p.embedding)
                where = xb[np.arange(b)[:, None, None], at[:, :, None] + np.arange(self.wide)]
                np.add.at(ge, where.ravel(), flow.reshape(-1, self.p.embedding))
                ge[0] = 0
                self.steps += 1
                for n, g in zip(names, (ge, gw, gh.sum(0), a.T @ q, q.sum(0))):
                    m, v = self.moments[n]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    step = self.p.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)
                    getattr(self, n).__isub__(step.astype(np.float32))

    def frozen(self) -> ByteNet:
        """Without the state of training."""
        self.__dict__.pop("moments", None)
        return self


def windows_of(raw: bytes, size: int) -> np.ndarray:
    """The bytes in rows of ``size``, the last one filled with zeros."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, size)


def bytes_of(text: str) -> bytes:
    return text.lower().replace("\x00", " ").encode("utf-8", "replace")


def plain(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def fit(texts: list[str], labels: list[str], p: NetParams = NetParams()) -> ByteNet:
    """Trains on the lines of labelled texts.  Labels may be wrong at times: after a first pass, a window that the
    network confidently reads as another language takes that language."""
    rng = np.random.default_rng(p.seed)
    xs, ys = [], []
    code = {c: i for i, c in enumerate(p.languages)}
    for text, label in zip(texts, labels):
        parts = []
        for line in (text or "").split("\n"):
            if line.strip():
                raw = bytes_of(plain(line) if rng.random() < 0.25 else line)
                parts += [w for w in windows_of(raw, p.window) if (w > 0).sum() >= 40 or len(raw) < 40]
        for i in rng.permutation(len(parts))[: p.windows]:
            w = parts[i].copy()
            if rng.random() < 0.2:  # short pieces occur too
                w[rng.integers(24, p.window) :] = 0
            xs.append(w)
            ys.append(code[label])
    net = ByteNet(p)
    if not xs:
        return net.frozen()
    x, y = np.stack(xs), np.array(ys)
    net.train(x, y, p.steps, rng)
    for sure in p.relabel:
        z = net.logits(x)
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        y = np.where(q.max(1) > sure, q.argmax(1), y)
        net.train(x, y, p.steps // 2, rng, even=True)
    return net.frozen()


def train_on(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", p: NetParams = NetParams()) -> ByteNet:
    """Fits the network on at most ``p.sample`` labelled rows, drawn by a hash of the key.

    They are drawn as they come, not evenly by label: so the wrong labels of a rare language don't outweigh the
    right ones of a common language.
    """
    named = df.select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label)).alias("code")).where("code is not null and t is not null")
    total = named.count()
    if not total:
        return ByteNet(p).frozen()
    place = F.pmod(F.xxhash64(F.lit(p.seed), "k"), F.lit(1_000_000_000))
    drawn = named.where(place <= int(min(1.0, 1.2 * p.sample / total) * 1_000_000_000)).select("t", "code", place.alias("h"))
    drawn = drawn.toPandas().sort_values(["h", "t"]).head(p.sample)
    return fit(list(drawn["t"]), list(drawn["code"]), p)


def segments(df: DataFrame, net: ByteNet, key: str, text: str) -> DataFrame:
    """(*columns but text, segs): for each row the languages of its segments, array of (seg_no, lang, confidence, n).

    A segment is a line that is not blank; n is its bytes.  Null and blank texts have an empty array.  Whole texts
    are read, window by window; logits are averaged over the windows of a segment.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in df.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "segs array<struct<seg_no:bigint,lang:string,confidence:double,n:int>>"])
    ordered = df.select(*rest, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_ = shared.value
        size, langs = net_.p.window, np.array(net_.p.languages, dtype=object)
        for whole in batches:
            for start in range(0, len(whole), 256):
                b = whole.slice(start, 256)
                raws, of = [], []
                for i, t in enumerate(b.column(len(rest)).to_pylist()):
                    lines = [bytes_of(ln) for ln in (t or "").split("\n") if ln.strip()]
                    raws += lines
                    of.append(len(lines))
                if raws:
                    each = [windows_of(r, size) for r in raws]
                    first = np.cumsum([0] + [len(w) for w in each])
                    x = np.concatenate(each)
                    weight = (x > 0).sum(1, keepdims=True) + 1e-3
                    z = np.add.reduceat(net_.logits(x) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                    q = np.exp(z - z.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                    lang, conf = langs[q.argmax(1)], q.max(1).astype(float)
                else:
                    lang, conf = np.zeros(0, object), np.zeros(0)
                no = np.concatenate([np.arange(1, n + 1) for n in of]) if of else np.zeros(0, int)
                rows = pa.StructArray.from_arrays([pa.array(no, pa.int64()), pa.array(lang, pa.string()), pa.array(conf), pa.array([len(r) for r in raws], pa.int32())], ["seg_no", "lang", "confidence", "n"])
                segs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *of]), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), segs], [*rest, "segs"])

    return ordered.mapInArrow(read, schema)


def main_language(segs: Column) -> Column:
    """The language with the most bytes; of equals the first by code; null without segments."""
    langs = F.array_distinct(F.transform(segs, lambda s: s["lang"]))
    total = lambda lang: F.aggregate(F.filter(segs, lambda s: s["lang"] == lang), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return F.array_min(F.transform(langs, lambda x: F.struct((-total(x)).alias("n"), x.alias("x"))))["x"]


def accuracy(net: ByteNet, texts: list[str], labels: list[str]) -> float:
    """Share of texts read as their label."""
    hits = []
    for t, label in zip(texts, labels):
        x = windows_of(bytes_of(t), net.p.window)
        hits.append(net.p.languages[int(net.logits(x).mean(0).argmax())] == label)
    return float(pd.Series(hits).mean())

"""The k most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample and split until their lists are balanced; a vector near a boundary
is put on several lists.  The centroids are searched by an in-memory neighbour graph, and a query visits the
lists whose centroids are hardly farther than the nearest.  Within a list all pairs are scored block by block
with one matrix product, and only the best k of each query leave the block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.functions.text import key_of
from tessela.session import cut_lineage


@dataclass(frozen=True)
class ListParams:
    """What the index is built with.

    sample: vectors that the centroids are fitted on, at most (about; chosen by a hash of the id).
    list_size: vectors that a list should hold; most_lists bounds what is sent to executors (4 bytes x dimension each).
    copies, copy_ratio: lists that a vector is put on, and how much farther than the nearest they may be.
    probes, probe_ratio: the same for a query, but 1.5 x the square root of the number of lists if that is more; a query that then has fewer than k neighbours visits four times as many
    lists, again and again, in the end all.
    posting_block, query_block: rows of one matrix product; larger lists are cut into blocks.
    """

    dimension: int = 384
    sample: int = 20_000
    list_size: int = 2_048
    most_lists: int = 16_384
    copies: int = 2
    copy_ratio: float = 1.06
    probes: int = 6
    probe_ratio: float = 1.2
    posting_block: int = 8_192
    query_block: int = 16_384
    seed: int = 7


class CentroidGraph:
    """Unit centroids with links to their nearest neighbours, searched by a beam for a batch of queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, entries: int = 16) -> None:
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        n = len(self.c)
        degree = min(degree, max(1, n - 1))
        links = np.zeros((n, degree), dtype=np.int32)
        for b in range(0, n, 1024):
            s = self.c[b : b + 1024] @ self.c.T
            s[np.arange(len(s)), np.arange(b, b + len(s))] = -9
            top = np.argpartition(-s, degree - 1, axis=1)[:, :degree] if n > 1 else np.zeros((len(s), degree), int)
            links[b : b + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        rng = np.random.default_rng(n)
        far = rng.integers(0, n, (n, 4), dtype=np.int32)  # long links keep the graph connected
        self.links = np.hstack([links, far])
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int32))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``width`` nearest centroids found: (ids, similarities), best first; -1 fills up."""
        n, width = len(self.c), min(width, len(self.c))
        beam = max(width, min(n, 12))
        rows = np.arange(len(x))
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.full((len(x), beam + len(self.entries)), -1, dtype=np.int32)
        sims = np.full(ids.shape, -9, dtype=np.float32)
        ids[:, : len(self.entries)], sims[:, : len(self.entries)] = self.entries, x @ self.c[self.entries].T
        done = ids < 0
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(v, order, 1) for v in (ids, sims, done))
        live = rows
        while len(live):
            at = np.argmax(~done[live], axis=1)
            open_ = ~done[live, at] & (ids[live, at] >= 0)
            live, at = live[open_], at[open_]
            if not len(live):
                break
            done[live, at] = True
            near = self.links[ids[live, at]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            s = np.einsum("bd,bmd->bm", x[live], self.c[near], optimize=True)
            s[~fresh] = -9
            for a in range(1, near.shape[1]):  # a centroid linked twice counts once
                s[:, a][(near[:, a : a + 1] == near[:, :a]).any(axis=1)] = -9
            alls = np.hstack([sims[live], s])
            top = np.argsort(-alls, axis=1, kind="stable")[:, :beam]
            pick = lambda u, v: np.take_along_axis(np.hstack([u, v]), top, 1)
            ids[live], done[live] = pick(ids[live], np.where(s > -9, near, -1)), pick(done[live], s <= -9)
            sims[live] = np.take_along_axis(alls, top, 1)
        return ids[:, :width], sims[:, :width]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centroids(x: np.ndarray, lists: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Unit centroids of balanced lists: spherical k-means, then the fullest lists are split in two."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))

    def assign(c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[b : b + 4096] @ c.T, axis=1) for b in range(0, len(x), 4096)])

    def means(own: np.ndarray, k: int, old: np.ndarray) -> np.ndarray:
        total = np.zeros((k, x.shape[1]), dtype=np.float32)
        np.add.at(total, own, x)
        return _unit(np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-9, total, old))

    c = _unit(x[rng.choice(len(x), lists, replace=False)])
    for _ in range(rounds):
        c = means(assign(c), len(c), c)
    for _ in range(3):
        own = assign(c)
        size = np.bincount(own, minlength=len(c))
        full = np.flatnonzero(size > 2.5 * len(x) / len(c))
        if not len(full):
            break
        halves = []
        for j in full:
            part = x[own == j]
            pair = part[rng.choice(len(part), 2, replace=False)]
            for _ in range(4):
                side = np.argmax(part @ pair.T, axis=1)
                if side.all() or not side.any():
                    break
                pair = _unit(np.stack([part[side == s].sum(0) for s in (0, 1)]))
            halves.append(pair)
        c = np.concatenate([np.delete(c, full, axis=0), *halves])
        c = means(assign(c), len(c), c)
    return c


def _vectors(col: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)


def usable(df: DataFrame, key: str, group: str, vector: str, dimension: int) -> DataFrame:
    """(id, grp, vector): vectors of the right length that are not all zero and hold no null or NaN; a row without a group is its own."""
    good = (F.size(vector) == dimension) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.where(good).where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(F.coalesce(key_of(F.col(group)), F.concat(F.lit("\x00"), F.col(key)))).alias("grp"), F.col(vector).alias("vector"))


def nearest(df: DataFrame, k: int, p: ListParams = ListParams()) -> DataFrame:
    """(id, other, similarity): for each vector of ``usable`` the k most similar of other groups that the index finds.

    Repeated rows count once.  Fewer than k come out where there are fewer; no vectors give no rows.  Of equal
    similarities the smaller id holds.
    """
    spark = df.sparkSession
    total = df.count()
    schema = "id string, other string, similarity float"
    if not total:
        return spark.createDataFrame([], schema)
    part = max(1, total // p.sample)
    drawn = df.where(F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(part)) == 0) if part > 1 else df
    x = _unit(_vectors(drawn.select("vector").toArrow().column(0), p.dimension))
    if not len(x):
        x = _unit(_vectors(df.limit(1).select("vector").toArrow().column(0), p.dimension))
    centroids = fit_centroids(x, max(1, min(p.most_lists, total // p.list_size)), p.seed)
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))
    probes = max(p.probes, int(1.5 * np.sqrt(len(centroids))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                b = whole.slice(start, 1024)
                v = _unit(_vectors(b.column(2), p.dimension))
                ids, sims = graph.value.search(v, max(p.copies, probes))
                far = np.sqrt(np.maximum(2 - 2 * sims, 1e-9))
                lists = []
                for most, ratio in ((p.copies, p.copy_ratio), (probes, p.probe_ratio)):
                    keep = (far[:, :most] <= ratio * far[:, :1]) & (ids[:, :most] >= 0)
                    lists.append(_lists(ids[:, :most], keep))
                half = v.astype(np.float16)
                raw = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((np.arange(len(v) + 1, dtype=np.int32) * (2 * p.dimension)).tobytes()), pa.py_buffer(half.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, *lists], ["id", "grp", "half", "posts", "visits"])

    placed = cut_lineage(df.mapInArrow(place, _PLACED))
    best = cut_lineage(_search(placed, placed, k, p))
    wider = probes
    while wider < len(centroids):
        done = best.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("id")
        short = cut_lineage(placed.join(done, "id", "left_anti"))
        if short.isEmpty():
            break
        wider = min(4 * wider, len(centroids))
        wide = short.mapInArrow(functools.partial(_wider, graph=graph, probes=wider, dimension=p.dimension), _PLACED)
        best = cut_lineage(best.join(short.select("id"), "id", "left_anti").unionByName(_search(placed, wide, k, p)))
    return best


_PLACED = "id string, grp long, half binary, posts array<int>, visits array<int>"


def _lists(ids: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], keep.sum(1).cumsum()]), pa.int32()), pa.array(ids[keep], pa.int32()))


def _wider(batches: Iterator[pa.RecordBatch], graph, probes: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """Placed vectors, with the nearest ``probes`` lists to visit."""
    c = graph.value.c
    for whole in batches:
        for start in range(0, len(whole), 256):
            b = whole.slice(start, 256)
            v = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.float16).reshape(-1, dimension).astype(np.float32)
            s = v @ c.T
            near = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(v), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(near, np.ones(near.shape, bool))], b.schema.names)


def _search(placed: DataFrame, asking: DataFrame, k: int, p: ListParams) -> DataFrame:
    """(id, other, similarity): the best k of the lists that each row of ``asking`` visits."""
    sizes = placed.select(F.explode("posts").alias("l"), F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(asking.select(F.explode("visits").alias("l"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    cuts = sizes.groupBy("l").agg(F.ceil(F.sum("p") / p.posting_block).cast("int").alias("pb"), F.ceil(F.sum("q") / p.query_block).cast("int").alias("qb")).where("pb > 0 and qb > 0")
    cuts = F.broadcast(cuts)  # a row per list, at most most_lists and their splits
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posts = placed.select("id", "grp", "half", F.explode("posts").alias("l")).join(cuts, "l").withColumn("x", own("pb")).withColumn("y", every("qb")).withColumn("asks", F.lit(False))
    asks = asking.select("id", "grp", "half", F.explode("visits").alias("l")).join(cuts, "l").withColumn("y", own("qb")).withColumn("x", every("pb")).withColumn("asks", F.lit(True))
    units = posts.unionByName(asks).select("l", "x", "y", "id", "grp", "half", "asks")

    def score(t: pa.Table) -> pa.Table:
        mat = np.frombuffer(b"".join(t.column("half").to_pylist()), dtype=np.float16).reshape(len(t), -1).astype(np.float32)
        asks_, grp, names = t.column("asks").to_numpy(), t.column("grp").to_numpy(), np.array(t.column("id").to_pylist(), dtype=object)
        qs, ps = ({n: i for i, n in zip(np.flatnonzero(m)[::-1], names[m][::-1])} for m in (asks_, ~asks_))  # once per id
        qi, pi = np.fromiter(qs.values(), int), np.array([ps[n] for n in sorted(ps)], dtype=int)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(0, len(qi), 512):
            q = qi[b : b + 512]
            s = mat[q] @ mat[pi].T if len(pi) else np.zeros((len(q), 0), np.float32)
            s[grp[q][:, None] == grp[pi][None]] = -9
            m = min(k, s.shape[1])
            if not m:
                continue
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            val = np.take_along_axis(s, top, 1)
            ok = val > -9
            out.append((names[np.repeat(q, m).reshape(-1, m)[ok]], names[pi[top[ok]]], val[ok]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.array([], dtype=object if i < 2 else np.float32) for i in range(3)]
        return pa.table({"id": pa.array(cols[0], pa.string()), "other": pa.array(cols[1], pa.string()), "similarity": pa.array(cols[2].astype(np.float32), pa.float32())})

    found = units.groupBy("l", "x", "y").applyInArrow(score, "id string, other string, similarity float")
    best = found.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    ranked = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), 1, k).alias("top"))
    return ranked.select("id", F.explode("top").alias("t")).select("id", F.col("t.other").alias("other"), (-F.col("t.s")).alias("similarity"))

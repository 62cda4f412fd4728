"""Filling containers of fixed capacity with items of varying size.

The instance is the histogram of sizes, which has at most ``capacity`` rows however many items there are.
On it, sets of few items that dominate all alternatives for their largest item (Martello-Toth) are fixed as
whole containers, as often as the counts allow; best-fit decreasing packs what is left.  The plan assigns
containers to ranks within a size, and the items, ranked without any large group in one task, look theirs up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.session import cut_lineage

#: Items of one bucket of the ranking.
BUCKET_ROWS = 200_000


@dataclass
class Plan:
    """slots: (size, first rank, containers' first number, items of this size in each); bins: containers so far."""

    capacity: int
    slots: list[tuple[int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    bins: int = 0
    fixed: int = 0

    def put(self, size: int, base: int, bins: int, each: int) -> None:
        """``each`` items of a size go into each of ``bins`` containers from ``base``."""
        rank = self.used.get(size, 0)
        self.slots.append((size, rank, base, each))
        self.used[size] = rank + bins * each

    def fix(self, sizes: list[int], bins: int) -> None:
        for s in sorted(set(sizes)):
            self.put(s, self.bins, bins, sizes.count(s))
        self.bins += bins
        self.fixed += bins


def dominating_set(j: int, sizes: list[int], counts: dict[int, int], capacity: int) -> list[int] | None:
    """A set of at most three items with j that dominates every other feasible set with j; None if none is found.

    A set dominates another if the other's items can be parted into groups each of which fits in the place of one of its
    own items.  ``sizes`` are those with items left, in ascending order.
    """
    room = capacity - j
    left = lambda s: counts[s] - (s == j)
    small: list[int] = []  # the three smallest others
    for s in sizes:
        small += [s] * min(3 - len(small), left(s))
        if len(small) == 3:
            break
    if not small or small[0] > room:
        return [j]
    at = bisect_right(sizes, room) - 1
    while at >= 0 and not left(sizes[at]):
        at -= 1
    k = sizes[at]
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return [j, k]
    if len(small) == 3 and sum(small) <= room:
        return None
    # at most two others fit: k alone or the best pair
    best = (0, 0, 0)
    lo, hi = 0, at
    while lo <= hi:
        a, b = sizes[hi], sizes[lo]
        if a + b > room or not left(a) or (a == b and left(a) < 2):
            hi -= 1
            if a == b:
                lo += 1
            continue
        if left(b):
            best = max(best, (a + b, a, b))
        lo += 1
    if k >= best[0]:
        return [j, k]
    _, a, b = best
    lesser = 0  # the largest item that can be the smaller one of a pair
    for i, y in enumerate(sizes):
        if 2 * y > room:
            break
        partner = y if left(y) >= 2 else next((x for x in sizes[i + 1 :] if left(x)), None)
        if left(y) and partner is not None and y + partner <= room:
            lesser = y
    return [j, a, b] if a >= k and b >= lesser else None


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Packs items given as size -> count; sizes from 1 to the capacity."""
    if any(s < 1 or s > capacity for s in histogram):
        raise ValueError("a size is outside 1..capacity")
    p = Plan(capacity)
    counts = {s: n for s, n in histogram.items() if n}
    sizes = sorted(counts)

    def take(s: int, n: int) -> None:
        counts[s] -= n
        if not counts[s]:
            del counts[s]
            sizes.pop(bisect_left(sizes, s))

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            found = dominating_set(j, sizes, counts, capacity)
            if found is None:
                break
            times = min(counts[s] // found.count(s) for s in set(found))
            p.fix(found, times)
            for s in set(found):
                take(s, times * found.count(s))
    _best_fit(p, counts)
    return p


def _best_fit(p: Plan, counts: dict[int, int]) -> None:
    """Best-fit decreasing over groups of equally full containers; a group is a range of container numbers."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first number, containers)
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            groups[room].append((first, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = p.capacity, p.bins
                bins = -(-n // (p.capacity // s))
                p.bins += bins
            each = room // s
            whole, part = divmod(min(n, bins * each), each)
            if whole:
                p.put(s, first, whole, each)
                add(room - each * s, first, whole)
            if part:
                p.put(s, first + whole, 1, part)
                add(room - part * s, first + whole, 1)
            add(room, first + whole + (part > 0), bins - whole - (part > 0))
            n -= whole * each + part


def pack(sizes: DataFrame, key: str, containers: list[tuple[str, int]], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(container, bin_id, key, part_no, token_start, n_tokens): every item in a container of each kind.

    An item over the capacity is cut into full containers and a rest, which is packed; no other item is cut.
    Items of size 0 or null have no rows, a container without name or capacity isn't used.  Of equal sizes the smaller key comes first.
    """
    spark = sizes.sparkSession
    containers = [(c, int(n)) for c, n in containers if c is not None and n is not None and n > 0]
    if not containers:
        return sizes.select(F.lit("").alias("container"), F.lit("").alias("bin_id"), F.col(key), F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens").limit(0)
    kinds = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("container"), F.lit(int(n)).cast("bigint").alias("capacity")) for i, (c, n) in enumerate(containers)])
    each = sizes.where("n_tokens > 0").select(F.col(key).alias("k"), "n_tokens", F.explode(kinds).alias("c")).select("k", "n_tokens", "c.*")
    full = each.where("n_tokens >= capacity").withColumn("part", F.explode(F.expr("sequence(0L, n_tokens div capacity - 1)")))
    full = full.select("container", F.concat_ws("-", "container", "k", "part").alias("bin_id"), F.col("k").alias(key), (F.col("part") + 1).cast("int").alias("part_no"), (F.col("part") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"))
    rest = each.withColumn("size", F.expr("n_tokens % capacity").cast("int")).where("size > 0")
    histogram = rest.groupBy("ci", "size").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    total = sum(r["n"] for r in histogram) // max(1, len(containers))
    plans = [plan({r["size"]: r["n"] for r in histogram if r["ci"] == i}, n) for i, (_, n) in enumerate(containers)]
    widest = max((n for _, n in containers), default=0) + 1
    rows = sorted((i * widest + s, rank, base, k) for i, p in enumerate(plans) for s, rank, base, k in p.slots)
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    slots = spark.sparkContext.broadcast(table)  # bounded by the capacities, not by the items

    buckets = max(1, -(-total // bucket_rows))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))
    counted = rest.groupBy("ci", "size", "bucket").agg(F.count("*").alias("n"))
    offset = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("ci", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("ci", "size", "bucket").orderBy("k"))).join(offset, ["ci", "size", "bucket"])
    ranked = ranked.select("k", "container", "ci", "size", (F.col("before") + F.col("r") - 1).alias("rank"), (F.col("n_tokens") - F.col("size")).alias("token_start"), F.expr("int(n_tokens div capacity) + 1").alias("part_no"))
    kind = dict(ranked.dtypes)["k"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        where = (t[:, 0] << 40) + t[:, 1]
        for b in batches:
            code = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * widest + b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(where, (code << 40) + rank, side="right") - 1
            bins = t[at, 2] + (rank - t[at, 1]) // t[at, 3] if len(t) else rank
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(5), b.column(6), pa.array(bins)], ["k", "container", "size", "token_start", "part_no", "bin"])

    placed = ranked.mapInArrow(look_up, f"k {kind}, container string, size int, token_start bigint, part_no int, bin bigint")
    placed = placed.select("container", F.concat_ws("-", "container", F.col("bin")).alias("bin_id"), F.col("k").alias(key), "part_no", "token_start", F.col("size").cast("bigint").alias("n_tokens"))
    return full.unionByName(placed)


def fixed_by_dominance(sizes: DataFrame, containers: list[tuple[str, int]]) -> dict[str, int]:
    """How many containers of each kind the dominance reduction fixes, before best fit takes the rest."""
    out = {}
    for c, n in containers:
        if c is not None and n is not None and n > 0:
            rest = sizes.where("n_tokens > 0").select(F.expr(f"int(n_tokens % {int(n)})").alias("size")).where("size > 0")
            out[c] = plan({r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}, int(n)).fixed  # at most n rows
    return out


def fill_report(packed: DataFrame, containers: list[tuple[str, int]], fixed: dict[str, int] | None = None) -> DataFrame:
    """Containers used, tokens in them, the least number that could hold them, the share that is filled, and how many of
    them were fixed as dominating all others (null if not given)."""
    kinds = packed.sparkSession.createDataFrame([(c, int(n), (fixed or {}).get(c)) for c, n in containers if c is not None and n is not None], "container string, capacity bigint, fixed bigint")
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    out = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.sum("items").alias("items"), F.max("n").alias("fullest"))
    return out.join(F.broadcast(kinds), "container").select("container", "capacity", "bins", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 5).alias("filled"), "fixed")


def checked_sizes(sizes: DataFrame) -> DataFrame:
    """Sizes are computed once and kept in the shared folder: texts are tokenized a single time."""
    return cut_lineage(sizes)

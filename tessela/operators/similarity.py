"""Greatest similarity to stored vectors of the same group, without writing out pairs.

Groups are cut into blocks on both sides, so that one that holds a third of all rows is spread over many tasks; a pair of
blocks is one matrix product, of which only the maximum of each new vector leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2_048


def greatest_similarity(new: DataFrame, old: DataFrame, key: str, group: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, top): for each new vector the greatest cosine to an old one of its group.

    A zero, empty or null vector, and one of another length, has similarity 0 to all; groups without old vectors have no rows.
    """
    kinds = dict(new.dtypes)
    side = lambda df, is_new: df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"), F.lit(is_new).alias("is_new")).where("g is not null")
    both = side(new, True).unionByName(side(old.withColumn(key, F.lit(None).cast(kinds[key])), False))
    cut = F.ceil(F.count("*") / block).cast("int")
    n_new = both.where("is_new").groupBy("g").agg(cut.alias("xs"))
    n_old = both.where("not is_new").groupBy("g").agg(cut.alias("ys"))
    sized = both.join(n_new.join(n_old, "g"), "g")
    own = lambda n: F.pmod(F.xxhash64("k", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    units = sized.where("is_new").withColumn("x", own("xs")).withColumn("y", every("ys")).unionByName(sized.where("not is_new").withColumn("y", own("ys")).withColumn("x", every("xs")))

    def score(t: pa.Table) -> pa.Table:
        vs, is_new = t.column("v").to_pylist(), t.column("is_new").to_numpy()
        out = np.zeros(int(is_new.sum()))
        sizes = np.array([len(v) if v else 0 for v in vs])
        for size in set(sizes[is_new]) & set(sizes[~is_new]) - {0}:
            a, b = (np.array([vs[i] for i in np.flatnonzero(m & (sizes == size))], dtype=float) for m in (is_new, ~is_new))
            a, b = (np.nan_to_num(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)) for m in (a, b))
            best = (a @ b.T).max(axis=1)
            if (sizes[~is_new] != size).any():
                best = np.maximum(best, 0)
            out[sizes[is_new] == size] = best
        return pa.table({"k": t.column("k").filter(pa.array(is_new)), "top": pa.array(out)})

    found = units.select("g", "x", "y", "k", "v", "is_new").groupBy("g", "x", "y").applyInArrow(score, f"k {kinds[key]}, top double")
    return found.groupBy("k").agg(F.max("top").alias("top")).select(F.col("k").alias(key), "top")

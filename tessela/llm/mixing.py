"""Mixing sources to target shares of tokens.

Each source is given as many whole copies of all its texts as fit its target; the rest is drawn by Pareto order
sampling: texts are ranked by random odds divided by inclusion odds, and the first ones up to the wanted tokens
are taken.  Inclusion probabilities are in proportion to size, texts whose probability reaches 1 are certain, and
texts larger than what is wanted are not drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Ranges of the ranking variable that are summed before single texts are looked at.
RANGES = 1024
#: Size classes per octave in which the inclusion probabilities are solved.
CLASSES = 16
SEED = 20_230_101


def allot(targets: list[Row], available: dict[str, int], total_tokens: int | None = None) -> list[dict]:
    """For each target how many whole copies and how many further tokens its source gives.

    Without ``total_tokens`` a mix is as large as it can be with every share reached: a source that has no text can give
    none, and its share is left to the others.  With it, a source gives at most ``max_repeats`` times what it has.
    """
    out = []
    for mix in sorted({t["mix"] for t in targets}):
        own = sorted((t for t in targets if t["mix"] == mix), key=lambda t: t["source"])
        live = [t for t in own if available.get(t["source"], 0) > 0 and t["target_share"] > 0 and t["max_repeats"] > 0]
        scale = sum(t["target_share"] for t in live)
        total = total_tokens
        if total is None:
            total = min((t["max_repeats"] * available[t["source"]] * scale / t["target_share"] for t in live), default=0)
        for t in own:
            has = available.get(t["source"], 0)
            want = 0
            if t in live:
                share = t["target_share"] / (scale if total_tokens is None else 1)
                want = min(t["max_repeats"] * has, round(share * total))
            out.append({"mix": mix, "source": t["source"], "target_share": float(t["target_share"]), "max_repeats": int(t["max_repeats"]), "has": has, "want": want, "copies": want // has if has else 0, "rest": want % has if has else 0})
    return out


def inclusion_rate(classes: list[tuple[int, int, int]], rest: int) -> float:
    """theta such that texts of size n, included with min(1, theta n), give ``rest`` tokens; classes of (texts, sum n, sum n^2)."""
    if not rest or not classes:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(s, mid * q) for _, s, q in classes) < rest else (low, mid)
    return high


def mix(sizes: DataFrame, targets: list[Row], total_tokens: int | None = None, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """(mix, source, doc_id, n_tokens, copies): the texts of each mix and how often each is used.

    ``sizes`` is (source, doc_id, n_tokens), each text once; texts without tokens, or of sources without a target, are
    not used.  ``targets`` is the bounded list of mixes; a target with a null in it is none.  The rest of a source is met to within half a text.
    """
    spark = sizes.sparkSession
    targets = [t for t in targets if None not in (t["mix"], t["source"], t["target_share"], t["max_repeats"])]
    names = sorted({t["source"] for t in targets})
    texts = sizes.where((F.col("n_tokens") > 0) & F.col("source").isin(names))
    octave = F.floor(F.log2("n_tokens") * CLASSES).cast("int")
    rows = texts.groupBy("source", octave.alias("o")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("s"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("q")).collect()  # bounded by targets and size classes
    available: dict[str, int] = {}
    for r in rows:
        available[r["source"]] = available.get(r["source"], 0) + r["s"]
    plan = allot(targets, available, total_tokens)
    for p in plan:
        fits = [(r["n"], r["s"], r["q"]) for r in rows if r["source"] == p["source"] and 2 ** (r["o"] / CLASSES) <= p["rest"]]
        p["theta"] = inclusion_rate(fits, p["rest"])
    if not plan:
        return texts.select(F.lit("").alias("mix"), "source", "doc_id", "n_tokens", F.lit(0).alias("copies")).limit(0)
    shares = spark.createDataFrame([(p["mix"], p["source"], p["copies"], p["rest"], p["theta"]) for p in plan], "mix string, source string, whole bigint, rest bigint, theta double")
    shares = F.broadcast(shares)  # a row per target

    u = (F.pmod(F.xxhash64(F.lit(seed), "mix", "doc_id"), F.lit(2**52)) + 0.5) / 2.0**52
    pi = F.least(F.lit(1.0), F.col("theta") * F.col("n_tokens"))
    odds = F.when(pi >= 1, 0.0).otherwise(u / (1 - u) / (pi / (1 - pi)))
    drawn = texts.join(shares, "source").where("n_tokens <= rest").withColumn("q", odds).withColumn("range", F.least(F.lit(ranges - 1), F.floor(F.col("q") / (1 + F.col("q")) * ranges)).cast("int"))
    sums = drawn.groupBy("mix", "source", "range").agg(F.sum("n_tokens").alias("n"))
    until = F.sum("n").over(Window.partitionBy("mix", "source").orderBy("range")) - F.col("n")
    edges = F.broadcast(sums.withColumn("before", until))  # at most ``ranges`` rows per target
    placed = drawn.join(edges.select("mix", "source", "range", "before", F.col("n").alias("in_range")), ["mix", "source", "range"], "left")
    inside = placed.where("before < rest and before + in_range > rest")
    running = F.sum("n_tokens").over(Window.partitionBy("mix", "source", "range").orderBy("q", "doc_id"))
    edge = inside.withColumn("run", running).where(F.col("before") + F.col("run") - F.col("n_tokens") / 2 <= F.col("rest"))
    taken = placed.where("before + in_range <= rest").select("mix", "source", "doc_id", "n_tokens").unionByName(edge.select("mix", "source", "doc_id", "n_tokens")).withColumn("copies", F.lit(1))
    whole = texts.join(shares, "source").where("whole > 0").select("mix", "source", "doc_id", "n_tokens", F.col("whole").alias("copies"))
    return whole.unionByName(taken).groupBy("mix", "source", "doc_id", "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))


def share_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The share each source reached in each mix, beside its target, what it has and how often its texts are used at most."""
    got = mixed.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    has = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    targets = targets.select("mix", "source", "target_share", "max_repeats").dropna()
    full = targets.join(got, ["mix", "source"], "left").join(has, "source", "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select("mix", "source", "target_share", F.when(total > 0, F.coalesce("tokens", F.lit(0)) / total).alias("reached_share"), zero("tokens"), zero("available_tokens"), "max_repeats", zero("most_copies"), zero("texts"))

"""Spaced repetition and study statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scheduler: steps in minutes, intervals in days.
LEARNING_STEPS = (1, 10)
RELEARNING_STEP = 10
GRADUATING, EASY_GRADUATING = 1, 4
EASE_START, EASE_FLOOR, EASE_LAPSE, EASE_HARD, EASE_EASY = 2.5, 1.3, 0.20, 0.15, 0.15
HARD_FACTOR, EASY_BONUS, LONGEST = 1.2, 1.3, 36_500

STATE = "struct<status:string,interval:int,ease_factor:double,repetitions:int,lapses:int,learning_step:int,relearning_step:int,minutes:int>"


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def next_state(state: Column, rating: Column) -> Column:
    """The state after one review, rated 1 (again) to 4 (easy); fields that are null or 0 count as at the start.

    ``minutes`` is the wait of a step, 0 where the interval in days holds.  The due time is the time of the review
    plus either.
    """
    get = lambda f, d: F.coalesce(F.nullif(state[f], F.lit(0)), F.lit(d))
    status = F.coalesce(F.nullif(state["status"], F.lit("")), F.lit("new"))
    ease, interval = get("ease_factor", EASE_START).cast("double"), get("interval", 0)
    reps, lapses, step, restep = get("repetitions", 0), get("lapses", 0), get("learning_step", 0), get("relearning_step", 0)
    fresh, again = status.isin("new", "learning"), status == "relearning"
    last = len(LEARNING_STEPS) - 1
    here = F.element_at(F.array(*map(F.lit, LEARNING_STEPS)), F.least(step, F.lit(last)) + 1)
    after = F.element_at(F.array(*map(F.lit, LEARNING_STEPS)), F.least(step + 1, F.lit(last)) + 1)

    def at_least(days: Column) -> Column:
        return F.least(F.lit(LONGEST), F.greatest(interval + 1, _half_up(days)))

    new_ease = F.when(fresh | again, ease).when(rating == 1, F.greatest(F.lit(EASE_FLOOR), ease - EASE_LAPSE)).when(rating == 2, F.greatest(F.lit(EASE_FLOOR), ease - EASE_HARD)).when(rating == 4, ease + EASE_EASY).otherwise(ease)
    graduates = F.when(fresh, (rating == 4) | ((rating == 3) & (step >= last))).when(again, rating >= 3).otherwise(rating >= 2)
    days = (
        F.when(~graduates, F.lit(0))
        .when(fresh, F.when(rating == 4, EASY_GRADUATING).otherwise(GRADUATING))
        .when(again & (rating == 3), GRADUATING)
        .when(again, F.greatest(F.lit(EASY_GRADUATING), _half_up(F.greatest(interval, F.lit(GRADUATING)) * EASY_BONUS)))
        .when(rating == 2, at_least(interval * HARD_FACTOR))
        .when(rating == 3, at_least(interval * ease))
        .otherwise(at_least(interval * new_ease * EASY_BONUS))
    )
    minutes = (
        F.when(graduates, F.lit(0))
        .when(fresh & (rating == 1), F.lit(LEARNING_STEPS[0]))
        .when(fresh & (rating == 2), F.when(step < last, _half_up((here + after) / 2)).otherwise(here))
        .when(fresh, after)
        .otherwise(RELEARNING_STEP)
    )
    return F.struct(
        F.when(graduates, "review").when(fresh, "learning").otherwise("relearning").alias("status"),
        days.cast("int").alias("interval"),
        F.round(new_ease, 2).alias("ease_factor"),
        F.when((fresh | again) & graduates, 1).when(fresh | again, reps).when(rating == 1, 0).otherwise(reps + 1).cast("int").alias("repetitions"),
        (lapses + F.when(fresh | again | (rating != 1), 0).otherwise(1)).cast("int").alias("lapses"),
        F.when(fresh, F.when(graduates | (rating == 1), 0).when(rating == 3, step + 1).otherwise(step)).otherwise(step).cast("int").alias("learning_step"),
        F.when(fresh, restep).otherwise(0).cast("int").alias("relearning_step"),
        minutes.cast("int").alias("minutes"),
    )


def replay(reviews: DataFrame, key: str, order: list[str], rating: str) -> DataFrame:
    """(key, state, reviews): the state of each card after all its reviews in order, from a new card.

    The reviews of one card are a bounded list: no one rates a card without end.
    """
    start = F.struct(F.lit("new").alias("status"), F.lit(0).alias("interval"), F.lit(EASE_START).alias("ease_factor"), *[F.lit(0).alias(f) for f in ("repetitions", "lapses", "learning_step", "relearning_step", "minutes")]).cast(STATE)
    seq = F.array_sort(F.collect_list(F.struct(*order, F.col(rating).alias("rating"))))
    return reviews.groupBy(key).agg(F.aggregate(seq, start, lambda s, r: next_state(s, r["rating"]).cast(STATE)).alias("state"), F.count("*").alias("reviews"))


def interval_text(days: Column, minutes: Column) -> Column:
    """How a wait is shown: minutes, days, months or years."""
    return (
        F.when(days > 0, F.when(days < 30, F.format_string("%d dias", days)).when(days < 365, F.format_string("%.1f meses", days / 30.0)).otherwise(F.format_string("%.1f anos", days / 365.0)))
        .when(minutes < 1, "< 1 min").when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h", _half_up(minutes / 60).cast("int")))
    )


def deck_counts(cards: DataFrame, now: Column) -> DataFrame:
    """Cards of each deck: all, new, due, and due ones still being learnt."""
    due = F.col("sm2.due_date").isNull() | (F.col("sm2.due_date") <= now)
    reps = F.coalesce("sm2.repetitions", F.lit(0))
    return cards.groupBy("deck_id").agg(F.count("*").alias("total"), F.count_if(reps == 0).alias("new"), F.count_if(due).alias("due"), F.count_if(due & (reps < 3)).alias("learning"))


def study_kpis(log: DataFrame, rating: str, seconds: str, today: Column) -> DataFrame:
    """One row: reviews of the day, retention in percent (100 for no reviews) and mean time, to one decimal."""
    n = F.count("*")
    return log.agg(F.count_if(today).alias("today"), F.when(n == 0, 100.0).otherwise(F.round(100.0 * F.count_if(F.col(rating) >= 2) / n, 1)).alias("retention"), F.when(n == 0, 0.0).otherwise(F.round(F.avg(seconds), 1)).alias("mean_seconds"))


def mastery(cards: DataFrame, group: str) -> DataFrame:
    """Share of mastered cards (two repetitions, ease of 2.0) among the high-yield ones, or among all where there are none."""
    good = (F.col("sm2.repetitions") >= 2) & (F.col("sm2.ease_factor") >= 2.0)
    high = F.coalesce(F.col("high_yield"), F.lit(False))
    share = lambda cond: F.round(100.0 * F.count_if(cond & good) / F.count_if(cond), 1)
    pct = F.when(F.count_if(high) > 0, share(high)).otherwise(share(F.lit(True)))
    return cards.groupBy(group).agg(pct.alias("mastery"))


def fired_signals(signals: DataFrame, key: str, now: Column, ts: str, weight: Column, threshold: float = 3.0, days: int = 90) -> DataFrame:
    """(key, total): sums of the weights of signals that haven't expired, where they reach the threshold."""
    return signals.where(F.col(ts) > now - F.make_dt_interval(F.lit(days))).groupBy(key).agg(F.round(F.sum(weight), 6).alias("total")).where(F.col("total") >= threshold)


def folded_mean(values: Column) -> Column:
    """The mean that versions keep: each new value weighs as much as each before it; null without values."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.coalesce((a["mean"] * a["n"] + x) / (a["n"] + 1), x.cast("double")).alias("mean"), (a["n"] + 1).alias("n"))
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), start, step, lambda a: a["mean"])


def merged_cycle(cycles: Column) -> Column:
    """The cycle that all versions have, else mixed; null without any."""
    known = F.array_distinct(F.filter(cycles, lambda c: c.isNotNull()))
    return F.when(F.size(known) == 1, known[0]).when(F.size(known) > 1, "mixed")

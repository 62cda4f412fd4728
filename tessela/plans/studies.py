"""Aggregates, study statistics and scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.operators import ordering as o
from tessela.operators import review as r
from tessela.session import table

catalog = Catalog()
NOW = "2025-01-01 00:00:00"
_NOW = "timestamptz '2025-01-01 00:00:00+00'"
_CARDS = "(select id, any_value(deck_id) deck_id, any_value(sm2) sm2, any_value(high_yield) high_yield, any_value(type) \"type\" from cards group by id)"
RATING = "case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").dropDuplicates(["id"])


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("rating", F.expr(RATING)).withColumn("day", F.to_date("ts"))


@catalog.add("status_pivot", "select count(*) filter (event_type = 'view') \"view\", count(*) filter (event_type = 'error') \"error\", count(*) total from events")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "view").alias("view"), F.count_if(F.col("event_type") == "error").alias("error"), F.count("*").alias("total"))


@catalog.add("count_by_system", "select coalesce(system, 'SEM SISTEMA') system, count(*) n, count(distinct normalized_term) terms from terms group by 1")
def count_by_system(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").groupBy(F.coalesce("system", F.lit("SEM SISTEMA")).alias("system")).agg(F.count("*").alias("n"), F.countDistinct("normalized_term").alias("terms"))


@catalog.add("top_predicates", "select predicate, count(distinct id) n from graph_edges group by 1 order by n desc, predicate limit 10")
def top_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges").groupBy("predicate").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "predicate").limit(10)


@catalog.add("first_row_of_group", "select normalized_term, id, term from (select *, row_number() over (partition by normalized_term order by id) rn from terms) where rn = 1")
def first_row_of_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms").groupBy("normalized_term").agg(F.min(F.struct("id", "term")).alias("m")).select("normalized_term", "m.id", "m.term")


@catalog.add("origin_counts", "select 'board' kind, board as name, count(distinct id) n from knowledge_assets where trim(coalesce(board, '')) <> '' group by 2 union all select 'professor', professor, count(distinct id) from knowledge_assets where trim(coalesce(professor, '')) <> '' group by 2")
def origin_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "knowledge_assets").select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("board", "professor")])).alias("x")).select("id", "x.*")
    return a.where("trim(coalesce(name, '')) != ''").groupBy("kind", "name").agg(F.countDistinct("id").alias("n"))


@catalog.add("kb_stats", "select count(*) \"rows\", count(distinct asset_id) assets, count(distinct id) chunks from chunk_vectors")
def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").agg(F.count("*").alias("rows"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("id").alias("chunks"))


@catalog.add("deck_counts", f"select deck_id, count(*) total, count(*) filter (coalesce(sm2.repetitions, 0) = 0) \"new\", count(*) filter (sm2.due_date is null or sm2.due_date <= {_NOW}) due, count(*) filter ((sm2.due_date is null or sm2.due_date <= {_NOW}) and coalesce(sm2.repetitions, 0) < 3) learning from {_CARDS} group by 1")
def deck_counts(spark: SparkSession, d: str) -> DataFrame:
    return r.deck_counts(_cards(spark, d), F.to_timestamp(F.lit(NOW)))


@catalog.add("study_kpis", f"select count(*) filter (ts::date = '2024-01-30') today, round(100.0 * count(*) filter ({RATING} >= 2) / count(*), 1) retention, round(avg(value), 1) mean_seconds from events")
def study_kpis(spark: SparkSession, d: str) -> DataFrame:
    return r.study_kpis(_reviews(spark, d), "rating", "value", F.col("day") == F.to_date(F.lit("2024-01-30")))


@catalog.add("heatmap", "select strftime(ts, '%Y-%m-%d') \"day\", count(*) n from events group by 1")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@catalog.add("mastery", f"""select deck_id, case when count(*) filter (high_yield) > 0 then round(100.0 * count(*) filter (high_yield and g) / count(*) filter (high_yield), 1) else round(100.0 * count(*) filter (g) / count(*), 1) end mastery
    from (select deck_id, coalesce(high_yield, false) high_yield, coalesce(sm2.repetitions >= 2 and sm2.ease_factor >= 2.0, false) g from {_CARDS}) group by 1""")  # fmt: skip
def mastery(spark: SparkSession, d: str) -> DataFrame:
    return r.mastery(_cards(spark, d), "deck_id")


@catalog.add("daily_streaks", """select user_id, strftime(min(day), '%Y-%m-%d') first_day, strftime(max(day), '%Y-%m-%d') last_day, count(*) "days" from (select user_id, day, day - (row_number() over (partition by user_id order by day))::int g
    from (select distinct user_id, ts::date "day" from events)) group by user_id, g""")  # fmt: skip
def daily_streaks(spark: SparkSession, d: str) -> DataFrame:
    s = o.streaks(_reviews(spark, d), ["user_id"], "day")
    return s.select("user_id", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "days")


@catalog.add("daily_streak", """with i as (select user_id, min(day) a, max(day) b, count(*) n from (select user_id, day, day - (row_number() over (partition by user_id order by day))::int g from (select distinct user_id, ts::date "day" from events where ts::date <= '2024-01-29')) group by user_id, g)
    select user_id, coalesce(max(case when b between date '2024-01-28' and date '2024-01-29' then least(n, 365) end), 0)::bigint streak from i group by 1""")  # fmt: skip
def daily_streak(spark: SparkSession, d: str) -> DataFrame:
    return o.current_streak(_reviews(spark, d), ["user_id"], "day", "2024-01-29")


@catalog.add("dense_calendar", "select strftime(c.d, '%Y-%m-%d') \"day\", count(e.event_id) n from (select unnest(generate_series(date '2024-02-10' - 59, date '2024-02-10', interval 1 day))::date d) c left join events e on e.ts::date = c.d group by 1")
def dense_calendar(spark: SparkSession, d: str) -> DataFrame:
    return o.dense_calendar(_reviews(spark, d), "day", "2024-02-10").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@catalog.add("burst_window", "select user_id, event_id, n in_window from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) n from events) where n >= 3")
def burst_window(spark: SparkSession, d: str) -> DataFrame:
    return o.bursts(table(spark, d, "events"), ["user_id"], "ts", "event_id", 3, 86_400)


@catalog.add("sm2_step", f"""with c as (select id, coalesce(nullif(sm2.status, ''), 'new') st, coalesce(nullif(sm2.ease_factor, 0), 2.5) ea, coalesce(sm2.interval, 0) iv, coalesce(sm2.learning_step, 0) ls from {_CARDS})
    select id, case st when 'review' then 'review' when 'relearning' then 'review' else case when ls >= 1 then 'review' else 'learning' end end status,
      case st when 'review' then least(36500, greatest(iv + 1, floor(iv * ea + 0.5)))::int when 'relearning' then 1 else case when ls >= 1 then 1 else 0 end end "interval", round(ea, 2) ease from c""")  # fmt: skip
def sm2_step(spark: SparkSession, d: str) -> DataFrame:
    s = _cards(spark, d).select("id", r.next_state(F.col("sm2"), F.lit(3)).alias("s"))
    return s.select("id", F.col("s.status").alias("status"), F.col("s.interval").alias("interval"), F.col("s.ease_factor").alias("ease"))


@catalog.add("sm2_replay")
def sm2_replay(spark: SparkSession, d: str) -> DataFrame:
    return r.replay(_reviews(spark, d), "user_id", ["ts", "event_id"], "rating").select("user_id", "state.*", "reviews")


@catalog.add("signal_threshold", "select user_id, round(sum(case event_type when 'error' then 1.5 else 1.0 end), 6) total from events where event_type in ('error', 'view') and ts > timestamp '2024-01-31' - interval 20 day group by 1 having total >= 3.0")
def signal_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").where(F.col("event_type").isin("error", "view"))
    return r.fired_signals(s, "user_id", F.to_timestamp(F.lit("2024-01-31")), "ts", F.when(F.col("event_type") == "error", 1.5).otherwise(1.0), 3.0, 20)


@catalog.add("ttl_delete", "select event_id from events where not (event_type = 'purchase' and ts <= timestamp '2024-01-20' - interval 24 hour)")
def ttl_delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("not (event_type = 'purchase' and ts <= timestamp'2024-01-20' - interval 24 hours)").select("event_id")


@catalog.add("conditional_update", "select event_id, case when event_type = 'error' then (event_id % 5) + 1 else event_id % 5 end retry_count, case when event_type = 'purchase' then 'synced' else event_type end status from events")
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.col("event_id") % 5)
    return e.select("event_id", F.when(F.col("event_type") == "error", F.col("n") + 1).otherwise(F.col("n")).alias("retry_count"), F.when(F.col("event_type") == "purchase", "synced").otherwise(F.col("event_type")).alias("status"))


@catalog.add("dashboard_counts", "select model, count(*) n, sum(coalesce(length(conteudo_texto), 0))::bigint chars, arg_max(asset_id, (created_at, asset_id)) latest from asset_texts group by 1")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_texts").groupBy("model").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("conteudo_texto"), F.lit(0))).cast("bigint").alias("chars"), F.max_by("asset_id", F.struct("created_at", "asset_id")).alias("latest"))


@catalog.add("distinct_tags", "select distinct trim(t) tag from (select unnest(tags) t from cards) where trim(t) <> ''")
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select(F.explode("tags").alias("t")).select(F.trim("t").alias("tag")).where("tag != ''").distinct()


@catalog.add("tag_counts", "select t tag, count(*) n from (select id, unnest(any_value(tags)) t from cards group by id) group by 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@catalog.add("recency_buckets", f"select case when a <= 1 then '1' when a <= 7 then '7' when a <= 30 then '30' else 'older' end bucket, count(*) n from (select epoch({_NOW} - updated_at) / 86400.0 a from decks) group by 1")
def recency_buckets(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(F.to_timestamp(F.lit(NOW))) - F.unix_micros("updated_at")) / 86_400e6
    return table(spark, d, "decks").groupBy(F.when(age <= 1, "1").when(age <= 7, "7").when(age <= 30, "30").otherwise("older").alias("bucket")).agg(F.count("*").alias("n"))


@catalog.add("confidence_classes", "select source_asset_id, count(*) filter (confidence = 'low') low, count(*) n, round(count(*) filter (confidence = 'low') / count(*), 4) low_ratio from (select distinct id, source_asset_id, confidence from extracted_questions) group by 1")
def confidence_classes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").select("id", "source_asset_id", "confidence").distinct()
    low = F.count_if(F.col("confidence") == "low")
    return q.groupBy("source_asset_id").agg(low.alias("low"), F.count("*").alias("n"), F.round(low / F.count("*"), 4).alias("low_ratio"))


@catalog.add("segmentation_bands", "select source_asset_id, p pct, case when p < 50 then 'ruim' when p < 80 then 'medio' else 'otimo' end band from (select source_asset_id, round(100.0 * count(*) filter (confidence = 'high') / count(*), 1) p from (select distinct id, source_asset_id, confidence from extracted_questions) group by 1)")
def segmentation_bands(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "extracted_questions").select("id", "source_asset_id", "confidence").distinct()
    p = q.groupBy("source_asset_id").agg(F.round(100.0 * F.count_if(F.col("confidence") == "high") / F.count("*"), 1).alias("pct"))
    return p.withColumn("band", F.when(F.col("pct") < 50, "ruim").when(F.col("pct") < 80, "medio").otherwise("otimo"))


@catalog.add("moving_average", "select user_id, round(avg(value), 4) dna, count(*) versions from events where event_type = 'view' group by 1")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """A versioned moving average, (old * v + new) / (v + 1): from the first value on it is the mean, which needs no order."""
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("dna"), F.count("value").alias("versions"))


@catalog.add("clamped_mean", "select user_id, round(avg(coalesce(least(1, greatest(0, value / 100)), 0.5)), 5) dna from events group by 1")
def clamped_mean(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)), F.lit(0.5))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(c), 5).alias("dna"))


@catalog.add("majority_vote", "select user_id, case when v > p then 'view' when p > v then 'purchase' else 'mixed' end vote from (select user_id, count(*) filter (event_type = 'view') v, count(*) filter (event_type = 'purchase') p from events group by 1)")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return c.select("user_id", F.when(F.col("v") > F.col("p"), "view").when(F.col("p") > F.col("v"), "purchase").otherwise("mixed").alias("vote"))


@catalog.add("cube_rollup", "select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@catalog.add("revenue_by_nation", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = s_nationkey group by 1""")  # fmt: skip
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = li.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.groupBy("s_nationkey").agg(F.sum("v").alias("v")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.round("v", 2).alias("revenue"))


@catalog.add("pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) qty, round(avg(l_discount), 6) disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))

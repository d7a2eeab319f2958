"""Operators over rows in order."""

from pyspark.sql import functions as F

from ..functions import accumulators as A
from ..operators import ordered as W
from ..operators.statistics import top_n
from .registry import ORDER, off_tie, query, read, sql_off_tie


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _numbered_sql(where: str, order: str = "ts, event_id") -> str:
    return f"""
select user_id, event_id, value from (
    select *, row_number() over (partition by user_id order by {order}) as rn, count(*) over (partition by user_id) as n
    from events) where {where}"""


DESC = "ts desc, event_id desc"


@query(_numbered_sql("rn <= 20", DESC))
def recency_buffer(spark, sf_dir):
    return W.recency_buffer(_events(spark, sf_dir), "user_id", ORDER, 20).select("user_id", "event_id", "value")


@query(_numbered_sql("rn <= 40 and rn > least(n, 40) - 10"))
def head_tail_sample(spark, sf_dir):
    return W.head_then_tail(_events(spark, sf_dir), "user_id", ORDER, 40, 10).select("user_id", "event_id", "value")


@query(_numbered_sql("rn <= 40", DESC))
def tail_lines(spark, sf_dir):
    return W.tail_n(_events(spark, sf_dir), "user_id", ORDER, 40).select("user_id", "event_id", "value")


@query(_numbered_sql("rn <= 7"))
def head_lines(spark, sf_dir):
    return W.head_n(_events(spark, sf_dir), "user_id", ORDER, 7).select("user_id", "event_id", "value")


@query(_numbered_sql("rn % 10 = 0"))
def every_tenth(spark, sf_dir):
    return W.every_nth(_events(spark, sf_dir), "user_id", ORDER, 10).select("user_id", "event_id", "value")


@query("select event_id, user_id, value from events order by value desc, event_id limit 100")
def top_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return top_n(events, [F.col("value").desc(), F.col("event_id").asc()], 100)


SHARDS_SQL = """
select user_id, shard, count(*) as n_rows, min(event_id) as first_event, max(event_id) as last_event from (
    select *, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 16)::BIGINT as shard from events)
group by user_id, shard"""


@query(SHARDS_SQL)
def trace_shards(spark, sf_dir):
    return W.shard_index(_events(spark, sf_dir), "user_id", ORDER, 16).groupBy("user_id", "shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""
select user_id, event_id, lag(value) over w as pre_value, lag(event_type) over w as pre_type, value as post_value,
       event_type as post_type, round(value - lag(value) over w, 4) as delta_value
from events window w as (partition by user_id order by ts, event_id)""")
def pre_post_pairs(spark, sf_dir):
    pairs = W.pre_post_pairs(_events(spark, sf_dir), "user_id", ORDER, ["value", "event_type"], ["value"])
    return pairs.select("user_id", "event_id", F.col("pre.value").alias("pre_value"), F.col("pre.event_type").alias("pre_type"),
                        F.col("post.value").alias("post_value"), F.col("post.event_type").alias("post_type"),
                        F.round("delta_value", 4).alias("delta_value"))


@query(f"""
select event_id, count(value) over w as run_n, round(sum(value::DECIMAL(28,10)) over w::DOUBLE, 4) as run_sum,
       {sql_off_tie("sum(value::DECIMAL(28,10)) over w::DOUBLE / count(value) over w")} as run_mean,
       {sql_off_tie("coalesce(var_samp(value) over w, 0)")} as run_var
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def running_stats(spark, sf_dir):
    return W.running_stats(_events(spark, sf_dir), "user_id", ORDER, "value").select(
        "event_id", "run_n", F.round(F.col("run_sum").cast("double"), 4).alias("run_sum"),
        off_tie("run_mean").alias("run_mean"), off_tie("run_var").alias("run_var"))


@query("""
with d as (select user_id, value, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events)
select user_id, round(sum(greatest(0, coalesce(delta, 0))), 4) as grown, max(value) as peak from d group by user_id""")
def positive_deltas(spark, sf_dir):
    deltas = W.with_delta(_events(spark, sf_dir), "user_id", ORDER, "value")
    return deltas.groupBy("user_id").agg(F.round(A.positive_sum("delta").cast("double"), 4).alias("grown"),
                                         F.max("value").alias("peak"))


@query("""
with h as (select event_id, unnest([0, 1, 2, 3]) as slot,
    unnest([lag(value, 3) over w, lag(value, 2) over w, lag(value, 1) over w, value]) as v,
    unnest([lag(hour(ts), 3) over w, lag(hour(ts), 2) over w, lag(hour(ts), 1) over w, hour(ts)]) as h,
    value, hour(ts) as hr
    from events window w as (partition by user_id order by ts, event_id))
select event_id, slot::INTEGER as slot, coalesce(v, 0)::DOUBLE as value_then, coalesce(h, 0)::DOUBLE as hour_then,
       case when slot = 3 then value else 0 end::DOUBLE as value_now, case when slot = 3 then hr else 0 end::DOUBLE as hour_now
from h""")
def sequence_features(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    both = W.sequence_features(events, "user_id", ORDER, ["value", "hour"], 4, "current_only", "now")
    both = W.sequence_features(both, "user_id", ORDER, ["value", "hour"], 4, "history", "then")
    pairs = both.select("event_id", F.posexplode(F.arrays_zip("then", "now")).alias("slot", "s"))
    return pairs.select("event_id", "slot", F.col("s.then")[0].alias("value_then"), F.col("s.then")[1].alias("hour_then"),
                        F.col("s.now")[0].alias("value_now"), F.col("s.now")[1].alias("hour_now"))

"""Streaming queries over the events, fed in three runs by time as files arrive."""

from pyspark.sql import functions as F

from ..functions import accumulators as A
from ..functions.draws import uniform
from ..functions.scalars import is_finite
from ..operators.records import nested_record
from ..session import state_on_disk, work_path
from ..sources.artifacts import TIME_FORMATS
from ..sources import snapshots as N
from ..streaming import guarded as G
from ..streaming import operators as ST
from ..streaming import ordered as O
from ..streaming import sinks as K
from .folding import CLAMPED_SQL, SIGNED_SQL, signed_events
from .registry import off_tie, query, read, sql_off_tie, sql_uniform

SEED = 7
CUTS = ("2024-01-11", "2024-01-21")
SLICE_SQL = f"(case when ts < TIMESTAMP '{CUTS[0]}' then 0 when ts < TIMESTAMP '{CUTS[1]}' then 1 else 2 end)"


def slice_of(ts="ts"):
    at = F.col(ts) if isinstance(ts, str) else ts
    return F.when(at < F.lit(CUTS[0]).cast("timestamp_ntz"), 0).when(
        at < F.lit(CUTS[1]).cast("timestamp_ntz"), 1).otherwise(2)


def feed(spark, df, start):
    """Append each time slice to a folder and let the query work off what has arrived."""
    folder = work_path(spark, "feed")
    for part in range(3):
        df.filter(slice_of() == part).write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()


@query(f"""
select event_type, count(value) as n, 0::BIGINT as n_bad, round(sum(value::DECIMAL(28,10))::DOUBLE, 4) as exact_sum,
       {sql_off_tie("sum(value::DECIMAL(28,10))::DOUBLE / count(value)")} as mean,
       {sql_off_tie("coalesce(var_samp(value), 0)")} as variance, true as all_finite
from events group by event_type""")
def stream_monitor(spark, sf_dir):
    out, mark = work_path(spark, "monitor"), work_path(spark, "mark")
    events = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    feed(spark, events, lambda s: K.sink_batches(ST.stream_monitor(s, "event_type", "value"), out, mark))
    last = K.latest_rows(spark, out, "event_type")
    return last.select("event_type", "n", "n_bad", F.round(F.col("sum").cast("double"), 4).alias("exact_sum"),
                       off_tie("mean").alias("mean"), off_tie("var").alias("variance"), "all_finite")


@query(f"select event_id, user_id, value from events where {sql_uniform(SEED, 'promote', 'event_id')} < 0.05")
def stream_promote(spark, sf_dir):
    out, mark = work_path(spark, "promote"), work_path(spark, "mark")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    feed(spark, events, lambda s: K.sink_batches(ST.stream_promote(s, "event_id", 0.05, seed=SEED), out, mark, "append"))
    return spark.read.parquet(out).select("event_id", "user_id", "value")


@query(f"select *, 0::BIGINT as n_late from ({CLAMPED_SQL})")
def stream_fold(spark, sf_dir):
    out, mark = work_path(spark, "fold"), work_path(spark, "mark")
    feed(spark, signed_events(spark, sf_dir), lambda s: K.sink_batches(
        ST.stream_fold(s, "user_id", "ts", "event_id", "delta", 0, 500, 100), out, mark))
    return K.latest_rows(spark, out, "user_id").select("user_id", F.round("state", 4).alias("state"), "n_steps", "n_late")


DELAY_HOURS = 48
LATE_SHARE = 0.02
JITTER_SQL = sql_uniform(SEED, "jitter", "event_id")
ARRIVAL_SQL = SLICE_SQL.replace("ts <", f"ts + to_microseconds(({JITTER_SQL} * {DELAY_HOURS - 1} * 3600000000)::BIGINT) <")


@query(f"""
with e as (select user_id, ts, event_id, {SIGNED_SQL}::DECIMAL(38,6) as d,
                  case when {sql_uniform(SEED, "late", "event_id")} < {LATE_SHARE} then 2 else {ARRIVAL_SQL} end as part from events),
tops as (select max(ts) filter (where part < 1) as t1, max(ts) filter (where part < 2) as t2 from e),
marked as (select e.*, coalesce(ts < date_trunc('milliseconds', case part when 1 then t1 when 2 then t2 end) - to_hours({DELAY_HOURS}), false) as late from e, tops)
select user_id, round(list_reduce(coalesce(list(d order by ts, event_id) filter (where not late), []),
    lambda a, x: least(500::DECIMAL(38,6), greatest(0::DECIMAL(38,6), (a + x)::DECIMAL(38,6))), 100::DECIMAL(38,6))::DOUBLE, 4) as state,
    count(*) filter (where not late) as n_steps, count(*) filter (where late) as n_late, 0::BIGINT as n_waiting
from marked group by user_id""")
def stream_fold_late(spark, sf_dir):
    """Rows out of order by up to two days are folded in their place; a share comes at the very end, and of these the older ones are late.

    A row of another key, far ahead in time, ends the stream.
    """
    out, mark, folder = (work_path(spark, p) for p in ("ordered", "mark", "feed"))
    events = signed_events(spark, sf_dir).select("user_id", "ts", "event_id", "delta")
    shift = (uniform(SEED, "jitter", "event_id") * (DELAY_HOURS - 1) * 3_600_000_000).cast("bigint")
    arrival = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + shift).cast("timestamp_ntz")
    part = F.when(uniform(SEED, "late", "event_id") < LATE_SHARE, 2).otherwise(slice_of(arrival))
    dealt = events.withColumn("part", part)
    ahead = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr(f"interval {3 * DELAY_HOURS} hours")).alias("ts"),
        F.lit(-1).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(0.0).alias("delta"))
    for rows in [dealt.filter(F.col("part") == n).drop("part") for n in range(3)] + [ahead]:
        rows.write.mode("append").parquet(folder)
        folded = O.ordered_stream_fold(spark.readStream.schema(events.schema).parquet(folder), "user_id", "ts", "event_id", "delta", 0, 500, 100, f"{DELAY_HOURS} hours")
        with state_on_disk(spark):
            running = K.sink_batches(folded, out, mark)
        running.awaitTermination()
    last = K.latest_rows(spark, out, "user_id").filter("user_id <> -1")
    return last.select("user_id", F.round("state", 4).alias("state"), "n_steps", "n_late", "n_waiting")


@query("""
select (event_id % 2)::BIGINT as seed, count(*) as n_rows, round(sum(value::DECIMAL(28,10))::DOUBLE, 4) as total,
       count(distinct user_id) as n_users, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_ts from events group by 1""")
def stream_trace(spark, sf_dir):
    out, mark = work_path(spark, "trace"), work_path(spark, "mark")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", (F.col("event_id") % 2).alias("seed"))

    def start(s):
        return K.stream_trace_sink(nested_record(s, {"pre": ["event_id", "user_id", "ts"], "post": ["value"]}), out, mark)

    feed(spark, events, start)
    schema = "pre struct<event_id bigint, user_id bigint, ts timestamp_ntz>, post struct<value double>, seed bigint"
    trace = spark.read.schema(schema).options(**TIME_FORMATS).json(out)
    return trace.groupBy("seed").agg(F.count(F.lit(1)).alias("n_rows"), F.round(A.exact_sum("post.value").cast("double"), 4).alias("total"),
                                     F.count_distinct("pre.user_id").alias("n_users"), F.date_format(F.max("pre.ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


@query("""
select 2::BIGINT as v, 'ok' as status, count(*) as n_rows from events""")
def periodic_snapshot(spark, sf_dir):
    """Three batches, a snapshot at every second one and one of the rest at the end, which holds all slices."""
    out, root, mark = (work_path(spark, p) for p in ("rows", "snapshots", "mark"))
    events = read(spark, sf_dir, "events").select("event_id", "ts", "value")
    feed(spark, events, lambda s: K.periodic_snapshot(s, out, root, mark, every=2))
    version = K.snapshot_rest(spark, out, root)
    return N.check_snapshot(spark, root, version).select(
        F.lit(version).cast("bigint").alias("v"), "status", F.col("stored_rows").alias("n_rows"))


def _totals(current, batch):
    """Running exact totals per event type."""
    fresh = batch.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), A.exact_sum("value").alias("total"),
        A.all_finite("value").alias("finite"))
    if current is not None:
        fresh = fresh.unionByName(current)
    return fresh.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,10)")).alias("total"),
                                           F.bool_and("finite").alias("finite"))


def run_guarded(spark, sf_dir):
    """The middle slice holds a NaN for every error event, so it must be turned away as a whole."""
    root, mark = work_path(spark, "guarded"), work_path(spark, "mark")
    poisoned = F.when((slice_of() == 1) & (F.col("event_type") == "error"), float("nan")).otherwise(F.col("value"))
    events = read(spark, sf_dir, "events").select("ts", "event_type", poisoned.alias("value"))
    gate = {"all_finite": F.bool_and("finite"), "counts_positive": A.all_finite("n")}
    feed(spark, events, lambda s: G.guarded_update(
        s, root, _totals, gate, mark, loss=(F.sum("total") / F.sum("n")).cast("double"), norm=F.sqrt(A.exact_sum(F.col("n") * F.col("n")).cast("double"))))
    return root


@query(f"""
select event_type, count(*) as n, round(sum(value::DECIMAL(28,10))::DOUBLE, 4) as total from events where {SLICE_SQL} <> 1
group by event_type""")
def guarded_update(spark, sf_dir):
    root = run_guarded(spark, sf_dir)
    state = N.load_snapshot(spark, root)[G.STATE]
    return state.select("event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


@query(f"""
with s as (select {SLICE_SQL} as part, count(*) as n, sum(value::DECIMAL(28,10)) as total from events group by 1)
select 0::BIGINT as batch_id, true as accepted, ''::VARCHAR as reason, -1::BIGINT as base, true as changed, {sql_off_tie("total::DOUBLE / n")} as loss
from s where part = 0
union all select 1, false, 'all_finite', 0, true, null
union all select 2, true, '', 0, true, {sql_off_tie("sum(total)::DOUBLE / sum(n)")} from s where part <> 1""")
def guarded_status(spark, sf_dir):
    status = G.update_status(spark, run_guarded(spark, sf_dir))
    return status.select("batch_id", "accepted", F.coalesce("reason", F.lit("")).alias("reason"),
                         F.coalesce("base", F.lit(-1)).cast("bigint").alias("base"), "changed",
                         F.when(is_finite("loss"), off_tie("loss")).alias("loss"))

"""Exact sums, means, variances, norms and softmax."""

from pyspark.sql import functions as F

from ..functions import accumulators as A
from ..functions import scalars as P
from ..operators import softmax as X
from ..operators import statistics as S
from .registry import SQL_BAD_VALUES, off_tie, query, read, sql_off_tie, with_bad_values


@query(f"""
select event_type, count(value) as n, 0::BIGINT as n_bad,
       round(sum(value::DECIMAL(28,10))::DOUBLE, 4) as exact_sum,
       {sql_off_tie("sum(value::DECIMAL(28,10))::DOUBLE / count(value)")} as mean,
       {sql_off_tie("coalesce(var_samp(value), 0)")} as variance
from events group by event_type""")
def stable_stats_by_type(spark, sf_dir):
    stats = S.stable_stats(read(spark, sf_dir, "events"), "event_type", "value")
    return stats.select("event_type", "n", "n_bad", F.round(F.col("sum").cast("double"), 4).alias("exact_sum"),
                        off_tie("mean").alias("mean"), off_tie("var").alias("variance"))


@query("""
select l_returnflag, l_linestatus, count(l_quantity) as n,
       sum(l_quantity::DECIMAL(28,10))::VARCHAR as sum_qty,
       sum(l_extendedprice::DECIMAL(28,10))::VARCHAR as sum_price,
       sum(l_discount::DECIMAL(28,10))::VARCHAR as sum_discount,
       sum(l_tax::DECIMAL(28,10))::VARCHAR as sum_tax
from lineitem group by l_returnflag, l_linestatus""")
def exact_sum_by_flag(spark, sf_dir):
    sums = {"sum_qty": "l_quantity", "sum_price": "l_extendedprice", "sum_discount": "l_discount", "sum_tax": "l_tax"}
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("l_quantity").alias("n"), *[A.exact_sum(c).cast("string").alias(n) for n, c in sums.items()])


@query(f"""
select l_shipmode_proxy as flag, n, {sql_off_tie("mean")} as mean, {sql_off_tie("variance")} as variance
from (select l_returnflag as l_shipmode_proxy, count(*) as n, avg(l_quantity) as mean, var_samp(l_quantity) as variance
      from lineitem group by l_returnflag)""")
def quantity_variance(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), off_tie(A.stable_mean("l_quantity")).alias("mean"),
        off_tie(A.stable_variance("l_quantity")).alias("variance"))


@query(f"""
select event_type, count(*) filter (isfinite(value)) as n,
       count(*) filter (not isfinite(value)) as n_bad,
       round(sum(case when isfinite(value) then value else 0 end::DECIMAL(28,10))::DOUBLE, 4) as exact_sum,
       bool_and(isfinite(value)) as all_finite
from {SQL_BAD_VALUES} group by event_type""")
def finite_gate(spark, sf_dir):
    return with_bad_values(read(spark, sf_dir, "events")).groupBy("event_type").agg(
        F.count(A.quantize("value")).alias("n"), A.bad_count("value").alias("n_bad"),
        F.round(A.exact_sum("value").cast("double"), 4).alias("exact_sum"),
        A.all_finite("value").alias("all_finite"))


@query("""
select user_id, round(list_reduce(
    list({'s': value, 'c': 0::DOUBLE} order by ts, event_id),
    lambda a, b: {'s': a.s + (b.s - a.c), 'c': ((a.s + (b.s - a.c)) - a.s) - (b.s - a.c)},
    {'s': 0::DOUBLE, 'c': 0::DOUBLE}).s, 6) as kahan_sum
from events group by user_id""")
def kahan_ordered_sum(spark, sf_dir):
    sums = S.kahan_sum(read(spark, sf_dir, "events"), "user_id", "value")
    return sums.select("user_id", F.round("kahan_sum", 6).alias("kahan_sum"))


@query("""
select user_id, list_reduce(
    list({'s': value, 'c': 0::DOUBLE} order by ts, event_id),
    lambda a, b: {'s': a.s + (b.s - a.c), 'c': ((a.s + (b.s - a.c)) - a.s) - (b.s - a.c)},
    {'s': 0::DOUBLE, 'c': 0::DOUBLE}).s as kahan_sum
from events group by user_id""")
def kahan_literal(spark, sf_dir):
    """The ordered recurrence itself, equal to the last bit."""
    return S.ordered_kahan_sum(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


SCORE_SQL = """(select vec_id, label, (generate_subscripts(embedding, 1) - 1)::INTEGER as pos, unnest(embedding)::DOUBLE * 20 as score
    from embeddings)"""


def _scores(spark, sf_dir):
    """Every element of every vector, in groups by label."""
    scores = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return scores.select("vec_id", "pos", "label", (F.col("x").cast("double") * 20).alias("score"))


@query(f"""
select label, round(max(top) + ln(sum(exp(score - top))), 6) as lse
from (select *, max(score) over (partition by label) as top from {SCORE_SQL}) group by label""")
def logsumexp_by_label(spark, sf_dir):
    return S.logsumexp(_scores(spark, sf_dir), "label", "score").select("label", F.round("lse", 6).alias("lse"))


def _softmax_sql(source: str, group: str, key: str, temp: str) -> str:
    return f"""
with s as (select {key}, {group}, least(1e6, greatest(-1e6, score / ({temp}))) as x from {source}),
     e as (select *, exp(x - max(x) over (partition by {group})) as e from s),
     f as (select *, greatest(1e-12, e / sum(e) over (partition by {group})) as f from e)
select {key}, {group}, round(f / sum(f) over (partition by {group}), 9) as p from f"""


@query(_softmax_sql(SCORE_SQL, "label", "vec_id, pos", "1"))
def softmax_by_label(spark, sf_dir):
    return X.stable_softmax(_scores(spark, sf_dir), "label", ["vec_id", "pos"], "score").select(
        "vec_id", "pos", "label", F.round("p", 9).alias("p"))


@query(_softmax_sql("(select event_id, user_id, value as score from events)", "user_id", "event_id", "25"))
def softmax_by_user(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return X.stable_softmax(events, "user_id", "event_id", "value", 25.0).select(
        "event_id", "user_id", F.round("p", 9).alias("p"))


@query("""
select event_id, user_id, case when row_number() over (partition by user_id order by value desc, event_id) = 1
       then 1.0::DOUBLE else 0.0::DOUBLE end as p from events""")
def softmax_cold_by_user(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return X.stable_softmax(events, "user_id", "event_id", "value", 1e-9).select("event_id", "user_id", "p")


ARRAY_SQL = """(select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::DOUBLE * 20 as score
    from embeddings)"""


def _logits(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double") * 20)
    return read(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"))


@query(f"""
with s as (select vec_id, pos, score / greatest(0.5, 1 - 0.005 * vec_id) as x from {ARRAY_SQL}),
     e as (select *, exp(x - max(x) over (partition by vec_id)) as e from s),
     f as (select *, greatest(1e-12, e / sum(e) over (partition by vec_id)) as f from e)
select vec_id, pos::INTEGER as pos, round(f / sum(f) over (partition by vec_id), 9) as p from f""")
def softmax_schedule(spark, sf_dir):
    probs = P.softmax_array("logits", P.temperature("vec_id"))
    return _logits(spark, sf_dir).select("vec_id", F.posexplode(probs).alias("pos", "p")).withColumn("p", F.round("p", 9))


@query(f"""
select vec_id, pos::INTEGER as pos,
       case when row_number() over (partition by vec_id order by score desc, pos) = 1 then 1.0::DOUBLE
            else 0.0::DOUBLE end as p from {ARRAY_SQL}""")
def softmax_cold(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.posexplode(P.softmax_array("logits", 1e-9)).alias("pos", "p"))


SCALES = (1.0, 10.0, 100.0, 1e3, 1e4, 1e6)


@query(f"""
with s as (select label, scale, least(1e6, greatest(-1e6, score * scale)) as x
           from {SCORE_SQL}, unnest([{", ".join(f"{s}::DOUBLE" for s in SCALES)}]) as t(scale)),
     e as (select *, exp(x - max(x) over (partition by scale, label)) as e from s),
     p as (select *, e / sum(e) over (partition by scale, label) as p from e),
     f as (select *, greatest(1e-12, p) as f from p),
     g as (select *, f / sum(f) over (partition by scale, label) as g from f),
     d as (select scale, label, sum(abs(g - p)) as l1 from g group by scale, label)
select scale, round(max(l1), 6) as max_l1, max(l1) <= 1e-3 as within_gate, count(*) as n_groups from d group by scale""")
def softmax_sweep(spark, sf_dir):
    return X.softmax_sweep(_scores(spark, sf_dir), "label", "score", SCALES).select(
        "scale", F.round("max_l1", 6).alias("max_l1"), (F.col("max_l1") <= 1e-3).alias("within_gate"), "n_groups")


@query("""
select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) as norm,
       (list_position(embedding, list_max(embedding)) - 1)::INTEGER as best
from embeddings""")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(P.l2_norm("embedding"), 6).alias("norm"), P.argmax_array("embedding").alias("best"))


@query("""
with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) as norm
           from embeddings)
select vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER as pos,
       round(unnest(embedding)::DOUBLE * least(1, 0.5 / (norm + 1e-6)), 6) as x from n""")
def clipped_vectors(spark, sf_dir):
    clipped = P.clip_by_norm("embedding", 0.5)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(clipped).alias("pos", "x")).withColumn(
        "x", F.round("x", 6))


@query("""
select label, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) as norm
from embeddings group by label""")
def global_norm(spark, sf_dir):
    norms = read(spark, sf_dir, "embeddings").select("label", P.l2_norm("embedding").alias("norm"))
    return S.global_norm(norms, "label", "norm").withColumn("norm", F.round("norm", 6))


RUN_METRICS_SQL = f"""
select user_id, epoch(max(ts)) * 0 + round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) as duration_s,
       count(*) as depth, count(distinct event_type) as encounters,
       {sql_off_tie("avg(value)")} as hp_mean, count(value) as hp_count, {sql_off_tie("coalesce(var_samp(value), 0)")} as hp_var,
       {sql_off_tie("avg(hour(ts))")} as xp_mean, count(hour(ts)) as xp_count,
       {sql_off_tie("coalesce(var_samp(hour(ts)), 0)")} as xp_var,
       count(value) as loss_count, {sql_off_tie("avg(value / 100)")} as loss_mean, epoch_us(max(ts)) // 1000000 as timestamp, 7::BIGINT as seed,
       {sql_off_tie("avg(value / 10)")} as norm_mean, least(count(*), 256) as norm_sample,
       round((max_by(value, (ts, event_id)) / 10)::DOUBLE, 6) as norm_last
from events group by user_id"""


def user_metrics(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("hour", F.hour("ts")).withColumn("loss", F.col("value") / 100).withColumn("norm", F.col("value") / 10)
    runs = S.run_metrics(events, "user_id", "ts", {"hp": "value", "xp": "hour"}, "event_type", losses="loss", norms="norm",
                         order_by=["ts", "event_id"], seed=7)
    return runs.select(
        "user_id", F.round("duration_s", 6).alias("duration_s"), "depth", "encounters",
        *[off_tie(f"{p}_{s}").alias(f"{p}_{s}") for p in ("hp", "xp") for s in ("mean", "var")], "hp_count", "xp_count",
        F.col("grad_loss_stats.loss_count").alias("loss_count"),
        off_tie("grad_loss_stats.loss_mean").alias("loss_mean"), "timestamp", "seed", off_tie("grad_norm_stats.norm_mean").alias("norm_mean"),
        F.size("grad_norm_last").cast("bigint").alias("norm_sample"), F.round(F.element_at("grad_norm_last", -1), 6).alias("norm_last"))


@query(RUN_METRICS_SQL)
def run_metrics(spark, sf_dir):
    return user_metrics(spark, sf_dir)


@query("""
select event_type, round(sum(abs(value::DECIMAL(28,10) - case when event_id % 3 = 0 then value + 1 else value end::DECIMAL(28,10)))::DOUBLE, 4) as l1
from events group by event_type""")
def l1_by_type(spark, sf_dir):
    before = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    after = before.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return S.l1_distance(before, after, "event_id", "value", by="event_type", scale=10).withColumn("l1", F.round("l1", 4))


@query("""
with s as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::DOUBLE * 20 as x
           from embeddings),
     e as (select *, exp(x - max(x) over (partition by vec_id)) as e from s),
     f as (select *, greatest(1e-12, e / sum(e) over (partition by vec_id)) as f from e),
     p as (select *, f / sum(f) over (partition by vec_id) as p from f)
select round(avg(-ln(p)), 6) as log_loss from p where pos = label""")
def log_loss(spark, sf_dir):
    probs = read(spark, sf_dir, "embeddings").select(
        "label", P.softmax_array(F.transform("embedding", lambda x: x.cast("double") * 20)).alias("probs"))
    loss = S.log_loss(probs, F.element_at("probs", F.col("label").cast("int") + 1))
    return loss.select(F.round("log_loss", 6).alias("log_loss"))


WIDE_SQL = """(select event_id, event_type, value * (case event_id % 3 when 0 then 1.0007e-9 when 1 then 1e6 else 1e13 end)::DOUBLE as value from events)"""


def _wide(spark, sf_dir):
    """Values over 22 orders of size, by the event's id."""
    m = F.col("event_id") % 3
    size = F.when(m == 0, 1.0007e-9).when(m == 1, 1e6).otherwise(1e13)
    return read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") * size).alias("value"))


@query(f"""
select event_type, size, count(value) as n, 0::BIGINT as n_bad, round(sum(value::DECIMAL(38,10))::DOUBLE / max(value), 6) as sum_share,
       round((sum(value::DECIMAL(38,10))::DOUBLE / count(value)) / max(value), 6) as mean_share,
       round(coalesce(stddev_samp(round(value, 10)), 0) / max(value), 6)::DOUBLE as spread_share
from (select *, event_id % 3 as size from {WIDE_SQL}) group by event_type, size""")
def stats_wide_range(spark, sf_dir):
    """Nothing is left out of n, sum, mean or variance; figures are given as shares of the largest value, of values rounded to ten decimals."""
    wide = _wide(spark, sf_dir).withColumn("size", F.col("event_id") % 3)
    tops = wide.groupBy("event_type", "size").agg(F.max("value").alias("top"))
    stats = S.stable_stats(wide, ["event_type", "size"], "value").join(tops, ["event_type", "size"])
    return stats.select("event_type", "size", "n", "n_bad", F.round(F.col("sum").cast("double") / F.col("top"), 6).alias("sum_share"),
                        F.round(F.col("mean") / F.col("top"), 6).alias("mean_share"), F.round(F.sqrt("var") / F.col("top"), 6).alias("spread_share"))


@query(f"""
select event_id % 3 as size, round(max(value) * sqrt(sum((value / top) * (value / top))) / max(value), 6) as norm_share
from (select *, max(value) over (partition by event_id % 3) as top from {WIDE_SQL}) group by 1""")
def norm_extremes(spark, sf_dir):
    wide = _wide(spark, sf_dir).withColumn("size", F.col("event_id") % 3)
    tops = wide.groupBy("size").agg(F.max("value").alias("top"))
    return S.global_norm(wide, "size", "value").join(tops, "size").select("size", F.round(F.col("norm") / F.col("top"), 6).alias("norm_share"))


@query("""
select event_type, case when event_type in ('click', 'view') then 'nan'::DOUBLE else round(count(*)::DOUBLE, 4) end as l1 from events group by event_type""")
def l1_extremes(spark, sf_dir):
    """Groups that hold NaN, or values too large to compare, have no distance; the others have theirs."""
    before = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    shifted = (F.when(F.col("event_type") == "click", float("nan")).when(F.col("event_type") == "view", F.col("value") * 1e18)
               .otherwise(F.col("value") + 1))
    return S.l1_distance(before, before.withColumn("value", shifted), "event_id", "value", by="event_type", scale=10).withColumn("l1", F.round("l1", 4))


@query("select true as endless from embeddings limit 1")
def log_loss_zero(spark, sf_dir):
    """Labels that the one-hot rule gives probability 0 make the loss infinite."""
    probs = read(spark, sf_dir, "embeddings").select(
        "label", P.softmax_array(F.transform("embedding", lambda x: x.cast("double") * 20), 1e-9).alias("probs"))
    loss = S.log_loss(probs, F.element_at("probs", F.col("label").cast("int") + 1))
    return loss.select((F.col("log_loss") == float("inf")).alias("endless"))

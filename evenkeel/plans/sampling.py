"""Keyed draws and samples."""

from pyspark.sql import functions as F

from ..functions import draws as SM
from ..functions import scalars as P
from ..operators import sampling as S
from .registry import ORDER, SQL_BAD_VALUES, off_tie, query, read, sql_uniform, sql_uniform_int, with_bad_values

SEED = 7


@query(f"""
select event_id, {sql_uniform(SEED, "env", "event_id")} as u, {sql_uniform_int("0", "6", SEED, "env", "event_id")} as k,
       {sql_uniform_int("0", "user_id + 5", SEED, "hit", "event_id")} as k_col,
       round(sqrt(-2 * ln(1 - {sql_uniform(SEED, "noise/radius", "event_id")}))
             * cos(2 * pi() * {sql_uniform(SEED, "noise/angle", "event_id")}), 9) as z
from events""")
def keyed_draws(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        "event_id", SM.uniform(SEED, "env", "event_id").alias("u"), SM.uniform_int(0, 6, SEED, "env", "event_id").alias("k"),
        SM.uniform_int(0, F.col("user_id") + 5, SEED, "hit", "event_id").alias("k_col"),
        F.round(SM.normal(SEED, "noise", "event_id"), 9).alias("z"))


@query(f"""
select event_id, user_id, value from events
where value >= 0 and {sql_uniform(SEED, "promote", "event_id")} < 0.05""")
def promote_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return S.promote(events, "event_id", 0.05, where=F.col("value") >= 0, seed=SEED)


TYPE_COUNTS_SQL = "(select user_id, event_type, count(*) as w from events group by user_id, event_type)"


def _type_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("w"))


@query(f"""
select user_id, event_type, round(sum(w) over (partition by user_id order by event_type)::DOUBLE
       / sum(w) over (partition by user_id)::DOUBLE, 9) as cdf from {TYPE_COUNTS_SQL}""")
def running_cdf(spark, sf_dir):
    return S.running_cdf(_type_counts(spark, sf_dir), "user_id", "event_type", "w").select(
        "user_id", "event_type", F.round("cdf", 9).alias("cdf"))


@query(f"""
with c as (select user_id, event_type, sum(w) over (partition by user_id order by event_type)::DOUBLE
                  / sum(w) over (partition by user_id)::DOUBLE as cdf from {TYPE_COUNTS_SQL})
select user_id, min(event_type) as event_type from c where {sql_uniform(SEED, "policy", "user_id")} < cdf group by user_id""")
def sample_categorical(spark, sf_dir):
    return S.sample_categorical(_type_counts(spark, sf_dir), "user_id", "event_type", "w", seed=SEED)


@query(f"""
with b as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as position
           from events),
     n as (select user_id, count(*) as n from events group by user_id having count(*) >= 32),
     d as (select user_id, draw, {sql_uniform_int("0", "n", SEED, "train", "user_id", "draw")} as position
           from n, generate_series(0, 31) as g(draw))
select user_id, draw::INTEGER as draw, position, event_id, value from d join b using (user_id, position)""")
def minibatch_per_user(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return S.minibatch(events, "user_id", ORDER, 32, seed=SEED).select("user_id", "draw", "position", "event_id", "value")


@query(f"""
select event_id, case when isfinite(value) then value else round(1e-3 *
       sqrt(-2 * ln(1 - {sql_uniform(SEED, "value/radius", "event_id")}))
       * cos(2 * pi() * {sql_uniform(SEED, "value/angle", "event_id")}), 9) end as value
from {SQL_BAD_VALUES}""")
def imputed_noise(spark, sf_dir):
    events = with_bad_values(read(spark, sf_dir, "events"))
    return events.select("event_id", F.when(P.is_finite("value"), F.col("value")).otherwise(
        F.round(P.noise_impute("value", SEED, "event_id"), 9)).alias("value"))


@query("""
select p_partkey, round(p_size / greatest(1, p_retailprice), 6) as f0, round(p_retailprice / greatest(1, 10.0 * greatest(1, p_size)) + 3e-7, 4) as f1,
       round(p_size / 50.0, 6) as f2, round(least(100, 1 + 0.5 * ln(1 + p_partkey::DOUBLE)) / 10, 6) as f3,
       round(p_retailprice / 200 + 3e-7, 4) as f4, round(p_size / 50.0, 6) as f5 from part""")
def actor_features(spark, sf_dir):
    """The feature vectors on the sizes and prices of parts."""
    parts = read(spark, sf_dir, "part").withColumn("difficulty", P.log_depth("p_partkey"))
    both = F.concat(P.actor_features("p_size", "p_retailprice", "p_retailprice", "p_size"), P.opponent_features("difficulty", "p_retailprice", "p_size"))
    return parts.select("p_partkey", both.alias("f")).select(
        "p_partkey", *[(off_tie(F.element_at("f", i + 1)) if i in (1, 4) else F.round(F.element_at("f", i + 1), 6)).alias(f"f{i}") for i in range(6)])


@query("""
select user_id, event_id, value from (
    select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1""")
def argmax_by_user(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return S.argmax_by(events, "user_id", "event_id", "value")


@query(f"""
with w as (select user_id, event_id, case when event_id % 3 = 0 then 1e-12 else 1e-12 * (1 + event_id % 5) end::DOUBLE as w from events),
     c as (select user_id, event_id, round(sum(w * 1e12) over (partition by user_id order by event_id)) as run,
                  round(sum(w * 1e12) over (partition by user_id)) as total from w)
select user_id, min(event_id) as event_id from c where {sql_uniform(SEED, "tiny", "user_id")} < run / total group by user_id""")
def categorical_tiny_weights(spark, sf_dir):
    """Weights of a trillionth are drawn like any others."""
    weight = F.when(F.col("event_id") % 3 == 0, F.lit(1e-12)).otherwise(F.lit(1e-12) * (1 + F.col("event_id") % 5))
    events = read(spark, sf_dir, "events").select("user_id", "event_id", weight.alias("w"))
    return S.sample_categorical(events, "user_id", "event_id", "w", seed=SEED, domain="tiny")

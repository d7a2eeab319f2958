"""State folds."""

from pyspark.sql import functions as F

from ..operators import folds as D
from .registry import ORDER, query, read

SIGNED_SQL = "(case when event_id % 2 = 0 then value else -value end)"


def signed_events(spark, sf_dir):
    value = F.col("value")
    signed = F.when(F.col("event_id") % 2 == 0, value).otherwise(-value)
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", signed.alias("delta"),
                                                (signed / 20).alias("d_hp"), (value / 20).alias("d_xp"))


CLAMPED_SQL = f"""
select user_id, round(list_reduce(list({SIGNED_SQL}::DECIMAL(38,6) order by ts, event_id),
    lambda a, x: least(500::DECIMAL(38,6), greatest(0::DECIMAL(38,6), (a + x)::DECIMAL(38,6))), 100::DECIMAL(38,6))::DOUBLE, 4) as state,
    count(*) as n_steps from events group by user_id"""


def _rounded(folded):
    return folded.select("user_id", F.round(F.col("state").cast("double"), 4).alias("state"), "n_steps")


@query(CLAMPED_SQL)
def clamped_fold(spark, sf_dir):
    return _rounded(D.clamped_fold(signed_events(spark, sf_dir), "user_id", ORDER, "delta", 0, 500, 100))


@query(CLAMPED_SQL)
def clamped_fold_blocks(spark, sf_dir):
    """The same fold with small blocks, as a large key would be folded."""
    return _rounded(D.clamped_fold(signed_events(spark, sf_dir), "user_id", ORDER, "delta", 0, 500, 100, block_rows=16))


LEVEL_CTE = f"""
with recursive e as (
    select user_id, event_id, ({SIGNED_SQL} / 20)::DECIMAL(28,6)::DOUBLE as dh, (value / 20)::DECIMAL(28,6)::DOUBLE as dx,
           row_number() over (partition by user_id order by ts, event_id) as rn from events),
steps as (
    select user_id, -1::BIGINT as event_id, 0::BIGINT as rn, 30::DOUBLE as hp, 30::DOUBLE as max_hp, 0::DOUBLE as xp, 1::BIGINT as level
    from (select distinct user_id from events)
    union all
    select user_id, event_id, rn, moved + case when up then 5 else 0 end, max_hp + case when up then 5 else 0 end, xp,
           level + case when up then 1 else 0 end
    from (select s.user_id, e.event_id, e.rn, least(s.max_hp, greatest(0, s.hp + e.dh)) as moved, s.max_hp, s.level,
                 least(1e12, s.xp + e.dx) as xp, round(least(1e12, s.xp + e.dx), 6) >= 10 * s.level as up
          from steps s join e on e.user_id = s.user_id and e.rn = s.rn + 1))"""


@query(f"""{LEVEL_CTE}
select user_id, round(max(hp), 4) as hp, max(max_hp) as max_hp, round(max(xp), 4) as xp, max(level) as level, max(rn) as n_steps,
       round(least(max(max_hp), max(hp) + trunc(0.1::DOUBLE * max(max_hp))), 4) as hp_recovered
from steps join (select user_id, count(*) as last from events group by user_id) using (user_id)
where rn = last group by user_id""")
def level_fold(spark, sf_dir):
    final = D.level_fold(signed_events(spark, sf_dir), "user_id", ORDER, "d_hp", "d_xp")
    final = final.withColumns({"hp": F.col("hp").cast("double"), "before": F.col("hp").cast("double")})
    return D.recover_all(final).select(
        "user_id", F.round("before", 4).alias("hp"), "max_hp", F.round(F.col("xp").cast("double"), 4).alias("xp"), "level",
        F.col("n_steps").cast("bigint").alias("n_steps"), F.round("hp", 4).alias("hp_recovered"))


@query(f"""{LEVEL_CTE}
select user_id, event_id, round(hp, 4) as hp, max_hp, round(xp, 4) as xp, level from steps where rn > 0""")
def level_history(spark, sf_dir):
    steps = D.level_history(signed_events(spark, sf_dir), "user_id", ORDER, "d_hp", "d_xp")
    return steps.select("user_id", "event_id", F.round("hp", 4).alias("hp"), "max_hp",
                        F.round(F.col("xp").cast("double"), 4).alias("xp"), "level")

"""Row-local expressions, record shapes and artifacts."""

from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.tokens import canonical_token
from ..operators import quality as Q
from ..operators import records as R
from ..operators.statistics import canonical_order
from ..session import work_path
from ..sources.artifacts import read_artifact, write_json_artifact
from ..sources.traces import read_trace, write_trace
from .ordering import SHARDS_SQL
from .registry import ORDER, SQL_BAD_VALUES, query, read, with_bad_values
from .statistics import RUN_METRICS_SQL, user_metrics


@query("""
select o_orderkey, substr(sha256(o_orderkey::VARCHAR), 1, 32) as stable_id, substr(sha1(o_orderpriority), 1, 12) as short_id
from orders""")
def stable_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", P.stable_id("o_orderkey").alias("stable_id"),
                                                P.short_id("o_orderpriority").alias("short_id"))


@query("""
select page_id, substr(split_part(url, '/', -1), 1, 200) || '_' || substr(sha1(url), 1, 12) as artifact from pages""")
def sanitized_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", P.sanitize_path("url").alias("artifact"))


@query("""
select event_id, round(least(100, 1 + 0.5 * ln(1 + event_id::DOUBLE)), 6) as difficulty,
       greatest(0.5, 1 - 0.005::DOUBLE * event_id)::DOUBLE as temperature from events""")
def depth_schedule(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(P.log_depth("event_id"), 6).alias("difficulty"),
                                                P.temperature("event_id").alias("temperature"))


@query("select c_custkey, round(c_acctbal / greatest(1, c_nationkey), 6) as ratio from customer")
def ratio_features(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(P.ratio_feature("c_acctbal", "c_nationkey"), 6).alias("ratio"))


@query(f"""
select event_id, isfinite(value) as finite, case when isnan(value) then -1e9 when value = 'inf'::DOUBLE then 1e9
       when value = '-inf'::DOUBLE then -1e9 else value end::DOUBLE as replaced,
       least(100, greatest(10, case when isnan(value) then -1e9 else value end))::DOUBLE as clamped
from {SQL_BAD_VALUES}""")
def nonfinite_clean(spark, sf_dir):
    return with_bad_values(read(spark, sf_dir, "events")).select(
        "event_id", P.is_finite("value").alias("finite"), P.replace_nonfinite("value").alias("replaced"),
        P.clamp(P.replace_nonfinite("value"), 10.0, 100.0).alias("clamped"))


VOCAB = ("click", "view", "purchase", "signup")


@query("""
select event_id, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 end::INTEGER as code,
       case when event_type in ('click', 'view', 'purchase', 'signup') then event_type end as label from events""")
def encode_types(spark, sf_dir):
    coded = read(spark, sf_dir, "events").select("event_id", P.encode_category("event_type", VOCAB).alias("code"))
    return coded.withColumn("label", P.decode_category("code", VOCAB))


@query("""
select event_id, 'Event ' || event_id::VARCHAR || ' | ' || event_type || ' user=' || user_id::VARCHAR || ' whole='
       || trunc(value)::BIGINT::VARCHAR || ' share=' || printf('%.6f', (value / 1000)) as line from events""")
def log_lines(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", P.format_line(
        "Event %d | %s user=%d whole=%d share=%.6f", "event_id", "event_type", "user_id", P.whole("value"),
        F.col("value") / 1000).alias("line"))


@query("""
select vec_id, 'float:' || len(embedding)::VARCHAR || ';'
       || array_to_string(list_transform(embedding, lambda x: x::DOUBLE::DECIMAL(38,4)::VARCHAR), ',') as token from embeddings""")
def canonical_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", canonical_token(F.col("embedding"), rows.schema["embedding"].dataType, 4).alias("token"))


@query("""
select event_id, '{"__type__":"timestamp_ntz"}' as ts, '{"__type__":"bigint"}' as user_id, event_type, value,
       '{"__type__":"string"}' as props from events""")
def redacted_events(spark, sf_dir):
    return R.redact(read(spark, sf_dir, "events"), ["event_id", "event_type", "value", "ts"])


@query("""
select event_id, event_type as shown_type, '{"__type__":"bigint"}' as shown_user, value as deep_value, '{"__type__":"timestamp_ntz"}' as deep_ts,
       [value, -value] as marks, '{"__type__":"array<struct<user_id:bigint>>"}' as owners, event_type || '=' || value::VARCHAR as entries from events""")
def redacted_nested(spark, sf_dir):
    """Structs in structs, arrays and maps: names and types are applied at every depth."""
    deep = F.struct("value", "ts").alias("deep")
    events = read(spark, sf_dir, "events").select(
        "event_id", F.struct("event_type", "user_id", deep).alias("record"), F.array(F.col("value"), -F.col("value")).alias("marks"),
        F.array(F.struct("user_id")).alias("owners"), F.create_map(F.lit("value"), F.struct("event_type", "value"), F.lit("who"), F.struct("event_type", "value")).alias("attributes"))
    shown = R.redact_nested(events, ["event_id", "record", "deep", "event_type", "value", "ts", "marks", "attributes"])
    entry = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["value"]["event_type"], e["value"]["value"]))
    return shown.select("event_id", F.col("record.event_type").alias("shown_type"), F.col("record.user_id").alias("shown_user"), F.col("record.deep.value").alias("deep_value"),
                        F.col("record.deep.ts").alias("deep_ts"), "marks", "owners", F.array_join(entry, ";").alias("entries"))


@query("""
select l_orderkey, l_linenumber, dense_rank() over (order by l_extendedprice) - 1 as code from lineitem""")
def learned_codes_many(spark, sf_dir):
    """Codes of a column in which most values are distinct."""
    return R.encode_learned(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").drop("l_extendedprice")


@query("select event_id, user_id, event_type, value from events")
def nested_roundtrip(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    nested = R.nested_record(events, {"pre": ["user_id", "event_type"], "post": ["value"]})
    schema = nested.select("pre", "post").schema
    text = nested.select("event_id", F.to_json(F.struct("pre", "post")).alias("doc"))
    back = text.select("event_id", F.from_json("doc", schema).alias("r")).select("event_id", "r.pre", "r.post")
    return R.flatten_record(back, ["pre", "post"])


@query("""
select event_id, case when props like '%"k"%' then '' else 'k,' end || 'source' as missing from events""")
def missing_keys(spark, sf_dir):
    return Q.missing_keys(read(spark, sf_dir, "events"), "props", ["k", "source"]).select(
        "event_id", F.array_join("missing", ",").alias("missing"))


@query("""
select event_id, dense_rank() over (order by event_type) - 1 as code from events""")
def learned_codes(spark, sf_dir):
    """Codes of a vocabulary that is read from the column itself."""
    return R.encode_learned(read(spark, sf_dir, "events"), "event_type").select("event_id", F.col("code").cast("bigint").alias("code"))


@query("""
select o_orderkey, o_orderpriority || '=' || o_orderstatus || ';status=' || o_orderstatus as entries from orders""")
def sorted_map_entries(spark, sf_dir):
    """Entries of a map column in the order of their keys, however the map was built."""
    pairs = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderstatus"))
    ordered = canonical_order(F.map_entries(pairs))
    text = F.array_join(F.transform(ordered, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("entries"))


@query(RUN_METRICS_SQL)
def artifact_roundtrip(spark, sf_dir):
    metrics, path = user_metrics(spark, sf_dir), work_path(spark, "artifact")
    write_json_artifact(metrics, path)
    return read_artifact(spark, path, metrics.schema)


@query(SHARDS_SQL)
def trace_roundtrip(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    path = work_path(spark, "trace")
    write_trace(events, path, "user_id", ORDER, seed=7, n=16)
    return read_trace(spark, path, events.schema, seeds=[7]).groupBy("user_id", "shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))

"""Fingerprints, comparisons, snapshots and quality checks."""

from pyspark.sql import functions as F

from ..functions.accumulators import exact_sum
from ..functions.draws import bernoulli
from ..functions.tokens import row_fingerprint as row_hash
from ..operators import compare as J
from ..operators import fingerprint as H
from ..operators import quality as Q
from ..operators.statistics import stable_stats
from ..session import work_path
from ..sources import snapshots as N
from .registry import query, read, sql_uniform

SEED = 7

ORDERS_ROW = """sha256(concat_ws(chr(31), 'o_custkey', o_custkey::VARCHAR, 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'),
    'o_orderkey', o_orderkey::VARCHAR, 'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus,
    'o_totalprice', o_totalprice::DECIMAL(38,4)::VARCHAR))"""
NO_STATUS_ROW = ORDERS_ROW.replace(" 'o_orderstatus', o_orderstatus,", "")
LINEITEM_ROW = """sha256(concat_ws(chr(31), 'l_discount', l_discount::DECIMAL(38,4)::VARCHAR,
    'l_extendedprice', l_extendedprice::DECIMAL(38,4)::VARCHAR, 'l_linenumber', l_linenumber::VARCHAR, 'l_linestatus', l_linestatus,
    'l_orderkey', l_orderkey::VARCHAR, 'l_partkey', l_partkey::VARCHAR, 'l_quantity', l_quantity::DECIMAL(38,4)::VARCHAR,
    'l_returnflag', l_returnflag, 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f'), 'l_suppkey', l_suppkey::VARCHAR,
    'l_tax', l_tax::DECIMAL(38,4)::VARCHAR))"""


def _number(digest: str) -> str:
    return f"('0x' || substr({digest}, 1, 15))::BIGINT::DECIMAL(28,0)"


@query(f"select o_orderkey, {ORDERS_ROW} as fingerprint from orders")
def row_fingerprints(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", row_hash(orders, scale=4).alias("fingerprint"))


def _table_sql(name: str, row: str) -> str:
    return f"select count(*) as n_rows, sum({_number('h')})::VARCHAR as hash_sum from (select {row} as h from {name})"


def _text(fingerprint):
    return fingerprint.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query(f"""select *, sha256('o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:double')
as schema_hash from ({_table_sql("orders", ORDERS_ROW)})""")
def table_fingerprint(spark, sf_dir):
    return _text(H.table_fingerprint(read(spark, sf_dir, "orders"), scale=4))


@query(_table_sql("lineitem", LINEITEM_ROW))
def lineitem_fingerprint(spark, sf_dir):
    return _text(H.table_fingerprint(read(spark, sf_dir, "lineitem"), scale=4)).drop("schema_hash")


GROUPED_SQL = f"""select o_orderstatus, count(*) as n_rows, sum({_number('h')})::VARCHAR as hash_sum
from (select o_orderstatus, {NO_STATUS_ROW} as h from orders) group by o_orderstatus"""


@query(GROUPED_SQL)
def grouped_fingerprint(spark, sf_dir):
    return _text(H.grouped_fingerprint(read(spark, sf_dir, "orders"), "o_orderstatus", scale=4))


@query(f"""select count(*) as n_rows, sum({_number("h")})::VARCHAR as hash_sum from (
    select sha256(concat_ws(chr(31), 'hash_sum', hash_sum, 'n_rows', n_rows::VARCHAR, 'o_orderstatus', o_orderstatus)) as h
    from ({GROUPED_SQL}))""")
def nested_fingerprint(spark, sf_dir):
    return _text(H.nested_fingerprint(read(spark, sf_dir, "orders"), "o_orderstatus", scale=4)).drop("schema_hash")


@query(f"""
with edited as (
    select o_orderkey, case when {sql_uniform(SEED, "edit", "o_orderkey")} < 0.03 then 'changed' else 'same' end as status from orders
    where {sql_uniform(SEED, "drop", "o_orderkey")} >= 0.02)
select o_orderkey, coalesce(e.status, 'removed') as status from orders left join edited e using (o_orderkey)
union all
select -o_orderkey - 1, 'added' from orders where {sql_uniform(SEED, "add", "o_orderkey")} < 0.01""")
def snapshot_diff(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    edited = orders.filter(~bernoulli(0.02, SEED, "drop", "o_orderkey")).withColumn(
        "o_totalprice", F.when(bernoulli(0.03, SEED, "edit", "o_orderkey"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = orders.filter(bernoulli(0.01, SEED, "add", "o_orderkey")).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return J.snapshot_diff(orders, edited.unionByName(added), "o_orderkey")


def _saved(spark, sf_dir, mode):
    root = work_path(spark, "snapshot")
    tables = {n: read(spark, sf_dir, n) for n in ("orders", "customer")}
    N.save_snapshot(tables, root, 1, mode, seed=SEED)
    return root, tables


@query("""
select 1::BIGINT as v, 'orders' as table_name, 'ok' as status, count(*) as n_rows, 'compressed' as mode, true as equal from orders
union all select 1, 'customer', 'ok', count(*), 'compressed', true from customer""")
def snapshot_roundtrip(spark, sf_dir):
    """Save, list, verify and load; the loaded tables equal the given ones."""
    root, tables = _saved(spark, sf_dir, "compressed")
    loaded = N.load_snapshot(spark, root)
    rows = None
    for name, df in tables.items():
        given, found = H.table_fingerprint(df), H.table_fingerprint(loaded[name])
        both = given.unionByName(found).agg((F.count_distinct("hash_sum", "n_rows", "schema_hash") == 1).alias("equal"))
        row = both.withColumn("table_name", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    status = N.check_snapshot(spark, root, 1).select(F.col("table").alias("table_name"), "status")
    listed = N.list_snapshots(spark, root).select("v", F.col("table").alias("table_name"), "n_rows", "mode")
    return listed.join(status, "table_name").join(rows, "table_name").select("v", "table_name", "status", "n_rows", "mode", "equal")


@query("""
select 'orders' as tampered, 'orders' as table_name, 'changed' as status, true as refused union all
select 'orders', 'customer', 'ok', true union all
select 'customer', 'orders', 'ok', true union all
select 'customer', 'customer', 'changed', true""")
def tamper_check(spark, sf_dir):
    """Edit one value of each stored table in turn: the check must name it and the load must refuse it."""
    edits = {"orders": ("o_totalprice", "o_orderkey"), "customer": ("c_acctbal", "c_custkey")}
    out = None
    for name, (column, key) in edits.items():
        root, tables = _saved(spark, sf_dir, "light")
        first = tables[name].agg(F.min(key).alias("__first"))
        edited = tables[name].join(F.broadcast(first), F.col(key) == F.col("__first"), "left").withColumn(
            column, F.col(column) + F.when(F.col("__first").isNotNull(), 1.0).otherwise(0.0)).drop("__first")
        edited.write.mode("overwrite").parquet(N.part_paths(root, N.read_manifest(spark, root, 1), name)[0])
        try:
            N.load_snapshot(spark, root)
            refused = False
        except N.SnapshotMismatch:
            refused = True
        status = N.check_snapshot(spark, root, 1).select(
            F.lit(name).alias("tampered"), F.col("table").alias("table_name"), "status", F.lit(refused).alias("refused"))
        out = status if out is None else out.unionByName(status)
    return out


SLICES = 6
SLICE_SQL = f"(event_id % {SLICES})"


def _appended(spark, sf_dir, max_parts):
    """Events arriving in slices, a version for each."""
    root = work_path(spark, "appended")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    for part in range(SLICES):
        N.append_snapshot({"events": events.filter(F.col("event_id") % SLICES == part)}, root, part, max_parts=max_parts)
    return root, events


@query(f"""
with s as (select {SLICE_SQL} as v, count(*) as n from events group by 1),
small as (select sum(n) as n from (select n from s where v < 4 order by n, v limit 2))
select v::BIGINT as v, (sum(n) over (order by v))::BIGINT as n_rows, (n + case when v = 4 then (select n from small) else 0 end)::BIGINT as n_written,
       'ok' as status, (case when v < 4 then v + 1 else v - 1 end)::BIGINT as n_parts
from s""")
def incremental_snapshots(spark, sf_dir):
    """Each version writes its own slice; the fifth finds four parts and takes in the two smallest. All verify."""
    root, _ = _appended(spark, sf_dir, max_parts=4)
    listed = N.list_snapshots(spark, root).withColumn("mine", F.col("part").startswith(F.concat(F.lit("v="), F.col("v"), F.lit("/"))))
    sizes = listed.groupBy("v").agg(F.sum("n_rows").alias("n_rows"), F.sum(F.when(F.col("mine"), F.col("n_rows"))).alias("n_written"), F.count("*").alias("n_parts"))
    checks = None
    for v in range(SLICES):
        row = N.check_snapshot(spark, root, v).select(F.lit(v).cast("bigint").alias("v"), "status")
        checks = row if checks is None else checks.unionByName(row)
    return sizes.join(checks, "v").select("v", "n_rows", "n_written", "status", "n_parts")


@query(f"""
select v::BIGINT as v, n_rows::BIGINT as n_rows, true as loads, {SLICES - 2}::BIGINT as n_gone, true as equal from (
  select {SLICE_SQL} as v, sum(count(*)) over (order by {SLICE_SQL}) as n_rows from events group by 1) where v >= {SLICES - 2}""")
def snapshot_pruning(spark, sf_dir):
    """After the newest two versions are kept they still load in full, and nothing else is left; the newest equals the events."""
    root, events = _appended(spark, sf_dir, max_parts=16)
    gone = N.prune_snapshots(spark, root, keep=2)
    out = None
    for v in (SLICES - 2, SLICES - 1):
        held = N.load_snapshot(spark, root, v)["events"]
        want = events.filter(F.col("event_id") % SLICES <= v)
        same = H.table_fingerprint(held).unionByName(H.table_fingerprint(want)).agg(
            (F.count_distinct("hash_sum", "n_rows", "schema_hash") == 1).alias("equal"), F.max("n_rows").alias("n_rows"))
        row = same.select(F.lit(v).cast("bigint").alias("v"), "n_rows", F.lit(True).alias("loads"), F.lit(len(gone)).cast("bigint").alias("n_gone"), "equal")
        out = row if out is None else out.unionByName(row)
    return out.join(N.list_snapshots(spark, root).select("v").distinct(), "v").select("v", "n_rows", "loads", "n_gone", "equal")


def _edited_orders(orders):
    edited = orders.filter(~bernoulli(0.02, SEED, "drop", "o_orderkey")).withColumn(
        "o_totalprice", F.when(bernoulli(0.03, SEED, "edit", "o_orderkey"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return edited.unionByName(orders.filter(bernoulli(0.01, SEED, "add", "o_orderkey")).withColumn("o_orderkey", -F.col("o_orderkey") - 1))


@query(f"""
with edited as (
    select o_orderkey, case when {sql_uniform(SEED, "edit", "o_orderkey")} < 0.03 then 'changed' else 'same' end as status from orders
    where {sql_uniform(SEED, "drop", "o_orderkey")} >= 0.02)
select o_orderkey, coalesce(e.status, 'removed') as status from orders left join edited e using (o_orderkey) where coalesce(e.status, 'removed') <> 'same'
union all
select -o_orderkey - 1, 'added' from orders where {sql_uniform(SEED, "add", "o_orderkey")} < 0.01""")
def snapshot_tree_diff(spark, sf_dir):
    """The differing keys of two versions, through their trees."""
    root, orders = work_path(spark, "trees"), read(spark, sf_dir, "orders")
    N.save_snapshot({"orders": orders}, root, 1, keys={"orders": "o_orderkey"}, depth=1)
    N.save_snapshot({"orders": _edited_orders(orders)}, root, 2, keys={"orders": "o_orderkey"}, depth=1)
    return N.diff_snapshots(spark, root, 1, 2, "orders")


@query("""
select o_orderkey, 'changed' as status, true as reads_little from (select o_orderkey from orders order by o_orderkey limit 10)""")
def tree_diff_of_few(spark, sf_dir):
    """Ten changed rows: under a twentieth of the table is read to find them."""
    root, orders = work_path(spark, "trees"), read(spark, sf_dir, "orders")
    few = orders.select("o_orderkey").orderBy("o_orderkey").limit(10).withColumn("__few", F.lit(True))
    changed = orders.join(F.broadcast(few), "o_orderkey", "left").withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(F.col("__few"), 1.0).otherwise(0.0)).drop("__few")
    for version, table in ((1, orders), (2, changed)):
        N.save_snapshot({"orders": table}, root, version, keys={"orders": "o_orderkey"}, depth=2)
    rows_read = N.differing_rows(spark, root, 1, 2, "orders", 2).count()
    return N.diff_snapshots(spark, root, 1, 2, "orders").withColumn("reads_little", F.lit(20 * rows_read < orders.count()))


@query(f"""
select 'added' as part, count(*) as n_rows, round(sum(o_totalprice::DECIMAL(28,10))::DOUBLE, 4) as total from orders where {sql_uniform(SEED, "add", "o_orderkey")} < 0.01
union all select 'removed', count(*), round(sum(o_totalprice::DECIMAL(28,10))::DOUBLE, 4) from orders where {sql_uniform(SEED, "drop", "o_orderkey")} < 0.02
union all select 'kept', count(*), round(sum((o_totalprice + case when {sql_uniform(SEED, "edit", "o_orderkey")} < 0.03 then 1 else 0 end)::DECIMAL(28,10))::DOUBLE, 4)
from orders where {sql_uniform(SEED, "drop", "o_orderkey")} >= 0.02""")
def diff_shortcuts(spark, sf_dir):
    """Added, removed and kept rows by semi and anti joins on the key alone."""
    orders = read(spark, sf_dir, "orders")
    edited = _edited_orders(orders)
    found = {"added": J.added_rows, "removed": J.removed_rows, "kept": J.kept_rows}
    out = None
    for name, rows_of in found.items():
        part = rows_of(orders, edited, "o_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.round(exact_sum("o_totalprice").cast("double"), 4).alias("total"))
        part = part.select(F.lit(name).alias("part"), "n_rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


RULES = {
    "quantity_positive": "l_quantity > 0", "discount_in_range": "l_discount between 0 and 0.05",
    "tax_finite": "isfinite(l_tax)", "flag_known": "l_returnflag in ('A', 'N', 'R')"}


@query(" union all ".join(
    f"select '{n}' as rule, count(*) filter (not ({r})) as n_bad, count(*) filter (not ({r})) = 0 as ok from lineitem"
    for n, r in RULES.items()))
def invariants(spark, sf_dir):
    from ..functions.scalars import is_finite

    rules = {n: is_finite("l_tax") if n == "tax_finite" else F.expr(r) for n, r in RULES.items()}
    return Q.invariant_report(read(spark, sf_dir, "lineitem"), rules)


PATTERNS = (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"(?i)secret", r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


@query(" union all ".join(
    f"select '{c}' as column_name, '{p}' as pattern, count(*) filter (regexp_matches({c}, '{p}')) as n_rows, "
    f"count(*) filter (regexp_matches({c}, '{p}')) = 0 as clean from documents"
    for c in ("text", "lang", "source") for p in PATTERNS))
def leak_scan(spark, sf_dir):
    return Q.leak_scan(read(spark, sf_dir, "documents"), PATTERNS, {PATTERNS[0]: "@", PATTERNS[2]: "-"})


LAYOUTS = (1, 2, 3)


@query("""
select unnest([1, 2, 3])::INTEGER as layout, count(distinct event_type) as n_rows, true as same from events""")
def determinism_audit(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "value")
    return Q.determinism_audit(lambda df: stable_stats(df, "event_type", "value"), events, LAYOUTS).select("layout", "n_rows", "same")


@query(f"""
select unnest(['as_is', 'columns_reversed', 'rows_dealt']) as variant, n_rows, hash_sum, true as same from ({_table_sql("orders", ORDERS_ROW)})""")
def order_invariance(spark, sf_dir):
    return _text(Q.order_invariance(read(spark, sf_dir, "orders"), scale=4))


@query("select count(distinct user_id) as n_rows, '' as missing from events")
def required_columns(spark, sf_dir):
    """The metric table has the keys a metrics record must have."""
    from .statistics import user_metrics

    metrics = user_metrics(spark, sf_dir)
    missing = Q.missing_columns(metrics)
    return metrics.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("missing", F.lit(",".join(missing)))

"""Streaming: late rows, replays, rejected updates."""

from conftest import rows
from pyspark.sql import functions as F

from evenkeel.functions.accumulators import all_finite
from evenkeel.operators.sampling import promote
from evenkeel import plans
from evenkeel.session import STATE_CONF, work_path
from evenkeel.sources import files, snapshots
from evenkeel.streaming import guarded, operators, ordered, sinks

SCHEMA = "k bigint, ts timestamp, i bigint, d double"


def batches(spark, parts, start):
    folder = work_path(spark, "test-feed")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        start(spark.readStream.schema(SCHEMA).parquet(folder)).awaitTermination()


def at(second):
    import datetime
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def test_late_rows_are_counted_not_applied(spark):
    out, mark = work_path(spark, "out"), work_path(spark, "mark")
    parts = [[(1, at(5), 5, 2.0), (1, at(3), 3, -50.0), (2, at(1), 1, 1.5)], [(1, at(4), 4, 100.0), (1, at(6), 6, 1.0)]]
    batches(spark, parts, lambda s: sinks.sink_batches(operators.stream_fold(s, "k", "ts", "i", "d", 0, 10, 5), out, mark))
    got = {r["k"]: (r["state"], r["n_steps"], r["n_late"]) for r in sinks.latest_rows(spark, out, "k").collect()}
    assert got == {1: (3.0, 3, 1), 2: (6.5, 1, 0)}


def test_promotion_does_not_depend_on_the_cut(spark):
    data = [(k, at(k % 60), k, 1.0) for k in range(300)]
    out, mark = work_path(spark, "out"), work_path(spark, "mark")
    batches(spark, [data[:40], data[40:]], lambda s: sinks.sink_batches(operators.stream_promote(s, "i", 0.2), out, mark, "append"))
    assert rows(spark.read.parquet(out).drop("batch_id")) == rows(promote(spark.createDataFrame(data, SCHEMA), "i", 0.2))


def test_guarded_update_keeps_the_old_state(spark):
    root, mark = work_path(spark, "root"), work_path(spark, "mark")

    def update(current, batch):
        fresh = batch.groupBy("k").agg(F.sum("d").alias("total"))
        return fresh if current is None else fresh.unionByName(current).groupBy("k").agg(F.sum("total").alias("total"))

    def start(s):
        return guarded.guarded_update(s, root, update, {"finite": all_finite("total")}, mark, loss=F.avg("total"))

    parts = [[(1, at(1), 1, 2.0)], [(1, at(2), 2, float("nan")), (2, at(2), 3, 1.0)], [(1, at(3), 4, 3.0)]]
    batches(spark, parts, start)
    assert [(r["k"], r["total"]) for r in snapshots.load_snapshot(spark, root)["state"].collect()] == [(1, 5.0)]
    status = guarded.update_status(spark, root).orderBy("batch_id").collect()
    assert [(r["accepted"], r["reason"], r["base"]) for r in status] == [(True, None, None), (False, "finite", 0), (True, None, 0)]
    assert status[1]["loss"] != status[1]["loss"] and status[2]["loss"] == 5.0
    assert [r[0] for r in snapshots.list_snapshots(spark, root).select("v").orderBy("v").collect()] == [0, 2]


def test_replayed_batch_gives_the_same_state(spark):
    root = work_path(spark, "root")
    parts = [[(1, at(1), 1, 2.0)], [(1, at(3), 4, 3.0)]]

    def update(current, batch):
        fresh = batch.groupBy("k").agg(F.sum("d").alias("total"))
        return fresh if current is None else fresh.unionByName(current).groupBy("k").agg(F.sum("total").alias("total"))

    # A lost checkpoint makes every batch come again; committed versions are skipped.
    for _ in range(2):
        batches(spark, parts, lambda s, mark=work_path(spark, "mark"): guarded.guarded_update(
            s, root, update, {"finite": all_finite("total")}, mark))
    assert snapshots.load_snapshot(spark, root)["state"].first()["total"] == 5.0


def test_failing_update_is_rejected(spark):
    root, mark = work_path(spark, "root"), work_path(spark, "mark")
    batches(spark, [[(1, at(1), 1, 2.0)]], lambda s: guarded.guarded_update(
        s, root, lambda current, batch: batch.select(F.raise_error(F.lit("no")).cast("double").alias("x")),
        {"finite": all_finite("x")}, mark))
    assert not guarded.update_status(spark, root).first()["accepted"]
    assert snapshots.load_snapshot(spark, root) is None


def test_batch_that_stops_before_its_status_or_manifest(spark):
    """Replays after a stop between manifest and status, and between the data and the manifest of a second run."""
    root = work_path(spark, "root")
    calls = []

    def update(current, batch):
        calls.append(1)
        fresh = batch.groupBy("k").agg(F.sum("d").alias("total"))
        return fresh if current is None else fresh.unionByName(current).groupBy("k").agg(F.sum("total").alias("total"))

    def run():
        batches(spark, [[(1, at(1), 1, 2.0)], [(1, at(3), 4, 3.0)]], lambda s, mark=work_path(spark, "mark"): guarded.guarded_update(
            s, root, update, {"finite": all_finite("total")}, mark, loss=F.avg("total")))

    run()
    before = rows(guarded.update_status(spark, root))
    files.remove(spark, f"{root}/status/batch_id=1")
    snapshots.stage_tables({"state": spark.createDataFrame([(1, 99.0)], "k bigint, total double")}, root, 1)
    assert snapshots.load_snapshot(spark, root, 1)["state"].first()["total"] == 5.0
    run()
    assert len(calls) == 2 and rows(guarded.update_status(spark, root)) == before


def test_periodic_snapshots_add_parts(spark):
    path, root, mark = (work_path(spark, p) for p in ("rows", "root", "mark"))
    parts = [[(k, at(k), k, 1.0)] for k in range(5)]
    batches(spark, parts, lambda s: sinks.periodic_snapshot(s, path, root, mark, every=2))
    assert sinks.snapshot_rest(spark, path, root) == 4 == sinks.snapshot_rest(spark, path, root)
    sizes = {v: [p.n_rows for p in snapshots.read_manifest(spark, root, v).parts] for v in (1, 3, 4)}
    assert sizes == {1: [2], 3: [2, 2], 4: [2, 2, 1]}
    assert rows(snapshots.load_snapshot(spark, root)["rows"].drop("batch_id")) == rows(spark.read.parquet(path).drop("batch_id"))


def plain_fold(rows, lo, hi, init):
    state = init
    for _, _, d in sorted(rows):
        state = min(hi, max(lo, state + d))
    return state


def test_composed_steps_equal_the_loop():
    import random

    import numpy as np

    rng = random.Random(3)
    for n in (1, 2, 3, 7, 64, 1001):
        steps = [rng.choice([-40, -7, 0, 3, 11, 5000, -5000]) for _ in range(n)]
        d, lo, hi = ordered.composed(np.array(steps), 0, 100, 200)
        for start in (0, 30, 100):
            assert min(hi, max(lo, start + d)) == plain_fold([(0, i, x) for i, x in enumerate(steps)], 0, 100, start)


def test_rows_out_of_order_within_the_delay(spark):
    """A hot key and a few others, shuffled over files by less than the delay; some rows come too late and are counted."""
    import datetime
    import random

    rng = random.Random(5)
    origin = datetime.datetime(2024, 1, 1)
    made = [(1 if rng.random() < 0.9 else rng.randint(2, 5), origin + datetime.timedelta(seconds=rng.randint(0, 40_000)), i, float(rng.randint(-9, 9))) for i in range(20_000)]
    arrival = {r[2]: (r[1] - origin).total_seconds() + rng.uniform(0, 3500) for r in made}
    files_ = [sorted((r for r in made if lo <= arrival[r[2]] < hi), key=lambda r: rng.random()) for lo, hi in ((0, 9000), (9000, 25_000), (25_000, 10**9))]
    late = [(1, origin + datetime.timedelta(seconds=s), 10**6 + s, 5000.0) for s in range(50)] + [(9, origin, 7, 1.0), (9, None, 8, 1.0)]
    far = [(-1, origin + datetime.timedelta(days=9), 0, 0.0)]
    out, mark = work_path(spark, "out"), work_path(spark, "mark")
    batches(spark, [*files_[:2], files_[2] + late, far], lambda s: sinks.sink_batches(
        ordered.ordered_stream_fold(s, "k", "ts", "i", "d", 0, 60, 30, "1 hour", portion=1000), out, mark))
    got = {r["k"]: (r["state"], r["n_steps"], r["n_late"], r["n_waiting"]) for r in sinks.latest_rows(spark, out, "k").collect() if r["k"] >= 0}
    want = {k: (plain_fold([r[1:] for r in made if r[0] == k], 0, 60, 30), sum(r[0] == k for r in made), 50 if k == 1 else 0, 0) for k in range(1, 6)}
    assert got == want | {9: (30.0, 0, 2, 0)}
    per_batch = spark.read.parquet(out).groupBy("batch_id", "k").count()
    assert per_batch.filter("count > 1").isEmpty()


def test_late_fold_in_a_session_built_elsewhere(spark, sf_dir):
    """A session with Spark's own settings holds stream state in the heap, which cannot hold this fold's."""
    import oracle

    other, plain = spark.newSession(), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    other.conf.set(STATE_CONF, plain)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(name, spark.conf.get(name))
    assert oracle.compare(plans.QUERIES["stream_fold_late"](other, sf_dir), oracle.connect(sf_dir), plans.ORACLES["stream_fold_late"]) == []
    assert other.conf.get(STATE_CONF) == plain


def test_fold_of_many_keys_meets_few_groups(spark):
    """Spark calls the fold once for each group of a micro-batch, so groups may not grow with the keys; late rows, NULLs and text keys as ever."""
    schema = "k string, ts timestamp, i bigint, d double"
    odd = ['a"b', "", None, "é\n", "0"]
    parts = [[(k, at(5), n, 2.0) for n, k in enumerate(odd)] + [(str(n), at(n % 50), n, -1.5) for n in range(2, 300)] + [("a\"b", at(5), 0, 2.0), ("x", None, 1, 3.0)],
             [(None, at(4), 9, 100.0), (None, at(6), None, 1.0), ("", at(6), 1, None), ("0", at(7), 2, 1e30), ("0", at(7), 3, float("nan"))]]
    out, mark, folder = (work_path(spark, p) for p in ("out", "mark", "test-feed"))
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        query = sinks.sink_batches(operators.stream_fold(spark.readStream.schema(schema).parquet(folder), "k", "ts", "i", "d", 0, 10, 5, buckets=3), out, mark)
        query.awaitTermination()
        assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 3
    got = {r["k"]: (r["state"], r["n_steps"], r["n_late"]) for r in sinks.latest_rows(spark, out, "k").collect()}
    want = {str(n): (3.5, 1, 0) for n in range(2, 300)} | {'a"b': (7.0, 1, 1), "é\n": (7.0, 1, 0), None: (8.0, 2, 1), "": (7.0, 2, 0), "0": (10.0, 3, 0), "x": (5.0, 0, 1)}
    assert got == want
    assert spark.read.parquet(out).groupBy("batch_id", "k").count().filter("count > 1").isEmpty()


def test_missing_amounts_move_nothing_in_the_ordered_fold(spark):
    out, mark = work_path(spark, "out"), work_path(spark, "mark")
    parts = [[(1, at(1), 1, 2.0), (1, at(2), 2, None), (1, at(3), 3, float("nan"))], [(-1, at(59), 0, 0.0)]]
    batches(spark, parts, lambda s: sinks.sink_batches(ordered.ordered_stream_fold(s, "k", "ts", "i", "d", 0, 60, 30, "1 second"), out, mark))
    got = {r["k"]: (r["state"], r["n_steps"], r["n_waiting"]) for r in sinks.latest_rows(spark, out, "k").collect()}
    assert got[1] == (32.0, 3, 0)

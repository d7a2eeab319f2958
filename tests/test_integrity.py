"""Fingerprints, snapshots, quality checks, records and artifacts."""

from decimal import Decimal

import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenkeel.functions import scalars as P
from evenkeel.functions.tokens import row_fingerprint
from evenkeel.operators import compare as J
from evenkeel.operators import fingerprint as H
from evenkeel.operators import model as M
from evenkeel.operators import quality as Q
from evenkeel.operators import records as R
from evenkeel.session import work_path
from evenkeel.sources import artifacts, files, snapshots, traces


def mark(df, **kw):
    return tuple(H.table_fingerprint(df, **kw).first())


def test_fingerprint_ignores_layout_and_sees_changes(events):
    base = mark(events)
    assert base == mark(events.repartition(7).select(*reversed(events.columns)))
    assert base != mark(events.filter("event_id <> 0"))
    assert base != mark(events.withColumn("value", F.col("value") + F.when(F.col("event_id") == 0, 1e-6).otherwise(0)))
    assert mark(events, exclude=["ts"]) == mark(events.withColumn("ts", F.lit(None).cast("timestamp_ntz")), exclude=["ts"])


def test_awkward_rows_have_their_own_hash(spark):
    schema = "a string, b string, x double, m map<string,int>, s struct<p:string,q:string>, z array<string>"
    mark_, sep = "\u001e", "\u001f"
    data = [
        ("p", "q", 1.0, {"a": 1, "b": 2}, ("u", "v"), ["x", "y"]), ("pq", "", 1.0, None, None, None), (None, "pq", 1.0, None, None, None),
        (mark_, "pq", 1.0, None, None, None), (sep, "", None, None, None, None), ("", sep, None, None, None, None),
        ("", "", float("nan"), None, None, None), ("", "", float("inf"), None, None, None), ("", "", -float("inf"), None, None, None),
        ("", "", 0.0, None, None, []), ("", "", 0.0, None, None, [""]), ("", "", 0.0, None, None, ["a,b"]), ("", "", 0.0, None, None, ["a", "b"]),
        ("", "", 0.0, None, None, [None]), ("", "", 0.0, None, ("u,1", "v"), None), ("", "", 0.0, None, ("u", "1,v"), None)]
    df = spark.createDataFrame(data, schema)
    assert df.select(row_fingerprint(df).alias("h")).distinct().count() == len(data)
    zero = spark.createDataFrame([("", "", z, None, None, None) for z in (0.0, -0.0)], schema)
    assert zero.select(row_fingerprint(zero).alias("h")).distinct().count() == 1


def test_map_order_does_not_matter(spark):
    one = spark.sql("select map('b', 2, 'a', 1) as m, array(1.0D, 2.0D) as z")
    two = spark.sql("select array(1.0D, 2.0D) as z, map('a', 1, 'b', 2) as m")
    assert mark(one) == mark(two)


def test_empty_table_has_a_fingerprint(events):
    assert mark(events.filter("false"))[:2] == (0, 0)


def test_diff_compares_repeated_keys_as_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "x"), (4, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z"), (5, "x"), (4, "x")], "k int, v string")
    got = {r["k"]: r["status"] for r in J.snapshot_diff(a, b, "k").collect()}
    assert got == {1: "same", 2: "changed", 3: "removed", 4: "changed", 5: "added"}


def test_snapshot_protocol(spark, events):
    root = work_path(spark, "test-snapshots")
    assert snapshots.load_snapshot(spark, root) is None
    players = spark.createDataFrame([(30.0, 30.0, 0.0, 1, 7)], "hp double, max_hp double, xp double, level int, seed bigint")
    for version, mode in ((1, "light"), (2, "full"), (3, "compressed")):
        snapshots.save_snapshot({"events": events, "player": players}, root, version, mode, seed=7)
    with pytest.raises(ValueError):
        snapshots.save_snapshot({"player": players}, root, 3)
    with pytest.raises(ValueError):
        snapshots.save_snapshot({"player": players}, root, 9, "other")
    snapshots.stage_tables({"player": players}, root, 4)
    assert snapshots.latest_version(spark, root) == 3 and snapshots.latest_version(spark, root, below=3) == 2
    loaded = snapshots.load_snapshot(spark, root)
    assert mark(loaded["events"]) == mark(events) and rows(loaded["player"]) == rows(players)
    assert snapshots.list_snapshots(spark, root).count() == 6
    stored = snapshots.part_paths(root, snapshots.read_manifest(spark, root, 3), "player")
    players.withColumn("hp", F.col("hp") + 1).write.mode("overwrite").parquet(*stored)
    with pytest.raises(snapshots.SnapshotMismatch):
        snapshots.load_snapshot(spark, root)
    warned = snapshots.load_snapshot(spark, root, on_mismatch="warn")
    assert warned["player"].first()["hp"] == 31.0
    status = {r["table"]: r["status"] for r in snapshots.check_snapshot(spark, root, 3).collect()}
    assert status == {"events": "ok", "player": "changed"}
    assert snapshots.load_snapshot(spark, root, 2)["player"].first()["hp"] == 30.0
    with pytest.raises(ValueError):
        snapshots.load_snapshot(spark, root, 4)


def test_committed_versions_are_never_rewritten(spark):
    root = work_path(spark, "test-attempts")
    one, two = (spark.range(n).toDF("x") for n in (3, 5))
    snapshots.save_snapshot({"t": one}, root, 1)
    # A second run that stops between data and manifest, and one that gets to the manifest, change nothing.
    attempt = snapshots.stage_tables({"t": two}, root, 1)
    assert snapshots.load_snapshot(spark, root, 1)["t"].count() == 3
    assert not snapshots.commit(spark, root, 1, attempt, ["t"])
    assert snapshots.load_snapshot(spark, root)["t"].count() == 3
    assert snapshots.save_snapshot({"t": two}, root, 1, if_committed="skip") == 1
    assert {r["status"] for r in snapshots.check_snapshot(spark, root, 1).collect()} == {"ok"}
    assert len(files.names_in(spark, f"{root}/data/v=1")) == 2
    # A folder without its manifest is no version.
    files.create_once(spark, f"{root}/manifests/v=7/other", "")
    assert snapshots.latest_version(spark, root) == 1 and snapshots.list_snapshots(spark, root).filter("v = 1").count() == 1
    assert not [n for n in files.names_in(spark, f"{root}/manifests") if n.startswith("_draft")]


def test_appended_parts_and_compaction(spark):
    root = work_path(spark, "test-append")
    for v in range(10):
        snapshots.append_snapshot({"t": spark.range(v * 10, v * 10 + 10).toDF("x")}, root, v, max_parts=4)
        manifest = snapshots.read_manifest(spark, root, v)
        assert len(manifest.parts) <= 4 and sum(p.n_rows for p in manifest.parts) == 10 * (v + 1) and manifest.base == (v - 1 if v else None)
    whole = snapshots.load_snapshot(spark, root)["t"]
    assert mark(whole) == mark(spark.range(100).toDF("x"))
    written = sum(p.n_rows for p in {p for v in range(10) for p in snapshots.read_manifest(spark, root, v).parts})
    assert written <= 100 * 4
    assert {r["status"] for v in (0, 4, 9) for r in snapshots.check_snapshot(spark, root, v).collect()} == {"ok"}
    with pytest.raises(ValueError):
        snapshots.append_snapshot({"t": spark.range(3).toDF("y")}, root, 30)
    with pytest.raises(ValueError):
        snapshots.append_snapshot({"t": spark.range(3).toDF("x")}, root, 30, scale=2)
    # A running attempt at a later version is not touched by pruning; parts that only old versions name go.
    running = snapshots.stage_tables({"t": whole}, root, 25)
    assert snapshots.prune_snapshots(spark, root, keep=3) == list(range(7))
    assert mark(snapshots.load_snapshot(spark, root, 7)["t"]) == mark(spark.range(80).toDF("x"))
    named = {p.place.rsplit("/", 1)[0] for v in (7, 8, 9) for p in snapshots.read_manifest(spark, root, v).parts}
    left = {f"{d}/{a}" for d in files.names_in(spark, f"{root}/data") for a in files.names_in(spark, f"{root}/data/{d}")}
    assert left == named | {f"v=25/attempt={running}"}
    assert snapshots.commit(spark, root, 25, running, ["t"]) and mark(snapshots.load_snapshot(spark, root)["t"]) == mark(whole)
    with pytest.raises(ValueError):
        snapshots.prune_snapshots(spark, root, keep=0)


def test_tree_diff_reads_what_differs(spark):
    """Parts, shared parts, hot and null keys, other depths: the same rows as the diff of whole tables."""
    root = work_path(spark, "test-trees")
    base = spark.range(4000).select((F.col("id") % 3500).alias("k"), F.col("id").cast("string").alias("x"))
    base = base.unionByName(spark.range(500).select(F.lit(7).cast("bigint").alias("k"), F.lit("hot").alias("x"))).unionByName(
        spark.createDataFrame([(None, "none")], "k bigint, x string"))
    more = spark.createDataFrame([(9000 + i, "new") for i in range(3)] + [(5, "5"), (None, "none")], "k bigint, x string")
    snapshots.save_snapshot({"t": base}, root, 1, keys={"t": "k"}, depth=1)
    snapshots.append_snapshot({"t": more}, root, 2)
    edited = base.withColumn("x", F.when(F.col("k") == 3000, "other").otherwise(F.col("x"))).filter("k <> 12 or k is null")
    snapshots.save_snapshot({"t": edited}, root, 3, keys={"t": "k"}, depth=2)
    whole = {1: base, 2: base.unionByName(more), 3: edited}
    for a, b in ((1, 2), (2, 1), (1, 3), (2, 3)):
        got = snapshots.diff_snapshots(spark, root, a, b, "t")
        assert rows(got) == rows(J.snapshot_diff(whole[a], whole[b], "k").filter("status <> 'same'"))
    assert snapshots.diff_snapshots(spark, root, 2, 2, "t").isEmpty()
    read = snapshots.differing_rows(spark, root, 1, 2, "t", 1)
    assert read.count() < 0.6 * 4000 and "PartitionFilters: [__range" in read._jdf.queryExecution().toString()
    assert mark(snapshots.load_snapshot(spark, root, 2)["t"]) == mark(whole[2])
    snapshots.save_snapshot({"t": base}, root, 4)
    with pytest.raises(ValueError):
        snapshots.diff_snapshots(spark, root, 3, 4, "t")


def test_diff_shortcuts_take_null_keys_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "w"), (None, "y"), (4, "q"), (4, "r")], "k int, v string")
    assert rows(J.added_rows(a, b, "k")) == rows(b.filter("k = 4")) and rows(J.removed_rows(a, b, "k")) == rows(a.filter("k = 3"))
    assert rows(J.kept_rows(a, b, "k")) == rows(b.filter("k = 1 or k is null"))


def test_manifest_status(spark):
    schema = "table string, n_rows bigint, hash_sum decimal(38,0), schema_hash string"
    five, six = Decimal(5), Decimal(6)
    a = spark.createDataFrame([("a", 1, five, "s"), ("b", 1, five, "s"), ("c", 1, five, "s")], schema)
    b = spark.createDataFrame([("a", 1, five, "s"), ("b", 1, six, "s"), ("d", 1, five, "s")], schema)
    got = {r["table"]: r["status"] for r in J.compare_manifests(a, b).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing", "d": "extra"}


def test_json_artifact_keeps_special_numbers(spark):
    path = work_path(spark, "test-artifact")
    df = spark.createDataFrame([(1, float("nan"), None), (2, float("inf"), "x"), (3, -float("inf"), "y")], "b int, a double, c string")
    artifacts.write_json_artifact(df, path)
    first = spark.read.text(path).filter("value like '%\"b\":1%'").first()[0]
    assert first.index('"a"') < first.index('"b"') < first.index('"c"') and "null" in first
    assert rows(artifacts.read_artifact(spark, path, df.schema)) == rows(df)
    spark.createDataFrame([("{oops",)], "value string").write.mode("append").text(path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        artifacts.read_artifact(spark, path, df.schema).collect()


@pytest.mark.parametrize("dirs", [False, True])
def test_trace_shards_are_whole(spark, events, dirs):
    path = work_path(spark, "test-trace")
    slim = events.select("user_id", "ts", "event_id")
    traces.write_trace(slim, path, "user_id", ["ts", "event_id"], seed=3, n=10, shard_dirs=dirs)
    back = traces.read_trace(spark, path, slim.schema, seeds=[3])
    assert rows(back.select(*slim.columns)) == rows(slim)
    assert back.groupBy("user_id", "shard").count().agg(F.max("count")).first()[0] == 10
    files = back.withColumn("f", F.input_file_name()).groupBy("user_id", "shard").agg(F.count_distinct("f").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1


def test_learned_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert R.learn_vocabulary(df, "x") == ["a", "b"]
    assert sorted(map(str, map(tuple, R.encode_learned(df, "x").collect()))) == sorted(map(str, [("b", 1), ("a", 0), (None, None), ("b", 1)]))
    assert {r["code"] for r in R.encode_learned(df, "x", vocabulary=["b"]).collect()} == {0, None}


def test_codes_of_many_values(spark):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 15_000).cast("string").alias("x")).unionByName(
        spark.range(3000).select(F.lit("9").alias("x"))).unionByName(spark.createDataFrame([(None,), ("",)], "x string"))
    want = {v: i for i, v in enumerate(sorted({r["x"] for r in df.collect()} - {None}))} | {None: None}
    got = R.encode_learned(df, "x")
    assert got.count() == df.count() and all(want[r["x"]] == r["code"] for r in got.collect())
    assert R.learn_codes(df.where("false"), "x").isEmpty()


def test_nested_redaction_at_every_depth(spark):
    data = [(1, ("HIDDEN", ("ok", b"HIDDEN")), [("HIDDEN", 2)], {"a": "ok", "HIDDEN": "HIDDEN"}, {5: "HIDDEN"}, [[1, None], None]), (2, None, None, None, None, [])]
    df = spark.createDataFrame(data, "i int, s struct<secret:string, in:struct<a:string, raw:binary>>, z array<struct<secret:string, n:int>>, m map<string,string>, q map<int,string>, w array<array<int>>")
    shown = R.redact_nested(df, ["i", "s", "in", "a", "raw", "z", "n", "m", "q", "w"])
    text = "".join(r[0] for r in shown.select(F.to_json(F.struct("*"))).collect())
    assert "HIDDEN" not in text
    first, second = shown.collect()
    assert first["s"]["in"]["a"] == "ok" and "binary" in first["s"]["in"]["raw"] and "string" in first["s"]["secret"]
    assert first["z"][0]["n"] == 2 and "m" in shown.columns and "map<int,string>" in first["q"] and first["w"] == [[1, None], None]
    assert second["s"] is None and second["z"] is None and second["m"] is None and second["w"] == []


def test_redaction_leaks_nothing(spark):
    df = spark.createDataFrame([(1, "HIDDEN:/home/user", [1, 2])], "i int, x string, z array<int>")
    text = R.redact(df, ["i", "z"]).select(F.to_json(F.struct("*"))).first()[0]
    assert "HIDDEN" not in text and '"i":1' in text and "array<int>" in text
    scan = Q.leak_scan(spark.createDataFrame([(text,)], "t string"), ["HIDDEN"]).first()
    assert scan["clean"] and scan["n_rows"] == 0


def test_required_columns_and_keys(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("[]",), (None,), ("{oops",)], "j string")
    got = [r["missing"] for r in Q.missing_keys(df, "j", ["k", "s"]).collect()]
    assert got == [["s"], ["k", "s"], ["k", "s"], ["k", "s"]]
    with pytest.raises(ValueError):
        Q.require_columns(df, ["j", "nope"])
    assert Q.require_columns(df, ["j"]) is df


def test_audit_notices_layout_dependence(events):
    exact = Q.determinism_audit(lambda d: d.groupBy("event_type").count(), events, [1, 4])
    assert [r["same"] for r in exact.collect()] == [True, True]
    loose = Q.determinism_audit(lambda d: d.select(F.spark_partition_id().alias("p")), events, [1, 4])
    assert not any(r["same"] for r in loose.collect())


def test_categories_and_paths(spark):
    df = spark.createDataFrame([("attack",), ("special",), ("dance",), (None,)], "a string")
    coded = df.select(P.encode_category("a").alias("c")).withColumn("back", P.decode_category("c"))
    assert [tuple(r) for r in coded.collect()] == [(0, "attack"), (4, "special"), (None, None), (None, None)]
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/b/",), ("plain",), (None,)], "p string")
    got = [r[0] for r in paths.select(P.sanitize_path("p")).collect()]
    assert got[0].startswith("c.txt_") and got[1].startswith("_") and got[2].startswith("plain_") and got[3] is None


def test_model_does_not_depend_on_input_layout(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fits = [M.fit_classifier(d, "vec_id", "embedding", "label", [64, 8, 10], 7, partitions=3, max_iter=5)
            for d in (df, df.repartition(5).orderBy(F.desc("vec_id")))]
    assert list(fits[0].weights) == list(fits[1].weights)
    scored = M.score(df, fits[0], "vec_id", "embedding")
    sums = scored.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9
    assert scored.filter("action not between 0 and 9").count() == 0

"""Versioned snapshots of several tables, made of parts that are never rewritten.

Layout: ``root/data/v=N/attempt=<id>/<table>`` is a part, a folder of Parquet written by one attempt at version N;
``root/manifests/v=N/manifest.json`` is the manifest, one line for each table and part with the part's rows and
fingerprint. It appears in one step and only once: a version without it does not exist for readers, and a version that has it is never
changed. An attempt that stops halfway, also one that repeats a committed version, leaves parts that no manifest names.

A version may name parts of the version before and add its own (``append_snapshot``), so what is written follows the new rows. Row
hashes add up, so a table's fingerprint is the sum over its parts. Past ``MAX_PARTS`` parts the smallest are put together
(compaction), at least half of them, so a row is written again only as often as the logarithm of the table's growth.

A table with a key can be stored by ranges of its key's hash with a tree of fingerprints beside it (``operators.hash_tree``); then
``diff_snapshots`` reads only the ranges in which two versions differ.

Names of manifests are listed to find versions; their texts are read for the version that is asked for.
"""

from __future__ import annotations

import json
import logging
import uuid
from datetime import datetime, timezone
from functools import reduce
from typing import Iterable, Mapping, NamedTuple, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import schema_digest
from ..operators import hash_tree
from ..operators.compare import compare_manifests, snapshot_diff
from ..operators.fingerprint import HASH_SUM, hash_sum, row_number_of
from ..operators.heat import as_list
from .files import create_once, exists, names_in, read_text, remove

LOG = logging.getLogger(__name__)

# Snapshot modes and the Parquet codec of each.
CODECS = {"light": "snappy", "full": "none", "compressed": "zstd"}

MAX_PARTS = 16

MANIFEST = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("hash_sum", HASH_SUM), T.StructField("schema_hash", T.StringType()),
    T.StructField("seed", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("scale", T.IntegerType()),
    T.StructField("key", T.ArrayType(T.StringType())), T.StructField("depth", T.IntegerType()),
    T.StructField("base", T.LongType()), T.StructField("saved_at", T.TimestampType()), T.StructField("v", T.LongType())])


class SnapshotMismatch(RuntimeError):
    """Stored and computed fingerprints of a snapshot differ."""


class Part(NamedTuple):
    """One part of a table; ``place`` is relative to the folder of the data."""

    table: str
    place: str
    n_rows: int
    hash_sum: int
    schema_hash: str
    key: tuple[str, ...] | None = None
    depth: int | None = None


class Manifest(NamedTuple):
    version: int
    parts: list[Part]
    seed: int
    mode: str
    scale: int | None
    base: int | None


def manifest_file(root: str, version: int) -> str:
    return f"{root}/manifests/v={version}/manifest.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers that have a folder for a manifest, newest first; the manifest itself may still be missing."""
    found = [n[2:] for n in names_in(spark, f"{root}/manifests") if n.startswith("v=")]
    return sorted((int(n) for n in found), reverse=True)


def committed(spark: SparkSession, root: str, version: int) -> bool:
    return exists(spark, manifest_file(root, version))


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """Newest committed version, or the newest below a given one. Names are listed; no manifest is read."""
    found = (v for v in versions(spark, root) if below is None or v < below)
    return next((v for v in found if committed(spark, root, v)), None)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per committed version, table and part; None when nothing was ever saved."""
    try:
        return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{root}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    """The manifest of one version; the others are not read."""
    if not committed(spark, root, version):
        raise ValueError(f"snapshot version {version} is not committed")
    rows = [json.loads(line) for line in read_text(spark, manifest_file(root, version)).splitlines()]
    parts = [Part(r["table"], r["part"], r["n_rows"], r["hash_sum"], r["schema_hash"], tuple(r["key"]) if r["key"] else None, r["depth"]) for r in rows]
    head = rows[0]
    return Manifest(version, sorted(parts, key=lambda p: (p.table, p.place)), head["seed"], head["mode"], head["scale"], head["base"])


def part_paths(root: str, manifest: Manifest, table: str) -> list[str]:
    return [f"{root}/data/{p.place}" for p in manifest.parts if p.table == table]


def staged_path(root: str, version: int, attempt: str, table: str) -> str:
    return f"{root}/data/v={version}/attempt={attempt}/{table}"


def save_snapshot(tables: Mapping[str, DataFrame], root: str, version: int, mode: str = "light", seed: int = 0,
                  scale: int | None = None, if_committed: str = "fail", keys: Mapping[str, object] | None = None, depth: int = hash_tree.DEPTH) -> int:
    """Write all tables, fingerprint what was written, then commit.

    ``keys`` names the key of tables that are to be stored by ranges, with a tree of ``depth`` levels. A version that is committed already is an error, or is left as it is if ``if_committed`` is ``skip`` (for replays of a batch).
    """
    spark = next(iter(tables.values())).sparkSession
    _check_request(mode, if_committed)
    if _is_done(spark, root, version, if_committed):
        return version
    attempt = stage_tables(tables, root, version, mode, scale, keys, depth)
    commit(spark, root, version, attempt, list(tables), mode, seed, scale, keys=keys, depth=depth)
    return version


def append_snapshot(fresh: Mapping[str, DataFrame], root: str, version: int, mode: str = "light", seed: int = 0, scale: int | None = None,
                    if_committed: str = "fail", max_parts: int = MAX_PARTS, keys: Mapping[str, object] | None = None,
                    depth: int = hash_tree.DEPTH) -> int:
    """Commit a version that holds the newest version below it and the fresh rows; only these, and what compaction takes, are written.

    Tables that are stored by ranges of a key stay so, with the depth they have.
    """
    spark = next(iter(fresh.values())).sparkSession
    _check_request(mode, if_committed)
    if _is_done(spark, root, version, if_committed):
        return version
    newest = latest_version(spark, root, below=version)
    base = None if newest is None else read_manifest(spark, root, newest)
    if base is not None and base.scale != scale:
        raise ValueError(f"version {newest} was hashed with scale {base.scale}, not {scale}")
    kept = [] if base is None else list(base.parts)
    tables, keys = {}, dict(keys or {})
    for name, df in fresh.items():
        old = [p for p in kept if p.table == name]
        if old and old[0].key:
            keys[name], depth = list(old[0].key), old[0].depth
        if any(p.schema_hash != schema_digest(df) for p in old):
            raise ValueError(f"table {name!r} has another schema than in version {newest}")
        merged = to_merge(old, max_parts)
        if merged:
            kept = [p for p in kept if p not in merged]
            df = df.unionByName(read_parts(spark, root, merged))
        tables[name] = df
    attempt = stage_tables(tables, root, version, mode, scale, keys, depth)
    commit(spark, root, version, attempt, list(tables), mode, seed, scale, base=newest, kept=kept, keys=keys, depth=depth)
    return version


def to_merge(parts: Sequence[Part], max_parts: int) -> list[Part]:
    """The parts that a new one takes in: none while there is room, else the smallest, until half of the places are free."""
    if len(parts) < max_parts:
        return []
    by_size = sorted(parts, key=lambda p: (p.n_rows, p.place))
    return by_size[:len(parts) - max_parts // 2]


def _check_request(mode: str, if_committed: str) -> None:
    if mode not in CODECS:
        raise ValueError(f"unknown snapshot mode {mode!r}")
    if if_committed not in ("fail", "skip"):
        raise ValueError(f"unknown if_committed {if_committed!r}")


def _is_done(spark: SparkSession, root: str, version: int, if_committed: str) -> bool:
    done = committed(spark, root, version)
    if done and if_committed == "fail":
        raise ValueError(f"snapshot version {version} exists already")
    return done


def stage_tables(tables: Mapping[str, DataFrame], root: str, version: int, mode: str = "light", scale: int | None = None,
                 keys: Mapping[str, object] | None = None, depth: int = hash_tree.DEPTH) -> str:
    """Write parts of a version under a new attempt, whose name is returned. Readers do not see them before ``commit``."""
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        place = staged_path(root, version, attempt, name)
        if name in (keys or {}):
            hash_tree.write_by_range(df, place, keys[name], depth, CODECS[mode])
            hash_tree.write_tree(df.sparkSession, place, f"{place}.tree", depth, scale)
        else:
            df.write.option("compression", CODECS[mode]).parquet(place)
    return attempt


def commit(spark: SparkSession, root: str, version: int, attempt: str, names: Sequence[str], mode: str = "light", seed: int = 0,
           scale: int | None = None, base: int | None = None, kept: Iterable[Part] = (), keys: Mapping[str, object] | None = None,
           depth: int = hash_tree.DEPTH) -> bool:
    """Make an attempt's parts, and those kept from ``base``, the version; False if another attempt has done so before."""
    fresh = []
    for name in names:
        key = tuple(as_list(keys[name])) if keys and name in keys else None
        part = Part(name, f"v={version}/attempt={attempt}/{name}", 0, 0, "", key, depth if key else None)
        found = _fingerprints(spark, root, [part], scale).first()
        fresh.append(part._replace(n_rows=found["n_rows"], hash_sum=int(found["hash_sum"]), schema_hash=found["schema_hash"]))
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    shared = {"seed": seed, "mode": mode, "scale": scale, "base": base, "saved_at": now}
    lines = [{"table": p.table, "part": p.place, "n_rows": p.n_rows, "hash_sum": p.hash_sum, "schema_hash": p.schema_hash,
              "key": p.key, "depth": p.depth, **shared} for p in sorted([*kept, *fresh], key=lambda p: (p.table, p.place))]
    return create_once(spark, manifest_file(root, version), "".join(json.dumps(line) + "\n" for line in lines))


def read_parts(spark: SparkSession, root: str, parts: Sequence[Part]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/data/{p.place}").drop(*[hash_tree.RANGE] * bool(p.key)) for p in parts])


def _fingerprints(spark: SparkSession, root: str, parts: Sequence[Part], scale: int | None) -> DataFrame:
    """(table, n_rows, hash_sum, schema_hash) of the stored parts of one table, computed now in one pass."""
    df = read_parts(spark, root, parts)
    return (df.select(row_number_of(df, df.columns, scale).alias("__h")).agg(F.count(F.lit(1)).alias("n_rows"), hash_sum(F.col("__h")).alias("hash_sum"))
            .select(F.lit(parts[0].table).alias("table"), "n_rows", "hash_sum", F.lit(schema_digest(df)).alias("schema_hash")))


def check_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Status of every table of a committed version against its manifest."""
    manifest = read_manifest(spark, root, version)
    names = sorted({p.table for p in manifest.parts})
    totals = [(n, sum(p.n_rows for p in manifest.parts if p.table == n), sum(p.hash_sum for p in manifest.parts if p.table == n),
               next(p.schema_hash for p in manifest.parts if p.table == n)) for n in names]
    stored = spark.createDataFrame(totals, "table string, n_rows bigint, hash_sum string, schema_hash string").withColumn("hash_sum", F.col("hash_sum").cast(HASH_SUM))
    computed = []
    for name in names:
        readable = [p for p in manifest.parts if p.table == name and exists(spark, f"{root}/data/{p.place}")]
        if readable:
            computed.append(_fingerprints(spark, root, readable, manifest.scale))
    return compare_manifests(stored, reduce(DataFrame.unionByName, computed) if computed else stored.limit(0))


def load_snapshot(spark: SparkSession, root: str, version: int | None = None, on_mismatch: str = "fail",
                  verify: bool = True) -> dict[str, DataFrame] | None:
    """All tables of a version (the latest committed one by default), verified first.

    A missing root gives None. A mismatch raises, or is logged when ``on_mismatch`` is ``warn``.
    Errors while reading always raise.
    """
    if on_mismatch not in ("fail", "warn"):
        raise ValueError(f"unknown on_mismatch {on_mismatch!r}")
    version = latest_version(spark, root) if version is None else version
    if version is None:
        return None
    manifest = read_manifest(spark, root, version)
    if verify:
        bad = check_snapshot(spark, root, version).filter(F.col("status") != "ok").collect()
        if bad:
            text = f"snapshot {version}: " + ", ".join(f"{r['table']} {r['status']}" for r in bad)
            if on_mismatch == "fail":
                raise SnapshotMismatch(text)
            LOG.warning(text)
    return {name: read_parts(spark, root, [p for p in manifest.parts if p.table == name]) for name in sorted({p.table for p in manifest.parts})}


def prune_snapshots(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Keep the newest ``keep`` versions and remove the others, with all parts up to the newest version that no kept manifest names.

    Manifests go first, so no reader meets a version without its parts. Parts of later versions may belong to a running
    attempt and stay.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    known = [v for v in versions(spark, root) if committed(spark, root, v)]
    retained, gone = known[:keep], known[keep:]
    named = {p.place.rsplit("/", 1)[0] for v in retained for p in read_manifest(spark, root, v).parts}
    for v in gone:
        remove(spark, f"{root}/manifests/v={v}")
    for folder in names_in(spark, f"{root}/data"):
        if not known or not folder.startswith("v=") or int(folder[2:]) > known[0]:
            continue
        attempts = names_in(spark, f"{root}/data/{folder}")
        for attempt in attempts:
            if f"{folder}/{attempt}" not in named:
                remove(spark, f"{root}/data/{folder}/{attempt}")
        if not names_in(spark, f"{root}/data/{folder}"):
            remove(spark, f"{root}/data/{folder}")
    return sorted(gone)


def diff_snapshots(spark: SparkSession, root: str, before: int, after: int, table: str) -> DataFrame:
    """Keys of a table that were ``added``, ``removed`` or ``changed`` between two versions, read from the ranges that differ alone.

    The table must be stored by ranges of one key in both. Rows of a key are compared as a multiset, as ``snapshot_diff`` does.
    """
    sides = [differing_rows(spark, root, before, after, table, which) for which in (before, after)]
    key = next(list(p.key) for p in read_manifest(spark, root, after).parts if p.table == table)
    return snapshot_diff(*sides, key, scale=read_manifest(spark, root, after).scale).where(F.col("status") != "same")


def differing_rows(spark: SparkSession, root: str, before: int, after: int, table: str, which: int) -> DataFrame:
    """The rows of one version in the ranges in which two versions differ; folders of other ranges are not read."""
    parts = {v: [p for p in read_manifest(spark, root, v).parts if p.table == table] for v in (before, after)}
    every = [p for of in parts.values() for p in of]
    if not all(parts.values()) or len({p.key for p in every}) > 1 or not every[0].key:
        raise ValueError(f"table {table!r} is not stored by ranges of one key in versions {before} and {after}")
    if len({read_manifest(spark, root, v).scale for v in (before, after)}) > 1:
        raise ValueError(f"versions {before} and {after} were hashed with different scales")
    depth = min(p.depth for p in every)
    # Parts that both versions name cancel out.
    own = {v: [p for p in of if not all(p in other for other in parts.values())] for v, of in parts.items()}
    empty = spark.createDataFrame([], "level int, node int, n_rows bigint, hash_sum decimal(38,0)")
    trees = [hash_tree.read_tree(spark, [f"{root}/data/{p.place}.tree" for p in own[v]]) for v in (before, after)]
    ranges = hash_tree.differing_ranges(*[empty if t is None else t for t in trees], depth)
    found = [hash_tree.rows_in_ranges(spark.read.parquet(f"{root}/data/{p.place}"), ranges, depth, p.depth) for p in parts[which]]
    return reduce(DataFrame.unionByName, found)

"""Clustering by centroids (Lloyd's rounds in whole numbers) with geometric drift tightening.

Vectors of exactly ``dims`` components, none null, NaN or infinite, are kept; each component x becomes the integer
floor(``scale`` * x). The first centroids are the ``k`` kept vectors whose sha256 of ``<salt>:<id>`` is smallest, in order of that
hash. A round assigns each vector to the nearest centroid (ties: the smaller number) and moves every
non-empty centroid to the floor of its vectors' mean, all exactly; after the last round vectors are assigned once more.

Each vector carries a lower bound of its distance to all centroids but its own. When centroids move, the bound
is loosened by less than the largest drift: a cluster's vectors lie in a sphere about its old centroid c, as wide as its
farthest vector. For another centroid that moves by d with midpoint m of its path, a point seen from m at an angle w to the path
comes nearer by at most d cos w, since its distances to both ends sum to twice its distance to m at least. In the plane of c
and the path the sphere is seen from m under angle(c) - asin(radius / |c - m|) or more, so d times the cosine of that
is the loosening for the whole sphere: d if m lies in the sphere or the path enters its cone, 0 if the path leads away.
A vector whose exact distance to its own centroid is under its bound, or under half the way from that centroid to the
next one, stays; all others are ambiguous and are scanned exactly, all centroids for each.

The state of a round is a table of rows, one for each cluster in a portion of at most ``PORTION_ROWS`` vectors: packed ids, vectors and
bounds, with counts, sums and radius. Rounds map portions to portions without a shuffle; Spark sums up the
clusters from the small columns alone. What comes to the driver and is broadcast are k rows.

Distances are exact in doubles while components stay below 2**22, in 64-bit integers up to 2**27; beyond that
squared distances need not fit a bigint, and the job fails with a message. A null or empty table, or one without kept
vectors, gives an empty result; fewer than k kept vectors give as many clusters. Equal vectors are
clustered alike. Rows of one id are vectors of their own; among the first centroids they are ordered by their components.
A row without id cannot be a first centroid but is assigned. The result has the columns named below; others are not carried.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stored

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = "2"
PORTION_ROWS = 1 << 16
IN_DOUBLES, IN_LONGS = 1 << 22, 1 << 27
# Bounds give way by this share, many times the rounding errors of their computation.
SLACK = 1e-9

STATE = ("cluster int, ids binary, nameless binary, vectors binary, bounds binary, distances binary, n bigint, scanned bigint, sums array<bigint>, "
         "farthest double, inertia_high bigint, inertia_low bigint")


class Centroids(NamedTuple):
    """Centroids, and what the last move means for vectors of each cluster."""

    at: np.ndarray
    loosening: np.ndarray | None  # of the lower bounds, by cluster
    free: np.ndarray  # half the distance to the next centroid


def cut_off(component: np.ndarray) -> np.ndarray:
    if len(component) and max(abs(int(component.min())), abs(int(component.max()))) > IN_LONGS:
        raise OverflowError(f"components beyond {IN_LONGS} have squared distances that do not fit a bigint")
    return component


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 vectors to each centroid."""
    largest = max((int(np.abs(a).max()) for a in (vectors, centroids) if a.size), default=0)
    if largest < IN_DOUBLES:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([own_distances(vectors, c) for c in centroids], axis=1)


def own_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to one centroid, or to one of its own."""
    apart = vectors - centroids
    return np.einsum("ij,ij->i", apart, apart)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and a lower bound of the distance to the others."""
    found = squared_distances(vectors, centroids)
    nearest = found.argmin(axis=1)
    rows = np.arange(len(found))
    own = found[rows, nearest]
    if found.shape[1] == 1:
        return nearest, own, np.full(len(found), np.inf)
    found[rows, nearest] = np.iinfo(np.int64).max
    return nearest, own, np.sqrt(found.min(axis=1).astype(np.float64)) * (1 - SLACK)


def loosenings(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the distance of a vector in its sphere to any other centroid may have shrunk.

    ``radii`` are those of the spheres about the centroids ``before`` that hold the clusters' vectors.
    """
    old, new = before.astype(np.float64), after.astype(np.float64)
    path = new - old
    drift = np.sqrt((path * path).sum(axis=1))
    middle = (old + new) / 2
    away = old[:, None, :] - middle[None, :, :]  # from the path's midpoint (second) to the sphere's centre (first)
    far = np.sqrt((away * away).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip((away * path[None]).sum(axis=2) / (far * drift[None]), -1, 1)
        sine_half = radii[:, None] / far
    outside = (sine_half < 1) & (drift[None] > 0)
    sine_half = np.where(outside, sine_half, 0)
    cosine = np.where(outside, cosine, 1)
    # cos(angle - half), for a path that does not enter the cone of the sphere.
    seen = np.cos(np.maximum(np.arccos(cosine) - np.arcsin(sine_half), 0))
    shrink = np.where(outside, drift[None] * np.maximum(seen, 0), drift[None])
    np.fill_diagonal(shrink, 0)
    return shrink.max(axis=1, initial=0) * (1 + SLACK) + SLACK


def free_radii(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the next; vectors nearer than that belong to it."""
    apart = squared_distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    return np.sqrt(apart.min(axis=1, initial=np.inf)) / 2 * (1 - SLACK)


def reassign(vectors: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, squared distance and bound of each vector after a move, and how many were scanned."""
    cluster, bounds = cluster.copy(), (bounds - centroids.loosening[cluster]) * (1 - SLACK)
    own = own_distances(vectors, centroids.at[cluster])
    ambiguous = np.flatnonzero(np.sqrt(own.astype(np.float64)) * (1 + SLACK) >= np.maximum(bounds, centroids.free[cluster]))
    if len(ambiguous):
        cluster[ambiguous], own[ambiguous], bounds[ambiguous] = scan(vectors[ambiguous], centroids.at)
    return cluster, own, bounds, len(ambiguous)


def narrowest(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes of a signed type."""
    for kind in (np.int8, np.int16, np.int32):
        if not vectors.size or (vectors.min() >= np.iinfo(kind).min and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind)
    return vectors


def state_rows(ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray, cluster: np.ndarray, own: np.ndarray, bounds: np.ndarray, scanned: int) -> pa.RecordBatch:
    """One row for each cluster of a portion."""
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.diff(cluster[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, int)
    rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    counts = [scanned] + [0] * (len(rows) - 1)
    columns = {
        "cluster": pa.array([int(cluster[r[0]]) for r in rows], pa.int32()),
        "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary()), "nameless": pa.array([np.packbits(nameless[r]).tobytes() for r in rows], pa.binary()),
        "vectors": pa.array([packed(vectors[r]) for r in rows], pa.binary()), "bounds": pa.array([bounds[r].tobytes() for r in rows], pa.binary()),
        "distances": pa.array([own[r].tobytes() for r in rows], pa.binary()), "n": pa.array([len(r) for r in rows], pa.int64()),
        "scanned": pa.array(counts[:len(rows)], pa.int64()), "sums": pa.array([vectors[r].sum(axis=0).tolist() for r in rows], pa.list_(pa.int64())),
        "farthest": pa.array([float(np.sqrt(float(own[r].max()))) for r in rows], pa.float64()),
        # Two halves, so that neither sum passes 64 bits.
        "inertia_high": pa.array([int((own[r] >> 31).sum()) for r in rows], pa.int64()),
        "inertia_low": pa.array([int((own[r] & 0x7FFFFFFF).sum()) for r in rows], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed(vectors: np.ndarray) -> bytes:
    slim = narrowest(vectors)
    return bytes([slim.itemsize]) + slim.tobytes()


def unpacked(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, dims).astype(np.int64)


def rows_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, nameless, vectors, cluster, distances, bounds) of each row of a state."""
    for row in batch.to_pylist():
        n = row["n"]
        yield (np.frombuffer(row["ids"], np.int64), np.unpackbits(np.frombuffer(row["nameless"], np.uint8), count=n).astype(bool), unpacked(row["vectors"], dims),
               np.full(n, row["cluster"]), np.frombuffer(row["distances"], np.int64), np.frombuffer(row["bounds"], np.float64))


def portions(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Rows of arrays put together until they have ``PORTION_ROWS`` vectors."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[0])
        if size >= PORTION_ROWS:
            yield [np.concatenate(column) for column in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(column) for column in zip(*held)]


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the usable rows, components as whole numbers."""
    at = F.col(vector_col)
    whole = F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.where((F.size(at) == dims) & whole)
    return usable.select(F.col(id_col).cast("bigint").alias("id"), F.transform(at, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def first_centroids(kept: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.where("id is not null").orderBy(rank, "v").limit(k).select("v").collect()
    return cut_off(np.array([r["v"] for r in rows], np.int64).reshape(-1, dims))


def summed(state: DataFrame, dims: int) -> list[dict]:
    """Per cluster: vectors, component sums, radius, inertia and scans; k rows."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    inertia = F.sum(F.col("inertia_high").cast("decimal(38,0)")) * F.lit(1 << 31) + F.sum(F.col("inertia_low").cast("decimal(38,0)"))
    rows = state.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"), inertia.alias("inertia"),
                                        F.sum("scanned").alias("scanned"), *sums).collect()
    return [r.asDict() for r in rows]


def moved(centroids: np.ndarray, clusters: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Centroids at the floored means of their vectors, and the radii of the spheres about the old ones."""
    after, radii = centroids.copy(), np.zeros(len(centroids))
    for row in clusters:
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
        radii[row["cluster"]] = row["farthest"] * (1 + SLACK)
    return after, radii


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
                    dims: int = DIMS, scale: int = SCALE, seed: str = SEED, counts: list[int] | None = None) -> DataFrame:
    """Per kept vector: id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    ``counts``, if given, takes the number of vectors that each assignment scanned in full.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dims, scale)
    centroids = first_centroids(kept, k, dims, seed)
    schema = f"`{id_col}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)

    def begin(batches: Iterator[pa.RecordBatch], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                ids = batch.column("id")
                yield (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                       cut_off(batch.column("v").flatten().to_numpy().reshape(-1, dims)))

        for ids, nameless, found in portions(rows()):
            yield state_rows(ids, nameless, found, *scan(found, at), len(found))

    def follow(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
        for ids, nameless, found, cluster, _, bounds in portions(row for batch in batches for row in rows_of(batch, dims)):
            cluster, own, bounds, scanned = reassign(found, cluster, bounds, centroids)
            yield state_rows(ids, nameless, found, cluster, own, bounds, scanned)

    state = stored(kept.mapInArrow(lambda batches, at=centroids: begin(batches, at), STATE), "clusters")
    clusters = summed(state, dims)
    for number in range(rounds):
        after, radii = moved(centroids, clusters)
        shipped = Centroids(after, loosenings(centroids, after, radii), free_radii(after))
        if counts is not None:
            counts.append(sum(c["scanned"] for c in clusters))
        state = stored(state.mapInArrow(lambda batches, c=shipped: follow(batches, c), STATE), "clusters")
        centroids, clusters = after, summed(state, dims)
    if counts is not None:
        counts.append(sum(c["scanned"] for c in clusters))
    inertia = {c["cluster"]: int(c["inertia"]) for c in clusters}
    total = sum(inertia.values())
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nameless, _, cluster, own, _ in rows_of(batch, dims):
                n, which = len(ids), int(cluster[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nameless), pa.array(cluster.astype(np.int32)), pa.array(own), pa.array(np.full(n, inertia[which])),
                     pa.array(np.full(n, total)), pa.array([marks[which]] * n, pa.string())],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.mapInArrow(unfold, schema)

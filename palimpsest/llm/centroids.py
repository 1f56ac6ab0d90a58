"""Centroid clustering (Lloyd's rounds) with exponion search, exact in integers.

A vector carries its centroid a, an upper bound u of the distance to it and a lower bound l of the distance to any other.
When centroids move, u grows by what a moved and l shrinks by the furthest that another one moved. If u < l nothing can have
come nearer. Otherwise u is made exact, and if that isn't enough only the centroids inside the ball of radius 2u + s around
a are scanned, s being the distance from a to its nearest other centroid: the nearest and the second nearest centroid lie
inside, so both bounds are whole again. Each centroid has its list of the others, sorted by distance, and a vector takes the
part of it that its radius reaches. The radius is inclusive and bounds are compared strictly, with a margin above what
floats round, so ties are always scanned and decided on exact integers: the smaller number wins.

A round is one pass over the table of vectors and bounds, without a shuffle; it writes the next table and deletes the one
before. Sums follow from the vectors that changed their centroid. The driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import discard, materialize, small_batches

SCALE, WIDTH, K, ROUNDS, SEED = 1024, 64, 8, 10, "3"
#: Components of this size and beyond would leave a squared distance no room in 64 bits.
MOST = 1 << 27
#: Relative margin for bounds; what floats lose over all rounds is a few units of 1e-16.
MARGIN = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, scanned int"


def whole_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, v): the vectors of ``width`` finite components, each floor(1024 * x). Those with a component beyond 2^27
    after that, whose distances aren't exact in 64 bits, take no part either."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < MOST))
    kept = vectors.filter((F.size("embedding") == width) & fits)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<int>").alias("v"))


def seed_key(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


@dataclass(frozen=True)
class Centroids:
    """The centroids, how far each one moved, and for each one the others by distance."""

    at: np.ndarray
    moved: np.ndarray

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each centroid all centroids by distance (itself first, then by number), and those distances."""
        far = ((self.at[:, None, :] - self.at[None, :, :]) ** 2).sum(2)
        far[np.arange(len(far)), np.arange(len(far))] = -1
        order = np.argsort(far, axis=1, kind="stable")
        return order, np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0))


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    diff = rows - centre
    return np.einsum("ij,ij->i", diff, diff)


def search(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, ...]:
    """(a, upper, lower, scanned) after the centroids moved. a < 0: no centroid yet, all are scanned."""
    k = len(centroids.at)
    order, far = centroids.neighbours()
    most = np.array([np.delete(centroids.moved, j).max(initial=0.0) for j in range(k)])
    a, old = a.copy(), np.maximum(a, 0)
    upper = np.where(a < 0, np.inf, upper + centroids.moved[old])
    lower = np.where(a < 0, 0.0, lower - most[old])
    scanned = np.zeros(len(v), np.int32)

    def open_rows() -> np.ndarray:
        return np.flatnonzero((a < 0) | ~(upper * (1 + MARGIN) + MARGIN < lower * (1 - MARGIN)))

    todo = open_rows()
    for j in range(k):  # first make the upper bound exact
        mine = todo[a[todo] == j]
        upper[mine] = np.sqrt(squared(v[mine], centroids.at[j]))
    for j in np.unique(old[todo := open_rows()]).tolist():
        mine = todo[old[todo] == j]
        radius = np.where(a[mine] < 0, np.inf, (2 * upper[mine] + (far[j, 1] if k > 1 else 0.0)) * (1 + MARGIN) + MARGIN)
        reach = np.searchsorted(far[j], radius, side="right")
        best = np.full(len(mine), np.iinfo(np.int64).max)
        second, name = best.copy(), np.full(len(mine), k)
        for place, c in enumerate(order[j].tolist()):
            inside = np.flatnonzero(reach > place)
            if not len(inside):
                break
            d = squared(v[mine[inside]], centroids.at[c])
            wins = (d < best[inside]) | ((d == best[inside]) & (c < name[inside]))
            second[inside] = np.where(wins, best[inside], np.minimum(second[inside], d))
            best[inside], name[inside] = np.where(wins, d, best[inside]), np.where(wins, c, name[inside])
        a[mine], upper[mine], scanned[mine] = name, np.sqrt(best), reach
        lower[mine] = np.sqrt(second.astype(float)) if k > 1 else np.inf
    return a, upper, lower, scanned


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.int64)


def _round(centroids: Centroids, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.asarray(b.column(2))
            new, upper, lower, scanned = search(_matrix(b.column(1), width), a, np.asarray(b.column(4)), np.asarray(b.column(5)), centroids)
            out = [b.column(0), b.column(1), pa.array(new, pa.int32()), pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned, pa.int32())]
            yield pa.record_batch(out, names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned"])

    return run


def _distances(at: np.ndarray, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.asarray(b.column(2))
            yield pa.record_batch([b.column(0), pa.array(a, pa.int32()), pa.array(squared(_matrix(b.column(1), width), at[a]))], names=["vec_id", "cluster", "distance"])

    return run


def _changes(state: DataFrame, width: int) -> list:
    """For each centroid the number and the sum of the vectors that came, less those that left: a row per centroid."""
    moves = state.filter("cluster <> was").select(
        "v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))).alias("m")
    )
    sums = [F.sum(F.col("v")[i] * F.col("m.sign").cast("long")).alias(f"s{i}") for i in range(width)]
    return moves.filter("m.c >= 0").groupBy("m.c").agg(F.sum("m.sign").alias("n"), *sums).collect()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for each kept vector of ``vectors`` (vec_id, embedding; other columns are ignored), and the
    final centroids.

    Centroids 0, 1, ... start as the k vectors with the smallest sha256 of ``3:<vec_id>`` (equal ids: by components). Each
    round assigns all vectors to the nearest centroid (squared distance; ties: the smaller number) and replaces centroids
    that have vectors by floor(sum / count); after the last round vectors are assigned once more. Vectors that are null, of
    another length, or hold a null, non-finite or too large component (``whole_vectors``) take no part; null vec_ids are
    hashed as empty and repeated rows count as often as they come. With fewer than k vectors there are as many centroids;
    without any the result is empty. Empty centroids stay where they are."""
    spark = vectors.sparkSession
    small_batches(spark)
    fresh = [F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scanned")]
    state = materialize(whole_vectors(vectors, width).select("vec_id", "v", *fresh), "centroids-0")
    first = state.select("v", seed_key(F.col("vec_id")).alias("key")).orderBy("key", "v").limit(k).collect()
    at = np.array([r.v for r in first], np.int64).reshape(-1, width)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), at
    counts, sums = [0] * len(at), [[0] * width for _ in at]
    centroids = Centroids(at, np.zeros(len(at)))
    for turn in range(rounds + 1):
        after = materialize(state.mapInArrow(_round(centroids, width), _STATE), f"centroids-{turn + 1}")
        discard(state)
        state = after
        if turn == rounds:
            break
        for r in _changes(state, width):
            counts[r.c] += r.n
            sums[r.c] = [s + r[f"s{i}"] for i, s in enumerate(sums[r.c])]
        old = centroids.at
        new = np.array([[s // n for s in total] if n else here for total, n, here in zip(sums, counts, old.tolist(), strict=True)], np.int64)
        centroids = Centroids(new, np.sqrt(((new - old) ** 2).sum(1)))
    return state.mapInArrow(_distances(centroids.at, width), "vec_id long, cluster int, distance long"), centroids.at


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances of its cluster and of all, and the digest of its centroid; a literal map of k
    entries names them."""
    if not len(centroids):
        return assigned.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    own = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = F.array(*[F.lit(own.get(c, 0)).cast("long") for c in range(len(digests))])
    names = F.array(*[F.lit(d) for d in digests])
    return assigned.select(
        "*", by_cluster[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256")
    )

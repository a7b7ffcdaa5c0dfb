"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

Components are integers floor(64 x), so sums, means floor(sum / count) and
squared distances are exact. Vectors are packed into chunks. A chunk keeps, for
each cluster, a heap of its members by the gap between the distance to the
second nearest centroid (lower bound) and to their own (upper bound), measured
when the member was last looked at and offset by the drift that its cluster had
accumulated by then. After each round a cluster's drift grows by its own
centroid's move plus the largest move of any other. A member whose key is above
its cluster's drift still has a gap, so its nearest centroid is unchanged and it
is not touched; only members whose gap has expired are popped, rescanned
exactly against all centroids, and pushed on a heap again.

Each round is one job over the chunks, written to the shared folder before the
next one reads it, so a lost executor costs the re-run of its chunks. A chunk
returns what its moved members change in the clusters' sums and counts; Spark
adds these up. The driver holds centroids, sums and drifts only: clusters x
components numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Most vectors of a chunk.
CHUNK = 4096
#: Scaled components are held to this, so that 64 squares of differences fit 64 bits.
LARGEST = 1 << 27
#: Below this the squares fit the 53 bits of a double, where products are fast.
SMALL = 1 << 22
#: A gap counts as expired this much (relative to the distances) before it is, for rounding.
SLACK = 1e-9


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, v: array of int) of the rows with ``dim`` finite components."""
    x = F.col("x")
    ok = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    return rows.where(F.coalesce(ok, F.lit(False))).select("id", F.transform(x, held).alias("v"))


def seeds(rows: DataFrame, k: int, round_key: str = "1:") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of the key and the decimal id,
    (k, dim); equal hashes in the order of their components."""
    key = F.sha2(F.concat(F.lit(round_key), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in first], "i8")


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centroids), in blocks."""
    large = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if large < SMALL:
        v, c = vectors.astype("f8"), centroids.astype("f8")
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype("i8")
    return np.stack([((vectors.astype("i8") - c) ** 2).sum(1) for c in centroids], 1)


class Heaps:
    """A chunk's heaps: for each cluster (key, member), least key first."""

    def __init__(self, k: int, keys=(), members=(), sizes=()):
        self.of, at = [[] for _ in range(k)], 0
        for j, n in enumerate(sizes):
            self.of[j] = list(zip(keys[at:at + n], members[at:at + n]))
            at += n

    def flat(self):
        """(keys, members, sizes), each heap in its own order."""
        return ([x for h in self.of for x, _ in h], [i for h in self.of for _, i in h], [len(h) for h in self.of])

    def expired(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """(member, cluster) whose gap the cluster's drift has used up."""
        out = []
        for j, heap in enumerate(self.of):
            while heap and heap[0][0] <= drift[j]:
                out.append((heapq.heappop(heap)[1], j))
        return out

    def push(self, member: int, cluster: int, gap: float, drift: np.ndarray):
        heapq.heappush(self.of[cluster], (gap + drift[cluster], member))


def rescan(vectors: np.ndarray, centroids: np.ndarray):
    """(nearest centroid, the smaller number of equally near ones; safe gap to
    the second nearest) of each vector."""
    d = squares(vectors, centroids)
    nearest = d.argmin(1)
    own = np.sqrt(d[np.arange(len(d)), nearest].astype("f8"))
    if d.shape[1] == 1:
        return nearest, np.full(len(d), np.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype("f8"))
    return nearest, second - own - SLACK * (1 + second + own)


def assign(heaps: Heaps, vectors: np.ndarray, todo: list[tuple[int, int]], centroids: np.ndarray, drift: np.ndarray):
    """Rescan the members of ``todo``; the change of the clusters' sums and
    counts (a cluster of -1 is none)."""
    k, dim = centroids.shape
    sums, counts = np.zeros((k, dim), "i8"), np.zeros(k, "i8")
    if todo:
        members, old = np.array(todo, "i8").T
        nearest, gap = rescan(vectors[members], centroids)
        for i, j, g in zip(members.tolist(), nearest.tolist(), gap.tolist()):
            heaps.push(i, j, g, drift)
        moved = nearest != old
        x = vectors[members[moved]].astype("i8")
        np.add.at(sums, nearest[moved], x)
        np.add.at(counts, nearest[moved], 1)
        was = old[moved] >= 0
        np.subtract.at(sums, old[moved][was], x[was])
        np.subtract.at(counts, old[moved][was], 1)
    return sums, counts


STATE = "ids array<{id}>, flat array<int>, keys array<double>, members array<int>, sizes array<int>, sums array<long>, counts array<long>, scanned long"


def _row(ids, flat, heaps: Heaps, sums, counts, scanned: int) -> pa.RecordBatch:
    keys, members, sizes = heaps.flat()
    one = [pa.array([x], pa.list_(t)) for x, t in ((flat, pa.int32()), (keys, pa.float64()), (members, pa.int32()), (sizes, pa.int32()),
                                                  (sums.ravel(), pa.int64()), (counts, pa.int64()))]
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([ids, *one, pa.array([scanned], pa.int64())],
                                      ["ids", "flat", "keys", "members", "sizes", "sums", "counts", "scanned"])


def _first_round(centroids: np.ndarray, chunk: int):
    """Arrow step: rows (id, v) to chunks, every vector scanned."""
    k, dim = centroids.shape

    def step(batches):
        for b in common.slices(batches, chunk):
            ids = b.column("id")
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            heaps, drift = Heaps(k), np.zeros(k)
            sums, counts = assign(heaps, flat.reshape(-1, dim), [(i, -1) for i in range(len(ids))], centroids, drift)
            yield _row(ids, flat, heaps, sums, counts, len(ids))
    return step


def _chunks(batches, k: int, dim: int):
    """(ids, flat, vectors, heaps) of each chunk."""
    for b in common.slices(batches, 1):
        ids, flat = b.column("ids")[0].values, b.column("flat")[0].values.to_numpy(zero_copy_only=False)
        heaps = Heaps(k, *(b.column(c)[0].as_py() for c in ("keys", "members", "sizes")))
        yield ids, flat, flat.reshape(-1, dim), heaps


def _next_round(centroids: np.ndarray, drift: np.ndarray):
    """Arrow step: chunks to chunks, only expired members scanned."""
    k, dim = centroids.shape

    def step(batches):
        for ids, flat, vectors, heaps in _chunks(batches, k, dim):
            todo = heaps.expired(drift)
            sums, counts = assign(heaps, vectors, todo, centroids, drift)
            yield _row(ids, flat, heaps, sums, counts, len(todo))
    return step


def _members(centroids: np.ndarray, id_name: str):
    """Arrow step: chunks to one row for each vector, with its exact distance."""
    k, dim = centroids.shape

    def step(batches):
        for ids, flat, vectors, heaps in _chunks(batches, k, dim):
            cluster = np.empty(len(vectors), "i4")
            distance = np.empty(len(vectors), "i8")
            for j, heap in enumerate(heaps.of):
                own = np.array([i for _, i in heap], "i8")
                if len(own):
                    cluster[own], distance[own] = j, squares(vectors[own], centroids[j:j + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], [id_name, "cluster", "distance"])
    return step


def moved(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray):
    """(new centroids: floor of the exact means, an empty cluster's stays; the
    drift to add for each cluster, rounded up)."""
    new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    move = np.sqrt(((new - centroids).astype("f8") ** 2).sum(1))
    others = np.array([np.delete(move, j).max(initial=0.0) for j in range(len(move))])
    return new, (move + others) * (1 + SLACK)


def _totals(state: DataFrame, k: int, dim: int):
    """(sums, counts) added up over the chunks: (dim + 1) x k numbers."""
    every = state.select(F.posexplode(F.concat("counts", "sums")).alias("at", "x"))
    got = {r["at"]: r["x"] for r in every.groupBy("at").agg(F.sum("x").alias("x")).collect()}
    flat = np.array([got.get(i, 0) for i in range(k * (dim + 1))], "i8")
    return flat[k:].reshape(k, dim), flat[:k]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_column: str = "vec_id",
            vector_column: str = "embedding", dim: int = DIM, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(one row for each vector: its id, ``cluster``, ``distance``; the final
    centroids). Centroids start as ``seeds``; each round assigns every vector to
    the nearest (of equally near ones the smaller number) and replaces every
    non-empty centroid by its vectors' floor(mean); then all are assigned once
    more. ``distance`` is the squared distance.

    Rows whose vector is null, has another number of components, or holds null
    or non-finite ones take no part; a null id is an id like any other (its
    hash is that of the empty id), repeated rows are vectors each for itself,
    other columns are left out. Scaled components beyond +-2^27 count as that.
    Fewer vectors than k give as many clusters; an empty table no rows."""
    rows = usable(vectors, id_column, vector_column, dim)
    kind = rows.schema["id"].dataType.simpleString()
    centroids = seeds(rows, k)
    if not len(centroids):
        return rows.limit(0).select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    k = len(centroids)
    drift, sums, counts = np.zeros(k), np.zeros((k, dim), "i8"), np.zeros(k, "i8")
    schema = STATE.format(id=kind)
    state = common.written(common.map_arrow(rows, _first_round(centroids, chunk), schema), "centroids-0")
    for r in range(1, rounds + 1):
        changed = _totals(state, k, dim)
        sums, counts = sums + changed[0], counts + changed[1]
        centroids, step = moved(centroids, sums, counts)
        drift = drift + step
        state = common.written(common.map_arrow(state, _next_round(centroids, drift), schema), f"centroids-{r}")
    out = common.map_arrow(state.select("ids", "flat", "keys", "members", "sizes"), _members(centroids, id_column),
                           f"`{id_column}` {kind}, cluster int, distance long")
    return common.written(out, "centroids-members"), centroids


def described(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The members with ``cluster_inertia`` and ``inertia`` (distances summed
    over the cluster and over all) and ``centroid_sha256`` (of the centroid's
    components, comma-joined). One row a cluster is joined: at most as many as
    centroids, so it may be broadcast."""
    spark = members.sparkSession
    hashes = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    of_cluster = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    every = sum(of_cluster.values())
    table = spark.createDataFrame([(j, of_cluster.get(j, 0), every, h) for j, h in hashes],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster")

"""Exact top-k search by inner product with vector-approximation files.

Components become integers floor(64 x). Vectors are dealt by a hash of their id
into chunks; a chunk holds its vectors twice: as approximations (one byte cell
per component) and exactly. For a block of queries, a chunk's approximations are
scanned first: the cells' edges bound every inner product from above and below.
The k-th largest lower bound is a first limit; exact vectors are then read in
the order of their upper bounds, a slice at a time, until no unread one can
reach the k-th score found so far. Each chunk returns its k best for each query,
and a ranking per query (k rows per chunk, cut on the map side) gives the
result. Queries are a stated set, met by all rows in blocks; nothing passes
through the driver, and each block of queries and chunk is one task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 64
#: Vectors aimed at for a chunk, and queries for a block.
CHUNK, BLOCK = 4096, 512
#: Cells per component.
CELLS = 256


class Approximation:
    """Cells of equal width for each component between its least and largest
    value; ``low`` and ``high`` are the cells' edges, widened to hold every
    member."""

    def __init__(self, vectors: np.ndarray):
        v = vectors.astype("f8")
        least, most = v.min(0), v.max(0)
        width = np.where(most > least, (most - least) / CELLS, 1.0)
        self.cells = np.clip(np.floor((v - least) / width), 0, CELLS - 1).astype("u1")
        self.least, self.width = least, width

    def bounds(self, queries: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of all inner products, queries x vectors."""
        low = self.least + self.cells[at] * self.width
        plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        base = low @ (plus + minus)
        # one cell up in every component is the most that a vector can exceed its low corner by
        slack = 1e-9 * (np.abs(low) @ np.abs(queries.T) + self.width @ np.abs(queries.T)) + 1e-6
        return (base + self.width @ minus - slack).T, (base + self.width @ plus + slack).T


def best_of_chunk(q_ids, queries, ids, vectors, k):
    """For each query the ids and scores of its k best in the chunk (largest
    score, then smallest id), its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    approx = Approximation(vectors)
    lower, upper = approx.bounds(queries.astype("f8"), slice(None))
    for i, q in enumerate(queries):
        lo, hi = lower[i], upper[i]
        others = ids != q_ids[i]
        if not others.all():
            lo, hi = np.where(others, lo, -np.inf), np.where(others, hi, -np.inf)
        n = int(others.sum())
        if not n:
            continue
        limit = np.partition(lo, len(lo) - k)[len(lo) - k] if n >= k else -np.inf
        candidates = np.flatnonzero((hi >= limit) & others)
        candidates = candidates[np.argsort(-hi[candidates], kind="stable")]
        found, scores, at = candidates[:0], np.zeros(0, "i8"), 0
        while at < len(candidates):
            part = candidates[at:at + max(4 * k, 64)]
            at += len(part)
            found = np.concatenate([found, part])
            scores = np.concatenate([scores, vectors[part] @ q])
            if len(found) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth
                found, scores = found[keep], scores[keep]
                if len(found) > k:
                    best = np.lexsort((found, -scores))[:k]
                    found, scores = found[best], scores[best]
                if at < len(candidates) and hi[candidates[at]] < kth:
                    break
        best = np.lexsort((found, -scores))[:k]
        yield q_ids[i], ids[found[best]], scores[best]


def _usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v: array of long, dim) of the rows that take part."""
    x = F.col("x")
    ok = F.col("x").isNotNull() & F.col("id").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
            .where(F.coalesce(ok, F.lit(False)))
            .select("id", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"), F.size("x").alias("dim")))


def _packed(df: DataFrame, key: str) -> DataFrame:
    """One row per key: its ids and vectors, flat. A key's size is held near
    ``CHUNK`` or ``BLOCK`` by the number of keys."""
    packed = df.groupBy("dim", key).agg(F.collect_list(F.struct("id", "v")).alias("m"))
    return packed.select("dim", key, F.col("m.id").alias("ids"), F.flatten("m.v").alias("flat"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id",
          vector_column: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors``
    for each row of ``queries`` (all, if fewer), ties to the smaller id.

    A row with a query's own id is no candidate for it. Rows with a null id, a
    null vector, or null or non-finite components take no part; vectors of
    different lengths do not meet. Repeated ids are candidates as often as they
    occur (a repeated query row counts once). Integer parts must stay below
    2^31 / sqrt(length) or so for the 64-bit sums to be exact. Empty tables
    give an empty result."""
    rows, asked = _usable(vectors, id_column, vector_column), _usable(queries, id_column, vector_column).dropDuplicates(["id"])
    count = vectors.count()
    chunks, blocks = -(-max(count, 1) // chunk), -(-max(queries.count(), 1) // block)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = _packed(rows, "chunk")
    # Each block of queries goes to every chunk: an equi-join on the chunk's number.
    right = (_packed(asked, "block").withColumnsRenamed({"ids": "q_ids", "flat": "q_flat"})
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    pairs = right.join(left, ["dim", "chunk"])

    def search(batches):
        for b in common.slices(batches, 1):
            dim = b.column("dim")[0].as_py()
            ids, q_ids = (b.column(c)[0].values.to_numpy() for c in ("ids", "q_ids"))
            v, q = (b.column(c)[0].values.to_numpy().reshape(len(n), dim) for c, n in (("flat", ids), ("q_flat", q_ids)))
            out = [(np.full(len(found), a), found, s) for a, found, s in best_of_chunk(q_ids, q, ids, v, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                                 ["query_id", "vec_id", "score"])

    found = common.map_arrow(pairs, search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""K3 exact cosine top-k over an embedding table.

Queries are dealt into blocks of about ``chunk`` vectors, one row each, and the
items meet every block by an equi-join on the block's number (salted, so that
items stay spread over all tasks). An item's row scores the whole block with
``zip_with`` / ``aggregate`` in double precision, JVM-side; the per-query top-k
is a ``row_number() <= k`` filter that Spark plans as a partial
WindowGroupLimit (k rows per query per partition cross the shuffle). Nothing
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_CHUNK = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays (null for a zero vector)."""
    d = _norm(a) * _norm(b)
    return F.when(d > 0, _dot(a, b) / d)


def topk_cosine(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id",
                vec: str = "embedding", chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, key, score, rank) for the k most similar items per query.

    items:   (key, vec)               vectors as array<float|double>
    queries: (query_id, vector)        array<double>; none give no rows
    """
    spark = items.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = queries.select(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(chunk)), F.lit(1))).scalar()
    packed = (queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), blocks)).groupBy("_block")
              .agg(F.collect_list(F.struct(F.col("query_id").cast("bigint").alias("query_id"), "vector")).alias("_q"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = items.select(F.col(key), v.alias("_v"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_block"))
    scores = F.transform("_q", lambda q: F.struct(q["query_id"].alias("query_id"), cosine(F.col("_v"), q["vector"]).alias("score")))
    scored = (rows.join(packed, ["_block", "_salt"]).select(F.col(key), F.explode(scores).alias("s"))
              .select("s.query_id", key, "s.score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroids(emb: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """(query_id, vector): mean vector per label, in double. One aggregation
    over (label, position), then the positions are re-assembled in order."""
    pos = emb.select(F.col(label), F.posexplode(F.col(vec)).alias("pos", "x"))
    agg = pos.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (agg.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
            .select(F.col(label).cast("bigint").alias("query_id"),
                    F.transform("p", lambda e: e["x"]).alias("vector")))

"""Exact de-duplication on texts without white space.

Texts are equal when identical after deleting every white-space character. They
are grouped by a 128-bit hash of that form, and the bytes themselves are
compared inside each hash group: the grouping key of the one text shuffle is
(hash, normalised text), so Spark's aggregation compares bytes, copies collapse
on the map side before the shuffle, and a group with a third of all rows sends
one row per task. A hash with several texts (a collision) is recognised by its
number of byte classes, and only its documents are matched by text instead of by
hash.

Of equal texts, the row with the most code points in the original text stays,
then the one with the smallest id (a null id comes last).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


#: Units of the rank: a length counts so much, and ids (up to 2^63 - 1) count down from the other, a null id being 0.
_LENGTHS, _IDS = 10**20, 2**63


def normalised(text: Column) -> Column:
    """The text without white space."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), common.SPACES, text)


def content_hash(norm: Column) -> Column:
    """128 bits: MD5 of the normalised text's UTF-8 bytes, in hex."""
    return F.md5(norm)


def _keyed(documents: DataFrame, id_column: str, text_column: str, hash_of: Callable) -> DataFrame:
    text = common.text_of(text_column)
    return (documents.select(F.col(id_column).cast("long").alias("doc_id"), F.length(text).cast("long").alias("len"),
                             normalised(text).alias("norm"))
            .withColumn("hash", hash_of(F.col("norm"))))


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            hash_of: Callable = content_hash) -> tuple[DataFrame, DataFrame]:
    """(one row per hash, one row per text of the hashes that have several).

    Columns: hash, [norm,] text_sha256, group_size, keep_len, keep_id."""
    keyed = _keyed(documents, id_column, text_column, hash_of)
    # (length, id) as one number, larger: stays. It has a fixed width, so the
    # aggregation hashes and does not sort the texts.
    rank = F.expr(f"CAST(len AS DECIMAL(10,0)) * {_LENGTHS}BD + coalesce({_IDS}BD - CAST(doc_id AS DECIMAL(20,0)), 0BD)")
    by_text = keyed.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("rank"))
    by_text = by_text.select(
        "hash", "norm", "group_size", F.expr(f"rank div {_LENGTHS}BD").alias("keep_len"),
        F.expr(f"CAST(nullif(rank % {_LENGTHS}BD, 0BD) * -1 + {_IDS}BD AS BIGINT)").alias("keep_id"))
    by_hash = by_text.groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_len").alias("keep_len"),
        F.max("keep_id").alias("keep_id"))
    whole = common.written(by_hash, "dedup-hashes")
    # With one text to a hash the maxima above are that text's values; else
    # they are not used, and the texts of those hashes are listed.
    single = whole.where("texts = 1").drop("texts")
    collided = whole.where("texts > 1").select("hash")
    several = (by_text.join(collided, "hash", "left_semi") if collided.limit(1).count()
               else by_text.where(F.lit(False)))
    return single, several


def assign(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           hash_of: Callable = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows repeated with the same id and text length are one document written
    several times: all of them say ``kept`` if their id stays (``deduplicate``
    leaves one). Null texts count as empty; an empty table gives no rows. A
    group whose rows all lack an id has a null ``keep_id``."""
    single, several = classes(documents, id_column, text_column, hash_of)
    keyed = _keyed(documents, id_column, text_column, hash_of).withColumn("text_sha256", F.sha2("norm", 256))
    by_hash = keyed.drop("norm").join(single, "hash")
    by_text = keyed.join(several, ["hash", "norm"]).drop("norm")
    both = by_hash.unionByName(by_text)
    return both.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))).alias("kept"),
                       "text_sha256")


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                hash_of: Callable = content_hash) -> DataFrame:
    """The input's rows, one of each class of equal texts, all their columns
    as they were. Rows that repeat the id and length of the one that stays are
    copies too: one of them stays."""
    single, several = classes(documents, id_column, text_column, hash_of)
    text = common.text_of(text_column)
    rows = (documents.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc_id"),
                             F.length(text).cast("long").alias("len"), normalised(text).alias("norm"))
            .withColumn("hash", hash_of(F.col("norm"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
    by_hash = rows.drop("norm").join(single, "hash").where(stays)
    by_text = rows.join(several, ["hash", "norm"]).where(stays)
    # Only an id that occurs twice can leave two rows; those few go through one
    # more grouping, the others need no further shuffle.
    ids = _keyed(documents, id_column, text_column, hash_of).groupBy("hash", "doc_id", "len").count().where("count > 1")
    ids = common.written(ids.select("hash", F.col("doc_id").alias("twice"), F.col("len").alias("twice_len")), "dedup-twice")
    same = [F.col("doc_id").eqNullSafe(F.col("twice")), F.col("len") == F.col("twice_len")]
    on = [by_hash["hash"] == ids["hash"], *same]
    once = by_hash.join(ids, on, "left_anti").select("row")
    again = (by_hash.join(ids, on, "left_semi").groupBy("hash").agg(F.any_value("row").alias("row")).select("row"))
    collided = by_text.groupBy("hash", "norm").agg(F.any_value("row").alias("row")).select("row")
    return once.unionByName(again).unionByName(collided).select("row.*")

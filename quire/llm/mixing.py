"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source, documents are ordered
by that key: the key's first digits name a range, ranges are sorted apart, and a
running sum over the ranges' totals plus one inside each range gives every
document's place in its source's words (a distributed prefix sum; no task holds
more than one range of one source). A source's target is met by whole passes
over it (epochs), then by the documents whose middle lies before the rest of the
budget in one more pass, so that whole documents come as near to the budget as
the last one allows.

The order depends on ids and texts alone: reruns, other partitionings and other
cluster sizes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights by the order of the sources (code points, null last), repeating; largest number of epochs.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 0
#: Hexadecimal digits of the key that name a range: 16^n ranges to a source.
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    """Size of a text: its number of words."""
    return F.regexp_count(text, F.lit(common.WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: shares of the total by weight,
    held to ``most`` times the source's size, the excess reshared by weight
    until none is above.

    That is one level of words per weight, at which the held and the other
    targets sum to the total: sources are ordered by the level at which they
    are held, and the first one that the rest's level does not exceed ends the
    held ones. One row per source, so one small task orders them."""
    cycle = F.array(*[F.lit(w) for w in weights])
    # Java orders strings by UTF-8 bytes, as code points are ordered
    ranked = sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    # exact integers throughout, so that every engine gets the same doubles
    ranked = ranked.select("source", "source_size", F.element_at(cycle, ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"))
    at = F.col("source_size") * most / F.col("w").cast("double")
    order = Window.orderBy(at, F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.select(
        "*", at.alias("held_at"),
        ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
         / F.sum("w").over(rest).cast("double")).alias("level"))
    found = F.min(F.when(F.col("level") <= F.col("held_at"), F.struct("held_at", "level"))).over(Window.partitionBy())["level"]
    return levels.select("source", "source_size", F.least(
        (F.col("source_size") * most).cast("double"), F.coalesce(found, F.lit(0.0)) * F.col("w")).alias("target"))


def _sized(documents: DataFrame, id_column: str, text_column: str, source_column: str, seed: int) -> DataFrame:
    text = common.text_of(text_column)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text))
    return documents.select(F.struct("*").alias("row"), F.col(source_column).cast("string").alias("source"),
                            words(text).alias("size"), key.alias("key"))


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs (whole passes) and last
    (the key of the last document taken once more; null if none). ``sized`` has
    source, key and size; rows with the same key are one unit."""
    units = common.written(sized.groupBy("source", "key").agg(F.sum("size").alias("size"))
                           .withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix-units")
    ranges = units.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = common.written(targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"),
                           F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (units.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
              .select("source", "key", (F.col("range_start") + F.col("within") + F.col("size") / 2.0).alias("middle")))
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("left", target - F.col("epochs") * size)
    last = (placed.join(goal.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("middle") < F.col("left")).groupBy("source").agg(F.max("key").alias("last"))
            .withColumnRenamed("source", "s"))
    out = goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return common.written(out.select("source", "source_size", "target", "epochs", "last"), "mix-cuts")


def plan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every row as the struct ``row``, with size, source_size, target (its
    source's) and copies: how often the mix takes it.

    Null texts and empty ones have size 0 and follow their place in the order.
    Rows without a source are a source of their own. Rows with the same id,
    text and source are taken together. An empty table gives an empty result;
    a source without words has target 0 and none of it is taken."""
    sized = _sized(documents, id_column, text_column, source_column, seed)
    cut = cuts(sized.drop("row"), weights, most).withColumnRenamed("source", "s")
    joined = sized.join(cut, F.col("source").eqNullSafe(F.col("s")))
    more = F.coalesce(F.col("key") <= F.col("last"), F.lit(False)).cast("long")
    return joined.select("row", "size", "source_size", "target", (F.col("epochs") + more).alias("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix: the input's rows, each as often as the plan takes it."""
    return (plan(documents, **options).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*"))

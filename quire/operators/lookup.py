"""K2 identifier lookup (batch) and K9 error records with suggestions.

Lookup is an equi join between request keys and the exploded identifier
variants of the items (C4). Variants are ambiguous (``SCP-100-J`` also has
``100`` and ``SCP-100``), so every match gets a rank and the best match per
request wins (``row_number`` over request; groups are tiny: the few items
sharing a key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import identifier_variants, label_number, normalize_id
from ..session import written

# Rank of a match by the variant it hit: scp, link, padded label, number.
VARIANT_RANK = {0: 0, 2: 1, 3: 2, 1: 3}


def variant_table(items: DataFrame) -> DataFrame:
    """(link, scp_number, scp, pos, variant, key, rank) one row per variant."""
    v = items.select("link", "scp", "scp_number",
                     F.posexplode(identifier_variants()).alias("pos", "variant"))
    rank = F.when(F.col("pos") == 0, 0).when(F.col("pos") == 2, 1).when(F.col("pos") == 3, 2).otherwise(3)
    return v.withColumn("key", F.upper("variant")).withColumn("rank", rank)


def lookup_many(items: DataFrame, requests: DataFrame, request: str = "request") -> DataFrame:
    """Best item per request: (request, link, scp, scp_number, match_rank).

    A request matches a variant equal (case-insensitive) to the request as
    given or to its normalized label (B1). Ties: lower rank, then the item
    without a suffix, then the lower number, then link.
    """
    r0 = F.trim(F.col(request))
    req = (requests.select(F.col(request)).distinct()
           .select(F.col(request), F.explode(F.array_distinct(F.array(F.upper(r0), F.upper(normalize_id(r0)))))
                   .alias("key")))
    v = variant_table(items)
    m = (req.join(v, "key").groupBy(request, "link", "scp", "scp_number")
         .agg(F.min("rank").alias("match_rank")))
    suffixed = ~F.upper("scp").rlike(r"^SCP-[0-9]+$")
    w = Window.partitionBy(request).orderBy("match_rank", suffixed, "scp_number", "link")
    return m.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _next_three(rows: DataFrame, part: str, down: bool) -> DataFrame:
    """``rows`` (``number``, ``scps``: null for a request) with the up to three
    item numbers at or below it (``down``) or above it, nearest first, from the
    rows of the same ``part`` in the order of the number."""
    # items of a request's own number count as below it
    order = ([F.col("number"), F.col("scps").isNull()] if down
             else [F.col("number").desc(), F.col("scps").isNull().desc()])
    items = Window.partitionBy(part, F.col("scps").isNull()).orderBy(order[0])
    one = F.struct("number", "scps")
    three = F.filter(F.array(one, F.lag(one, 1).over(items), F.lag(one, 2).over(items)), lambda x: x.isNotNull())
    rows = rows.withColumn("_three", F.when(F.col("scps").isNotNull(), three))
    upto = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("below" if down else "above", F.last("_three", ignorenulls=True).over(upto)).drop("_three")


def nearest_items(numbers: DataFrame, items: DataFrame, n: int = 3, partitions: int | None = None) -> DataFrame:
    """(number, nearest): for each distinct number the labels of its ``n`` (3
    at most) nearest items, by distance, then number, then label.

    Numbers and items are dealt into ranges of the number. In each range
    running windows carry the last three and the next three item numbers along;
    the few at a range's ends are carried over to the ranges beside it, however
    many of them are empty. So no radius is needed and no number meets more
    than six others. Of items with one number the first ``n`` labels count."""
    spark = items.sparkSession
    first = Window.partitionBy("scp_number").orderBy("scp")
    few = (items.select("scp_number", "scp").where("scp_number is not null and scp is not null")
           .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n))
    few = few.groupBy(F.col("scp_number").alias("number")).agg(F.array_sort(F.collect_list("scp")).alias("scps"))
    asked = numbers.select("number").where("number is not null").distinct().withColumn("scps", F.lit(None).cast("array<string>"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, because a range's border is a sample's: a second computation may draw another
    rows = written(few.unionByName(asked).repartitionByRange(parts, "number").withColumn("part", F.spark_partition_id()), "nearest-ranges")

    def ends(last: bool) -> DataFrame:
        """For each part, the three nearest item numbers of the parts before
        (``last``) or after it. At most three rows a part are ordered as one."""
        side = F.col("number").desc() if last else F.col("number").asc()
        border = rows.where("scps is not null").withColumn("_n", F.row_number().over(Window.partitionBy("part").orderBy(side))).where("_n <= 3")
        marks = rows.select("part").distinct().select(F.lit(None).cast("long").alias("number"), F.lit(None).cast("array<string>").alias("scps"), "part")
        both = border.select("number", "scps", "part").unionByName(marks)
        # a part's mark comes before its own items, in the direction of the walk
        walk = [F.col("part") if last else F.col("part").desc(), F.col("number").isNotNull(), F.col("number") if last else F.col("number").desc()]
        one = F.struct("number", "scps")
        seen = Window.partitionBy(F.col("number").isNull()).orderBy(*walk)
        three = F.filter(F.array(one, F.lag(one, 1).over(seen), F.lag(one, 2).over(seen)), lambda x: x.isNotNull())
        both = both.withColumn("_three", F.when(F.col("number").isNotNull(), three))
        upto = Window.partitionBy(F.lit(0)).orderBy(*walk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("_three", F.last("_three", ignorenulls=True).over(upto)).where("number is null")
        return both.select("part", F.explode("_three").alias("e")).select("e.number", "e.scps", "part")

    rows = rows.unionByName(ends(True)).unionByName(ends(False))
    rows = _next_three(_next_three(rows, "part", True), "part", False).where("scps is null")
    none = F.array().cast("array<struct<number:bigint,scps:array<string>>>")
    candidates = F.flatten(F.transform(F.concat(F.coalesce("below", none), F.coalesce("above", none)), lambda e: F.transform(
        e["scps"], lambda s: F.struct(F.abs(e["number"] - F.col("number")).alias("dist"), e["number"].alias("at"), s.alias("scp")))))
    return rows.select("number", F.transform(F.slice(F.array_sort(candidates), 1, n), lambda c: c["scp"]).alias("nearest"))


def not_found_with_suggestions(requests: DataFrame, items: DataFrame, request: str = "request", n_suggest: int = 3) -> DataFrame:
    """K9: one error record per request that matches no label; suggestions are
    the ``n_suggest`` (3 at most) nearest items by number, however far. A
    request without a number has none."""
    req = requests.select(F.col(request)).distinct().withColumn("normalized", normalize_id(F.trim(F.col(request))))
    missing = req.join(items.select(F.col("scp").alias("normalized")), "normalized", "left_anti")
    missing = missing.withColumn("number", label_number("normalized").cast("bigint"))
    top = missing.join(nearest_items(missing, items, n_suggest), "number", "left")
    return top.select(F.col(request), F.lit("ITEM_NOT_FOUND").alias("code"),
                      F.concat(F.lit("Item "), F.col("normalized"), F.lit(" not found in dataset")).alias("message"),
                      F.coalesce("nearest", F.array().cast("array<string>")).alias("suggestions"))

"""K4 related items and D5 reference edges.

Relations from a set of seed items:
  references     seed -> item it references
  referenced_by  item -> seed (items whose references name the seed)
  shared_hub     hubs of the seed with their member counts (``related_hubs``)
Seeds are filtered first, so the work is proportional to the seeds' edges.
Shared hubs are reported per hub with a member count (one partial+final
aggregation per hub) instead of expanding every co-member: a hub may hold a
third of all items, and expanding it for many seeds would emit all pairs of
the hub. ``related_list`` ranks both kinds together and finds the first of a
list without listing hubs; ``hub_members`` lists one seed's when a caller asks.
The seed side is a user's request and is broadcast only after its size is
checked; past the limit the joins are shuffle joins (AQE splits hot keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SEED_BROADCAST_LIMIT = 100_000


def _maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def reference_edges(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(src_link, dst_link) for references that name an existing item."""
    return (refs.join(items.select(F.col("link").alias("ref_link")), "ref_link")
            .select(F.col("link").alias("src_link"), F.col("ref_link").alias("dst_link")))


def dangling(refs: DataFrame, items: DataFrame) -> DataFrame:
    """References whose slug is no item (left anti)."""
    return refs.join(items.select(F.col("link").alias("ref_link")), "ref_link", "left_anti")


def related(seeds: DataFrame, refs: DataFrame, items: DataFrame,
            seed_limit: int = SEED_BROADCAST_LIMIT) -> DataFrame:
    """(seed, link, n_relations, relations) for every item related by references.

    seeds: (seed)            links of the seed items
    refs:  (link, ref_link)  reference edges (exploded ``references``)
    """
    s = _maybe_broadcast(seeds.select("seed").distinct(), seed_limit)
    live = items.select(F.col("link").alias("dst"))
    out_e = (refs.join(s, refs.link == s.seed).select("seed", F.col("ref_link").alias("link"))
             .join(live, F.col("link") == F.col("dst")).drop("dst")
             .withColumn("relation", F.lit("references")))
    in_e = (refs.join(s, refs.ref_link == s.seed).select("seed", "link")
            .withColumn("relation", F.lit("referenced_by")))
    return (out_e.unionByName(in_e).groupBy("seed", "link")
            .agg(F.count(F.lit(1)).alias("n_relations"),
                 F.array_sort(F.collect_set("relation")).alias("relations")))


def related_hubs(seeds: DataFrame, hubs: DataFrame, seed_limit: int = SEED_BROADCAST_LIMIT) -> DataFrame:
    """(seed, hub, n_others): hubs of each seed and how many other items share it."""
    s = _maybe_broadcast(seeds.select("seed").distinct(), seed_limit)
    sizes = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("n_members"))
    seed_hubs = hubs.join(s, hubs.link == s.seed).select("seed", "hub").distinct()
    return (seed_hubs.join(sizes, "hub")
            .select("seed", "hub", (F.col("n_members") - 1).alias("n_others")))


def hub_members(seed_link: str, hubs: DataFrame) -> DataFrame:
    """Co-members of one seed's hubs (output size = the hubs' sizes)."""
    mine = hubs.where(F.col("link") == F.lit(seed_link)).select("hub").distinct()
    return (hubs.join(F.broadcast(mine), "hub").where(F.col("link") != F.lit(seed_link))
            .select(F.lit(seed_link).alias("seed"), "link", "hub"))


def related_ranked(rel: DataFrame, items: DataFrame) -> DataFrame:
    """``rel`` with its items' columns and ``pos`` (from 1) in the order of a
    related list: relation count desc, rating desc, link. Ranking is per
    seed, over that seed's own relations."""
    order = Window.partitionBy("seed").orderBy(F.col("n_relations").desc(), F.col("rating").desc_nulls_last(), "link")
    return rel.join(items, "link").withColumn("pos", F.row_number().over(order))


def _signatures(hubs: DataFrame) -> DataFrame:
    """(link, signature): the sorted set of an item's hubs."""
    return hubs.groupBy("link").agg(F.array_sort(F.collect_set("hub")).alias("signature"))


def related_list(seeds: DataFrame, refs: DataFrame, hubs: DataFrame, items: DataFrame, k: int,
                 seed_limit: int = SEED_BROADCAST_LIMIT) -> DataFrame:
    """K4 with hubs: (seed, pos, link, n_relations, relations), the first ``k``
    of each seed's related items. An item's relations are the references
    between it and the seed (out, in) and the hubs that they share, one each;
    order: their number desc, rating desc, link.

    Items with the same set of hubs share as many hubs with a seed, so they are
    collapsed to that set (its signature), and shared hubs are counted between
    signatures. Of a signature at most k + 1 members can be among the first k
    of any seed (the seed itself may be one): those with the highest rating.
    And of the signatures only those are opened that share more hubs than the
    level at which k + 1 members are reached, or as many. A hub's members are
    never listed for a seed, so a hub may hold any part of all items; the work
    is pairs of signatures that share a hub, and the rows that these leave.

    ``items``: (link, rating), ``hubs``: (link, hub). Null hubs are none."""
    hubs = hubs.where("hub is not null").join(items.select("link"), "link", "left_semi").distinct()
    # one row an item that has hubs; used for seeds, members and sizes
    signed = written(_signatures(hubs).join(items.select("link", "rating"), "link"), "related-signatures")
    sizes = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("size"))
    best = Window.partitionBy("signature").orderBy(F.col("rating").desc_nulls_last(), "link")
    members = signed.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    own = seeds.select("seed").distinct()
    of_seed = signed.join(own, F.col("link") == F.col("seed")).select("seed", F.col("signature").alias("mine"))
    asked = of_seed.select("mine").distinct()
    by_hub = sizes.select("signature", "size", F.explode("signature").alias("hub"))
    shared = (asked.select("mine", F.explode("mine").alias("hub")).join(by_hub, "hub")
              .groupBy("mine", "signature").agg(F.count(F.lit(1)).alias("n_shared"), F.first("size").alias("size")))
    # members at higher levels, for each level of shared hubs: one row a level
    levels = shared.groupBy("mine", "n_shared").agg(F.sum("size").alias("members"))
    above = Window.partitionBy("mine").orderBy(F.col("n_shared").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_above", F.coalesce(F.sum("members").over(above), F.lit(0))).where(F.col("_above") <= k)
    opened = shared.join(levels.select("mine", "n_shared"), ["mine", "n_shared"]).join(
        members.select("signature", "link", "rating"), "signature")
    first = Window.partitionBy("mine").orderBy(F.col("n_shared").desc(), F.col("rating").desc_nulls_last(), "link")
    opened = opened.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    by_hubs = (of_seed.join(opened.select("mine", "link"), "mine").where("link <> seed").select("seed", "link"))
    by_refs = related(seeds, refs, items, seed_limit)
    # every candidate with all of its relations: references counted above, hubs from the two sets
    pairs = by_hubs.join(by_refs, ["seed", "link"], "full_outer")
    pairs = pairs.join(of_seed, "seed", "left").join(signed.select("link", F.col("signature").alias("theirs")), "link", "left")
    n_hubs = F.coalesce(F.size(F.array_intersect("mine", "theirs")), F.lit(0))
    pairs = pairs.select("seed", "link", (F.coalesce("n_relations", F.lit(0)) + F.greatest(n_hubs, F.lit(0))).cast("long").alias("n_relations"),
                         F.concat(F.coalesce("relations", F.array().cast("array<string>")),
                                  F.when(n_hubs > 0, F.array(F.lit("shared_hub"))).otherwise(F.array().cast("array<string>"))).alias("relations"))
    order = Window.partitionBy("seed").orderBy(F.col("n_relations").desc(), F.col("rating").desc_nulls_last(), "link")
    ranked = pairs.join(items.select("link", "rating"), "link").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    return ranked.select("seed", F.col("pos").cast("long").alias("pos"), "link", "n_relations", "relations")

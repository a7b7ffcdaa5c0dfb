"""Catalog responses (K6, K7, K10) composed from the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as C

# Fixed values of the attribution record.
LICENSE = "CC BY-SA 3.0"
NOTICE = ("Content from the SCP Wiki is licensed under CC BY-SA 3.0. "
          "Derivatives must be shared under the same license.")
MIN_CONTENT_LENGTH = 100


def attribution(items: DataFrame, history: DataFrame | None = None, enabled: bool = True,
                min_length: int = MIN_CONTENT_LENGTH) -> DataFrame:
    """(link, title, url, authors, license, notice, short) for every item;
    ``short`` flags a primary content under ``min_length`` characters. ``history`` is the long
    (scp_number, author) table; authors are aggregated per item (bounded by
    the item's edits) and merged with the creator."""
    if not enabled:
        items = items.where(F.lit(False))
    short = F.coalesce(F.length(C.primary_content()), F.lit(0)) < min_length
    it = items.select("scp_number", "link", "title", "url", "creator", short.alias("short"))
    if history is not None:
        # distinct (item, author) pairs first: the map-side partial aggregate
        # drops repeated edits before anything is shuffled, so an item with a
        # huge history ships each author once
        ha = (history.where(F.col("author").isNotNull()).select("scp_number", "author").distinct()
              .groupBy("scp_number").agg(F.collect_list("author").alias("h_authors")))
        it = it.join(ha, "scp_number", "left")
    else:
        it = it.withColumn("h_authors", F.array().cast("array<string>"))
    authors = F.array_sort(F.array_distinct(F.concat(
        F.when(F.col("creator").isNotNull(), F.array("creator")).otherwise(F.array().cast("array<string>")),
        F.coalesce("h_authors", F.array().cast("array<string>")))))
    return it.select("link", "title", "url", authors.alias("authors"),
                     F.lit(LICENSE).alias("license"), F.lit(NOTICE).alias("notice"), "short")


def content_response(items: DataFrame) -> DataFrame:
    """K6: the four texts, url, hash, commit and ``fallback`` (no markdown)."""
    return items.select("link", "markdown", "raw_content", "raw_source", "summary", "url",
                        "content_sha1", "dataset_commit",
                        C.nz("markdown").isNull().alias("fallback"),
                        C.primary_content().alias("best_content"),
                        C.summary_content().alias("summary_content"))


def get_items(items: DataFrame, requests: DataFrame, include_content: bool = False,
              request: str = "request") -> DataFrame:
    """K2 / K8: the best-matching item for each requested identifier.
    ``include_content=False`` (item metadata) drops the whole-text columns
    before the join, so they are never read from storage (column pruning)."""
    from ..operators.lookup import lookup_many
    from ..schemas import HEAVY_COLUMNS
    best = lookup_many(items, requests, request).select(request, "link", "match_rank")
    cols = [c for c in items.columns if include_content or c not in HEAVY_COLUMNS]
    return best.join(items.select(*cols), "link")


def get_item_content(items: DataFrame, requests: DataFrame, request: str = "request") -> DataFrame:
    """K6 for identifiers: the content response of each requested item."""
    from ..operators.lookup import lookup_many
    best = lookup_many(items, requests, request).select(request, "link")
    return best.join(content_response(items), "link")


def series_resource(items: DataFrame, series_id: str) -> DataFrame:
    """K8 series resource: ``1`` means ``series-1``; other ids as given."""
    sid = str(series_id)
    name = f"series-{sid}" if sid.isdigit() else sid
    return items.where(F.col("series") == F.lit(name))

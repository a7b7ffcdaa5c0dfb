"""The item table built from the driver's tables (mapping in FIXTURES.md §3).

documents  -> identity, title, series, raw_source      (one projection)
orders     -> created_at, rating via customer balance   (left joins on key)
pages      -> raw_content (HTML), content_sha1, images  (left join on key)
labels     -> tags euclid/keter/hostile                 (long table)
lineitem   -> references                                (long table)
events     -> history, spread over items by event_id    (long table)

The long tables are also exposed on their own (``item_tags`` ...) because most
catalog queries need them as edges, not as arrays; the array columns are only
built when a caller asks for the full 23-column item row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_DOMAIN
from ..schemas import ITEM_COLUMNS
from .tables import read_table

# Fixed values of the mapping.
URL_BASE = "https://wiki.example.org/"
JOKE_EVERY = 50          # doc_id % 50 == 49 is a suffixed "-J" item
CREATOR_NULL_EVERY = 10  # doc_id % 10 == 0 has no creator


def _base_label(doc_id):
    return F.concat(F.lit("SCP-"), F.when(doc_id < 1000, F.lpad(doc_id.cast("string"), 3, "0"))
                    .otherwise(doc_id.cast("string")))


def item_core(spark: SparkSession, sf_dir: str, with_text: bool = True, with_meta: bool = True) -> DataFrame:
    """One row per document: every scalar item column. ``with_text=False``
    prunes the two whole-text columns (and the pages scan) away;
    ``with_meta=False`` skips the orders/customer joins (rating, created_at,
    creator) for jobs that only need identity and text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    if with_text:
        # Whole texts ride along: spread them before the per-row work when the
        # scan gives fewer splits than the cluster has cores, by the key that
        # the joins below need, so that they are shuffled once.
        docs = docs.repartition("doc_id")
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])

    d = F.col("doc_id")
    base = _base_label(d)
    joke = (d % JOKE_EVERY) == JOKE_EVERY - 1
    items = docs.select(
        d.alias("scp_number"),
        F.when(joke, F.concat(F.lower(base), F.lit("-j"))).otherwise(F.lower(base)).alias("link"),
        F.when(joke, F.concat(base, F.lit("-J"))).otherwise(base).alias("scp"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.when(joke, F.lit("joke")).otherwise(
            F.concat(F.lit("series-"), (F.floor(d / 1000.0).cast("bigint") + 1).cast("string"))
        ).alias("series"),
        F.concat(F.lit(URL_BASE), F.lower(base)).alias("url"),
        F.col("text").alias("raw_source"),
        F.array(F.concat(F.lit("hub-"), F.col("source"))).alias("hubs"),
    )
    # Each step is one projection (chained withColumn calls would re-analyse
    # the growing plan once per column).
    keep = [c for c in items.columns if with_text or c != "raw_source"]
    if with_meta:
        oc = (orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
              .select(F.col("o_orderkey"), F.col("o_orderdate"), F.col("c_name"), F.col("c_acctbal")))
        items = items.join(oc, items.scp_number == oc.o_orderkey, "left").select(
            *keep, F.floor("c_acctbal").cast("bigint").alias("rating"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
            F.when((F.col("scp_number") % CREATOR_NULL_EVERY) == 0, None).otherwise(F.col("c_name")).alias("creator"))
        keep = items.columns
    if with_text:
        pages = read_table(spark, sf_dir, "pages", ["page_id", "html"])
        items = items.join(pages, items.scp_number == pages.page_id, "left").select(
            *keep, F.col("html").alias("raw_content"), F.sha1("html").alias("content_sha1"))
    else:
        items = items.select(*keep)
    return items


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scp_number, tag): language, source, quality and toxic labels."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return (docs.select(F.col("doc_id").alias("scp_number"),
                        F.concat(F.lit("lang-"), F.col("lang")).alias("tag"))
            .unionByName(docs.select(F.col("doc_id").alias("scp_number"), F.col("source").alias("tag")))
            .unionByName(labels.select(F.col("doc_id").alias("scp_number"),
                                       F.when(F.col("quality") == 1, "euclid").otherwise("keter").alias("tag")))
            .unionByName(labels.where(F.col("toxic") == 1)
                         .select(F.col("doc_id").alias("scp_number"), F.lit("hostile").alias("tag"))))


def item_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scp_number, hub): one hub per document source (the long form of the
    ``hubs`` column that ``item_core`` projects)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return docs.select(F.col("doc_id").alias("scp_number"),
                       F.concat(F.lit("hub-"), F.col("source")).alias("hub"))


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scp_number, markdown, summary): texts that are stored with an item. The
    benchmark passage of the same number is its Markdown, the first answer of
    the conversation of that number its summary."""
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    markdown = bench.groupBy(F.col("item_id").alias("scp_number")).agg(F.min("text").alias("markdown"))
    summary = conv.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("scp_number")).agg(
        F.min_by("text", F.struct("turn", "text")).alias("summary"))
    return markdown.join(summary, "scp_number", "full_outer")


def item_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scp_number, ref_link): order lines as references, part key as slug.
    Distinct per (item, slug); only orders that are items: the other lines are
    dropped first, and all steps use the one shuffle by order."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    pk = F.col("l_partkey")
    return li.join(docs, li.l_orderkey == docs.doc_id, "left_semi").select(
        F.col("l_orderkey").alias("scp_number"),
        F.concat(F.lit("scp-"), F.when(pk < 1000, F.lpad(pk.cast("string"), 3, "0"))
                 .otherwise(pk.cast("string"))).alias("ref_link")).distinct()


def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scp_number, seq, author, date, comment): events spread over items by
    ``event_id % number_of_documents`` (the count is a scalar subquery, run
    once when the plan runs; no action while the plan is built)."""
    n_docs = read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.count(F.lit(1))).scalar()
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return ev.select(
        (F.col("event_id") % F.greatest(n_docs, F.lit(1))).alias("scp_number"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.col("event_type").alias("comment"),
    )


IMG_SRC_RE = r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""


def build_items(spark: SparkSession, sf_dir: str, tags: bool = True, references: bool = True,
                history: bool = True, dataset_commit: str | None = None) -> DataFrame:
    """The full 23-column item table. Arrays are aggregated per item (bounded:
    a handful of tags, the lines of one order, the events of one item) and
    joined back on the item key; each part can be switched off so that a
    query pays only for what it reads."""
    items = item_core(spark, sf_dir, with_text=True)
    empty = F.array().cast("array<string>")
    hist_t = "array<struct<author:string,date:timestamp_ntz,comment:string>>"
    parts = {}
    if tags:
        parts["tags"] = item_tags(spark, sf_dir).groupBy("scp_number").agg(
            F.array_sort(F.collect_list("tag")).alias("tags"))
    if references:
        parts["references"] = item_references(spark, sf_dir).groupBy("scp_number").agg(
            F.array_sort(F.collect_list("ref_link")).alias("references"))
    if history:
        parts["history"] = (
            item_history(spark, sf_dir).groupBy("scp_number")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "author", "date", "comment"))).alias("h"))
            .select("scp_number", F.transform("h", lambda e: F.struct(
                e["author"].alias("author"), e["date"].alias("date"), e["comment"].alias("comment")))
                .alias("history")))
    for part in parts.values():
        items = items.join(part, "scp_number", "left")
    defaults = {"tags": empty, "references": empty, "history": F.array().cast(hist_t)}
    fixed = {
        "domain": F.lit(DEFAULT_DOMAIN),
        "page_id": F.lit(None).cast("string"),
        "markdown": F.lit(None).cast("string"),
        "summary": F.lit(None).cast("string"),
        "images": F.coalesce(F.regexp_extract_all("raw_content", F.lit(IMG_SRC_RE), 1), empty),
        "content_file": F.lit(None).cast("string"),
        "dataset_commit": F.lit(dataset_commit).cast("string"),
        "hubs": F.coalesce("hubs", empty),
    }
    cols = []
    for c in ITEM_COLUMNS:
        if c in fixed:
            cols.append(fixed[c].alias(c))
        elif c in defaults:
            cols.append((F.coalesce(c, defaults[c]) if c in parts else defaults[c]).alias(c))
        else:
            cols.append(F.col(c))
    return items.select(*cols)

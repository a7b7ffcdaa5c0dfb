"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Every query reads the data folder's tables (or what Spark derives from them)
in full; parameters are fixed here and mirrored in ``oracle_sql``. Array
columns are flattened to sorted, comma-joined strings so that both engines
hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import item_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _join_arr(c: str):
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(F.col(c)), ","))


def _items_with_tags(spark, sf_dir, with_text=False, with_meta=True):
    core = item_view.item_core(spark, sf_dir, with_text=with_text, with_meta=with_meta)
    tags = item_view.item_tags(spark, sf_dir).groupBy("scp_number").agg(
        F.array_sort(F.collect_list("tag")).alias("tags"))
    return (core.join(tags, "scp_number", "left")
            .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
            .withColumn("summary", F.lit(None).cast("string")))


# ----------------------------------------------------------------- K1 search

@register
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 minimum slice: tags all of [lang-en, euclid], series-1, rating >= 0,
    page of 25 ordered by rating desc, link asc, as hits."""
    items = _items_with_tags(spark, sf_dir)
    page = search.search_items(items, tags=["lang-en", "euclid"], series="series-1", min_rating=0, limit=25)
    return page.withColumn("tags", F.array_join("tags", ","))


# --------------------------------------------------- A4/C8 item table

@register
def items_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built 23-column item table, arrays flattened, texts as hashes."""
    it = item_view.build_items(spark, sf_dir)
    return it.select(
        "link", "scp", "scp_number", "title", "series", "rating", "created_at", "creator", "url",
        "domain", "content_sha1",
        F.sha1("raw_source").alias("raw_source_sha1"),
        _join_arr("tags").alias("tags"), _join_arr("hubs").alias("hubs"),
        _join_arr("references").alias("refs"), F.size("images").cast("bigint").alias("n_images"),
        F.size("history").cast("bigint").alias("n_history"))


@register
def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = item_view.build_items(spark, sf_dir, references=False, history=False)
    return it.select("link", F.explode("tags").alias("tag"))


@register
def item_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = item_view.build_items(spark, sf_dir, tags=False, history=False)
    return it.select("link", F.explode("references").alias("ref_link"))


@register
def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = item_view.build_items(spark, sf_dir, tags=False, references=False)
    return it.select("link", F.posexplode("history").alias("pos", "h")).select(
        "link", F.col("pos").cast("bigint").alias("pos"), "h.author", "h.date", "h.comment")


# ------------------------------------------------------- B ids and selection

def _labels(spark, sf_dir):
    return item_view.item_core(spark, sf_dir, with_text=False, with_meta=False).select(F.col("scp").alias("label"))


def _id_inputs(spark, sf_dir):
    """Mixed identifier spellings derived from the documents (every row)."""
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False).select("scp_number", "link", "scp")
    n = F.col("scp_number").cast("string")
    return (core.select(F.lit("number").alias("kind"), n.alias("input"))
            .unionByName(core.select(F.lit("prefixed").alias("kind"), F.concat(F.lit("scp-"), n).alias("input")))
            .unionByName(core.select(F.lit("link").alias("kind"), F.col("link").alias("input")))
            .unionByName(core.select(F.lit("zero_padded").alias("kind"), F.lpad(n, 6, "0").alias("input")))
            .unionByName(core.select(F.lit("bare_suffix").alias("kind"),
                                     F.regexp_replace(F.col("scp"), "^SCP-", "").alias("input"))))


@register
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 and B2 over every spelling of every item id, plus the range number."""
    from ..functions.ids import label_number, normalize_id
    inp = _id_inputs(spark, sf_dir)
    return inp.select("kind", "input",
                      normalize_id("input", True).alias("norm_loader"),
                      normalize_id("input", False).alias("norm_script"),
                      label_number(normalize_id("input", True)).cast("bigint").alias("number"))


def _part_requests(spark, sf_dir):
    li = item_view.read_table(spark, sf_dir, "lineitem", ["l_partkey"])
    return li.select(F.col("l_partkey").cast("string").alias("request")).distinct()


@register
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import choose
    return choose(_labels(spark, sf_dir), item_or_range="250-100")


@register
def select_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 for many ids: items named by the part keys of the order lines."""
    from ..operators.selection import select_requested
    return select_requested(_labels(spark, sf_dir), _part_requests(spark, sf_dir))


@register
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import choose
    return choose(_labels(spark, sf_dir), random_n=25, seed=42)


@register
def invalid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 + K9: part-key requests that are no item, with nearest suggestions."""
    from ..operators.lookup import not_found_with_suggestions
    items = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    out = not_found_with_suggestions(_part_requests(spark, sf_dir), items)
    return out.withColumn("suggestions", F.when(F.size("suggestions") > 0, F.array_join("suggestions", ",")))


@register
def shard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ids import file_link, shard_folder
    inp = _id_inputs(spark, sf_dir)
    sh = shard_folder(scp="input")
    fl = file_link("input")
    return inp.select("kind", "input", sh.alias("shard"), fl.alias("file_link"),
                      F.concat_ws("/", F.lit("markdown"), sh, F.concat(fl, F.lit(".md"))).alias("path"))


# ------------------------------------------------------------ C4 / K2 lookup

@register
def identifier_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lookup import variant_table
    v = variant_table(item_view.item_core(spark, sf_dir, with_text=False, with_meta=False))
    return v.select("link", F.col("pos").cast("bigint").alias("pos"), "variant")


def _lookup_requests(spark, sf_dir):
    li = item_view.read_table(spark, sf_dir, "lineitem", ["l_partkey"]).select("l_partkey").distinct()
    pk = F.col("l_partkey").cast("string")
    return (li.select(pk.alias("request"))
            .unionByName(li.select(F.concat(F.lit("SCP-"), pk).alias("request")))
            .unionByName(li.select(F.concat(F.lit("scp-"), pk, F.lit("-j")).alias("request"))))


@register
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lookup import lookup_many as lm
    items = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    return lm(items, _lookup_requests(spark, sf_dir)).select("request", "link", "match_rank")


# --------------------------------------------------- C5 / K7 / K8 / E5 lists

@register
def item_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(_items_with_tags(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@register
def items_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: compact catalog with the total count (a scalar subquery)."""
    items = item_view.item_core(spark, sf_dir, with_text=False)
    total = items.select(F.count(F.lit(1))).scalar()
    return items.select("link", "scp", "title", "series", "rating", total.cast("bigint").alias("total_count"))


@register
def series_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 series resource: ``1`` means ``series-1``."""
    sid = "1"
    series = f"series-{sid}" if sid.isdigit() else sid
    items = _items_with_tags(spark, sf_dir).where(F.col("series") == series)
    return search.hits(items).withColumn("tags", F.array_join("tags", ","))


@register
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_view.item_core(spark, sf_dir, with_text=False)
    return items.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.avg("rating"), 6).alias("avg_rating"),
        F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"))


@register
def search_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second keyset page (cursor taken from page 1) of all items."""
    items = _items_with_tags(spark, sf_dir)
    p1 = search.browse_page(items, 25)
    cur = search.next_cursor(p1, 25)
    page = search.search_items(items, min_rating=None, limit=25, cursor=cur)
    return page.withColumn("tags", F.array_join("tags", ","))


# ------------------------------------------------- C1-C3 / C9 / K6 / K10 / I1

def _content_items(spark, sf_dir):
    core = item_view.item_core(spark, sf_dir, with_text=True)
    return core.join(item_view.stored_texts(spark, sf_dir), "scp_number", "left")


@register
def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text each accessor picks (as sha1 of whole texts)."""
    from ..functions import content as C
    it = _content_items(spark, sf_dir)
    return it.select(
        "link", C.primary_source().alias("primary_source"),
        F.sha1(C.primary_content()).alias("primary_sha1"),
        F.sha1(C.summary_content()).alias("summary_sha1"),
        C.has_content().alias("has_content"),
        F.sha1(C.html_pick()).alias("html_sha1"),
        C.nz("markdown").isNull().alias("fallback"))


@register
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-detection hash of raw_content (non-empty only)."""
    from ..functions.content import content_sha1
    it = item_view.item_core(spark, sf_dir, with_text=True, with_meta=False)
    return it.select("link", content_sha1("raw_content").alias("content_sha1"),
                     F.sha1("raw_source").alias("source_sha1"))


@register
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution of every item, flagged where it has under 100 characters;
    authors = creator and history authors, distinct, sorted."""
    from ..plans.catalog import attribution as attr
    it = _content_items(spark, sf_dir)
    hist = item_view.item_history(spark, sf_dir)
    out = attr(it, hist)
    return out.withColumn("authors", F.array_join("authors", ","))


# ------------------------------------------------------------ K1 BM25 / K3

@register
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top-5 items per benchmark passage over title + tags + content."""
    items = (_items_with_tags(spark, sf_dir, with_text=True, with_meta=False)
             .withColumn("markdown", F.lit(None).cast("string")))
    bench = item_view.read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    qs = bench.select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_search(items, qs, 5, "link", search.search_text(items)).select(
        "query_id", "link", "score", F.col("rank").cast("bigint").alias("rank"))


@register
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: 3 nearest vectors (cosine) to each label centroid."""
    from ..operators.vectors import label_centroids, topk_cosine
    emb = item_view.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    q = label_centroids(emb)
    return topk_cosine(emb.select("vec_id", "embedding"), q, 3).select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------ K4 / K5

def _refs(spark, sf_dir):
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False).select("scp_number", "link")
    return item_view.item_references(spark, sf_dir).join(core, "scp_number").select("link", "ref_link")


def _joke_seeds(spark, sf_dir):
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    return core.where(F.col("series") == "joke").select(F.col("link").alias("seed"))


@register
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: items related to the joke items by references (out and in)."""
    from ..operators.related import related
    items = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    rel = related(_joke_seeds(spark, sf_dir), _refs(spark, sf_dir), items)
    return rel.withColumn("relations", F.array_join("relations", ","))


@register
def related_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 result: the related items of each joke item as hits, in rank order."""
    from ..operators.related import related, related_ranked
    items = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    rel = related(_joke_seeds(spark, sf_dir), _refs(spark, sf_dir), items)
    ranked = related_ranked(rel, _items_with_tags(spark, sf_dir))
    return ranked.select("seed", F.col("pos").cast("bigint").alias("pos"), "link", "n_relations",
                         F.array_join("relations", ",").alias("relations"), "scp", "scp_number", "title", "series", "rating",
                         F.when(F.size("tags") > 0, F.array_join("tags", ",")).alias("tags"))


@register
def related_with_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 with hubs: the first 25 related items of every joke item, by
    references out and in and shared hubs together."""
    from ..operators.related import related_list
    items = item_view.item_core(spark, sf_dir, with_text=False).select("scp_number", "link", "rating")
    hubs = item_view.item_hubs(spark, sf_dir).join(items.select("scp_number", "link"), "scp_number").select("link", "hub")
    rel = related_list(_joke_seeds(spark, sf_dir), _refs(spark, sf_dir), hubs, items.select("link", "rating"), 25)
    return rel.withColumn("relations", F.array_join("relations", ","))


@register
def related_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 shared hubs of the joke items, with member counts."""
    from ..operators.related import related_hubs as rh
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False).select("scp_number", "link")
    hubs = item_view.item_hubs(spark, sf_dir).join(core, "scp_number").select("link", "hub")
    return rh(_joke_seeds(spark, sf_dir), hubs)


@register
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.related import dangling
    items = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    return dangling(_refs(spark, sf_dir), items).select("link", "ref_link")


@register
def random_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: one seeded random hit among series-1 items tagged euclid."""
    from ..operators.selection import sample
    items = search.filter_items(_items_with_tags(spark, sf_dir), tags=["euclid"], series="series-1",
                                min_rating=None)
    pick = sample(items, 1, seed=7, key="scp")
    return search.hits(pick).withColumn("tags", F.array_join("tags", ","))


# ------------------------------------------------- L1 / L2 diff, sync, merge

def _old_snapshot(spark, sf_dir):
    """The previous snapshot as Spark derives it from the tables: items that
    carry labels, with the hash of the raw source where the quality label is
    0 (their page changed since), plus the slugs that references still name
    but that no longer exist (removed since)."""
    core = item_view.item_core(spark, sf_dir, with_text=True, with_meta=False)
    labels = item_view.read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    kept = (core.join(labels, core.scp_number == labels.doc_id)
            .select("link", F.when(F.col("quality") == 0, F.sha1("raw_source"))
                    .otherwise(F.col("content_sha1")).alias("content_sha1")))
    from ..operators.related import dangling
    gone = (dangling(_refs(spark, sf_dir), core).select(F.col("ref_link").alias("link")).distinct()
            .withColumn("content_sha1", F.lit(None).cast("string")))
    return kept.unionByName(gone)


@register
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diff import snapshot_diff as sd
    new = item_view.item_core(spark, sf_dir, with_text=True, with_meta=False).select("link", "content_sha1")
    return sd(_old_snapshot(spark, sf_dir), new)


@register
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diff import snapshot_diff as sd
    from ..operators.diff import sync_summary as ss
    new = item_view.item_core(spark, sf_dir, with_text=True, with_meta=False).select("link", "content_sha1")
    return ss(sd(_old_snapshot(spark, sf_dir), new))


@register
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 merge: the new items plus old rows whose link is not new."""
    from ..operators.diff import merge_upsert as mu
    new = (item_view.item_core(spark, sf_dir, with_text=True, with_meta=False).select("link", "content_sha1")
           .withColumn("origin", F.lit("new")))
    old = _old_snapshot(spark, sf_dir).withColumn("origin", F.lit("old"))
    return mu(old, new)


# ------------------------------------------- L4 / L5 retention, version info

def _versions_log(spark, sf_dir):
    """A version log derived from the orders: one publish per order date of
    each priority class (table name); row_count = orders of that day."""
    o = item_view.read_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderdate"])
    per_day = o.groupBy(F.col("o_orderpriority").alias("table_name"),
                        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at")).agg(
        F.count(F.lit(1)).alias("row_count"))
    from pyspark.sql import Window
    w = Window.partitionBy("table_name").orderBy("created_at")
    return (per_day.withColumn("version", F.row_number().over(w).cast("bigint"))
            .withColumn("dataset_commit", F.substring(F.sha1(F.col("created_at").cast("string")), 1, 12)))


@register
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.publish import retention_plan as rp
    return rp(_versions_log(spark, sf_dir), keep=20).select("table_name", "version", "created_at")


@register
def version_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.publish import version_info as vi
    return vi(_versions_log(spark, sf_dir))


# ---------------------------------------------------------------- G1 / L6

@register
def dump_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: rows 11..30 of the item table in link order (columns)."""
    from ..plans.publish import dump_page as dp
    it = item_view.build_items(spark, sf_dir, references=False, history=False)
    page = dp(it, offset=10, limit=20)
    return page.select("link", "scp", "scp_number", "title", "series", "rating", "created_at", "creator",
                       "url", _join_arr("tags").alias("tags"), "content_sha1")


def _fields_of(lines: DataFrame, column: str, *more: str) -> DataFrame:
    """JSON objects of items read back by field."""
    field = lambda name: F.get_json_object(column, f"$.{name}")
    strings = lambda name: F.array_join(F.from_json(field(name), "array<string>"), ",")
    edits = F.from_json(field("history"), "array<struct<author:string,date:string,comment:string>>")
    return lines.select(
        *more, *[field(c).alias(c) for c in ("link", "scp", "title", "series", "url", "creator", "created_at", "content_sha1") if c not in more],
        *[field(c).cast("bigint").alias(c) for c in ("scp_number", "rating")],
        *[strings(c).alias(c) for c in ("tags", "references", "hubs")],
        F.sha1(field("raw_source")).alias("source_sha1"), F.sha1(field("raw_content")).alias("html_sha1"),
        F.sha1(F.array_join(F.transform(edits, lambda e: F.concat_ws("|", e["author"], e["date"], e["comment"])), ",")).alias("history_sha1"))


@register
def dump_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole item table as JSON lines (nulls kept), read back by field:
    arrays joined, whole texts and the history as hashes."""
    from ..plans.publish import dump_jsonl
    return _fields_of(dump_jsonl(item_view.build_items(spark, sf_dir)), "json")


@register
def history_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's history written as JSON text and read back, and
    every event's properties read as a history text, which they are not."""
    from ..functions.content import iso_format, parse_history
    it = item_view.build_items(spark, sf_dir, tags=False, references=False)
    edits = F.transform("history", lambda h: F.struct(h["author"].alias("author"), iso_format(h["date"]).alias("date"), h["comment"].alias("comment")))
    texts = it.select("link", F.to_json(edits, {"ignoreNullFields": "false"}).alias("text"))
    events = item_view.read_table(spark, sf_dir, "events", ["event_id", "props"])
    texts = texts.unionByName(events.select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("link"), F.col("props").alias("text")))
    parsed, raw = parse_history("text")
    return texts.select("link", F.size(parsed).cast("bigint").alias("n_edits"), raw.alias("raw"), F.sha1(F.array_join(F.transform(
        parsed, lambda e: F.concat_ws("|", e["author"], e["date"], e["comment"])), ",")).alias("edits_sha1"))


@register
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 / K8 by identifier: the metadata of the best-matching item of each
    request (no text column is read)."""
    from ..plans.catalog import get_items
    items = item_view.item_core(spark, sf_dir, with_text=False)
    return get_items(items, _lookup_requests(spark, sf_dir)).select(
        "request", "match_rank", "link", "scp", "scp_number", "title", "series", "rating", "created_at", "creator", "url")


# ------------------------------------------------------- I9-I12 frontmatter

@register
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.exports import frontmatter as fm
    it = item_view.build_items(spark, sf_dir, history=False)
    return it.select("link", fm().alias("frontmatter"))


@register
def strip_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 on exported documents (frontmatter + raw source): the body is back."""
    from ..functions.content import strip_frontmatter as sfm
    from ..plans.exports import frontmatter as fm
    it = item_view.build_items(spark, sf_dir, history=False)
    doc = F.concat(fm(), F.lit("\n\n"), F.col("raw_source"))
    body = sfm(doc)
    return it.select("link", F.sha1(body).alias("body_sha1"), F.length(body).cast("bigint").alias("body_len"))


# ------------------------------------------------------------ N2 worklist

def _existing_summaries(spark, sf_dir):
    """Items with a staged summary: the ones with quality labels (derived)."""
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False).select("scp_number", "link")
    labels = item_view.read_table(spark, sf_dir, "labels", ["doc_id"])
    return core.join(labels, core.scp_number == labels.doc_id, "left_semi").select("link")


@register
def summary_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every item without a staged summary, from its
    stored Markdown, its converted page, or its source."""
    from ..plans.summaries import worklist
    it = _content_items(spark, sf_dir)
    wl = worklist(it, _existing_summaries(spark, sf_dir), convert_html=True)
    return wl.select("link", "source", "part", "n_parts", F.sha1("prompt").alias("prompt_sha1"),
                     F.length("prompt").cast("bigint").alias("prompt_len"))


# ---------------------------------------------------------- §1.3 validate

def _raw_items(spark, sf_dir):
    """Raw (string) items: number given as the label text, dates as ISO
    text with a zone that depends on the language."""
    core = item_view.item_core(spark, sf_dir, with_text=False)
    docs = item_view.read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    zone = (F.when(F.col("lang") == "en", "Z").when(F.col("lang") == "fr", "+02:00")
            .when(F.col("lang") == "de", "-05:30").otherwise(""))
    return (core.join(docs, core.scp_number == docs.doc_id)
            .select("link", "scp", F.col("scp").alias("scp_number"), "title", "series", "url",
                    F.col("rating").cast("string").alias("rating"), "creator",
                    F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone).alias("created_at")))


@register
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validate import validate, with_defaults
    v = with_defaults(validate(_raw_items(spark, sf_dir)))
    return v.select("link", "valid", F.col("number").alias("scp_number"),
                    F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"),
                    "rating", "created_at")


# ---------------------------------------------------- N1 / B8 / E1 runs

@register
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 dry run of an export: paths and whether staged files exist
    (markdown staged for items with a page, summaries for labelled items)."""
    from ..plans.exports import export_plan as ep
    core = item_view.item_core(spark, sf_dir, with_text=False, with_meta=False)
    pages = item_view.read_table(spark, sf_dir, "pages", ["page_id"])
    staged_md = core.join(pages, core.scp_number == pages.page_id, "left_semi").select("link")
    return ep(core, staged_md, _existing_summaries(spark, sf_dir))


@register
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of an import over every label and every part-key request:
    not loadable -> skipped, invalid -> error, else imported."""
    from ..operators.validate import validate
    from ..functions.ids import normalize_id
    v = validate(_raw_items(spark, sf_dir)).select(F.col("scp").alias("label"), "valid")
    req = _part_requests(spark, sf_dir).select(normalize_id("request", False).alias("label")).distinct()
    run = v.select("label").unionByName(req).distinct()
    st = run.join(v, "label", "left").select(
        "label", F.when(F.col("valid").isNull(), "skipped").when(F.col("valid"), "imported")
        .otherwise("error").alias("status"))
    from ..plans.exports import run_counts as rc
    return rc(st)


# ---------------------------------------------------------- J18-J22 pages

def _pages(spark, sf_dir):
    from ..sources.tables import ensure_parallelism
    return ensure_parallelism(item_view.read_table(spark, sf_dir, "pages", ["page_id", "html"]))


@register
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, seq, kind, token length, token sha1) for every token."""
    from ..functions.html_extract import token_kind, tokens
    t = _pages(spark, sf_dir).select("page_id", F.posexplode(tokens("html")).alias("seq", "token"))
    return t.select("page_id", F.col("seq").cast("bigint").alias("seq"), token_kind(F.col("token")).alias("kind"),
                    F.length("token").cast("bigint").alias("len"), F.sha1("token").alias("token_sha1"))


@register
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.html_extract import links
    t = _pages(spark, sf_dir).select("page_id", F.posexplode(links("html")).alias("pos", "l"))
    return t.select("page_id", F.col("pos").cast("bigint").alias("pos"), "l.href", "l.text")


@register
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.html_extract import images
    t = _pages(spark, sf_dir).select("page_id", F.posexplode(images("html")).alias("pos", "i"))
    return t.select("page_id", F.col("pos").cast("bigint").alias("pos"), "i.src", "i.alt", "i.markdown")


@register
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.html_extract import headings, page_title
    t = _pages(spark, sf_dir).select("page_id", page_title("html").alias("title"),
                                      F.posexplode_outer(headings("html")).alias("pos", "h"))
    return t.select("page_id", "title", F.col("pos").cast("bigint").alias("pos"), "h.level", "h.text")


@register
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.html_extract import plain_text
    t = _pages(spark, sf_dir).select("page_id", plain_text("html").alias("text"))
    return t.select("page_id", F.length("text").cast("bigint").alias("text_len"), F.sha1("text").alias("text_sha1"))


# ------------------------------------------------- J0-J17 corpus page jobs

@register
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, the live text nodes left after cleaning (count and
    hash of their concatenation)."""
    from ..operators.html_markdown import clean_pages as cp
    c = cp(_pages(spark, sf_dir))
    live = F.filter("nodes", lambda n: n["alive"] & (n["tag"] == "#text"))
    text = F.array_join(F.transform(live, lambda n: n["own"]), "")
    return c.select("page_id", "root", F.size("nodes").alias("n_nodes"), F.size(live).alias("n_live_text"),
                    F.sha1(text).alias("text_sha1"), "shred_error")


@register
def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every page."""
    from ..operators.html_markdown import pages_to_markdown as p2m
    return p2m(_pages(spark, sf_dir)).select("page_id", "markdown", "md_source", "error")


# ---------------------------------------------------------- N1 exports

@register
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's Markdown file: stored Markdown, or its page
    converted by the page job, or its source."""
    from ..plans.exports import markdown_exports
    it = item_view.build_items(spark, sf_dir, history=False).drop("markdown", "summary")
    ex = markdown_exports(it.join(item_view.stored_texts(spark, sf_dir), "scp_number", "left"), spread=False)
    return ex.select("link", "path", "source", F.length("body").alias("body_len"),
                     F.sha1("body").alias("body_sha1"))


@register
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a JSON file body, read back by field."""
    from ..plans.exports import json_exports
    return _fields_of(json_exports(item_view.build_items(spark, sf_dir)), "body", "path")


@register
def search_ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K1a with text queries: for every benchmark passage the second
    keyset page (25 items) of the series-1 items tagged lang-en by BM25 score."""
    items = (_items_with_tags(spark, sf_dir, with_text=True, with_meta=True)
             .withColumn("markdown", F.lit(None).cast("string")))
    bench = item_view.read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    queries = bench.select(F.col("item_id").alias("query_id"), "text")
    ranked = search.ranked_results(items, queries, tags=["lang-en"], series="series-1", min_rating=None, materialize=True)
    page = search.page_of_each(ranked, 25, search.cursors_of(search.page_of_each(ranked, 25), 25))
    return page.withColumn("tags", F.array_join("tags", ",")).withColumn("rank", F.col("rank").cast("bigint"))


@register
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table profile in one aggregation (partial + final): rows,
    rows above a rating, rows with a tag, rows with content, per series."""
    from ..functions.content import has_content
    items = _items_with_tags(spark, sf_dir, with_text=True).withColumn("markdown", F.lit(None).cast("string"))
    return items.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("rating") >= 1000).alias("n_rating_ge_1000"),
        F.count_if(F.array_contains("tags", "euclid")).alias("n_euclid"),
        F.count_if(F.array_contains("tags", "hostile")).alias("n_hostile"),
        F.count_if(has_content()).alias("n_with_content"),
        F.count_if(F.col("creator").isNull()).alias("n_no_creator"))


@register
def item_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 by identifier: the content response of each part-key request that
    names an item (best match per request), texts as hashes."""
    from ..plans.catalog import get_item_content
    items = _content_items(spark, sf_dir).withColumn("dataset_commit", F.lit(None).cast("string"))
    out = get_item_content(items, _lookup_requests(spark, sf_dir))
    return out.select("request", "link", "url", "content_sha1", "fallback",
                      F.sha1("best_content").alias("best_sha1"), F.sha1("summary_content").alias("summary_sha1"))


# ------------------------------------------- A, C6-C8, L2/L3 snapshot import

def _folder(spark, name: str) -> str:
    """A new folder of the shared scratch folder."""
    import uuid

    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _raw_of(items):
    """Items as a snapshot holds them, with their label."""
    from ..functions.content import iso_format
    history = F.transform("history", lambda h: F.struct(h["author"].alias("author"), iso_format(h["date"]).alias("date"),
                                                        h["comment"].alias("comment")))
    return items.drop("content_sha1", "content_file", "dataset_commit", "domain").select(
        F.col("scp").alias("label"), "*").withColumn("history", history).withColumn("created_at", iso_format("created_at"))


def _raw_snapshot_items(spark, sf_dir):
    """Every item as a snapshot holds it, with the quality of each of its label
    rows (``qualities``: null if it has none); written once, for snapshots and
    parts of them are counted and written from it, without a join of the texts."""
    from ..session import written
    labels = item_view.read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).groupBy(F.col("doc_id").alias("scp_number")).agg(
        F.collect_list(F.struct("quality")).alias("qualities"))
    return _raw_of(written(item_view.build_items(spark, sf_dir).join(labels, "scp_number", "left"), "items"))


@register
def import_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshot folders (labelled items; all items) are written from the
    tables; the newer one is found, loaded, validated, published as a table
    version and read back, with the commit and the total count (K7)."""
    from ..schemas import ITEM_SCHEMA
    from ..session import passing
    from ..sources import snapshots
    from .import_items import import_and_publish
    from .publish import TableStore

    root = _folder(spark, "import")
    with passing(spark):
        raw = _raw_snapshot_items(spark, sf_dir)
        snapshots.write_snapshot(raw.where("qualities is not null"), f"{root}/raw", "scp-1700000000-aaaaaaaaaaaa")
        snapshots.write_snapshot(raw, f"{root}/raw", "scp-1800000000-bbbbbbbbbbbb")
    with passing(spark):
        import_and_publish(spark, f"{root}/raw", f"{root}/tables")
    items = TableStore(spark, f"{root}/tables").read("items", schema=ITEM_SCHEMA)
    total = items.select(F.count(F.lit(1))).scalar()
    return items.select(
        "link", "scp", "scp_number", "title", "series", "rating", "created_at", "creator", "url", "domain", "content_sha1",
        F.sha1("raw_source").alias("raw_source_sha1"), _join_arr("tags").alias("tags"), _join_arr("hubs").alias("hubs"),
        _join_arr("references").alias("refs"), F.size("images").cast("bigint").alias("n_images"),
        F.size("history").cast("bigint").alias("n_history"), F.array_max(F.col("history.date")).alias("last_edit"),
        F.col("content_file").isNotNull().alias("has_file"), "dataset_commit", total.cast("bigint").alias("total_count"))


@register
def import_large_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 / A4 on the layout with one index file and one content file, maps of
    all labels: both are read by byte ranges and joined."""
    from ..sources import snapshots
    root, snapshot = _folder(spark, "maps"), "scp-1800000000-cccccccccccc"
    snapshots.write_single_maps(_raw_snapshot_items(spark, sf_dir), root, snapshot)
    items = snapshots.load_items(spark, root)
    return items.select("label", "link", "title", "series", "creator", "created_at", "content_sha1", F.sha1("raw_source").alias("raw_source_sha1"),
                        _join_arr("references").alias("refs"), F.size("history").cast("bigint").alias("n_history"), "dataset_commit")


@register
def sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: two snapshots arrive in three runs of the stream. The first run
    brings an older snapshot (labelled items, those of quality 0 with another
    page, and an item for every slug that only references name) and half of the
    newer one's content files; the second its other half; the third its index.
    A run over the same folders with no state publishes nothing more. Returned
    are the items of both published versions with their sync's record."""
    from ..operators.related import dangling
    from ..schemas import ITEM_SCHEMA
    from ..session import passing
    from ..sources import snapshots
    from ..streaming.sync_stream import sync_log
    from ..streaming.sync_stream import sync_stream as run
    from .publish import TableStore

    root = _folder(spark, "sync")
    slug = F.col("ref_link")
    newer = "scp-1800000000-bbbbbbbbbbbb"
    half = F.pmod(F.xxhash64("label"), F.lit(2))

    def once(checkpoint: str):
        run(spark, f"{root}/raw", f"{root}/tables", f"{root}/{checkpoint}", settle_seconds=86_400).awaitTermination()

    with passing(spark):
        raw = _raw_snapshot_items(spark, sf_dir)
        kept = raw.withColumn("quality", F.explode("qualities.quality")).withColumn("raw_content", F.when(
            F.col("quality") == 0, F.concat("raw_content", F.lit("<p>old</p>"))).otherwise(F.col("raw_content"))).drop("quality", "qualities")
        gone = dangling(_refs(spark, sf_dir), raw.select("link")).select(slug).distinct().select(
            F.upper(slug).alias("label"), slug.alias("link"), F.upper(slug).alias("scp"), F.upper(slug).alias("scp_number"), slug.alias("title"),
            F.lit("gone").alias("series"), F.concat(F.lit("https://wiki.example.org/"), slug).alias("url"))
        older = kept.withColumn("scp_number", F.col("scp_number").cast("string")).unionByName(gone, allowMissingColumns=True)
        snapshots.write_snapshot(older, f"{root}/raw", "scp-1700000000-aaaaaaaaaaaa")
        snapshots.write_content(raw.where(half == 0), f"{root}/raw", newer)
        once("state")
        snapshots.write_content(raw.where(half == 1), f"{root}/raw", newer)
    once("state")
    snapshots.write_index(spark, f"{root}/raw", newer)
    once("state")
    once("no-state")
    store, log = TableStore(spark, f"{root}/tables"), sync_log(spark, f"{root}/tables")
    versions = [store.read("items", v, ITEM_SCHEMA).withColumn("version", F.lit(v).cast("bigint"))
                for v in sorted(r["version"] for r in store.versions("items").select("version").collect())]
    items = versions[0].unionByName(versions[-1]) if len(versions) > 1 else versions[0]
    log = log.select("version", "snapshot", "added", "updated", "unchanged", "removed", "errors")
    return items.join(log, "version").select("version", "snapshot", "dataset_commit", "link", "scp_number", "title", "content_sha1",
                                             "added", "updated", "unchanged", "removed", "errors")


def _stand_in_model(prompts):
    """A pure function in place of a model."""
    import hashlib
    return prompts.map(lambda p: f"Summary of {len(p)} characters, {hashlib.md5(p.encode()).hexdigest()}")


@register
def staged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of all items that have a
    page and summary files (by a stand-in function) of all items without
    quality labels are written as a staged tree; the snapshot is imported with
    it, published and read back with the staged texts."""
    from ..schemas import ITEM_SCHEMA
    from ..session import passing, written
    from ..sources import snapshots
    from .exports import markdown_exports, summary_exports, write_file_tree
    from .import_items import import_and_publish
    from .publish import TableStore
    from .summaries import summarize, worklist

    root = _folder(spark, "staged")
    with passing(spark):
        items = written(item_view.build_items(spark, sf_dir), "items")  # read by both exports, the worklist and the snapshot
        write_file_tree(markdown_exports(items.where("raw_content is not null")), f"{root}/staging")
        summaries = summarize(worklist(items, _existing_summaries(spark, sf_dir)), _stand_in_model)
        write_file_tree(summary_exports(items, summaries), f"{root}/staging")
        snapshots.write_snapshot(_raw_of(items), f"{root}/raw", "scp-1800000000-bbbbbbbbbbbb")
    with passing(spark):
        import_and_publish(spark, f"{root}/raw", f"{root}/tables", f"{root}/staging")
    out = TableStore(spark, f"{root}/tables").read("items", schema=ITEM_SCHEMA)
    return out.select("link", F.sha1("markdown").alias("markdown_sha1"), F.length("markdown").cast("bigint").alias("markdown_len"),
                      "summary", F.sha1("raw_source").alias("raw_source_sha1"))

"""K1 search: filters, ordering, keyset pages (K1a) and BM25 ranking.

All filters are plain predicates on the item table: on a published table
Catalyst pushes ``series`` / ``rating`` into the parquet scan (on the item view
of the driver tables, whose columns are computed, nothing can be pushed); the tag test is an array
expression evaluated right after the scan. Pages are a global ordered limit
(``TakeOrderedAndProject``): every partition keeps its own top rows and only
those meet in one place, so the cost of a page does not grow with the table.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import primary_content
from ..schemas import HIT_COLUMNS

# Page sizes of the catalog.
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
# BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"


def tag_predicate(tags, mode: str = "all", column: str = "tags") -> Column:
    wanted = F.array(*[F.lit(t) for t in tags])
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    if mode == "all":
        return F.size(F.array_except(wanted, have)) == 0
    if mode == "any":
        return F.arrays_overlap(wanted, have)
    raise ValueError(f"tag mode must be 'all' or 'any', not {mode!r}")


def matches(tags=None, series: str | None = None, min_rating: int | None = 0, tag_mode: str = "all") -> Column:
    """K1 filters as one condition: series equality, rating >= min_rating
    (default 0, as in the catalog signature, so negative ratings are hidden),
    all (or any) tags."""
    out = F.lit(True)
    if series is not None:
        out = out & (F.col("series") == F.lit(series))
    if min_rating is not None:
        out = out & (F.col("rating") >= F.lit(int(min_rating)))
    if tags:
        out = out & tag_predicate(list(tags), tag_mode)
    return out


def filter_items(items: DataFrame, tags=None, series: str | None = None,
                 min_rating: int | None = 0, tag_mode: str = "all") -> DataFrame:
    """The items that ``matches`` holds for."""
    return items.where(matches(tags, series, min_rating, tag_mode))


def hits(items: DataFrame, *more: str) -> DataFrame:
    """Item -> hit (and the columns named in ``more``); empty tags become null. Heavy text columns are pruned."""
    cols = [F.when(F.size("tags") > 0, F.col("tags")).alias("tags") if c == "tags" else F.col(c)
            for c in HIT_COLUMNS]
    return items.select(*cols, *more)


def page_size(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_PAGE_SIZE
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit > MAX_PAGE_SIZE:
        raise ValueError(f"limit must not be above {MAX_PAGE_SIZE}; read further pages with the cursor")
    return int(limit)


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True).encode()).decode()


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()).decode())


def browse_page(items: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Empty-query search page: order rating desc, link asc; keyset cursor
    ``{"rating": r, "link": l}`` from the last row of the previous page."""
    df = items
    if cursor:
        c = decode_cursor(cursor)
        r, l = F.lit(c["rating"]), F.lit(c["link"])
        if c["rating"] is None:  # null ratings come last, by link
            df = df.where(F.col("rating").isNull() & (F.col("link") > l))
        else:
            df = df.where((F.col("rating") < r) | ((F.col("rating") == r) & (F.col("link") > l)) | F.col("rating").isNull())
    return df.orderBy(F.col("rating").desc_nulls_last(), F.col("link").asc()).limit(page_size(limit))


def next_cursor(page: DataFrame, limit: int | None = None, keys=("rating", "link")) -> str | None:
    """Cursor after ``page`` (None on a short, i.e. last, page). Reads only the
    page itself, which is at most MAX_PAGE_SIZE rows."""
    rows = page.select(*keys).collect()
    if len(rows) < page_size(limit) or not rows:
        return None
    last = rows[-1].asDict()
    return encode_cursor({k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in last.items()})


def search_items(items: DataFrame, tags=None, series=None, min_rating=0, limit=None,
                 cursor=None, tag_mode="all") -> DataFrame:
    """K1 with an empty query: filtered, ordered hits of one page."""
    return hits(browse_page(filter_items(items, tags, series, min_rating, tag_mode), limit, cursor))


def total_count(items: DataFrame, tags=None, series=None, min_rating=0, tag_mode="all") -> int:
    """Number of matches before the page limit."""
    return filter_items(items, tags, series, min_rating, tag_mode).count()


# --------------------------------------------------------------------- BM25

def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits (empty pieces dropped)."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT_RE), "")


def search_text(items: DataFrame) -> Column:
    """Searchable text: title, tags and the primary content."""
    return F.concat_ws(" ", F.col("title"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "),
                       primary_content())


def postings(docs: DataFrame, key: str = "link", text: Column | None = None) -> DataFrame:
    """(key, term, tf, dl) over whole texts. One explode per document, one
    partial+final aggregation on (key, term); persist it for many queries."""
    text = text if text is not None else F.col("text")
    toks = docs.select(F.col(key), tokens(text).alias("toks"))
    toks = toks.select(F.col(key), F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return toks.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _bm25_score(post: DataFrame, qterms: DataFrame, df: DataFrame, n_docs, avgdl, k: int, key: str,
                k1: float, b: float) -> DataFrame:
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = idf * F.col("tf") * F.lit(k1 + 1.0) / norm * F.col("qtf")
    scored = (post.join(df, "term").join(qterms, "term").groupBy("query_id", key)
              .agg(F.sum(part.cast("double")).alias("score")))
    w = _rank_window(key)
    return (scored.withColumn("score", F.round("score", 6))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def _small(df: DataFrame, limit: int) -> bool:
    return bool(limit) and df.count() <= limit


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _query_terms(queries: DataFrame) -> DataFrame:
    return (queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_topk(post: DataFrame, queries: DataFrame, k: int, key: str = "link",
              k1: float = BM25_K1, b: float = BM25_B, broadcast_limit: int = 1_000_000) -> DataFrame:
    """Top-k documents per query by BM25 (Lucene idf ``ln(1+(N-df+.5)/(df+.5))``)
    over a prebuilt (persisted) postings table (key, term, tf, dl).

    N and the mean document length come from one scalar subquery. Query terms
    are joined to the postings on ``term`` (never queries x documents) and are
    broadcast only when their number is below ``broadcast_limit`` (checked on
    the queries alone); above it the join is a shuffle join and AQE splits hot
    terms. Per-query top-k is ``row_number() <= k``, planned with a partial
    WindowGroupLimit before the shuffle.
    """
    stats = (post.groupBy(key).agg(F.first("dl").alias("dl"))
             .select(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))).scalar())
    qterms = _query_terms(queries)
    small = _small(qterms, broadcast_limit)  # bounds the terms' document frequencies too: one row per query term
    qterms = _hinted(qterms, small)
    df = post.join(qterms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    return _bm25_score(post, qterms, _hinted(df, small), stats["n"], stats["avgdl"],
                       k, key, k1, b)


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "link", text: Column | None = None,
                k1: float = BM25_K1, b: float = BM25_B, broadcast_limit: int = 1_000_000,
                partitions: int | None = None, keep: Column | None = None) -> DataFrame:
    """(query_id, key, score) for every document sharing a term with a query,
    computed without a prebuilt index (same scores as ``bm25_topk``). With
    ``keep`` only documents for which it is true are scored; the corpus
    statistics are those of all.

    Plan shape: documents are tokenized once. Their tokens -> explode -> semi
    join with the query vocabulary (broadcast, size-checked) -> tf per (doc,
    term), partial sums before the shuffle -> written. With them, under the
    null term, goes one row per document for N and the mean length. The
    statistics and the scores read what was written: document frequencies per
    term (at most one row per query term, broadcast), then only the kept
    documents' postings -> repartition by document key -> the score sum per
    (query, doc) inside those partitions, with no further exchange.
    """
    from ..session import written
    text = text if text is not None else F.col("text")
    keep = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    toks = docs.select(F.col(key), tokens(text).alias("toks"), keep.alias("keep")).select(
        key, "toks", F.size("toks").alias("dl"), "keep").where(F.col("dl") > 0)
    qterms = _query_terms(queries)
    small = _small(qterms, broadcast_limit)  # bounds the vocabulary and the document frequencies too
    vocab = qterms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("term")))
    vocab, qterms = _hinted(vocab.withColumnRenamed("term", "_term"), small), _hinted(qterms, small)
    each = toks.select(key, "dl", "keep", F.explode(F.concat(F.array(F.lit(None).cast("string")), "toks")).alias("term"))
    post = written(each.join(vocab, F.col("term").eqNullSafe(F.col("_term")), "left_semi").groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.first("keep").alias("keep"), F.sum("dl").alias("all_dl")), "bm25-postings")
    n_docs = F.coalesce(F.sum("tf"), F.lit(0)).cast("double")
    stats = post.where(F.col("term").isNull()).select(F.struct(n_docs.alias("n"), (F.sum("all_dl") / F.sum("tf")).alias("avgdl"))).scalar()
    post = post.where(F.col("term").isNotNull())
    idf = F.log(F.lit(1.0) + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = _hinted(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf")), small)
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / stats["avgdl"])
    # a posting's weight is computed once, before its queries are joined
    weight = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm
    # A fixed partition count on purpose: the shuffled rows are few, but the
    # (query, document) fan-out after them is heavy, and AQE would otherwise
    # coalesce them into a handful of tasks.
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    post = post.where("keep").select(key, "term", "tf", "dl").repartition(n, key).join(df, "term").select(key, "term", weight.alias("weight"))
    return (post.join(qterms, "term").groupBy("query_id", key)
            .agg(F.round(F.sum((F.col("weight") * F.col("qtf")).cast("double")), 6).alias("score")))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "link", text: Column | None = None,
                k1: float = BM25_K1, b: float = BM25_B, broadcast_limit: int = 1_000_000,
                partitions: int | None = None) -> DataFrame:
    """One-shot BM25 top-k per query (``bm25_scores`` + a per-query
    ``row_number() <= k``, planned with a partial WindowGroupLimit)."""
    scored = bm25_scores(docs, queries, key, text, k1, b, broadcast_limit, partitions)
    return scored.withColumn("rank", F.row_number().over(_rank_window(key))).where(F.col("rank") <= k)


def ranked_results(items: DataFrame, queries: DataFrame, tags=None, series=None, min_rating=0,
                   tag_mode: str = "all", materialize: bool = False) -> DataFrame:
    """K1 with text queries: (query_id, the columns of a hit, score) of every
    matching item. BM25's statistics are those of the whole catalog (they do
    not depend on the filters); only items that pass the filters are scored.
    ``materialize`` writes the list once (reliable checkpoint), so that every
    page of the same queries reads it instead of ranking the catalog again."""
    keep = matches(tags, series, min_rating, tag_mode)
    scored = bm25_scores(items, queries, "link", search_text(items), keep=keep)
    out = hits(items.join(scored, "link"), "query_id", "score")
    if materialize:
        from ..session import cut_lineage
        out = cut_lineage(out)
    return out


def page_of_each(results: DataFrame, limit: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """One keyset page of every query's ranked list, with ``rank`` in the page
    (from 1): the first, or those after ``cursors`` (``cursors_of`` the pages
    before; a query without one has no further page). All queries' pages are
    one job; a query matching everything sends ``limit`` rows a task."""
    df = results
    if cursors is not None:
        c = cursors.select("query_id", F.col("score").alias("_score"), F.col("link").alias("_link"))
        df = df.join(c, "query_id").where((F.col("score") < F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("link") > F.col("_link"))))
        df = df.drop("_score", "_link")
    return df.withColumn("rank", F.row_number().over(_rank_window("link"))).where(F.col("rank") <= page_size(limit))


def cursors_of(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, score, link) of the last row of every full page."""
    return pages.where(F.col("rank") == page_size(limit)).select("query_id", "score", "link")


def ranked_page_of(results: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """One keyset page of a ranked list, ordered by (score desc, link asc);
    the cursor is ``{"score": s, "link": l}`` of the previous page's last row."""
    df = results
    if cursor:
        c = decode_cursor(cursor)
        sc, lk = F.lit(float(c["score"])), F.lit(c["link"])
        df = df.where((F.col("score") < sc) | ((F.col("score") == sc) & (F.col("link") > lk)))
    return df.orderBy(F.col("score").desc(), F.col("link").asc()).limit(page_size(limit))


def ranked_page(items: DataFrame, queries: DataFrame, tags=None, series=None, min_rating=0, limit=None,
                cursor: str | None = None, tag_mode: str = "all") -> DataFrame:
    """One page without materializing: ranks the catalog for this call."""
    return ranked_page_of(ranked_results(items, queries, tags, series, min_rating, tag_mode), limit, cursor)


def _rank_window(key):
    from pyspark.sql import Window
    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key).asc())

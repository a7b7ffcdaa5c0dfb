import math
import os
import re
import shutil
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators import lookup, related, search, vectors
from quire.plans import summaries
from quire.streaming.sync_stream import sync_log, sync_stream


def test_sync_stream_publishes_each_snapshot_once(spark, raw_root, tmp_path):
    src = str(tmp_path / "raw")
    os.makedirs(src)
    shutil.copytree(os.path.join(raw_root, "scp-1700000000-aaaaaaaaaaaa"),
                    os.path.join(src, "scp-1700000000-aaaaaaaaaaaa"))
    tables, ckpt = str(tmp_path / "tables"), str(tmp_path / "ckpt")
    sync_stream(spark, src, tables, ckpt).awaitTermination()
    shutil.copytree(os.path.join(raw_root, "scp-1800000000-bbbbbbbbbbbb"),
                    os.path.join(src, "scp-1800000000-bbbbbbbbbbbb"))
    sync_stream(spark, src, tables, ckpt).awaitTermination()          # names a missing file: waits
    assert {r.dataset_commit for r in sync_log(spark, tables).collect()} == {"aaaaaaaaaaaa"}
    with open(os.path.join(src, "scp-1800000000-bbbbbbbbbbbb", "items", "late.json"), "w") as f:
        f.write("{}")
    sync_stream(spark, src, tables, ckpt, settle_seconds=0).awaitTermination()
    sync_stream(spark, src, tables, ckpt, settle_seconds=0).awaitTermination()   # nothing new
    log = {r.dataset_commit: r for r in sync_log(spark, tables).collect()}
    assert set(log) == {"aaaaaaaaaaaa", "bbbbbbbbbbbb"}
    b = log["bbbbbbbbbbbb"]
    assert (b.version, b.added, b.updated, b.unchanged, b.removed, b.errors) == (2, 3, 1, 0, 0, 1)


# ------------------------------------------------------------- search / BM25

DOCS = [("a", "the cat sat on the mat"), ("b", "the dog sat"), ("c", "cats and dogs and the cat"),
        ("d", "nothing here"), ("e", "")]


def bm25_brute(docs, query, k1=1.2, b=0.75):
    toks = {d: [t for t in re.split(r"[^\w]+", x.lower()) if t] for d, x in docs}
    toks = {d: t for d, t in toks.items() if t}
    n = len(toks)
    avg = sum(len(t) for t in toks.values()) / n
    df = Counter(t for ts in toks.values() for t in set(ts))
    q = Counter(t for t in re.split(r"[^\w]+", query.lower()) if t)
    out = {}
    for d, ts in toks.items():
        tf = Counter(ts)
        s = 0.0
        for t, qtf in q.items():
            if t in tf:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                s += idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avg)) * qtf
        if s:
            out[d] = round(s, 6)
    return out


def test_bm25_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "link string, text string")
    post = search.postings(docs)
    qs = spark.createDataFrame([(1, "the cat"), (2, "dog dog"), (3, "zebra")], "query_id long, text string")
    got = {(r.query_id, r.link): r.score for r in search.bm25_topk(post, qs, 10).collect()}
    for qid, text in [(1, "the cat"), (2, "dog dog"), (3, "zebra")]:
        exp = bm25_brute(DOCS, text)
        assert {d: s for (q, d), s in got.items() if q == qid} == pytest_approx(exp)


def pytest_approx(d):
    import pytest
    return pytest.approx(d, abs=1e-6)


def test_keyset_pages_chain_to_full_order(spark):
    items = spark.range(0, 57).select(
        F.concat(F.lit("scp-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("link"),
        (F.col("id") % 7).alias("rating"))
    full = [r.link for r in items.orderBy(F.col("rating").desc(), "link").collect()]
    seen, cur = [], None
    while True:
        page = search.browse_page(items, 10, cur)
        seen += [r.link for r in page.collect()]
        cur = search.next_cursor(page, 10)
        if cur is None:
            break
    assert seen == full


# ------------------------------------------------------------ vectors / K3

def test_vector_topk_against_numpy(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    q = rng.normal(size=(3, 8))
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in vectors.topk_cosine(emb, qs, 4, chunk=2).collect()}
    v64 = vecs.astype("float64")
    sims = (q @ v64.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v64, axis=1)[None, :])
    for qi in range(3):
        order = np.argsort(-sims[qi], kind="stable")[:4]
        assert [got[(qi, r)] for r in range(1, 5)] == order.tolist()


# ----------------------------------------------------------- lookup / related

def test_lookup_ranks_unsuffixed_first(spark):
    items = spark.createDataFrame([("scp-100", "SCP-100", 100), ("scp-100-j", "SCP-100-J", 100),
                                   ("scp-002", "SCP-002", 2)], "link string, scp string, scp_number long")
    req = spark.createDataFrame([("100",), ("scp-100-j",), ("2",), ("SCP-002",), ("nope",)], "request string")
    got = {r.request: r.link for r in lookup.lookup_many(items, req).collect()}
    assert got == {"100": "scp-100", "scp-100-j": "scp-100-j", "2": "scp-002", "SCP-002": "scp-002"}
    nf = lookup.not_found_with_suggestions(spark.createDataFrame([("101",)], "request string"), items).first()
    assert nf.suggestions == ["SCP-100", "SCP-100-J", "SCP-002"] and nf.code == "ITEM_NOT_FOUND"


def test_related_and_hubs(spark):
    items = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3)], "link string, rating long")
    refs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "zz")], "link string, ref_link string")
    hubs = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("c", "h2")], "link string, hub string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    rel = {r.link: r.relations for r in related.related(seeds, refs, items).collect()}
    assert rel == {"b": ["references"], "c": ["referenced_by"]}
    rh = {r.hub: r.n_others for r in related.related_hubs(seeds, hubs).collect()}
    assert rh == {"h1": 2}
    assert sorted(r.link for r in related.hub_members("a", hubs).collect()) == ["b", "c"]
    assert [r.ref_link for r in related.dangling(refs, items).collect()] == ["zz"]


# --------------------------------------------------------- summaries / N2-N3

def test_worklist_and_summaries(spark):
    items = spark.createDataFrame(
        [("scp-1", "SCP-1", "One", None, "<p>html</p>", "src", None),
         ("scp-2", "SCP-2", "Two", "md", None, None, None),
         ("scp-3", "SCP-3", "Three", None, None, None, None),
         ("scp-4", "SCP-4", "Four", None, None, "x" * 200_000, None)],
        "link string, scp string, title string, markdown string, raw_content string, raw_source string, "
        "summary string")
    existing = spark.createDataFrame([("scp-2",)], "link string")
    rows = summaries.worklist(items, existing).orderBy("link", "part").collect()
    wl = {r.link: r for r in rows if r.part == 1}
    assert set(wl) == {"scp-1", "scp-4"}
    assert wl["scp-1"].source == "raw_html" and "SCP Item: SCP-1 - One\n\nContent:\n<p>html</p>\n" in wl["scp-1"].prompt
    assert len(wl["scp-4"].prompt) == len(summaries.PROMPT_HEAD) + len("SCP-4 - Four\n\nContent:\n") + 102_000 + 1
    assert [(r.part, r.n_parts, r.prompt.count("x" * 1000)) for r in rows if r.link == "scp-4"] == [(1, 2, 102), (2, 2, 98)]
    assert set(summaries.worklist(items, existing, force=True).select("link").toPandas().link) == {
        "scp-1", "scp-2", "scp-4"}

    def fake_model(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if "SCP-4" in p else "  summary of " + p.split("SCP Item: ")[1][:5])
    out = {r.link: r for r in summaries.summarize(summaries.worklist(items, existing), fake_model, 2).collect()}
    assert out["scp-1"].summary == "summary of SCP-1" and out["scp-1"].status == "summarized"
    assert out["scp-4"].summary is None and out["scp-4"].status == "skipped"


def test_get_items_metadata_and_content(spark, raw_root):
    from quire.plans.catalog import get_item_content, get_items, series_resource
    from quire.plans.import_items import import_items
    items = import_items(spark, raw_root).items
    req = spark.createDataFrame([("173",), ("scp-096",), ("nope",)], "request string")
    meta = {r.request: r for r in get_items(items, req).collect()}
    assert set(meta) == {"173", "scp-096"} and "raw_content" not in get_items(items, req).columns
    assert meta["173"].link == "scp-173"
    full = get_items(items, req, include_content=True)
    assert "raw_content" in full.columns
    content = {r.request: r for r in get_item_content(items, req).collect()}
    assert content["scp-096"].fallback is True and content["scp-096"].best_content.startswith("<div")
    assert series_resource(items, "1").count() == 4


def test_table_info(spark, raw_root, tmp_path):
    from quire.plans.import_items import import_and_publish
    from quire.plans.publish import TableStore
    root = str(tmp_path / "t")
    import_and_publish(spark, raw_root, root)
    info = TableStore(spark, root).table_info("items")
    assert info["rows"] == 4 and info["versions"] == 1 and info["current_version"] == 1
    assert info["columns"][:3] == ["link", "scp", "scp_number"]


def test_summaries_call_the_model_once(spark, tmp_path):
    from pyspark.sql import functions as F
    calls = str(tmp_path / "calls")
    os.makedirs(calls)
    items = spark.range(40).select(F.concat(F.lit("scp-"), F.col("id").cast("string")).alias("link"),
                                   F.lit("SCP-X").alias("scp"), F.lit("T").alias("title"),
                                   F.lit(None).cast("string").alias("markdown"),
                                   F.lit(None).cast("string").alias("raw_content"),
                                   F.lit("text").alias("raw_source"))

    def model(prompts):
        import uuid
        open(os.path.join(calls, uuid.uuid4().hex), "w").write(str(len(prompts)))
        return prompts.map(lambda p: "ok")
    out = summaries.summarize(summaries.worklist(items), model, concurrency=2)
    assert out.count() == 40 and out.where("status = 'summarized'").count() == 40
    total = sum(int(open(os.path.join(calls, f)).read()) for f in os.listdir(calls))
    assert total == 40                      # each prompt sent exactly once, despite two actions

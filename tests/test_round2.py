"""Rules that small data rarely meets: null ratings, long prompts, microseconds,
failed publishes and model calls, scalar tags."""

import datetime as dt
import json
import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.validate import coerce_tags
from quire.operators.vectors import topk_cosine
from quire.plans.catalog import attribution
from quire.plans.publish import TableStore, dump_jsonl
from quire.plans.summaries import summarize, worklist
from quire.streaming.sync_stream import sync_log, sync_stream


def test_pages_over_tied_and_null_ratings_hold_every_item(spark):
    rows = [("a", 5), ("b", 3), ("c", 3), ("d", None), ("e", None), ("f", None)]
    items = spark.createDataFrame(rows, "link string, rating long")
    got, cursor = [], None
    while True:
        page = search.browse_page(items, 2, cursor)
        got += [r.link for r in page.collect()]
        cursor = search.next_cursor(page, 2)
        if cursor is None:
            break
    assert got == list("abcdef")
    with pytest.raises(ValueError):
        search.page_size(search.MAX_PAGE_SIZE + 1)


def test_long_prompts_come_in_parts_that_hold_the_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(102_000)) + "end"
    df = spark.createDataFrame([("l", "SCP-1", "t", None, None, text)],
                               "link string, scp string, title string, markdown string, raw_content string, raw_source string")
    parts = [r.prompt.split("Content:\n")[1][:-1] for r in worklist(df).orderBy("part").collect()]
    assert len(parts) == 2 and "".join(parts) == text


def test_one_bad_prompt_is_skipped_alone(spark):
    def model(prompts):
        if (prompts == "bad").any():
            raise ValueError("refused")
        return prompts.str.upper()

    work = spark.createDataFrame([(str(i), "bad" if i == 3 else "p") for i in range(20)], "link string, prompt string")
    got = {r.link: r.status for r in summarize(work, model, 1).collect()}
    assert got == {str(i): "skipped" if i == 3 else "summarized" for i in range(20)}
    assert isinstance(model(pd.Series(["a"])), pd.Series)


def test_dump_keeps_microseconds(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 3, 4, 5, 123456), None), (dt.datetime(2020, 1, 2, 3, 4, 5), None)],
                               "created_at timestamp_ntz, n long")
    assert [json.loads(r.json)["created_at"] for r in dump_jsonl(df).collect()] == ["2020-01-02T03:04:05.123456", "2020-01-02T03:04:05"]


def test_publish_goes_on_after_a_crash_between_data_and_log(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1)], "link string, n long")
    store.publish(df)
    os.rename(store._log_path, str(tmp_path / "kept"))
    assert store.publish(df) == 1
    os.rename(str(tmp_path / "kept"), str(tmp_path / "_more"))
    assert store.publish(df) == 2 and store.read().count() == 1


def test_empty_query_set_and_scalar_tags(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([], "query_id long, vector array<double>")
    assert topk_cosine(items, queries, 3).count() == 0
    tags = spark.createDataFrame([("[redacted]",), ('["a","b"]',), ('"x"',), (None,)], "t string")
    assert [r.t for r in tags.select(coerce_tags(F.col("t")).alias("t")).collect()] == [["[redacted]"], ["a", "b"], ["x"], []]


def test_attribution_off_has_the_same_columns(spark):
    items = spark.createDataFrame([(1, "l", "t", "u", "c", None, "x", None)],
                                  "scp_number long, link string, title string, url string, creator string, markdown string, raw_content string, raw_source string")
    on = attribution(items)
    assert on.first().short and attribution(items, enabled=False).columns == on.columns


def test_a_quiet_folder_is_published_without_a_new_file_of_its_own(spark, raw_root, tmp_path):
    src, tables, ckpt = str(tmp_path / "raw"), str(tmp_path / "tables"), str(tmp_path / "ckpt")
    new, old = "scp-1800000000-bbbbbbbbbbbb", "scp-1700000000-aaaaaaaaaaaa"
    os.makedirs(src)
    shutil.copytree(os.path.join(raw_root, new), os.path.join(src, new))
    sync_stream(spark, src, tables, ckpt).awaitTermination()  # names a missing file: waits
    shutil.copytree(os.path.join(raw_root, old), os.path.join(src, old))
    sync_stream(spark, src, tables, ckpt, settle_seconds=0).awaitTermination()
    assert {r.dataset_commit for r in sync_log(spark, tables).collect()} == {"aaaaaaaaaaaa", "bbbbbbbbbbbb"}

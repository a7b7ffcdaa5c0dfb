"""The reference's model tests, as DataFrame tests of the column functions."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions import content as C
from quire.functions.ids import identifier_variants, parse_scp_number
from quire.operators.diff import sync_result
from quire.operators.search import hits
from quire.plans.catalog import content_response


def _items(spark, rows):
    schema = ("link string, scp string, scp_number bigint, title string, series string, tags array<string>, "
              "rating bigint, created_at timestamp_ntz, creator string, url string, raw_source string, "
              "raw_content string, markdown string, summary string, content_sha1 string, dataset_commit string")
    return spark.createDataFrame(rows, schema)


FULL = ("scp-173", "SCP-173", 173, "The Sculpture", "series-1", ["euclid", "statue", "hostile"], 1234,
        dt.datetime(2008, 7, 25, 20, 49), "Moto42", "https://scp-wiki.wikidot.com/scp-173", None,
        "Item #: SCP-173 ...", "# SCP-173 - The Sculpture", None, "abc123def456", "commit-hash-123")


def minimal(**kw):
    base = dict(link="scp-173", scp="SCP-173", scp_number=173, title="The Sculpture", series="series-1",
                tags=[], rating=0, created_at=None, creator=None, url="https://x/scp-173", raw_source=None,
                raw_content=None, markdown=None, summary=None, content_sha1=None, dataset_commit=None)
    base.update(kw)
    return tuple(base.values())


def test_item_creation(spark):
    r = _items(spark, [FULL]).first()
    assert r.link == "scp-173" and r.scp_number == 173 and r.tags == ["euclid", "statue", "hostile"]


def test_number_parsing(spark):
    df = spark.createDataFrame([("SCP-002",), ("2",), ("scp-173",), ("SCP-100-J",), ("x",)], "v string")
    got = [r.n for r in df.select(parse_scp_number("v").alias("n")).collect()]
    assert got == [2, 2, 173, None, None]


def test_has_content(spark):
    df = _items(spark, [minimal(), minimal(raw_content="x"), minimal(summary="s"), minimal(raw_source="")])
    assert [r.h for r in df.select(C.has_content().alias("h")).collect()] == [False, True, True, False]


def test_primary_content(spark):
    df = _items(spark, [minimal(markdown="md", raw_content="raw"), minimal(raw_content="raw", raw_source="src"),
                        minimal(markdown="", raw_source="src"), minimal()])
    assert [r.p for r in df.select(C.primary_content().alias("p")).collect()] == ["md", "raw", "src", None]


def test_summary_fallback(spark):
    df = _items(spark, [minimal(summary="sum", markdown="md"), minimal(markdown="md"), minimal(raw_content="r")])
    assert [r.s for r in df.select(C.summary_content().alias("s")).collect()] == ["sum", "md", "r"]


def test_identifier_variants(spark):
    df = _items(spark, [minimal(), minimal(link="scp-002", scp="SCP-002", scp_number=2),
                        minimal(link="scp-1234", scp="SCP-1234", scp_number=1234),
                        minimal(link="scp-100-j", scp="SCP-100-J", scp_number=100)])
    got = [r.v for r in df.select(identifier_variants().alias("v")).collect()]
    assert got[0] == ["SCP-173", "173", "scp-173"]
    assert got[1] == ["SCP-002", "2", "scp-002"]
    assert got[2] == ["SCP-1234", "1234", "scp-1234"]
    assert got[3] == ["SCP-100-J", "100", "scp-100-j", "SCP-100"]


def test_item_hit_from_item(spark):
    df = _items(spark, [FULL, minimal(link="scp-096", scp="SCP-096", scp_number=96, tags=[])])
    rows = hits(df).collect()
    assert rows[0].tags == ["euclid", "statue", "hostile"] and rows[0].rating == 1234
    assert rows[1].tags is None
    assert set(hits(df).columns) == {"link", "scp", "scp_number", "title", "rating", "series", "tags",
                                     "created_at", "creator", "summary"}


def test_search_result_full_and_empty(spark):
    from quire.operators.search import next_cursor, search_items
    df = _items(spark, [FULL, minimal(link="scp-096", scp="SCP-096", scp_number=96, rating=987)])
    page = search_items(df, min_rating=0, limit=1)
    assert [r.link for r in page.collect()] == ["scp-173"]
    assert next_cursor(page, 1) is not None
    empty = search_items(df, series="nope")
    assert empty.count() == 0 and next_cursor(empty) is None


def test_content_response(spark):
    df = _items(spark, [minimal(markdown="md", raw_content="r", raw_source="s", summary="sum"),
                        minimal(raw_content="r")])
    rows = content_response(df).collect()
    assert rows[0].fallback is False and rows[0].best_content == "md" and rows[0].summary_content == "sum"
    assert rows[1].fallback is True and rows[1].best_content == "r" and rows[1].summary_content == "r"


def test_version_info_and_sync_result(spark):
    from quire.operators.diff import snapshot_diff
    from quire.plans.publish import version_info
    from quire.schemas import VERSION_SCHEMA
    v = spark.createDataFrame([("items", 42, None, "c1", 10, "p"), ("items", 43, None, "c2", 12, "p")],
                              VERSION_SCHEMA)
    r = version_info(v, keep=3).first()
    assert r.current_version == 43 and r.n_versions == 2 and r.dataset_commit == "c2" and r.keep_versions == 3
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "link string, content_sha1 string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "link string, content_sha1 string")
    res = sync_result(snapshot_diff(old, new), "c2", 43)
    assert res["updated"] == 2 and res["skipped"] == 2 and res["errors"] == []
    assert F is not None


def test_iso_parsing_is_independent_of_session_zone(spark):
    vals = ["2008-07-25T20:49:00Z", "2008-07-25T20:49:00+02:00", "2008-07-25T20:49:00-05:30",
            "2008-07-25 20:49:00", "2008-07-25", "garbage", None]
    want = ["2008-07-25 20:49:00", "2008-07-25 18:49:00", "2008-07-26 02:19:00", "2008-07-25 20:49:00",
            "2008-07-25 00:00:00", "None", "None"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([(v,) for v in vals], "v string")
            assert [str(r.t) for r in df.select(C.parse_iso_ts("v").alias("t")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_iso_format_drops_zero_fraction(spark):
    df = spark.createDataFrame([(dt.datetime(2008, 7, 25, 20, 49),), (dt.datetime(2008, 7, 25, 20, 49, 0, 5),)],
                               "t timestamp_ntz")
    assert [r.s for r in df.select(C.iso_format("t").alias("s")).collect()] == [
        "2008-07-25T20:49:00", "2008-07-25T20:49:00.000005"]

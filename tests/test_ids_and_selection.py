from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.ids import file_link, label_number, normalize_id, shard_folder
from quire.operators import selection


# identifier, padded form, form that keeps a prefixed identifier's digits
NORMALIZED = [
    ("2", "SCP-002", "SCP-002"), ("002", "SCP-002", "SCP-002"), ("0", "SCP-000", "SCP-000"), ("1234", "SCP-1234", "SCP-1234"),
    ("00000000000000000000042", "SCP-042", "SCP-042"), ("scp-2", "SCP-002", "SCP-2"), ("SCP-002", "SCP-002", "SCP-002"),
    ("Scp-100-j", "SCP-100-J", "SCP-100-J"), ("100-J", "SCP-100-J", "SCP-100-J"), ("keter", "SCP-KETER", "SCP-KETER"),
    ("scp-", "SCP-", "SCP-"), ("scp", "SCP-SCP", "SCP-SCP"),
]


def test_normalize_table(spark):
    df = spark.createDataFrame([(v,) for v, _, _ in NORMALIZED], "v string")
    got = {r.v: (r.a, r.b) for r in df.select("v", normalize_id("v", True).alias("a"), normalize_id("v", False).alias("b")).collect()}
    assert got == {v: (a, b) for v, a, b in NORMALIZED}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789scpSCP-jJx", min_size=1, max_size=8), min_size=1, max_size=20))
def test_normalize_properties(spark, values):
    """Upper case, one prefix, numbers of three digits at least, and stable
    when applied again."""
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pad in (True, False):
        one = normalize_id("v", pad)
        for r in df.select("v", one.alias("a")).withColumn("b", normalize_id("a", pad)).collect():
            assert r.a.startswith("SCP-") and r.a == r.a.upper() and r.b == r.a
            assert not r.v.isdigit() or (len(r.a) >= 7 and int(r.a[4:]) == int(r.v))


def test_shard_and_file_link(spark):
    df = spark.createDataFrame([("SCP-1234", "scp-1234"), ("SCP-100-J", "scp-100-j"), ("", "x"), ("", "")],
                               "scp string, link string")
    rows = df.select(shard_folder("scp", "link", None).alias("s"), file_link("link").alias("f")).collect()
    assert [r.s for r in rows] == ["1/2/3/4", "1/0/0/-/j", "x", "unknown"]
    assert [r.f for r in rows] == ["scp-1234", "scp-100-j", "scp-x", "scp-"]


def test_range_includes_suffixed_and_swaps(spark):
    labels = spark.createDataFrame([("SCP-099",), ("SCP-100",), ("SCP-100-J",), ("SCP-200",), ("SCP-201",),
                                    ("OTHER",)], "label string")
    got = sorted(r.label for r in selection.choose(labels, "200-100").collect())
    assert got == ["SCP-100", "SCP-100-J", "SCP-200"]
    assert labels.select(label_number("label").alias("n")).where("n is null").count() == 1


def test_single_and_not_found(spark):
    labels = spark.createDataFrame([("SCP-002",), ("SCP-173",)], "label string")
    assert [r.label for r in selection.choose(labels, "2").collect()] == ["SCP-002"]
    assert selection.choose(labels, "scp-2").count() == 0          # scripts do not pad scp-2
    req = spark.createDataFrame([("173",), ("999",)], "request string")
    assert [r.request for r in selection.not_found(req, labels).collect()] == ["999"]


def test_sampling_independent_of_partitioning(spark):
    labels = spark.range(500).select(F.concat(F.lit("SCP-"), F.col("id").cast("string")).alias("label"))
    a = sorted(r.label for r in selection.sample(labels.repartition(1), 17, seed=42).collect())
    b = sorted(r.label for r in selection.sample(labels.repartition(7), 17, seed=42).collect())
    c = sorted(r.label for r in selection.sample(labels, 17, seed=43).collect())
    assert a == b and len(a) == 17 and a != c
    assert selection.sample(labels, 10_000, seed=1).count() == 500

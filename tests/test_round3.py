"""JSON maps by byte ranges, the file tree source, nearest suggestions, related
lists with hubs, pages of all queries, history texts and the stream's state,
each against a plain model."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions.content import parse_history
from quire.operators import lookup, related, search
from quire.plans import publish
from quire.plans.import_items import import_items
from quire.sources import file_tree, json_maps
from quire.sources import snapshots as S
from quire.streaming.state import Arrivals


# ------------------------------------------------------------- JSON maps

@pytest.fixture
def split_size(spark):
    """Set how many bytes of a file a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "10")
    yield to
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def random_json(rng, depth=0):
    k = rng.random()
    if k < .3 or depth > 3:
        return "".join(rng.choice('ab"\\{}[],:é\n你 ') for _ in range(rng.randint(0, 30)))
    if k < .5:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if k < .9:
        return {f"k{i}" + rng.choice(',"}\\'): random_json(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return rng.choice([None, 1, 2.5, True])


@pytest.mark.parametrize("size", ["200", "100m"])
def test_maps_equal_the_json_module(spark, tmp_path, split_size, size):
    """Ranges of 200 bytes lie inside strings, escapes and nested values, and
    entries span several of them."""
    rng, want = random.Random(3), {}
    for f, n in enumerate((0, 1, 3, 8, 14)):
        m = {f"L{i}" + rng.choice(["", '"', "\\", "}", ",", "é"]): random_json(rng) for i in range(n)}
        text = json.dumps(m, ensure_ascii=rng.random() < .5, indent=rng.choice([None, 1])) + rng.choice(["", " \n"])
        (tmp_path / f"f{f}.json").write_text(text, encoding="utf-8")
        want[f"f{f}.json"] = (m, text.encode())
    bad = {"b0": "{not json", "b1": '{"a": {"b": 1}\n', "b2": '["a"]', "b3": '{"a": "x}', "b4": '{"a": 1}}'}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
    split_size(size)
    maps = json_maps.read_maps(spark, f"{tmp_path}/*.json")
    shaped = {os.path.basename(r.path): r.shaped for r in maps.files.collect()}
    assert shaped == {**{f"{b}.json": False for b in bad}, **{f: True for f in want}}
    got = {}
    for r in maps.entries.collect():
        got.setdefault(os.path.basename(r.path), []).append((r.pos, r.label, r.value))
    for f, (m, raw) in want.items():
        found = sorted(got.get(f, []))
        assert [x[1] for x in found] == list(m) and [json.loads(x[2]) for x in found] == list(m.values())
        assert all(raw[p:].lstrip().startswith(b'"') for p, _, _ in found)


def test_single_maps_are_read_by_several_tasks(spark, tmp_path, split_size):
    rows = [(f"SCP-{i:03d}", f"scp-{i:03d}", f"SCP-{i:03d}", str(i), f'title "{i}" }} {{', "series-1", f"u{i}", "x" * i) for i in range(60)]
    items = spark.createDataFrame(rows, "label string, link string, scp string, scp_number string, title string, series string, url string, raw_source string")
    S.write_single_maps(items, str(tmp_path), "scp-1700000000-aaaaaaaaaaaa")
    split_size("1000")
    got = {r.label: (r.title, r.raw_source) for r in S.load_items(spark, str(tmp_path)).collect()}
    assert got == {r[0]: (r[4], r[7]) for r in rows}
    counted = json_maps.read_maps(spark, S.items_pattern(str(tmp_path), "scp-1700000000-aaaaaaaaaaaa"))
    assert counted.files.count() == 2
    pieces = spark.read.option("lineSep", "}").text(S.items_pattern(str(tmp_path), "scp-1700000000-aaaaaaaaaaaa"))
    assert pieces.select(F.spark_partition_id()).distinct().count() > 4


def test_structure_of_quotes_and_backslashes():
    data = np.frombuffer(rb'{"a\\": "\"}", "b": [1, {"c\\\"": 2}]}', "u1")
    at, inside, quotes = json_maps.structure(data)
    outside = bytes(data[at[~inside]])
    assert outside == b"{,[,{}]}" and quotes % 2 == 0


def test_import_status_names_what_is_missing(spark, raw_root):
    status = {r.label: r for r in import_items(spark, raw_root).status.collect()}
    assert status["SCP-500"].status == "skipped" and status["SCP-500"].reason == "broken.json: not a JSON map"
    assert status["SCP-404"].reason == "no content file named"
    assert status["SCP-405"].reason == "missing.json: missing, or without the label"
    assert status["SCP-002"].reason is None and status["SCP-002"].status == "imported"


# -------------------------------------------------------------- file tree

def test_file_tree_round_trip_in_groups(spark, tmp_path):
    docs = spark.range(40).select(F.format_string("d%d/f%02d.md", F.col("id") % 3, "id").alias("path"),
                                  F.concat(F.lit("tëxt\n"), F.col("id").cast("string")).alias("body")).repartition(4)
    root = str(tmp_path / "tree")
    file_tree.write_tree(docs, root)
    file_tree.write_tree(spark.createDataFrame([("d0/f00.md", "new"), ("e.txt", None)], "path string, body string"), root)
    read = file_tree.read_tree(spark, root, ".md", group_bytes=300_000)
    got = {r.path: r.body for r in read.collect()}
    want = {r.path: r.body for r in docs.collect()}
    assert got == {**want, "d0/f00.md": "new"} and read.rdd.getNumPartitions() > 4
    assert sorted(os.listdir(root)) == ["d0", "d1", "d2", "e.txt"]


def test_failed_write_leaves_no_file(spark, tmp_path):
    root = str(tmp_path / "tree")
    file_tree.write_tree(spark.createDataFrame([("a.md", "old")], "path string, body string"), root)
    bad = spark.range(20).repartition(4).select(F.format_string("f%d.md", "id").alias("path"),
                                                F.when(F.col("id") == 13, F.raise_error(F.lit("boom"))).otherwise("x").alias("body"))
    with pytest.raises(Exception, match="boom"):
        file_tree.write_tree(bad, root)
    assert os.listdir(root) == ["a.md"] and (tmp_path / "tree" / "a.md").read_text() == "old"


def test_an_attempt_that_nobody_reported_is_not_published(tmp_path):
    writer = file_tree.FileTreeWriter(str(tmp_path))
    kept = writer.write(iter([{"path": "x/a.md", "body": "1"}]))
    writer.write(iter([{"path": "x/a.md", "body": "2"}, {"path": "x/b.md", "body": "2"}]))
    writer.commit([kept, None])
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and [p.name for p in (tmp_path / "x").iterdir()] == ["a.md"]
    assert (tmp_path / "x" / "a.md").read_text() == "1"


# ---------------------------------------------------- nearest suggestions

@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest_items_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    items = sorted({(rng.choice([rng.randint(0, 60), rng.randint(5000, 5010), 10 ** 12]), f"SCP-{rng.randint(0, 10 ** 6)}") for _ in range(60)})
    items += [(77, f"SCP-077-{k}") for k in "abcdefgh"]
    asked = [rng.randint(0, 6000) for _ in range(50)] + [77, 78, 0, 10 ** 12 + 5, -3]
    df = spark.createDataFrame(items + [(None, "SCP-X")], "scp_number long, scp string")
    got = lookup.nearest_items(spark.createDataFrame([(n,) for n in asked] + [(None,)], "number long"), df, 3, partitions)
    want = {n: [s for _, _, s in sorted((abs(m - n), m, s) for m, s in items)[:3]] for n in asked}
    assert {r.number: r.nearest for r in got.collect()} == want
    assert lookup.nearest_items(spark.createDataFrame([(4,)], "number long"), df.limit(0), 3, partitions).collect()[0].nearest == []


# ------------------------------------------------------------ related list

def brute_related(seeds, refs, hubs, items, k):
    links = {x for x, _ in items}
    of = {x: {h for y, h in hubs if y == x and h} for x in links}
    out = []
    for s in sorted(set(seeds)):
        rows = []
        for x, rating in items:
            kinds = (["references"] if (s, x) in refs else []) + (["referenced_by"] if (x, s) in refs else [])
            shared = len(of[s] & of[x]) if s in links and x != s else 0
            n = len(kinds) + shared
            if n:
                rows.append((-n, rating is None, -(rating or 0), x, n, sorted(kinds) + (["shared_hub"] if shared else [])))
        out += [(s, i + 1, r[3], r[4], r[5]) for i, r in enumerate(sorted(rows)[:k])]
    return out


def test_related_list_equals_brute_force(spark):
    """One hub holds two thirds of the items; others overlap in every way."""
    rng = random.Random(11)
    for n_hubs in (1, 4):
        items = [(f"i{n:02d}", rng.choice([None, 1, 2, 3])) for n in range(45)]
        links = [x for x, _ in items]
        hubs = [(x, "h0") for x in links if rng.random() < .66] + [(x, f"h{rng.randint(1, n_hubs)}") for x in links for _ in range(2)] + [("i00", None), ("gone", "h0")]
        refs = {(rng.choice(links), rng.choice([*links, "dangling"])) for _ in range(60)}
        refs = {(a, b) for a, b in refs if a != b}
        seeds = [links[0], links[0], *links[5:15]]
        got = related.related_list(spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(sorted(refs), "link string, ref_link string"),
                                   spark.createDataFrame(hubs, "link string, hub string"), spark.createDataFrame(items, "link string, rating long"), 6)
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute_related(seeds, refs, hubs, items, 6))


# ------------------------------------------------------- pages of all queries

def test_pages_of_all_queries_chain(spark):
    rng = random.Random(2)
    rows = [(q, f"l{i:02d}", float(rng.randint(0, 4))) for q, n in ((1, 23), (2, 5), (3, 10)) for i in range(n)]
    results = spark.createDataFrame(rows, "query_id long, link string, score double")
    want = {q: [x for _, x in sorted((-s, x) for p, x, s in rows if p == q)] for q in (1, 2, 3)}
    seen, cursors = {1: [], 2: [], 3: []}, None
    for _ in range(6):
        page = search.page_of_each(results, 5, cursors)
        for r in page.orderBy("query_id", "rank").collect():
            seen[r.query_id].append(r.link)
        cursors = search.cursors_of(page, 5)
    assert seen == want


def test_filtered_scores_are_the_scores(spark):
    docs = spark.createDataFrame([("a", "the cat sat", 1), ("b", "the dog", 2), ("c", "cats the cat", 3), ("d", "", 4)], "link string, text string, rating long")
    qs = spark.createDataFrame([(1, "the cat"), (2, "dog")], "query_id long, text string")
    every = {(r.query_id, r.link): r.score for r in search.bm25_scores(docs, qs).collect()}
    some = {(r.query_id, r.link): r.score for r in search.bm25_scores(docs, qs, keep=F.col("rating") > 1).collect()}
    assert some == {k: v for k, v in every.items() if k[1] != "a"} and len(some) < len(every)


# ------------------------------------------------------------- history texts

def test_history_parsed_or_raw(spark):
    texts = ['[{"author": "a", "date": null, "comment": "é"}]', "[]", "", "not json", '{"author": "a"}', "[1]", '[{"author"', None]
    parsed, raw = parse_history("text")
    got = [(r.p, r.raw) for r in spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", parsed.alias("p"), raw.alias("raw")).orderBy("n").collect()]
    assert [None if p is None else [tuple(x) for x in p] for p, _ in got] == [[("a", None, "é")], [], None, None, None, None, None, None]
    assert [r for _, r in got] == [None, None, *texts[2:]]


# ------------------------------------------------------------ stream state

class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Files(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v


class Handle:
    def __init__(self):
        self.timers, self.files, self.totals = [], Files(), Value()

    def getMapState(self, *a):
        return self.files

    def getValueState(self, *a):
        return self.totals

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def play(batches, settle=10, folder=False):
    """What the state says after each batch of (now, [(kind, file, changed)])."""
    handle, op, said = Handle(), Arrivals(settle), []
    op.init(handle)
    for now, rows in batches:
        out = []
        if rows:
            df = pd.DataFrame(rows, columns=["kind", "file", "changed_ms"]).assign(folder=folder)
            out += list(op.handleInputRows(("s",), iter([df[:1], df[1:]] if len(df) > 1 else [df]), Now(now)))
        due = [t for t in handle.timers if t < now]
        handle.timers = [t for t in handle.timers if t >= now]
        if due:
            out += list(op.handleExpiredTimer(("s",), Now(now), None))
        said.append([r for d in out for r in d["reason"]])
    return said


def test_arrivals_in_any_order():
    index = [("index", "a", 1), ("index", "b", 1), ("index", "a", 1), ("index", None, 1)]
    files = [("content", "a", 2), ("content", "b", 3), ("content", "unnamed", 3)]
    rng = random.Random(1)
    for _ in range(30):
        rows = rng.sample(index + files, 7)
        cut = rng.randint(0, 7)
        said = play([(100, rows[:cut]), (200, rows[cut:]), (300, rows)])
        assert sum(said, []) == ["complete"] and said[2] == []
    assert play([(100, files)]) == [[]] and play([(100, [("index", None, 1)])]) == [["complete"]]
    # an index folder is whole when no file that is there is unnamed
    assert play([(100, index[:1] + files[:2]), (200, index[1:])], folder=True) == [[], ["complete"]]


def test_arrivals_quiet_rule():
    first = [("index", "a", 1_000), ("index", "gone", 1_000), ("content", "a", 2_000)]
    assert play([(3_000, first), (11_000, []), (12_000, []), (13_000, [])]) == [[], [], ["quiet"], []]
    # a change moves the timer; what comes late is not said again
    assert play([(3_000, first), (11_000, [("content", "c", 10_500)]), (13_000, []), (21_000, []), (22_000, [("content", "gone", 21_900)])]) == [[], [], [], ["quiet"], []]
    assert play([(50_000, first)]) == [["quiet"]]
    assert play([(50_000, [("content", "a", 1)])]) == [[]]


# ---------------------------------------------------------------- publish

def test_a_version_number_is_given_once(spark, tmp_path):
    root = str(tmp_path / "t")
    a, b = publish.TableStore(spark, root), publish.TableStore(spark, root)
    df = spark.createDataFrame([("x", "1")], "link string, content_sha1 string")
    assert a.publish(df) == 1
    b.current_version = lambda table: None  # looked before the other one had published
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        b.publish(df)
    assert a.versions("items").count() == 1 and a.read("items").count() == 1


def test_scores_tokenize_the_documents_once(spark):
    """The texts are read for the postings alone; statistics and scores read what was written. Repeated keys count as documents."""
    docs = spark.createDataFrame([("a", "The cat; the CAT!"), ("b", " dog"), ("b", "a dog ran"), ("c", ""), ("d", None), ("e", "ein é")], "link string, text string")
    qs = spark.createDataFrame([(1, "the cat"), (2, "dog é")], "query_id long, text string")
    scored = search.bm25_scores(docs, qs)
    assert "ExistingRDD[link" not in scored._jdf.queryExecution().executedPlan().toString()
    avgdl, n = (4 + 1 + 3 + 2) / 4, 4

    def bm(tf, dl, df):
        return math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))

    got = {(r.query_id, r.link): r.score for r in scored.collect()}
    assert got[1, "a"] == pytest.approx(2 * bm(2, 4, 1), abs=1e-6) and got[2, "e"] == pytest.approx(bm(1, 2, 1), abs=1e-6)
    assert set(got) == {(1, "a"), (2, "b"), (2, "e")}

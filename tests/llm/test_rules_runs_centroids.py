"""Quality rules, periodic runs and centroid clustering against brute force on
small, awkward tables: nulls, empty and long texts, ties, repeated rows, empty
tables, extra and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import centroids, common, periodic_runs, quality_rules, queries

DOCS = "doc_id long, text string"


def words_of(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


# ------------------------------------------------------------ quality rules

def brute_counts(text):
    t, w = text or "", words_of(text)
    lines = [x for x in t.split("\n") if words_of(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def brute_kept(text):
    n, chars, symbols, dup, again = brute_counts(text)
    w = words_of(text)
    lines = sum(1 for x in (text or "").split("\n") if words_of(x))
    shouted = sum(x == x.upper() and x != x.lower() for x in w)
    letterless = sum(not any(c.isalpha() for c in x) for x in w)
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    base = n < 20 or 100 * again > 30 * n
    return base, not (base or 10 * symbols > n or not 2 * n <= chars <= 20 * n or 2 * dup > lines
                      or 100 * shouted > 30 * n or 100 * letterless > 30 * n or 100 * stutter > 30 * n)


def awkward_texts():
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = prose(12)
    out = [None, "", " \n\t ", "one", prose(19), prose(20), prose(60), prose(40).upper(), "a b c " * 30, prose(30) + "\r\n" + passage + "\x0b" + prose(9) + " " + passage,
           passage + " " + passage, prose(25) + " a# b$ c% d& e| f< g> h*", "\n".join([prose(9)] * 3 + [prose(30)] * 1 + [" ", "x\t"] * 4), prose(30) + " 12 34 56 7 8 9 - -- 99" * 4,
           "x" * 3000 + " " + prose(30), "the the of of a a to to in in " * 2 + prose(4), "naïve 你好 🎉 " * 9 + prose(10), prose(20_000), "na na " * 20_000,
           " ".join(["w%d" % (i % 8) for i in range(40)]), " ".join(["v%d" % (i % 9) for i in range(17)])]
    return out + [out[6], out[6]]


@pytest.mark.parametrize("weak", [False, True])
def test_rules_equal_brute_force(spark, weak):
    """Also where every window has one of three hashes (collisions)."""
    rows = [(i if i % 5 else None, t, "clash") for i, t in enumerate(awkward_texts()) if not weak or len(t or "") < 10_000]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("f", F.lit(1))
    few = lambda words: F.transform(quality_rules.window_hashes(words), lambda h: F.pmod(h, F.lit(3)))
    names = [r.name for r in quality_rules.RULES]
    got = quality_rules.judge(df, order=names, hashes_of=few if weak else quality_rules.window_hashes)
    assert got.columns == ["doc_id", "text", "f", *quality_rules.MADE]
    have = Counter((r.doc_id, r.text, *[r[c] for c in quality_rules.COUNTS], r.base_failed, r.kept) for r in got.collect())
    assert have == Counter((i, t, *brute_counts(t), *brute_kept(t)) for i, t, _ in rows)


def test_rules_order_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(awkward_texts())], DOCS)
    names = [r.name for r in quality_rules.RULES]
    kept = [{r.doc_id: r.kept for r in quality_rules.judge(df, order=o).collect()} for o in (names, names[::-1])]
    kept.append({r.doc_id: r.kept for r in quality_rules.judge(df).collect()})
    assert kept[0] == kept[1] == kept[2]
    reasons = {r.rejected_by for r in quality_rules.judge(df, order=names).collect()}
    assert reasons <= {None, "base", *names} and {"base", None, "symbols"} <= reasons
    assert quality_rules.judge(df.limit(0)).count() == 0
    assert quality_rules.judge(df, rules=()).where("kept = base_failed").count() == 0


def test_rules_are_ordered_by_rejections_per_cost():
    # a rejects most, but costs too much; of b and c, c's rows are b's as well, so that d comes before it
    cost = {"a": 100.0, "b": 1.0, "c": 1.0, "d": 1.0}
    patterns = [("1000", 40), ("1110", 20), ("1101", 5), ("1001", 3), ("0000", 30)]
    assert quality_rules.in_order(patterns, cost) == [("b", 25), ("d", 3), ("a", 40), ("c", 0)]


def test_rules_skip_what_is_rejected(spark):
    """A later rule does not run for texts that an earlier one rejects."""
    boom = quality_rules.Rule("boom", lambda t, w, f: F.raise_error(F.lit("looked at")).cast("boolean"))
    symbols = quality_rules.RULES[0]
    rows = spark.createDataFrame([(1, "# word " * 30), (2, None)], DOCS)
    assert [r.kept for r in quality_rules.judge(rows, (symbols, boom), order=["symbols", "boom"]).collect()] == [False, False]


def test_rules_query_keeps_prose(spark):
    sf = "/root/testdata/sf0.01"
    kept = queries.op11_quality_rules(spark, sf).join(common.table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    of = {(r["quality"], r["kept"]): r["count"] for r in kept.where("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert of.get((1, False), 0) <= 0.01 * of[1, True] and of.get((0, True), 0) <= 0.1 * of[0, False]


# ------------------------------------------------------------ periodic runs

def brute_runs(w, least=24, powers=3):
    """Every stretch that keeps a distance, and no smaller one."""
    out = []
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, powers * q):
                x = w[s:e]
                if not any(x[p:] == x[:-p] for p in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 5)):
            letters, w = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 2, 3, 5, 26])], []
            while len(w) < rng.randint(0, 120):
                unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
                n = len(unit) * rng.randint(1, 6) - rng.randint(0, len(unit) - 1) if rng.random() < .4 else 1
                w += (unit * 6)[:n]
            texts.append(w)
        least = rng.choice([1, 6, 24])
        got = list(periodic_runs.collapse([" ".join(t).encode() for t in texts], least))
        want = [brute_runs(t, least) for t in texts]
        assert [[tuple(x) for x in r.tolist()] for _, r, _ in got] == want
        assert [c.decode() for _, _, c in got] == [brute_collapsed(t, r) for t, r in zip(texts, want)]


def test_runs_in_small_blocks_and_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [(" ".join([rng.choice("ab") for _ in range(rng.randint(0, 50))] * rng.randint(1, 4))).encode() for _ in range(40)]
    whole = [(n, r.tolist(), c) for n, r, c in periodic_runs.collapse(texts)]
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 7)
    monkeypatch.setattr(periodic_runs, "PIECE", 3)
    assert [(n, r.tolist(), c) for n, r, c in periodic_runs.collapse(texts)] == whole


RUN_TEXTS = [None, "", " \n ", "one", "a b " * 12, "a b " * 11 + "a", "x\ty\nz " * 9, "é ü 你 " * 30 + "end", "w " * 50_000, " ".join(f"w{i}" for i in range(20_000)),
             "p q r s " * 5 + "t u v " * 9, "p q r s " * 5 + "t u v " * 9, "p " * 24]


def test_runs_of_awkward_tables(spark):
    rows = [(i if i % 4 else None, t, i, "clash") for i, t in enumerate(RUN_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, runs string").withColumn("_", F.lit(3))
    got = periodic_runs.find(df)
    assert got.columns == ["doc_id", "row", "_", "n_words", "runs", "collapsed"]
    for r in got.collect():
        w = words_of(RUN_TEXTS[r.row])
        want = brute_runs(w) if len(w) < 1000 else [(0, 50_000, 1)] if w[0] == "w" else []
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, brute_collapsed(w, want)), r.row
    assert periodic_runs.find(df.limit(0)).count() == 0
    assert periodic_runs.find(df.select("text")).where("collapsed is null").count() == 0


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = RUN_TEXTS[:8] + RUN_TEXTS[10:] + [" ".join(rng.choice(["aa", "b", "cc"]) for _ in range(rng.randint(1, 300))) for _ in range(120)]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = words_of(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        found = brute_runs(w)
        s, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), s, n, q, None if s is None else 1000 * n // q, sha("".join("%d,%d,%d\n" % r for r in found)),
                     sha(brute_collapsed(w, found))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(x[0] is not None and zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in want)


# ------------------------------------------------------- centroid clustering

def brute_lloyd(rows, k, rounds):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, of) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v), far(v, c[nearest(v)])) for i, v in kept], c


@pytest.mark.parametrize("kind", ["close", "ties", "large"])
def test_centroids_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    scale = {"close": 1.0, "ties": 0.03, "large": 2e6}[kind]
    vectors = rng.normal(0, scale, (150, 6)).clip(-2e6, 2e6)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("-inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    got, c = centroids.cluster(df, k=5, rounds=3, dim=6, chunk=16)
    want, centres = brute_lloyd(rows, 5, 3)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert c.tolist() == centres
    told = centroids.described(got, c).collect()
    assert {r.inertia for r in told} == {sum(d for _, _, d in want)}
    for r in told:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_centroids_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got, c = centroids.cluster(df, dim=2)
    assert Counter(map(tuple, got.collect())) == Counter(brute_lloyd([(1, [0.5, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0])], 16, 3)[0])
    empty, c = centroids.cluster(df.limit(0), dim=2)
    assert centroids.described(empty, c).columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.described(empty, c).count() == 0


def test_heaps_leave_unexpired_members_alone():
    """Well parted clusters: after the first rounds no gap expires, and a key
    holds as long as the bound that it stands for."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-20, 20, (60, 4)) + 2000 * j for j in range(4)]).astype("i4")
    c = v[[0, 60, 120, 180]].astype("i8")
    heaps, drift = centroids.Heaps(4), np.zeros(4)
    sums, counts = centroids.assign(heaps, v, [(i, -1) for i in range(len(v))], c, drift)
    c, step = centroids.moved(c, sums, counts)
    drift += step
    assert heaps.expired(drift) == [] and counts.tolist() == [60] * 4
    keys, members, sizes = heaps.flat()
    again = centroids.Heaps(4, keys, members, sizes)
    assert sorted(i for i, _ in again.expired(np.full(4, np.inf))) == list(range(len(v)))
    # random moves: whoever is not popped keeps its nearest centroid
    for _ in range(30):
        v = rng.integers(-300, 300, (200, 3)).astype("i4")
        c = rng.integers(-300, 300, (5, 3)).astype("i8")
        heaps, drift = centroids.Heaps(5), np.zeros(5)
        centroids.assign(heaps, v, [(i, -1) for i in range(len(v))], c, drift)
        of = {i: j for j, h in enumerate(heaps.of) for _, i in h}
        for _ in range(3):
            new = c + rng.integers(-15, 16, c.shape)
            move = np.sqrt(((new - c) ** 2).sum(1))
            drift, c = drift + [move[j] + np.delete(move, j).max() for j in range(5)], new
            popped = heaps.expired(drift)
            left = {i for h in heaps.of for _, i in h}
            d = centroids.squares(v, c)
            assert all(d[i].argmin() == of[i] for i in left)
            centroids.assign(heaps, v, popped, c, drift)
            of = {i: j for j, h in enumerate(heaps.of) for _, i in h}
            assert all(d[i].argmin() == of[i] for i in range(len(v)))


def test_squares_are_exact():
    rng = np.random.default_rng(6)
    for large in (100, 1 << 21, (1 << 27) - 1):
        v, c = rng.integers(-large, large, (20, 64)).astype("i4"), rng.integers(-large, large, (3, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        assert centroids.squares(v, c).tolist() == want

"""Operators against brute force on small, awkward tables: nulls, empty and
long texts, ties, repeated rows, empty tables, extra and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import (bpe, chat, common, components, exact_dedup, exact_topk, mixing, pii, quality, queries, simhash_dedup,
                       toxicity, url_filter)

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


AWKWARD = [(1, "a b\tc", "en", "s0"), (2, "abc", "de", "s0"), (3, None, None, None), (4, "", "en", "s1"), (5, " \n ", "en", None),
           (6, "x " * 40_000, "fr", "s1"), (7, "x" * 70_000, "fr", "s1"), (7, "x" * 70_000, "fr", "s1"), (None, "abc", "en", "s0"),
           (None, None, None, None), (8, "abc ", "en", "s2"), (9, "Ünï çødé 你好 🎉", "es", "é"), (10, "a  bc", "en", "s2")]


# -------------------------------------------------------------- exact dedup

def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for i, t, *_ in rows:
        key = (-len(t or ""), i is None, i or 0)
        best[norm(t)] = min(best.get(norm(t), key), key)
    return [(i, None if best[norm(t)][1] else best[norm(t)][2], sum(norm(x[1]) == norm(t) for x in rows),
             (-len(t or ""), i is None, i or 0) == best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows]


WEAK = {"md5": exact_dedup.content_hash, "collisions": lambda norm: F.concat(F.lit("h"), F.length(norm) % 3)}


@pytest.mark.parametrize("hash_of", list(WEAK))
def test_exact_dedup_awkward(spark, hash_of):
    got = exact_dedup.assign(docs(spark, AWKWARD), hash_of=WEAK[hash_of]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_dedup(AWKWARD)))


@pytest.mark.parametrize("hash_of", list(WEAK))
def test_exact_dedup_keeps_one_row_of_each_text(spark, hash_of):
    rows = [(*r, i, "z") for i, r in enumerate(AWKWARD)]
    kept = exact_dedup.deduplicate(docs(spark, rows, DOCS + ", hash long, row string"), hash_of=WEAK[hash_of])
    assert kept.columns == ["doc_id", "text", "lang", "source", "hash", "row"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect())
    want = {(x[1] if x[1] is not None else -1, r[1]) for r, x in zip(AWKWARD, brute_dedup(AWKWARD)) if x[3]}
    assert got == sorted(want)


# -------------------------------------------------------------------- top-k

def test_topk_with_ties_nulls_and_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype("f4")]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4),
             (105, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (106, [1.0, 2.0]), (107, []), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = exact_topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, chunk=16, block=2).orderBy("query_id", "rank").collect()
    ok = [(i, np.floor(64 * np.array(v)).astype("i8")) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 20 == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert [tuple(r) for r in got] == sorted(want)
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_bounds_hold():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-500, 500, (200, 16)), rng.integers(-500, 500, (20, 16))
    lower, upper = exact_topk.Approximation(v).bounds(q.astype("f8"), slice(None))
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


# ------------------------------------------------------------------ simhash

def brute_fingerprint(text, n=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_awkward_tables(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.near_duplicates(docs(spark, AWKWARD)).collect()}
    fps = {(i, format(brute_fingerprint(t), "016x")) for i, t, *_ in AWKWARD}
    assert set(got) == fps
    for (i, a), c in got.items():
        if c is not None:
            assert c == min(j for j, b in fps if j is not None and got[j, b] == c)
    assert got[3, "0" * 16] == got[4, "0" * 16] == got[5, "0" * 16] == 3
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_dedup_with_repeated_ids(spark):
    rows = [*AWKWARD, (4, "one two three four", "en", "s"), (11, "one two three four", "en", "s")]
    kept = simhash_dedup.deduplicate(docs(spark, rows).withColumn("fp", F.lit(1)))
    texts = [r.text for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "lang", "source", "fp"]
    assert len(texts) == len({brute_fingerprint(t) for t in texts}) == len({brute_fingerprint(r[1]) for r in rows})


def test_links_are_whole_in_dense_groups():
    """Thousands of near fingerprints, above the size at which keys are split."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(90)}
    fps |= {rng.getrandbits(64) for _ in range(500)}
    fps |= {base[0] ^ rng.getrandbits(10) for _ in range(900)}
    fps = np.array(sorted(fps), "u8")
    forest = simhash_dedup.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1:
            forest.join(i, int(j))
    got = simhash_dedup.Forest(len(fps))
    at = {int(x): i for i, x in enumerate(fps)}
    keys = simhash_dedup.join_keys(fps, 2, 1)
    for column in keys.T:
        order = np.argsort(column, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
            for u, v in zip(*simhash_dedup.links(fps[part])):
                assert bin(int(u) ^ int(v)).count("1") <= 64
                got.join(at[int(u)], at[int(v)])
    assert [forest.root(i) for i in range(len(fps))] == [got.root(i) for i in range(len(fps))]
    whole = simhash_dedup.Forest(len(fps))
    for u, v in zip(*simhash_dedup.links(fps)):
        whole.join(at[int(u)], at[int(v)])
    assert [forest.root(i) for i in range(len(fps))] == [whole.root(i) for i in range(len(fps))]


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# --------------------------------------------------------------------- urls

def test_url_rules(spark):
    urls = ["https://Example.ORG/en/12", "https://example.org/en/", "http://www.example.org/es/1", "http://a.com/fr/", "http://a.com/de/x",
            "http://xcom/de/x", "http://com/de/x", "https://example.org", "https://example.org?x=/en/1", "https://m.ads-track.net/a", None,
            "no scheme", "x://", "http://evilexample.org/es/1", "http://example.org:80/es/1", "http://b.net/wp-login.php", "ftp://q.org/#a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("verdict", F.lit("old"))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    rules = [(r.name, r.verdict) for r in url_filter.SITE_RULES]
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host):])[0]
        fits = [(n, v) for n, v in rules if (h := n.partition("/")) and (host == h[0] or host.endswith("." + h[0])) and path.startswith(h[1] + h[2])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0]), u
        assert best[1] in (None, got[i].verdict)
    assert got[9].verdict == got[15].verdict == "block" and got[10].verdict == got[7].verdict == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("a.example.org", "/es/")] * 3 + [("b.example.com", "/x")], "host string, path string")
    index = url_filter.rarest_tokens(df, url_filter.SITE_RULES[:2])
    assert {k: [r.name for r in v] for k, v in index.items()} == {"org": ["org/"], "es": ["example.org/es/"]}


# ---------------------------------------------------------------------- BPE

TEXTS = ["", None, "Hello wörld's it's 123 !!! <|endoftext|>a \u0085x Σας", "a" * 5000, " \t\n", "the the the", "e\u0301 É ﬁ\u200b 你好🎉",
         "<|startoftext|> < | endoftext | >", "word " * 20_000, "\x1c\x1d a\x00b", "don't we'll 'S"]


@pytest.mark.parametrize("block", [1, 64, 1 << 24])
def test_bpe_equals_the_library(spark, block):
    from tokenizers import Tokenizer
    content = queries.tokenizer_content()
    t = Tokenizer.from_str(content)
    df = spark.createDataFrame([(i, x, "keep") for i, x in enumerate(TEXTS * 2)], "doc_id long, text string, ids string").repartition(3).cache()
    got = bpe.decode(bpe.encode(df, content, block_bytes=block), content).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        e = t.encode((TEXTS * 2)[r.doc_id] or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), content).count() == 0


def test_bpe_blocks_do_not_follow_arrow_batches(spark, tmp_path):
    """20 MB of long texts, Arrow batches ended by bytes: the passes with and
    without the other columns cut the same blocks."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer
    rng = random.Random(5)
    some = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(some, k=rng.randint(1_500, 4_500))) for _ in range(1_700)]
    assert sum(map(len, texts)) > 20 << 20
    path = str(tmp_path / "long.parquet")
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "more": ["m" * (i % 2000) for i in range(len(texts))]}), path)
    content, key = queries.tokenizer_content(), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))
    try:
        got = {r.doc_id: r.ids for r in bpe.encode(spark.read.parquet(path), content, block_bytes=1 << 20).select("doc_id", "ids").collect()}
    finally:
        spark.conf.set(key, before)
    t = Tokenizer.from_str(content)
    ids_of = {w: t.encode(w, add_special_tokens=False).ids for w in some}
    assert got == {i: [x for w in text.split() for x in ids_of[w]] for i, text in enumerate(texts)}


def test_decode_leaves_out_unknown_ids(spark):
    content = queries.tokenizer_content()
    pieces = bpe.pieces_of(content)
    df = spark.createDataFrame([(1, [320, 10**6, -1, 49407]), (2, None), (3, []), (4, [320])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, content).collect()}
    assert got == {1: f"{pieces[320]} <|endoftext|>", 2: "", 3: "", 4: str(pieces[320])}


# ---------------------------------------------------------------------- PII

def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_pii_against_python(spark):
    rng = random.Random(7)
    parts = ["a@b.co", "x.y_z@q-r.s.t", "@", ".", "a@b", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+49 (30) 123-4567", "+1 2", "+", "_", "-", "🎉", "ü", " ", "\n", "5", "12", "%", "a.b@c.d@e.f", "é@x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["a" * 30_000, "1" * 30_000, "a." * 15_000 + "@b" + ".c" * 15_000, "1 " * 15_000, "+" + "1(" * 15_000, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(len(texts), None, 1)], "doc_id long, text string, pii int")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.pii if s["kind"] in pii.BASE] for r in pii.find(df).collect()}
    for i, t in enumerate([*texts, ""]):
        assert got[i] == brute_pii(t), t[:200]


def test_pii_kinds_that_context_decides(spark):
    """A long run of letters and digits, or a number, counts only where a word
    such as "token" or "account" stands within 40 characters."""
    rng = random.Random(8)
    hexes = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "abcdefghijklmnopqrstuvwxyz", "A1" * 12, "12345678901234567890123", "short1", "x-1_" * 9]
    parts = [*hexes, "12345678", "1234567", "12345678901234567", "token = ", "Secret", "API key:", "account", "konto", " ", "\n", "\"", "word " * 7, "ü" * 39, "plain words here "]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\"", ""]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["a1" * 40_000 + " token", ""]

    def brute(t):
        out = []
        for kind, pattern, ok in (("secret", r"[A-Za-z0-9_-]{20,}", lambda m: re.search("[0-9]", m) and re.search("[A-Za-z]", m)),
                                  ("account", "[0-9]+", lambda m: 8 <= len(m) <= 17)):
            for m in re.finditer(pattern, t):
                near = (t[max(0, m.start() - 40):m.start()] + " " + t[m.end():m.end() + 40]).lower()
                if ok(m[0]) and re.search(pii.CONTEXT[kind], near):
                    out.append((kind, m.start(), m.end()))
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.pii if s["kind"] in pii.BY_CONTEXT] for r in pii.find(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    kinds = Counter(k for v in got.values() for k, _, _ in v)
    assert min(kinds["secret"], kinds["account"]) > 20
    assert pii.find(df.limit(0)).count() == 0


def test_pii_of_repeated_rows(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")]
    assert [len(r.pii) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1, 1, 1]


def test_iban_context_and_redaction(spark):
    t = "my bank account DE89 3704 0044 0532 0130 00, not DE89370400440532013001; mail me: a@b.co"
    df = spark.createDataFrame([(t,)], "text string")
    spans = pii.find(df).first().pii
    iban = next(s for s in spans if s["kind"] == "iban")
    assert t[iban["start"]:iban["end"]] == "DE89 3704 0044 0532 0130 00" and iban["score"] == pytest.approx(0.9)
    assert [s["kind"] for s in spans] == ["email", "iban"]
    assert pii.redact(pii.find(df)).first().text == "my bank account <IBAN>, not DE89370400440532013001; mail me: <EMAIL>"


# --------------------------------------------------------------------- chat

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|> \\ [x]"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"),
         (2, 2, "user", None), (3, 0, "user", "hi"), (4, 0, "system", ""), (4, 1, None, "<\\ \\< [\\"), (4, 1, "assistant", "<|start|>"),
         (None, 5, "assistant", "x"), (None, 2, "user", "y"), (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    nodes, steps = chat.prefix_tree(df)
    got = {r.conv_id: r for r in chat.conversations_of(nodes, steps).collect()}
    for conv, rows in itertools.groupby(sorted(CHATS, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        rows = list(rows)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
        loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = chat.prefix_tree(df.limit(0))
    assert chat.conversations_of(*empty).count() == 0


def test_chat_tree_places_and_attention(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    nodes, _ = chat.prefix_tree(df)
    nodes = {bytes(r.node): r for r in nodes.collect()}
    at = 0
    for r in sorted(nodes.values(), key=lambda r: r.start):
        assert r.start == at and r.end - r.start == len(r.segment)  # every node once, without gaps
        at = r.end
        path, p = [], bytes(r.parent)
        while p:
            path.append(nodes[p])
            p = bytes(nodes[p].parent)
        assert r.position == sum(len(x.segment) for x in path)
        attended = {i for s in r.attend for i in range(s["start"], s["end"])}
        assert attended == {i for x in path for i in range(x.start, x.end)}
        if path:  # depth-first: all of a node's subtree follows it before anything else
            between = [x for x in nodes.values() if path[0].start < x.start < r.start]
            assert all(path[0] in _above(nodes, x) for x in between)


def _above(nodes, r):
    out, p = [], bytes(r.parent)
    while p:
        out.append(nodes[p])
        p = bytes(nodes[p].parent)
    return out


# ------------------------------------------------------------------- mixing

def waterfill(sizes, weights, most=3):
    """Cap and reshare, step by step, as the contract words it."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        out = [most * sizes[i] if i in capped else rest * weights[i] / w if w else 0 for i in range(len(sizes))]
        new = {i for i in range(len(sizes)) if i not in capped and out[i] > most * sizes[i] + 1e-9}
        if not new:
            return out
        capped |= new


def test_targets_meet_the_stepwise_rule(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 3, 50, 1000, 20_000]) for _ in range(rng.randint(1, 9))]
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        want = waterfill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert [got[n] for n in names] == pytest.approx(want)


def test_mixing_budgets_and_reruns(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, "v " * 30, "en", "a")] * 5
    df = docs(spark, rows).withColumn("key", F.lit("clash"))
    plan = mixing.plan(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan(df.repartition(7)).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()))
    for source in ("a", "b", "c", None):
        own = [r for r in plan if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 75 and max(r.copies for r in own) <= 3
    assert mixing.mix(df).count() == sum(r.copies for r in plan) and mixing.mix(df).columns == df.columns
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.plan(docs(spark, [(1, None, None, None), (2, "", None, "a")])).where("copies > 0").count() == 0


# -------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def trained(spark, ):
    sf = "/root/testdata/sf0.1"
    d, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    return d, labels, toxicity.train(d, labels), quality.train(d, labels)


def _held_out_auc(spark, scored, labels, label):
    rows = scored.join(labels, "doc_id").where(common.held_out()).select("score", label).collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    order = s.argsort().argsort()
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_classifiers_on_the_held_out_fold(spark, trained):
    d, labels, tox, trees = trained
    assert _held_out_auc(spark, toxicity.score(d, tox), labels, "toxic") > 0.95
    assert _held_out_auc(spark, quality.score(d, trees), labels, "quality") > 0.98


def test_classifiers_score_awkward_rows(spark, trained):
    _, _, tox, trees = trained
    df = docs(spark, [(*r, 5) for r in AWKWARD], DOCS + ", score int")
    for out in (toxicity.score(df, tox), quality.score(df, trees)):
        rows = out.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows) and out.columns.count("score") == 1
    assert toxicity.score(df.limit(0), tox).count() == quality.score(df.limit(0), trees).count() == 0


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    d = docs(spark, AWKWARD)
    assert len({r.score for r in toxicity.score(d, toxicity.train(d, none)).collect()}) == 1
    assert len({r.score for r in quality.score(d, quality.train(d, none)).collect()}) == 1


def test_long_texts_score_as_in_one_block(spark, trained, monkeypatch):
    tox = trained[2]
    text = " ".join(random.Random(1).choice(["the", "of", "idiot", "and", "moron", "to"]) for _ in range(3000))
    whole = toxicity.Scorer(tox)([text, "", "a b"])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 16)
    assert toxicity.Scorer(tox)([text, "", "a b"]) == pytest.approx(whole, abs=1e-5)


def test_toxicity_learns_from_long_texts(spark):
    """A corpus of texts above ``SAMPLE_WORDS`` words still gives a model."""
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(200):
        words = rng.choices(plain, k=toxicity.SAMPLE_WORDS + 100 + i)
        if i % 2:
            words[rng.randrange(len(words))] = "vile"
        rows.append((i, " ".join(words), "en", "s", i % 2))
    d = docs(spark, rows, DOCS + ", toxic int")
    model = toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"))
    s = toxicity.Scorer(model)([r[1] for r in rows])
    assert min(s[1::2]) > max(s[::2])
    assert list(model.thresholds) == ["en"]


def test_toxicity_thresholds_come_from_rows_left_out_of_the_fit():
    """Texts of words of their own and labels by chance: fitted, they are told
    apart; left out, all texts of a part look alike."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 1 << toxicity.TABLE_BITS, (30, 3), dtype="i4") for _ in range(90)]
    y = rng.integers(0, 2, 90)
    fitted = toxicity.score_sample(toxicity.fit(texts, y), texts)
    assert fitted[y == 1].min() > fitted[y == 0].max()
    left_out = toxicity.left_out_scores(texts, y)
    assert left_out[y == 1].min() < left_out[y == 0].max()


def test_toxicity_fit_in_blocks_is_the_fit_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 500, (int(n), 3), dtype="i4") for n in rng.integers(1, 200, 60)]
    y = rng.integers(0, 2, 60)
    whole = toxicity.fit(texts, y)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 16)
    blocks = toxicity.fit(texts, y)
    assert np.allclose(whole.table, blocks.table, atol=1e-3) and np.allclose(whole.out, blocks.out, atol=1e-3)


@pytest.mark.parametrize("kind, label", [(toxicity, "toxic"), (quality, "quality")])
def test_training_collects_one_row_of_an_id(spark, monkeypatch, kind, label):
    """One sampled id holds most rows: the fit gets each id once."""
    rows = [(i, f"text {'vile' if i % 2 else 'good'} {i}", "en", "s") for i in range(40)] + [(7, f"again {i}", "de", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], f"doc_id long, {label} int")
    collected, collect = [], type(labels).collect

    def counted(df):
        out = collect(df)
        collected.append(len(out))
        return out

    monkeypatch.setattr(type(labels), "collect", counted)
    kind.train(docs(spark, rows), labels)
    assert max(collected) <= 40


def test_toxicity_forward_pass_window_by_window():
    """The score of a text by loops over filters, windows and taps."""
    rng = np.random.default_rng(9)
    n = toxicity.FILTERS
    m = toxicity.Model(rng.normal(size=(1 << toxicity.TABLE_BITS, toxicity.DIM)).astype("f4"),
                       rng.normal(size=(toxicity.DIM, n * sum(toxicity.WIDTHS))).astype("f4"), rng.normal(size=n * 3).astype("f4"),
                       rng.normal(size=n * 3).astype("f4"), 0.3)
    texts = ["", "...", "One", "one two", "a b c d e f g a b", " ".join(f"w{i}" for i in range(60))]
    for text, score in zip(texts, toxicity.Scorer(m)(texts)):
        words = [sum(m.table[r].astype(float) for r in toxicity.rows_of(w)) for w in re.findall(r"[^\W_]+", text.lower())]
        z, first = m.out_bias, 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(n):
                best = max((sum(words[i + tap] @ m.taps[:, first + tap * n + f].astype(float) for tap in range(width) if i + tap < len(words))
                            for i in range(len(words))), default=0.0)
                z += max(0.0, best + m.bias[k * n + f]) * m.out[k * n + f]
            first += width * n
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_toxicity_finds_nine_of_ten_held_out(spark):
    """The query at sf0.1 on labelled rows that it never learned from."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf).join(common.table(spark, sf, "labels", "doc_id", "toxic"), "doc_id").where("held_out")
    of = {(r["toxic"], r["predicted"]): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert of[1, 1] >= 0.9 * (of[1, 1] + of.get((1, 0), 0)) and of.get((0, 1), 0) <= 0.02 * of[0, 0]


def test_quality_trees_walked_node_by_node():
    rng = np.random.default_rng(4)
    inner, leaves = 2 ** quality.DEPTH - 1, 2 ** quality.DEPTH
    trees = quality.Trees(rng.integers(0, 5, (6, inner)), rng.normal(size=(6, inner)), rng.normal(size=(6, leaves)), -0.2)
    x = rng.normal(size=(40, 5))
    for row, score in zip(x, trees.score(x)):
        z = trees.base
        for f, t, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            z += leaf[node - inner]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_first_split_is_the_best_one():
    """Of all features and limits between the bins, tried one by one."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)).round(1)
    y = ((x[:, 2] > 0.4) ^ (rng.random(300) < .1)).astype(float)
    w = rng.uniform(.5, 2, 300)
    trees = quality.fit(x, y, w)
    p = 1 / (1 + np.exp(-trees.base))
    g, h = (p - y) * w, p * (1 - p) * w

    def gain(left):
        if min(h[left].sum(), h[~left].sum()) < quality.LEAST_HESSIAN:
            return 0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1)

    every = {(j, t): gain(x[:, j] <= t) for j in range(4) for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]))}
    assert every[trees.feature[0][0], trees.limit[0][0]] == pytest.approx(max(every.values()))
    assert trees.feature[0][0] == 2


def test_chat_hot_conversation_with_ties_and_shared_texts(spark):
    """A third of all rows without a conversation, many of them on one turn; texts shared by conversations; a long text."""
    long = "wörter [x] " * 20_000
    rows = [(None, None if i % 3 else 7, ("user", "assistant")[i % 2], f"t{i % 50} \\ <") for i in range(400)]
    rows += [(c, t, ("user", "assistant")[t % 2], "same" if t < 2 else f"own {c % 5} {t}") for c in range(200) for t in range(4)]
    rows += [(999, 0, "user", long), (999, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    want = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (key(r), r[1] is not None, r[1] or 0, r[2], r[3])), key=lambda r: r[0]):
        own = list(own)
        want[conv] = (len(own), hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest(),
                      hashlib.sha256("".join(r[3] for r in own if r[2] == "assistant").encode()).hexdigest())
    apart = chat.tree(df)
    for got in (chat.conversations_of(*apart), chat.conversations_of(*chat.prefix_tree(df))):
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in got.collect()} == want
    assert apart[2].count() == len({r[2:] for r in rows})  # each distinct segment once
    assert apart[0].count() == len({tuple(x[2:] for x in own[:k + 1]) for own in
                                    ([r for r in rows if r[0] == c] for c in (*range(200), 999)) for k in range(len(own))}) + 400


def test_bpe_decode_null_unknown_and_clashing(spark):
    content = queries.tokenizer_content()
    pieces = bpe.pieces_of(content).to_pylist()
    rows = [(1, [5, 6, 7], "x"), (2, None, "y"), (3, [], None), (4, [-1, 9, 10**9], "z"), (1, [5, 6, 7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.decode(df, content).collect() if r.ids is not None)
    assert got == sorted((i, ids, " ".join(pieces[x] for x in ids if 0 <= x < len(pieces))) for i, ids, _ in rows if ids is not None)
    assert [r.decoded for r in bpe.decode(df.where("ids is null"), content).collect()] == [""]
    assert bpe.decode(df.limit(0), content).count() == 0

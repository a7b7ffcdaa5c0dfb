"""Training of the toxicity classifier on all labelled rows, by shards."""

import zlib

import numpy as np
import pytest

from quire.llm import common, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def test_every_labelled_row_is_learned_from(spark):
    """12,000 rows, each of words of its own: nearly all these words have a vector (a sample's rest had none)."""
    rows = [(i, f"w{i}x w{i}y", "en", "s") for i in range(12_000)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, zlib.crc32(b"%d" % i) >> 9 & 1) for i in range(12_000)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    own = [r.doc_id for r in labels.where(~common.held_out()).select("doc_id").collect()]
    known = [any(model.table[toxicity.rows_of(f"w{i}{end}")[0]].any() for end in "xy") for i in own]
    assert len(own) > 9_000 and np.mean(known) > 0.97


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 20_000)


def test_shards_are_merged_into_one_model(spark, small_shards):
    """Ten shards and more: toxic words are found, twice the same model comes out, one threshold a language."""
    rows = [(i, " ".join([f"w{(i * k) % 97}" for k in range(1, 12)] + ["vile" if i % 3 == 0 else "fine"]), ("en", "de")[i % 2], "s")
            for i in range(2_500)]
    rows += [(7, "again", "en", "s")] * 50 + [(2_600, "", "en", "s"), (2_601, None, None, None), (None, "vile", "en", "s")]
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2_500)] + [(7, 1), (2_600, 0), (2_601, 0), (None, 1)],
                                   "doc_id long, toxic int")
    first, second = toxicity.train(d, labels), toxicity.train(d.repartition(3), labels)
    assert np.array_equal(first.table, second.table) and first.out_bias == second.out_bias
    assert sorted(first.thresholds) == ["de", "en"] and first.thresholds == second.thresholds
    scores = toxicity.Scorer(first)([r[1] or "" for r in rows[:2_500]])
    y = np.array([i % 3 == 0 for i in range(2_500)])
    assert scores[y].min() > scores[~y].max()


def test_one_shard_is_the_fit_in_memory(spark):
    rows = [(i, f"a{i % 7} b{i % 11} {'vile' if i % 2 else 'good'}", ("en", "de")[i % 3 == 0], "s") for i in range(300)]
    d, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    own = sorted((str(r.doc_id), r.toxic) for r in labels.where(~common.held_out()).collect())
    texts = [np.array([toxicity.rows_of(w) for w in toxicity.words_of(rows[int(i)][1])], "i4") for i, _ in own]
    y = np.array([t for _, t in own])
    want, got = toxicity.fit(texts, y), toxicity.train(d, labels)
    assert np.array_equal(want.table, got.table) and np.array_equal(want.out, got.out) and want.out_bias == got.out_bias
    scores, langs = toxicity.left_out_scores(texts, y), np.array([rows[int(i)][2] for i, _ in own])
    for lang in ("en", "de"):
        s, t = scores[langs == lang], y[langs == lang]
        f1 = np.array([2 * ((s >= g) & (t == 1)).sum() / max(1, (s >= g).sum() + (t == 1).sum()) for g in toxicity.GRID])
        assert got.thresholds[lang] == pytest.approx(np.median(toxicity.GRID[f1 == f1.max()]))


@pytest.mark.parametrize("toxic", [0, 1])
def test_shards_of_one_class_give_one_score(spark, small_shards, toxic):
    d = spark.createDataFrame([(i, f"w{i}", "en", "s") for i in range(600)], DOCS)
    labels = spark.createDataFrame([(i, toxic) for i in range(600)], "doc_id long, toxic int")
    scores = toxicity.Scorer(toxicity.train(d, labels))(["w1", "", "new words"])
    assert len(set(scores)) == 1 and (scores[0] > 0.5) == toxic


def test_hashes_are_not_shuffled(spark):
    """One shuffle, of the texts; of a repeated id the smallest language, then the smallest hashes count."""
    d = spark.createDataFrame([("1", "one", "en"), ("1", "two", None), ("2", "x y", "en"), ("2", "z", "de"), ("2", "w", "de"), ("3", "q", "en")],
                              "_id string, _text string, _lang string").repartition(3)
    known = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1)], "_id string, _y int")
    rows = toxicity.hashed_rows(d, known.hint("broadcast"), 2)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    hashes = {b: a for a in ("one", "two", "z", "w", "q") for b in [tuple(map(int, toxicity.rows_of(a)))]}
    got = {}
    for _, texts, y, langs in toxicity.shards_of(iter(rows.toArrow().to_batches())):
        got |= {hashes[tuple(t[0].tolist())]: (int(label), lang) for t, label, lang in zip(texts, y, langs)}
    assert got.pop("two") == (0, None) and got.pop("q") == (1, "en")
    assert list(got.values()) == [(1, "de")] and set(got) <= {"z", "w"}


def test_passes_drop_their_shuffle_files(spark, small_shards, monkeypatch):
    settings, run = [], toxicity.merged_pass
    monkeypatch.setattr(toxicity, "merged_pass", lambda *a, **k: settings.append(spark.conf.get(common.CLEANUP_SETTING)) or run(*a, **k))
    before = spark.conf.get(common.CLEANUP_SETTING, None)
    d = spark.createDataFrame([(i, f"w{i % 9} " * 60 + ("vile" if i % 2 else "fine"), "en", "s") for i in range(400)], DOCS)
    toxicity.train(d, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    assert len(settings) > 3 and set(settings) == {"true"} and spark.conf.get(common.CLEANUP_SETTING, None) == before

"""The pipeline, stage by stage, on a small data folder."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from quire.llm import common, mixing, simhash_dedup, toxicity
from quire.llm.oracle import SQL
from quire.llm.queries import QUERIES
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "source mixing", "BPE"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([c[0] for c in cur.description], cur.fetchall())


def test_stages_against_brute_force(spark):
    d = common.table(spark, SF, "documents")
    out = [common.written(f(spark, x, SF), "t") for x, (_, f) in zip([d], corpus_pipeline.STAGES[:1])]
    for _, f in corpus_pipeline.STAGES[1:]:
        out.append(common.written(f(spark, out[-1], SF), "t"))
    assert all(x.columns == d.columns for x in out[:4])
    rows = lambda df: sorted(map(tuple, df.collect()))
    model = toxicity.train(d, common.table(spark, SF, "labels"))
    assert rows(out[0]) == rows(toxicity.score(d, model).where("not rejected").select(d.columns))
    best = {}
    for r in out[0].collect():
        n = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[n] = min(best.get(n, (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert [r[0] for r in rows(out[1])] == sorted(i for _, i in best.values())
    linked = simhash_dedup.near_duplicates(out[1]).where("doc_id = component_id")
    assert sorted(r.doc_id for r in linked.collect()) == [r[0] for r in rows(out[2])]
    copies = {r.doc_id: r.copies for r in mixing.plan(out[2]).select("row.doc_id", "copies").collect()}
    assert [r[0] for r in rows(out[3])] == sorted(i for i, n in copies.items() for _ in range(n))
    from tokenizers import Tokenizer

    from quire.llm.queries import tokenizer_content
    t = Tokenizer.from_str(tokenizer_content())
    texts = {r.doc_id: r.text for r in out[3].collect()}
    got = out[4].collect()
    assert len(got) == out[3].count()
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def test_pipeline_on_an_empty_table_and_awkward_rows(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x y z", "en", "a", 5), (2, "x y z", "en", "a", 5)])):
        sf = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
        assert out.where(F.col("doc_id") == 2).count() == (1 if rows else 0)

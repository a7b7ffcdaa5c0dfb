"""One query per operator: the operator over its whole table with the
parameters of its contract, and the digest columns made from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, common, exact_dedup, exact_topk, mixing, periodic_runs, pii, quality, quality_rules, simhash_dedup, toxicity, url_filter

#: The tokenizer of the contract, by its name in the public tokenizers package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_content(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return bpe.tokenizer_json(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", common.held_out().alias("held_out"), "score", "predicted", "threshold", "rejected")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages", "page_id", "url")).drop("url")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = tokenizer_content()
    ids = bpe.encode(common.table(spark, sf_dir, "documents", "doc_id", "text"), content)
    return bpe.decode(ids, content).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.listed(of(*pii.BASE)), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations_of(*chat.tree(chat.with_extra(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    trees = quality.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, trees).select("doc_id", common.held_out().alias("held_out"), "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def with_made_periods(documents: DataFrame) -> DataFrame:
    """The input of op12: with h = crc32 of the decimal id, every text with
    h % 10 = 0 repeats, from a place on, a period of its words; a row without
    an id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, text = F.floor(h / 10), common.text_of()

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    words = quality_rules.words_of(text)
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise("")), 1)
    return documents.withColumn("text", F.when(h % 10 == 0, made).otherwise(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_made_periods(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic_runs.find(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(*centroids.cluster(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_exact_topk, op4_simhash_dedup, op5_url_filter, op6_bpe,
                                   op7_pii, op8_chat, op9_quality, op10_mixing, op11_quality_rules,
                                   op12_periodic_runs, op13_centroids, pipeline)}

"""The registered query of each operator: production parameters, whole tables, contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, epsilon_join, langid, packing, permutation, secrets, simhash, toxicity, url_filter, warc
from quillmark.llm.oracles import ORACLES
from quillmark.sources.tables import read_table as table

__all__ = ["ORACLES", "QUERIES"]

#: The contract's rules (host, path, verdict).
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", toxicity.predict(docs, model).alias("p"))
    return found.select("doc_id", "p.severity", "p.p_toxic", "p.grade", (F.col("p.p_toxic") >= 0.5).alias("toxic"))


def held_out() -> Column:
    """Documents whose language labels no query may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from text and language of the documents that are not held out."""
    return langid.fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_model(docs)
    found = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), langid.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation.search(vectors, vectors.where(permutation.divisible("vec_id", 50)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.simhash_groups(docs)
    return groups.withColumn("fingerprint", simhash.hex_fingerprint("fingerprint"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).drop("url")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    spans = F.col("spans")
    names = tuple(k.name for k in (*secrets.BASE_KINDS, secrets.OWNED))
    base = F.filter(spans, lambda s: s["rank"] < len(secrets.BASE_KINDS))

    def count(test):
        return F.size(F.filter(spans, test)).cast("long")

    def of_rank(rank):
        return lambda s: s["rank"] == rank

    return secrets.scan(docs, ["doc_id"]).select(
        "doc_id",
        *[count(of_rank(r)).alias(f"n_{name}") for r, name in enumerate(names)],
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        F.sha2(secrets.span_list(base, names), 256).alias("base_sha256"),
        secrets.span_list(spans, names).alias("spans"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digests(public_tokenizers.path("byte_bpe_50k.json")).alias("d")).select("doc_id", "d.*")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_join.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_langid, op3_warc, op4_permutation, op5_simhash, op6_url_filter, op7_secrets, op8_bpe, op9_packing, op10_epsilon_join)}

"""A training-data pipeline over ``documents``: five stages, each over all that the one before kept.

Every stage takes whole texts and all rows; an empty table gives no rows. All but the last return the
columns of their input, whatever their names, and use doc_id, text, lang, source and n_chars only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import langid, near_copies, packing, secrets, toxicity
from quillmark.llm.common import quoted, stage_table, unused_name
from quillmark.llm.queries import language_model, table

#: A document goes if it is toxic with at least this probability.
TOXIC = 0.5
#: Documents are near duplicates if their fingerprints differ in so many bits at most.
SIMHASH_BITS = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on ``labels``, does not call toxic.

    Null and empty texts say nothing toxic and stay, as do documents without an id. Repeated rows
    are judged alike and stay repeated. Without toxic labels all documents stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    told = unused_name(docs, "__toxic")
    return docs.withColumn(told, toxicity.predict(docs, model)).where(F.col(f"{told}.p_toxic") < TOXIC).drop(told)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the calibrated confidence.

    Null texts and texts without a letter go, and all texts where no document has a language to learn from.
    Repeated rows are judged alike and stay repeated.
    """
    model = language_model(docs)
    told = unused_name(docs, "__lang")
    return docs.withColumn(told, langid.predict(docs, model)).where(F.col(f"{told}.accepted")).drop(told)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Documents are linked by SimHash as in op5 (three-word shingles, 3 bits or fewer, through its tables
    of pivot distances), and those that are further apart by five-word shingles of Jaccard 0.8 or more.
    Texts without a word, null ones too, are one group. Of repeated rows one stays; a document without
    an id stays only if its group has none with one.
    """
    return near_copies.one_of_each_group(docs, radius=SIMHASH_BITS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every live-looking secret replaced by a mark and n_chars counted anew.

    A document without one is returned as it is, null texts and n_chars too. Repeated rows stay
    repeated; a null source owns nothing.
    """
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), "doc_id", "text", "source")
    found = secrets.scan(whole, ["doc"])
    live = F.filter("spans", lambda s: s["live"])
    clean = F.when(F.size(live) > 0, secrets.redacted(F.col("doc.text"), live)).otherwise(F.col("doc.text"))
    told = found.select("doc", clean.alias("text"), (F.size(live) > 0).alias("changed"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return told.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its place in a sequence of 2048 tokens.

    A null or empty text is the end token alone; repeated rows are documents of their own; ties of
    length are dealt in any order.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL can express neither the models nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None

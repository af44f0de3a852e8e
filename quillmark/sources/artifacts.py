"""JSON artifacts: requirement packages, recorded responses and raw model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.schemas import ITEM

#: The package version that is written, and those that are read.
PACKAGE_VERSION = "reqir_v4"
READABLE_VERSIONS = ("reqir_v1", "reqir_v2", "reqir_v3", "reqir_v4")
PAYLOAD = f"struct<items: array<{ITEM}>>"


def read_packages(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Rows (path, schema_version, item, error) of packages or bare lists of items, one file each.

    An unknown version gives a row with an error and no item; it is never read as if it were known.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    as_list = F.from_json("value", f"array<{item_schema}>")
    as_package = F.from_json("value", f"struct<schema_version: string, items: array<{item_schema}>>")
    listed = F.startswith(F.trim("value"), F.lit("["))
    version = F.when(listed, F.lit("list")).otherwise(as_package["schema_version"])
    known = listed | F.coalesce(version.isin(*READABLE_VERSIONS), F.lit(False))
    items = F.when(listed, as_list).otherwise(F.when(known, as_package["items"]))
    rows = files.select("path", version.alias("schema_version"), items.alias("items"), F.when(~known, F.lit("UNSUPPORTED_VERSION")).alias("error"))
    return rows.select("path", "schema_version", "error", F.explode_outer("items").alias("item"))


def write_package(items: DataFrame, group: str, metadata: Column) -> DataFrame:
    """(group, package): the JSON text of each group's package, items in their order column ``order``."""
    body = [c for c in items.columns if c not in (group, "order")]
    gathered = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("order", F.struct(*body).alias("item")))).alias("i"), F.first(metadata).alias("m"))
    return gathered.select(group, F.to_json(F.struct(F.lit(PACKAGE_VERSION).alias("schema_version"), F.col("m").alias("metadata"), F.col("i.item").alias("items"))).alias("package"))


def response_object(raw: Column) -> Column:
    """The JSON object in a model's answer, as a variant: the whole text, else the first fenced
    block, else from the first ``{`` to the last ``}``. The first of these that decodes decides;
    null if it is not an object."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    first = F.coalesce(*[F.try_parse_json(F.nullif(F.trim(t), F.lit(""))) for t in (raw, fenced, braced)])
    return F.when(F.startswith(F.schema_of_variant(first), F.lit("OBJECT")), first)


def recorded_items(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (request_fingerprint, chunk_id, chunk_fingerprint, block_ids) with their recorded
    response, or the code of the first thing that does not agree."""
    got = recorded.select("request_fingerprint", F.struct("chunk_id", "chunk_fingerprint", "block_ids").alias("r"), "payload")
    joined = requests.join(got, "request_fingerprint", "left")
    code = (
        F.when(F.col("r").isNull(), "RECORDED_RESPONSE_MISSING")
        .when(F.col("r.chunk_id") != F.col("chunk_id"), "RECORDED_CHUNK_ID_MISMATCH")
        .when(F.col("r.chunk_fingerprint") != F.col("chunk_fingerprint"), "RECORDED_CHUNK_FINGERPRINT_MISMATCH")
        .when(F.col("r.block_ids") != F.col("block_ids"), "RECORDED_BLOCK_IDS_MISMATCH")
    )
    return joined.withColumn("error_code", code).withColumn("payload", F.when(code.isNull(), F.col("payload"))).drop("r")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all files named ``case.json`` under ``path``, each a JSON object, with their folder; a
    file that is no such object has a null case_id and counts as broken."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="case.json")
    case = F.from_json("value", schema)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/case[.]json$", "")
    return files.select(folder.alias("folder"), case.alias("case")).select("folder", "case.*")

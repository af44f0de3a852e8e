"""Candidates of many chunks merged into requirements, with conflicts and possible duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The fields in which variants may disagree.
CONFLICT_FIELDS = ("type", "ears_pattern", "subject", "condition", "response", "priority", "verification_method")


def concrete(value: Column) -> Column:
    """Null, empty and ``unknown`` say nothing."""
    return F.when(~value.isin("", "unknown"), value)


def candidate_key(document: Column, identities: Column, statement: Column) -> Column:
    """``cand_`` and 16 hex digits of document, sorted source identities and normalised statement."""
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.to_json(F.struct(document.alias("document_id"), F.array_sort(identities).alias("sources"), statement.alias("statement"))), 256), 1, 16))


def merge_candidates(candidates: DataFrame, keys: list[str], order: list[Column], fields: tuple[str, ...] = CONFLICT_FIELDS) -> DataFrame:
    """One row per ``keys``: the first variant by ``order``, what all agree on, and the conflicts.

    ``candidates`` need confidence, tags, chunk_id, review_status and ``fields``. Confidence is the largest, tags and chunk
    ids are sorted unions; a field in which exactly one value is known takes it, one with more is a
    conflict and sends the row to recheck. ``variants`` counts the rows merged.
    """
    # of the rows that are first by ``order`` the smallest in all columns, so that the result is one
    head = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], *[F.col(c) for c in candidates.columns if c not in keys])
    known = {f: F.array_sort(F.collect_set(concrete(F.col(f)))) for f in fields}
    grouped = candidates.groupBy(*keys).agg(
        F.min(head).alias("first"), F.count("*").alias("variants"), F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"),
        *[values.alias(f"k_{f}") for f, values in known.items()],
    )
    resolved = [F.coalesce(concrete(F.col(f"first.{f}")), F.when(F.size(f"k_{f}") == 1, F.element_at(f"k_{f}", 1)), F.col(f"first.{f}")).alias(f) for f in fields]
    conflicts = F.array_compact(F.array(*[F.when(F.size(f"k_{f}") > 1, F.lit(f)) for f in fields]))
    kept = [c for c in candidates.columns if c not in {*keys, *fields, "confidence", "tags", "chunk_id", "review_status"}]
    out = grouped.select(
        *keys, *[F.col(f"first.{c}").alias(c) for c in kept], *resolved, "confidence", "tags", "source_chunk_ids", "variants",
        conflicts.alias("field_conflicts"), F.col("first.review_status").alias("__status"), F.struct(*[F.col(f"first.o{n}") for n in range(len(order))]).alias("sort_key"),
    )
    status = F.when(F.size("field_conflicts") > 0, "needs_recheck").otherwise(F.col("__status"))
    return out.withColumn("review_status", status).drop("__status")


def number_requirements(merged: DataFrame, document: str, key: str) -> DataFrame:
    """Requirement ids by source order within each document."""
    w = Window.partitionBy(document).orderBy("sort_key", key)
    return merged.withColumn("id", F.format_string("REQ-%04d", F.row_number().over(w)))


def duplicate_groups(requirements: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, reason, members): equal normalised statements, or one source with several.

    ``requirements``: document, id, statement_key, source_identities. A group has two ids at least;
    for one source, two statements at least.
    """
    by_statement = (
        requirements.groupBy(document, "statement_key")
        .agg(F.array_sort(F.collect_set("id")).alias("members"))
        .select(document, F.lit("normalized_statement_equal").alias("reason"), "members")
    )
    by_source = (
        requirements.select(document, "id", "statement_key", F.explode("source_identities").alias("identity"))
        .groupBy(document, "identity")
        .agg(F.array_sort(F.collect_set("id")).alias("members"), F.count_distinct("statement_key").alias("n"))
        .where("n > 1")
        .select(document, F.lit("same_source_divergent_statement").alias("reason"), "members")
    )
    return by_statement.unionByName(by_source).where(F.size("members") > 1).distinct()


def duplicate_members(requirements: DataFrame, document: str = "document_id", order: str = "order") -> DataFrame:
    """A row (document, group_id, reason, id) per member of each group of `duplicate_groups`.

    ``requirements``: document, id, order, statement_key, source_identities. Groups are numbered
    ``DUP-0001`` on within their document: those of equal statements first, then those of a source,
    each in the order of their first members. Groups with the same members and reason are one. Members
    are rows, not arrays, so a group may have any size. A null id or statement is none of the two that a group
    needs; numbers have four digits at least.
    """
    statements = requirements.select(document, F.lit(1).alias("rank"), F.struct(F.col("statement_key").alias("a")).cast("string").alias("key"), "id", "statement_key", F.struct(F.col(order).alias("o"), F.lit(0).alias("i")).alias("at"))
    sources = requirements.select(document, F.lit(2).alias("rank"), "id", "statement_key", order, F.posexplode("source_identities").alias("i", "key"))
    sources = sources.select(document, "rank", F.col("key").cast("string").alias("key"), "id", "statement_key", F.struct(F.col(order).alias("o"), "i").alias("at"))
    rows = statements.unionByName(sources)
    ids = rows.groupBy(document, "rank", "key", "id").agg(F.min("at").alias("at"))
    told = rows.groupBy(document, "rank", "key", "statement_key").agg(F.lit(1).alias("one")).groupBy(document, "rank", "key").agg(F.count("statement_key").alias("statements"))
    same = [F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("y")]
    groups = ids.groupBy(document, "rank", "key").agg(F.count("id").alias("n"), F.min("at").alias("at"), *same).join(told, [document, "rank", "key"])
    groups = groups.where("n > 1 and (rank = 1 or statements > 1)")
    first = groups.groupBy(document, "rank", "n", "x", "y").agg(F.min(F.struct("at", "key")).alias("f"))
    number = F.row_number().over(Window.partitionBy(document).orderBy("rank", "f"))
    named = first.select(document, "rank", F.col("f.key").alias("key"), F.format_string("DUP-%04d", number).alias("group_id"))
    reason = F.when(F.col("rank") == 1, "normalized_statement_equal").otherwise("same_source_divergent_statement")
    return ids.join(named, [document, "rank", "key"]).select(document, "group_id", reason.alias("reason"), "id")


def duplicate_marks(members: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, id, duplicate_group_id, possible_group_id): a requirement is marked with the first of
    its groups, and its possible duplicates are the other members of the last."""
    return members.groupBy(document, "id").agg(F.min("group_id").alias("duplicate_group_id"), F.max("group_id").alias("possible_group_id"))

"""Issues of requirements, evidence policies, quarantine and the outcome of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import strip

# Substrings that name an event; their case matters.
EVENT_TRIGGERS = ("当", "时", "后", "when", "WHEN")
POLICIES = ("quote_only", "structured_if_available", "structured_required")
HARD_FAILURES = ("FAIL_INVALID_REFERENCE", "FAIL_DERIVATION")


def _issue(condition: Column, level: str, code: str) -> Column:
    return F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


def schema_issues(id_: Column, statement: Column, n_sources: Column, confidence: Column, n_normalized: Column) -> Column:
    """Array of (level, code) in the order of the checks; a normalised field warns once for each."""
    warnings = F.transform(F.sequence(F.lit(1), n_normalized), lambda _: F.struct(F.lit("warning").alias("level"), F.lit("MODEL_FIELD_NORMALIZED").alias("code")))
    none = F.expr("cast(array() as array<struct<level: string, code: string>>)")
    errors = F.array(
        _issue(strip(id_) == "", "error", "SCHEMA_ID_EMPTY"),
        _issue(strip(statement) == "", "error", "SCHEMA_STATEMENT_EMPTY"),
        _issue(n_sources == 0, "error", "SCHEMA_SOURCES_EMPTY"),
        _issue(~confidence.between(0, 1) | F.isnan(confidence), "error", "SCHEMA_CONFIDENCE_RANGE"),
    )
    return F.concat(F.when(n_normalized > 0, warnings).otherwise(none), F.array_compact(errors))


def ears_issues(pattern: Column, condition: Column, statement: Column) -> Column:
    triggered = F.lit(False)
    for word in EVENT_TRIGGERS:
        triggered |= F.contains(statement, F.lit(word))
    bare = F.coalesce(condition, F.lit("")) == ""
    return F.array_compact(
        F.array(
            _issue(strip(statement) == "", "warning", "EARS_EMPTY_STATEMENT"),
            _issue((pattern == "event_driven") & bare & ~triggered, "warning", "EARS_EVENT_TRIGGER_MISSING"),
        )
    )


def passes_policy(policy: Column, block_known: Column, expected: Column, available: Column, results: Column) -> Column:
    """Whether a source passes: quote_only always; if available, no available capability may have
    failed hard; required, every expected one must pass. A block without expectations fails both."""
    status = lambda c: F.coalesce(results[c], F.lit("UNVERIFIED"))
    soft = ~F.exists(available, lambda c: status(c).isin(*HARD_FAILURES))
    hard = F.forall(expected, lambda c: status(c) == "PASS")
    return (
        F.when(policy == "quote_only", True)
        .when(~block_known | (F.size(expected) == 0), False)
        .when(policy == "structured_if_available", soft)
        .otherwise(hard)
    )


def blocks_policy(policy: Column, block_known: Column, capability: Column, available: Column, status: Column) -> Column:
    """Whether one capability's result keeps a source from passing."""
    return (
        F.when(policy == "quote_only", False)
        .when(~block_known, True)
        .when(policy == "structured_required", status != "PASS")
        .otherwise(F.array_contains(available, capability) & status.isin(*HARD_FAILURES))
    )


def active_capabilities(policy: Column, block_known: Column, expected: Column) -> Column:
    return F.when(~block_known | (policy == "quote_only"), F.array(F.lit("text_range"))).otherwise(expected)


def quarantine(df: DataFrame, *checks: Column) -> DataFrame:
    """``df`` with quarantined: rows for which some check is not true. A null check does not pass."""
    ok = F.lit(True)
    for check in checks:
        ok &= F.coalesce(check, F.lit(False))
    return df.withColumn("quarantined", ~ok)


def run_outcome(counts: dict[str, Column]) -> dict[str, Column]:
    """Status, warning codes in their order, the reason for an empty result and the error of a run,
    from its counts: items, accepted, rejected, validated, quarantined, chunk_errors,
    locator_warnings, field_conflicts, over_budget, oversized."""
    c = counts
    none_accepted = c["accepted"] == 0
    all_rejected = none_accepted & (c["items"] > 0) & (c["rejected"] == c["items"])
    reason = (
        F.when(none_accepted & (c["chunk_errors"] > 0), "PARTIAL_EXECUTION_EMPTY_RESULT")
        .when(none_accepted, "NO_REQUIREMENTS_FOUND")
        .when((c["validated"] == 0) & (c["quarantined"] > 0), "ALL_CANDIDATES_QUARANTINED")
    )
    codes = F.array_compact(
        F.array(
            F.when(none_accepted & (c["chunk_errors"] > 0), "PARTIAL_CHUNK_FAILURE"),
            F.when(reason.isin("NO_REQUIREMENTS_FOUND", "ALL_CANDIDATES_QUARANTINED"), reason),
            F.when(~none_accepted & (c["chunk_errors"] > 0), "PARTIAL_CHUNK_FAILURE"),
            F.when(c["rejected"] > 0, "MODEL_ITEMS_REJECTED"),
            F.when(c["quarantined"] > 0, "CANDIDATES_QUARANTINED"),
            F.when(c["locator_warnings"] > 0, "SOURCE_LOCATOR_WARNINGS"),
            F.when(c["field_conflicts"] > 0, "AGGREGATION_FIELD_CONFLICT"),
            F.when(c["over_budget"] > 0, "CHUNK_PROMPT_OVER_BUDGET"),
            F.when(c["oversized"] > 0, "CHUNK_OVERSIZED_BLOCK"),
        )
    )
    status = F.when(all_rejected, "failed").when(F.size(codes) > 0, "completed_with_warnings").otherwise("completed")
    return {
        "status": status,
        "warning_codes": F.when(all_rejected, F.expr("cast(array() as array<string>)")).otherwise(codes),
        "zero_result_reason": F.when(~all_rejected, reason),
        "error_code": F.when(all_rejected, "NO_VALID_MODEL_ITEMS"),
    }


def merge_reports(*reports: DataFrame) -> DataFrame:
    """(document_id, valid, issues): a document is valid if no report has an error for it."""
    rows = reports[0]
    for report in reports[1:]:
        rows = rows.unionByName(report)
    return rows.groupBy("document_id").agg((F.count_if(F.col("level") == "error") == 0).alias("valid"), F.count("code").alias("issues"))


def require_valid(policy: str, **reports: DataFrame) -> None:
    """Raise if the policy is strict and a report (document_id, valid, ...) has a document that is not
    valid; quarantine goes on. Reports are written before this is asked."""
    if policy not in ("strict", "quarantine"):
        raise ValueError(f"unknown validation policy {policy}")
    for name, report in reports.items():
        if policy == "strict" and not report.where("not valid").isEmpty():
            raise ValueError(f"{name} validation failed")

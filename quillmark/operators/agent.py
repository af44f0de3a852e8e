"""Analytics of agent runs: profiles, tool and finish rules, traces, loops and usage."""

from __future__ import annotations

import json as json_text

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.rates import known_total

# Fixed values.
LARGE_PROMPT, VERY_LARGE_PROMPT = 4_000, 16_000
CAPABILITIES = ("page_region", "table_cell", "text_range")
MAX_WARNINGS, MAX_PARAMETERS, MAX_VALUE = 64, 8, 1_000_000
MIN_PROMPT, MAX_PROMPT, MAX_OVERLAP = 1_000, 32_000, 3
SECRET_KEYS = ("api_key", "authorization", "cookie", "credential", "password", "secret", "access_token")
HUMAN_WARNINGS = ("ALL_CANDIDATES_QUARANTINED", "NO_REQUIREMENTS_FOUND", "PARTIAL_CHUNK_FAILURE")
HUMAN_ERRORS = ("ALL_CHUNKS_FAILED", "NO_EXTRACTABLE_CONTENT", "NO_VALID_MODEL_ITEMS")


def profile(blocks: DataFrame, prompt_overhead: int = 0) -> DataFrame:
    """One row per document: counts by block type, sections, characters and complexity flags.

    ``blocks``: document_id, type, text, section_path, expected and available (arrays of
    capabilities). The prompt's size is estimated as the text plus ``prompt_overhead`` per block.
    """
    held = lambda column, c: F.count_if(F.array_contains(column, c)).alias(f"{column}_{c}")
    counted = blocks.groupBy("document_id").agg(
        F.count("*").alias("block_count"),
        F.count_if(F.col("type") == "heading").alias("heading_count"),
        F.count_if(F.col("type") == "paragraph").alias("paragraph_count"),
        F.count_if(F.col("type") == "table").alias("table_block_count"),
        F.count_distinct(F.when(F.size("section_path") > 0, F.col("section_path"))).alias("section_count"),
        F.sum(F.length("text")).alias("rendered_text_chars"),
        *[held(column, c) for column in ("expected", "available") for c in CAPABILITIES],
        F.count_if(F.array_contains("expected", "table_cell") & ~F.array_contains("available", "table_cell")).alias("tables_unavailable"),
    )
    prompt = F.col("rendered_text_chars") + prompt_overhead * F.col("block_count")
    flags = F.array_compact(
        F.array(
            F.when(F.col("table_block_count") > 0, "HAS_TABLES"),
            F.when(F.col("available_page_region") > 0, "HAS_PAGE_REGIONS"),
            F.when(F.col("available_table_cell") > 0, "HAS_TABLE_CELL_EVIDENCE"),
            F.when(F.col("tables_unavailable") > 0, "HAS_UNAVAILABLE_TABLE_EVIDENCE"),
            F.when(prompt >= LARGE_PROMPT, "LARGE_DOCUMENT"),
            F.when(prompt >= VERY_LARGE_PROMPT, "VERY_LARGE_DOCUMENT"),
        )
    )
    return counted.withColumns({"estimated_prompt_chars": prompt, "complexity_flags": flags})


def safe_warnings(warnings: Column) -> Column:
    """Parser warnings without free text: the code with up to eight integer parameters in order."""

    def one(w: Column) -> Column:
        code = F.regexp_extract(w, "^([A-Z][A-Z0-9_]*)", 1)
        named = F.regexp_extract_all(w, F.lit(r"\b([a-z][a-z0-9_]*\s*=\s*-?[0-9]+)\b"), F.lit(1))
        pairs = F.transform(named, lambda p: F.struct(F.regexp_extract(p, "^[a-z0-9_]+", 0).alias("k"), F.regexp_extract(p, "-?[0-9]+$", 0).try_cast("long").alias("v")))
        small = F.filter(pairs, lambda p: F.abs(p["v"]) <= MAX_VALUE)
        first = F.filter(small, lambda p, i: F.array_position(F.transform(small, lambda x: x["k"]), p["k"]) == i + 1)
        shown = F.array_sort(F.transform(F.slice(first, 1, MAX_PARAMETERS), lambda p: F.concat(p["k"], F.lit("="), p["v"].cast("string"))))
        page = F.regexp_extract(w, r"(?i)^page\s+([0-9]+)\s+has no extractable text$", 1)
        return (
            F.when(code != "", F.when(F.size(shown) > 0, F.concat(code, F.lit(":"), F.array_join(shown, ","))).otherwise(code))
            .when(page != "", F.concat(F.lit("PDF_PAGE_NO_EXTRACTABLE_TEXT:page="), page.cast("long").cast("string")))
            .otherwise("PARSER_WARNING")
        )

    return F.array_distinct(F.transform(F.slice(warnings, 1, MAX_WARNINGS), one))


def tool_violation(tool: Column, allowed_tools: Column, mode: Column, allowed_modes: Column, prompt_chars: Column, overlap: Column) -> Column:
    """The first rule that a tool call breaks, or null."""
    extraction = tool == "run_requirement_extraction"
    return (
        F.when(~F.array_contains(allowed_tools, tool), "AGENT_TOOL_FORBIDDEN")
        .when(extraction & ~F.array_contains(allowed_modes, mode), "AGENT_CHUNKING_MODE_FORBIDDEN")
        .when(extraction & ~prompt_chars.between(MIN_PROMPT, MAX_PROMPT), "AGENT_PROMPT_BUDGET_OUT_OF_RANGE")
        .when(extraction & (overlap > MAX_OVERLAP), "AGENT_OVERLAP_OUT_OF_RANGE")
    )


def finish_allowed(outcome: Column, attempts: Column, status: Column, validated: Column, quarantined: Column, readable: Column, warnings: Column, error: Column, zero_reason: Column) -> Column:
    """Whether an outcome may be declared after what was last observed."""
    human_warning = F.arrays_overlap(warnings, F.array(*map(F.lit, HUMAN_WARNINGS)))
    clean = (validated > 0) & (quarantined == 0) & readable & (F.size(warnings) == 0)
    human_reason = F.coalesce(zero_reason.isin(*HUMAN_WARNINGS, *HUMAN_ERRORS), F.lit(False))
    return (
        F.when(attempts == 0, outcome.isin("needs_human", "failed"))
        .when(status == "failed", (outcome == "failed") | ((outcome == "needs_human") & F.coalesce(error.isin(*HUMAN_ERRORS), F.lit(False))))
        .when(status == "completed_with_warnings", (outcome == "completed_with_warnings") | ((outcome == "needs_human") & human_warning))
        .when(status == "completed", F.when(clean, outcome == "completed").otherwise((outcome == "failed") | ((outcome == "needs_human") & human_reason)))
        .otherwise(False)
    )


def action_loops(actions: DataFrame, run: str, order: list[str], signature: list[str]) -> DataFrame:
    """Actions that repeat an earlier one of their run, by a digest of ``signature``: the how-manieth."""
    digest = F.sha2(F.to_json(F.struct(*signature)), 256)
    w = Window.partitionBy(run, "signature").orderBy(*order)
    return actions.withColumn("signature", digest).withColumn("repeat", F.row_number().over(w)).where("repeat > 1")


def trace_problems(events: DataFrame, run: str, sequence: str, kind: str, first: str, last: tuple[str, ...]) -> DataFrame:
    """(run, problem, sequence): gaps and repeats in a run's numbers, a wrong first or last event."""
    w = Window.partitionBy(run).orderBy(sequence)
    numbered = events.withColumns({"before": F.lag(sequence).over(w), "after": F.lead(sequence).over(w)})
    problem = F.array_compact(
        F.array(
            F.when(F.col("before").isNull() & (F.col(kind) != first), "FIRST_EVENT"),
            F.when(F.col("after").isNull() & ~F.col(kind).isin(*last), "LAST_EVENT"),
            F.when(F.col("before") == F.col(sequence), "SEQUENCE_REPEATED"),
            F.when(F.col(sequence) - F.col("before") > 1, "SEQUENCE_GAP"),
        )
    )
    return numbered.select(run, F.explode(problem).alias("problem"), F.col(sequence).alias("sequence"))


def trace_counters(events: DataFrame, run: str, kind: str) -> DataFrame:
    """What the final state of a run must say, counted from its events."""
    n = lambda k: F.count_if(F.col(kind) == k)
    return events.groupBy(run).agg(
        n("decision").alias("steps"), n("planner_request").alias("planner_calls"), (n("tool_started") + 1).alias("tool_invocations"),
        n("policy_rejection").alias("policy_rejections"), n("error").alias("errors"),
    )


def usage_rollup(calls: DataFrame, keys: list[str], tokens: list[str], seconds: str, failed: Column) -> DataFrame:
    """Calls, failures and seconds by ``keys`` and their subtotals; a token total is null unless it is
    known for every call."""
    totals = [known_total(F.col(t)).alias(t) for t in tokens]
    return calls.rollup(*keys).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed_calls"), F.sum(seconds).alias("seconds"), *totals)


def paired_modes(runs: DataFrame, case: str, mode: str, value: str, modes: tuple[str, str]) -> DataFrame:
    """Cases that have both modes, with the value of each and the ratio (null for a zero base)."""
    wide = runs.groupBy(case).pivot(mode, list(modes)).agg(F.sum(value))
    a, b = F.col(modes[0]), F.col(modes[1])
    return wide.where(a.isNotNull() & b.isNotNull()).withColumn("ratio", F.when(a != 0, b / a))


class _Number(str):  # str(x) of one is a plain string
    """A JSON number as it was written."""


def _without_secrets(value):
    if isinstance(value, dict):
        return {k: _without_secrets(v) for k, v in value.items() if not any(x in k.strip().lower().replace("-", "_") for x in SECRET_KEYS)}
    return [_without_secrets(v) for v in value] if isinstance(value, list) else value


def _shown(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_shown(k)}:{_shown(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_shown, value)) + "]"
    return str(value) if isinstance(value, _Number) else json_text.dumps(value, ensure_ascii=False)


def _sanitized_text(text: str | None) -> str | None:
    try:
        value = _without_secrets(json_text.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)) if text is not None else None
    except ValueError:
        return None
    if isinstance(value, dict):
        value = {k: str(v) if isinstance(v, _Number) else _shown(v) if isinstance(v, bool) else v for k, v in value.items()}
    return _shown(value) if isinstance(value, (dict, list)) else None


def sanitized(json: Column) -> Column:
    """A JSON object or list without keys that name a secret, at any depth; '-' in a key counts as '_'.

    Numbers and booleans of the outermost object are given as text, nested values as they are. What
    is no JSON object or list gives null.
    """

    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        return pa.array([_sanitized_text(v) for v in values.to_pylist()], pa.string())

    return of(json)


def _digest_text(text: str | None) -> str | None:
    try:
        value = _without_secrets(json_text.loads(text)) if text is not None else None
        return json_text.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) if isinstance(value, (dict, list)) else None
    except ValueError:
        return None


def canonical_body(json: Column) -> Column:
    """A JSON object or list without keys that name a secret at any depth, its keys sorted and its
    types kept: bodies that say the same have the same text. What is no JSON object or list gives null."""

    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        return pa.array([_digest_text(v) for v in values.to_pylist()], pa.string())

    return of(json)


def inspection_facts(counts: dict[str, Column], chunk_warnings: Column, base: Column, zero_reason: Column) -> dict[str, Column]:
    """Facts of a finished run for a planner, its warnings with them, and whether trying again may help."""
    partial = (counts["chunks_failed"] > 0) | F.array_contains(base, "PARTIAL_CHUNK_FAILURE")
    over = F.arrays_overlap(chunk_warnings, F.array(F.lit("CHUNK_PROMPT_OVER_BUDGET"), F.lit("CHUNK_OVERSIZED_BLOCK")))
    facts = F.array_compact(
        F.array(
            F.when(partial, "PARTIAL_CHUNK_FAILURE"),
            F.when(over, "CHUNK_PROMPT_OVER_BUDGET"),
            F.when((counts["validated"] == 0) & (counts["quarantined"] > 0), "ALL_CANDIDATES_QUARANTINED"),
            F.when(zero_reason.isin("NO_REQUIREMENTS_FOUND", "NO_VALID_MODEL_ITEMS"), "NO_REQUIREMENTS_FOUND"),
            F.when(counts["rejected"] > 0, "MODEL_ITEMS_REJECTED"),
        )
    )
    return {"facts": facts, "warning_codes": F.array_distinct(F.concat(base, facts)), "retryable": partial | over}


def replay_mismatches(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Steps of a replay whose request is not the recorded one: run, step, problem. Both: run, step
    (from 1), request_fingerprint; every step must agree, in order."""
    a, b = requests.select("run", "step", F.col("request_fingerprint").alias("asked")), recorded.select("run", "step", F.col("request_fingerprint").alias("held"))
    problem = F.when(F.col("held").isNull(), "NOT_RECORDED").when(F.col("asked").isNull(), "NOT_REQUESTED").when(F.col("asked") != F.col("held"), "REQUEST_DIFFERS")
    return a.join(b, ["run", "step"], "full").select("run", "step", problem.alias("problem")).where("problem is not null")


def exact_checks(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, check, passed) for every column of ``expected``: values, lists included, must be equal."""
    names = [c for c in expected.columns if c != key]
    joined = expected.alias("e").join(actual.alias("a"), key, "left")
    checks = F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")).alias("passed")) for c in names])
    return joined.select(key, F.explode(checks).alias("c")).select(key, "c.check", "c.passed")


def task_readable(status: Column, generation: Column, expected_generation: Column, fingerprint: Column, expected_fingerprint: Column) -> Column:
    """The code of the first reason why a task's artifacts may not be read, or null."""
    return (
        F.when(~status.isin("completed", "completed_with_warnings"), "TASK_NOT_READABLE")
        .when(generation != expected_generation, "RUN_GENERATION_MISMATCH")
        .when(~fingerprint.eqNullSafe(expected_fingerprint), "EVIDENCE_FINGERPRINT_MISMATCH")
    )

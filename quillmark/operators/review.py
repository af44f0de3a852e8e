"""Review actions folded into each requirement's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses that an action is allowed from, and the fields that an edit may change.
APPROVE_FROM = ("pending", "needs_recheck")
REJECT_FROM = ("pending", "needs_recheck", "approved")
EDITABLE = ("statement", "tags", "priority", "metadata")


def allowed(status: Column, action: Column, fields: Column) -> Column:
    """Whether an action is accepted in a state; ``fields`` are those that an edit changes."""
    return (
        F.when(action == "approve", status.isin(*APPROVE_FROM))
        .when(action == "reject", status.isin(*REJECT_FROM))
        .when(action == "restore", status == "rejected")
        .when(action == "request_recheck", True)
        .when(action == "edit", F.size(F.array_except(F.coalesce(fields, F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, EDITABLE)))) == 0)
        .otherwise(False)
    )


def next_status(status: Column, action: Column, fields: Column) -> Column:
    return (
        F.when(action == "approve", "approved")
        .when(action == "reject", "rejected")
        .when(action == "restore", "pending")
        .when(action == "request_recheck", "needs_recheck")
        .when((action == "edit") & F.coalesce(F.array_contains(fields, "statement"), F.lit(False)), "needs_recheck")
        .otherwise(status)
    )


def fold_reviews(log: DataFrame, key: str, order: list[str], initial: str = "pending") -> DataFrame:
    """(key, status, revision, rejected_actions, log) after all actions of each key, in ``order``.

    ``log``: key, order columns, action, fields (array), expected_revision (null: any). An action
    that the state does not allow, or that expects another revision, changes nothing and is
    counted. Each key's log is one array, folded without Python.
    """
    entry = F.struct(*order, "action", "fields", "expected_revision")
    gathered = log.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    start = F.struct(F.lit(initial).alias("status"), F.lit(0).alias("revision"), F.lit(0).alias("refused"), F.expr("cast(array() as array<struct<action: string, before: string, after: string>>)").alias("log"))

    def step(state: Column, e: Column) -> Column:
        fresh = e["expected_revision"].isNull() | (e["expected_revision"] == state["revision"])
        ok = fresh & F.coalesce(allowed(state["status"], e["action"], e["fields"]), F.lit(False))
        after = F.when(ok, next_status(state["status"], e["action"], e["fields"])).otherwise(state["status"])
        record = F.array(F.struct(e["action"].alias("action"), state["status"].alias("before"), after.alias("after")))
        return F.struct(
            after.alias("status"),
            (state["revision"] + ok.cast("int")).alias("revision"),
            (state["refused"] + (~ok).cast("int")).alias("refused"),
            F.when(ok, F.concat(state["log"], record)).otherwise(state["log"]).alias("log"),
        )

    folded = gathered.withColumn("s", F.aggregate("entries", start, step))
    return folded.select(key, "s.status", "s.revision", F.col("s.refused").alias("rejected_actions"), "s.log")


def review_log(folded: DataFrame, key: str) -> DataFrame:
    """A row per accepted action, numbered from 1 within its requirement."""
    return folded.select(key, F.posexplode("log").alias("at", "r")).select(key, (F.col("at") + 1).alias("revision"), "r.action", "r.before", "r.after")

"""Event logs and reviews as streams: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.operators.review import APPROVE_FROM, EDITABLE, REJECT_FROM


def windowed_counts(events: DataFrame, time: str, kind: str, size: str, late: str) -> DataFrame:
    """Events of each kind per window of ``size``; rows that come later than ``late`` are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once, by its keys, for as long as the watermark keeps them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def review_step(status: str, action: str, fields: list[str]) -> str | None:
    """The status after an action, or None if it is refused."""
    if action == "approve":
        return "approved" if status in APPROVE_FROM else None
    if action == "reject":
        return "rejected" if status in REJECT_FROM else None
    if action == "restore":
        return "pending" if status == "rejected" else None
    if action == "request_recheck":
        return "needs_recheck"
    if action == "edit" and set(fields) <= set(EDITABLE):
        return "needs_recheck" if "statement" in fields else status
    return None


def review_states(actions: DataFrame, key: str) -> DataFrame:
    """The state of each requirement after every batch of its actions: key, status, revision, refused.

    ``actions``: key (string), seq, action, fields. Within a batch actions apply in the order of seq.
    """

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, revision, refused = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for action, fields in zip(rows["action"], rows["fields"]):
            after = review_step(status, action, [] if fields is None else list(fields))
            if after is None:
                refused += 1
            else:
                status, revision = after, revision + 1
        state.update((status, revision, refused))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "revision": [revision], "refused": [refused]})

    return actions.groupBy(key).applyInPandasWithState(
        fold, f"{key} string, status string, revision long, refused long", "status string, revision long, refused long", "update", GroupStateTimeout.NoTimeout
    )

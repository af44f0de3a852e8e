"""Old against new sources of a corpus that was parsed or keyed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, old, new, change): kept, rebound (another value), bound (only new) or lost (only old)."""
    a = old.select(*keys, F.col(value).alias("old"))
    b = new.select(*keys, F.col(value).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "bound").when(F.col("new").isNull(), "lost").when(F.col("old") == F.col("new"), "kept").otherwise("rebound")
    )
    return a.join(b, keys, "full").withColumn("change", change)


def change_statistics(changes: DataFrame) -> DataFrame:
    pair = F.concat_ws(">", "old", "new")
    return changes.agg(
        F.count("*").alias("total"), F.count_distinct("old").alias("old_ids"), F.count_distinct("new").alias("new_ids"),
        F.count_distinct(F.when(F.col("change") == "rebound", pair)).alias("rebound_pairs"),
        F.count_distinct(F.when(F.col("change") == "bound", F.col("new"))).alias("newly_bound"),
        F.count_if(F.col("change") == "lost").alias("lost"),
    )

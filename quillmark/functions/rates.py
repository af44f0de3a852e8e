"""Ratios under the four policies for an empty denominator; they must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, empty: float | None) -> Column:
    """``part / whole``, or ``empty`` where nothing was counted: 1.0 for locator metrics, null for
    corpus rates and plain ratios, 0.0 for usage and quality rates."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty).cast("double"))


def precision_recall_f1(matched: Column, candidates: Column, gold: Column) -> dict[str, Column]:
    """Nothing expected and nothing found is perfect; found without anything expected has recall 1,
    expected without anything found has neither."""
    precision = F.when(candidates > 0, matched.cast("double") / candidates).otherwise(F.when(gold > 0, 0.0).otherwise(1.0))
    recall = F.when(gold > 0, matched.cast("double") / gold).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def known_total(value: Column) -> Column:
    """A sum that is null unless every row has a value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))

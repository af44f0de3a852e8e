"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import delete, stage_table, written

#: A hub's rows are dealt over this many groups, so that its edges never meet in one task.
SALTS = 32
#: Hubs are the nodes with more than one in so many of all edge rows, so there are fewer of them, and
#: with more rows than one task takes at ease.
HUBS, FEW = 10_000, 1024


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) reduced to (node, smallest node linked with it), without the roots' own rows.

    The result has fewer rows than there are nodes, whatever the number of links.
    """
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        # roots of both ends take the smaller label, so whole trees merge in one step
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _least_neighbour(edges: DataFrame, by: str, other: str, rows: int) -> DataFrame:
    """Each edge with the smallest neighbour of its node ``by``; a hub's rows are dealt by salt.

    ``rows`` is the number of edges or more. Fewer than `HUBS` nodes can each have more than one in
    `HUBS` of them, which bounds the broadcast at any size.
    """
    many = F.count("*") > F.lit(max(rows / HUBS, FEW))
    least = edges.groupBy(by).agg(F.min(other).alias("least"), many.alias("hub"))
    hubs = edges.groupBy(by).agg(many.alias("hub")).where("hub")
    last = F.when(F.col("hub"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hub")
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = edges.join(F.broadcast(hubs), by, "left").withColumn("salt", salt).drop("hub")
    # the salted side is many times what its files suggest, so it must not be broadcast on their size
    return salted.join(least.hint("merge"), [by, "salt"]).drop("salt")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; long): the smallest node reachable.

    Each round reads a stage table, writes the next one and deletes the one it read; edges shrink
    towards one star per component, so the number of rounds grows with the logarithm of the longest
    path. Null ends are ignored, repeated and self links are harmless, and no edges give no rows.
    """
    spark = edges.sparkSession
    current, path = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    rows = current.count()
    nodes = stage_table(current.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _least_neighbour(both, "u", "v", 2 * rows)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
            .distinct()
        )
        small = _least_neighbour(large, "u", "v", rows)
        linked = small.select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("least").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v")
        read = path
        current, path = written(linked.where("u <> v").distinct(), "stars")
        delete(spark, read)
        after = tuple(
            current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        )
        if after == before:
            break
        before, rows = after, after[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )

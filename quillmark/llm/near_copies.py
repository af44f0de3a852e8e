"""Near copies by the Jaccard similarity of shingle sets: MinHash bands propose, exact sets decide; and by SimHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import simhash
from quillmark.llm.common import delete, list_rows, quoted, small_batches, stage_table, unused_name, utf8_rows, worker_cache, written
from quillmark.llm.components import connected_components

WIDTH = 5
SEED = 42
#: Sets are near copies from this similarity, 4/5; kept as whole numbers, so that the limit itself counts.
LEAST, OF = 4, 5
#: A pair at the limit shares none of the bands with probability (1 - 0.8 ** ROWS) ** BANDS, 5e-6; a closer pair with less.
BANDS, ROWS = 52, 7
#: Sets of one group that are compared in one task; a larger group is dealt over more tasks.
CELL_ROWS = 256
#: Shingles hashed by all functions at once.
SLAB = 256
_RNG = np.random.default_rng(20_240_105)
_TIMES = _RNG.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles, words as in `simhash.simhash`."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    last = max(len(words) - width, 0)
    end = (start + length)[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashed = (digest(joined[s:e], SEED) for s, e in zip(start[: last + 1].tolist(), end[: last + 1].tolist()))
    return np.unique(np.fromiter(hashed, np.uint64, last + 1))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of MinHash values; a set without shingles has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLAB):
        np.minimum(least, (hashes[None, at : at + SLAB] * _TIMES + _PLUS).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sketch(text: Column | str, width: int) -> Column:
    """The hash of a text's whole shingle set, and its band keys."""
    small_batches()

    @F.arrow_udf("struct<node: long, keys: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        worker_cache("near_copies", dict)  # frees what another operator kept
        sets = [shingles(t, width) for t in utf8_rows(texts)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        keys = [band_keys(s) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        return pa.StructArray.from_arrays([pa.array(nodes), lists], names=["node", "keys"])

    return of(text)


def _set_bytes(text: Column | str, width: int) -> Column:
    small_batches()

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t, width).tobytes() for t in utf8_rows(texts)], pa.binary())

    return of(text)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `LEAST` / `OF`."""
    few, many = sorted((len(a), len(b)))
    if OF * few < LEAST * many:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LEAST * (few + many - both)


def _verified(table: pa.Table) -> pa.Table:
    """The links of one cell that connect what its near copies connect: of sets that share a band,
    those not connected yet are compared. In a cell of two chunks only sets of both meet."""
    nodes = table.column("node").to_numpy()
    own = table.column("own").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    keys = list_rows(table.column("keys"))
    across = table.column("i")[0] != table.column("j")[0]
    owner = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label = np.arange(len(nodes))
    failed: set[tuple[int, int]] = set()
    links: list[tuple[int, int]] = []
    for members in np.split(owner, np.flatnonzero(flat[1:] != flat[:-1]) + 1):
        for n, a in enumerate(members[:-1].tolist()):
            rest = members[n + 1 :]
            rest = rest[label[rest] != label[a]]
            for b in (rest[own[rest] != own[a]] if across else rest).tolist():
                if label[a] == label[b] or (min(a, b), max(a, b)) in failed:
                    continue
                if similar(sets[a], sets[b]):
                    links.append((a, b))
                    label[label == label[b]] = label[a]
                else:
                    failed.add((min(a, b), max(a, b)))
    a, b = (nodes[np.array([x[k] for x in links], np.int64)] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_copy_links(rows: DataFrame, nodes: DataFrame, width: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the same sets as all pairs of near copies that share a band do.

    ``nodes``: node, __row (one row that has the set) and keys; ``rows``: __row and __text. Sets that
    share a band are candidates; what they connect is a group. A set goes once to its group, or,
    where the group has more than ``cell_rows``, to each pair of chunks that has its own.
    """
    keyed, path = written(nodes.select(F.explode("keys").alias("key"), "node"), "bands")
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    proposed = keyed.join(stage_table(shared, "shared-bands"), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = stage_table(connected_components(proposed.where("a <> b").distinct()).withColumnRenamed("component", "group"), "candidates")
    delete(nodes.sparkSession, path)
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("chunks"))
    members = nodes.join(groups.join(sizes, "group"), "node")
    held = stage_table(rows.join(members, "__row").select("group", "chunks", "node", "keys", _set_bytes("__text", width).alias("shingles")), "sets")
    cells = (
        held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "keys", "shingles")
    )
    return cells.groupBy("group", "i", "j").applyInArrow(_verified, "a long, b long")


def fingerprint_edges(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect the sets whose texts have SimHash fingerprints linked within ``radius`` bits.

    ``prints``: node and fp, both 64-bit hashes. The linked fingerprints are nodes between the sets;
    those that hold one set and no link have no edges.
    """
    pairs = stage_table(prints.distinct(), "set-prints")
    held = stage_table(pairs.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    links = stage_table(simhash.fingerprint_links(held, radius), "print-links")
    told = links.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(held.where("n > 1").select("fp")).distinct()
    return pairs.join(told, "fp", "left_semi").select(F.col("node").alias("a"), F.col("fp").alias("b")).unionByName(links)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of at least 0.8 are linked;
    texts without a word are copies of each other. With a ``radius``, texts whose fingerprints (`simhash`)
    differ in so many bits at most are linked too, whatever their sets. A row without an id stays only if no row of its
    component has one; of repeated rows one stays. Null, empty and blank texts have no word, texts of
    any length are compared whole, and an empty table gives no rows. All columns are returned as they
    are, whatever their names.
    """
    row, sketched, printed = (unused_name(docs, c) for c in ("__row", "__sketch", "__print"))
    made = {row: F.monotonically_increasing_id(), sketched: _sketch(quoted(text_col), width)}
    if radius is not None:
        made[printed] = simhash.fingerprint(quoted(text_col))
    rows = stage_table(docs.withColumns(made), "rows")
    held = rows.select(F.col(row).alias("__row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("__text"), F.col(sketched).alias("sketch"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("first")
    one = F.min_by(F.struct("__row", F.col("sketch.keys").alias("keys")), "__row").alias("one")
    by_set = stage_table(held.groupBy(F.col("sketch.node").alias("node")).agg(first, one), "first-of-set")
    nodes = by_set.select("node", "one.__row", "one.keys")
    links = near_copy_links(held.select("__row", "__text"), nodes, width)
    if radius is not None:
        links = links.unionByName(fingerprint_edges(rows.select(F.col(sketched)["node"].alias("node"), F.col(printed).alias("fp")), radius))
    labels = connected_components(links)
    kept = (
        by_set.join(labels, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.__row").alias(row))
    )
    return rows.join(kept, row, "left_semi").drop(*made)

"""SimHash fingerprints and near-duplicate groups found through tables of pivot distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import small_batches, stage_table, utf8_rows, worker_cache
from quillmark.llm.components import connected_components, star_forest

BITS = 64
SEED = 42
#: Rows of one group that are compared in one task; a larger group is dealt over more tasks.
CELL_ROWS = 1024
#: Shingles hashed at once; a longer text is taken in so many slabs.
SLAB = 1 << 16
#: The bits of a byte, most significant first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: The origin of the references, and the references far from each other.
_RNG = np.random.default_rng(20_240_101)
ORIGIN = np.uint64(_RNG.integers(0, 1 << 64, dtype=np.uint64))
FAR_PIVOTS = _RNG.integers(0, 1 << 64, size=16, dtype=np.uint64)
#: One reference for each bit: the origin with that bit turned.
NEAR_PIVOTS = ORIGIN ^ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))


def simhash(text: bytes | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of UTF-8 ``text``; zero for null and for texts without a word.

    A-Z are lowered, words are runs of bytes outside space and 0x09-0x0D, shingles are ``width``
    words joined by a space (all words, if there are fewer), repeats count.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    last = max(len(words) - width, 0)
    end = (start + length)[min(width, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, last + 1, SLAB):
        upto = min(at + SLAB, last + 1)
        hashed = b"".join([digest(joined[s:e], SEED) for s, e in zip(start[at:upto].tolist(), end[at:upto].tolist())])
        by_byte = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _BYTE_BITS
    packed = np.packbits(2 * ones > last + 1)
    return int.from_bytes(packed.tobytes(), "big", signed=True)


def fingerprint(text: Column | str, width: int = 3) -> Column:
    """A column of fingerprints (long)."""
    small_batches()

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        worker_cache("simhash", dict)  # frees what another operator kept
        return pa.array([simhash(t, width) for t in utf8_rows(texts)], pa.int64())

    return of(text)


def hex_fingerprint(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivot_distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the pivots for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def coordinate_groups(radius: int) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    """Groups of near references, and the choices of groups that serve as keys.

    Two fingerprints that differ in k bits differ in exactly k of the centred coordinates
    d(x, near pivot) - d(x, origin). With radius + 3 groups of references, at most ``radius``
    groups hold a difference, so all coordinates of some three groups are equal.
    """
    groups = np.array_split(np.arange(BITS), radius + 3)
    return groups, list(combinations(range(radius + 3), 3))


def group_keys(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint one key per choice of three groups, read off its pivot distances."""
    near = pivot_distances(fps, NEAR_PIVOTS) - pivot_distances(fps, np.array([ORIGIN]))
    groups, choices = coordinate_groups(radius)
    closer = near < 0
    keys = np.empty((len(fps), len(choices)), np.uint64)
    for c, chosen in enumerate(choices):
        bits = closer[:, np.concatenate([groups[g] for g in chosen])]
        key = np.zeros(len(fps), np.uint64)
        for column in bits.T:
            key = (key << np.uint64(1)) | column.astype(np.uint64)
        keys[:, c] = key | (np.uint64(c) << np.uint64(48))  # three groups hold 48 bits at most
    return keys.view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = group_keys(fps.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"]
        )


def close_pairs(fps: np.ndarray, run_end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` bits among rows of the same run; ``run_end`` is each row's run's end.

    A pair is discarded as soon as one pivot distance differs by more than ``radius`` (Hamming
    distance is a metric, so none within the radius is lost); survivors are compared bit by bit.
    """
    table = pivot_distances(fps, FAR_PIVOTS)
    at = np.arange(len(fps))
    step = 0
    while True:
        step += 1
        at = at[at + step < run_end[at]]
        if not len(at):
            return
        left = at
        for pivot in range(table.shape[1]):
            column = table[:, pivot]
            left = left[np.abs(column[left] - column[left + step]) <= radius]
            if not len(left):
                break
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= radius]
        if len(left):
            yield left, left + step


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, fp), sorted by cell: a star forest of each batch's links."""
    held: list[np.ndarray] | None = None

    def forest(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps = cells[-1].view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cells[:-1]], axis=0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fps))
        run_end = np.repeat(ends, ends - starts)
        node, root = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in close_pairs(fps, run_end, radius):
            node, root = star_forest(
                np.concatenate([node, cells[-1][a]]), np.concatenate([root, cells[-1][b]])
            )
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        # the last cell may go on in the next batch
        same = np.logical_and.reduce([c == c[-1] for c in rows[:3]])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = [c[cut:] for c in rows]
        if cut:
            yield from forest([c[:cut] for c in rows])
    if held is not None and len(held[0]):
        yield from forest(held)


def fingerprint_links(fps: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``radius`` bits do.

    ``fps`` has distinct values in its column fp. Each value is posted under its coordinate keys;
    keys with one value are dropped, and those with more than ``cell_rows`` are dealt in chunks
    whose pairs are cells, so that no task holds more than two chunks. Within a cell pairs are
    discarded by their pivot distances, and only a spanning forest of the links leaves the task.
    """
    keyed = fps.select("fp").mapInArrow(lambda it: _keyed(it, radius), "key long, fp long")
    keyed = stage_table(keyed, "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage_table(shared, "shared-keys")
    met = keyed.join(shared, "key")
    chunks = F.ceil(F.col("n") / F.lit(cell_rows)).cast("int")
    cells = (
        met.withColumn("chunks", chunks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda it: _linked(it, radius), "a long, b long")


def _components(prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, component, component_id) for each fingerprint of ``prints``: the smallest fingerprint
    reachable, and the smallest id of all rows that hold one of the component's fingerprints."""
    members = stage_table(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    labels = connected_components(fingerprint_links(members, radius))
    grouped = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    grouped = stage_table(grouped, "grouped")
    least = stage_table(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    return stage_table(grouped.join(least, "component").select("fp", "component", "component_id"), "named")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3
) -> DataFrame:
    """Per row of ``docs``: its id, fingerprint (long) and component_id, the smallest id reachable.

    Fingerprints within ``radius`` bits are linked. Copies share a fingerprint and are compared
    once. A null or empty text has fingerprint zero and links like any other. Null ids are never
    the smallest; a component of null ids only has a null component_id. Repeated rows each get
    their own row; other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    prints = stage_table(docs.select(F.col(id_col), fingerprint(text_col, width).alias("fp")), "prints")
    named = _components(prints, id_col, radius)
    return prints.join(named, "fp").select(F.col(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id.

    A row without an id stays only if no row of its component has one; of repeated rows one stays.
    All columns are returned as they are; their names may be any but __row and __fp.
    """
    rows = stage_table(docs.withColumns({"__row": F.monotonically_increasing_id(), "__fp": fingerprint(text_col, width)}), "rows")
    prints = rows.select("__row", F.col("__fp").alias("fp"), F.col(id_col).alias("id"))
    named = _components(prints, "id", radius)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("first")
    by_print = stage_table(prints.groupBy("fp").agg(first), "first-of-print")
    kept = (
        by_print.join(named.select("fp", "component"), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.__row").alias("__row"))
    )
    return rows.join(kept, "__row", "left_semi").drop("__row", "__fp")

"""Best-fit packing of token pieces into sequences, by sums of lengths that fill a gap exactly.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths:
``capacity`` numbers, however many pieces there are. Spark then deals the pieces of each length
to the plan's places by their rank.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import small_batches, stage_table, worker_cache
from quillmark.llm.tokens import SPACED, WordTable

CAPACITY = 2048
#: Pieces of one length are ranked in at least so many groups, and so many pieces make one more.
LEAST_GROUPS, GROUP_ROWS = 64, 20_000


class SumIndex:
    """Which single, pair and triple of available lengths has a given sum.

    ``counts`` only falls but for what is `held` for a while; what is held is left out of every
    combination. A sum that has no pair or triple of all counts never gets one again, so that is
    remembered; a combination is looked up again once one of its lengths has run out.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.held: Counter[int] = Counter()
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def free(self, length: int) -> int:
        return int(self.counts[length]) - self.held[length]

    def available(self, lengths: tuple[int, ...]) -> bool:
        return all(self.free(x) >= lengths.count(x) for x in lengths)

    @contextmanager
    def holding(self, *lengths: int) -> Iterator[None]:
        self.held.update(lengths)
        try:
            yield
        finally:
            self.held.subtract(lengths)

    def _find_pair(self, counts: np.ndarray, total: int) -> tuple[int, int] | None:
        large = np.arange(total - 1, (total - 1) // 2, -1)
        fits = (counts[large] > 0) & (counts[total - large] > 0)
        if total % 2 == 0 and len(fits) and counts[total // 2] < 2:
            fits[-1] = False
        at = np.flatnonzero(fits)
        return (int(large[at[0]]), int(total - large[at[0]])) if len(at) else None

    def pair(self, total: int) -> tuple[int, int] | None:
        found = self.pairs.get(total, ())
        if found is None or (found and self.available(found)):
            return found
        found = self.pairs[total] = self._find_pair(self.counts, total)
        if found and not self.available(found):
            left = self.counts.copy()
            for length, n in self.held.items():
                left[length] -= n
            found = self._find_pair(left, total)
        return found

    def _find_triple(self, total: int) -> tuple[int, int, int] | None:
        for first in np.flatnonzero(self.counts[:total] > 0)[::-1].tolist():
            if 3 * first < total:
                return None  # the largest of three is at least a third
            if total - first < 2 or self.pairs.get(total - first, ()) is None or self.free(first) < 1:
                continue
            with self.holding(first):
                rest = self.pair(total - first)
            if rest:
                return first, *rest
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        found = self.triples.get(total, ())
        if found is None or (found and self.available(found)):
            return found
        held, self.held = self.held, Counter()
        found = self.triples[total] = self._find_triple(total)
        self.held = held
        return self._find_triple(total) if found and not self.available(found) else found

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths with this sum."""
        if total < 1:
            return None
        if self.free(total) > 0:
            return (total,)
        return self.pair(total) or self.triple(total)


@dataclass
class Plan:
    """For ranges of ranks of each length: the first sequence, how many to a sequence, the offset."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_sequences: int

    #: Ranks are below this.
    RANKS = 1 << 50

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks within their length."""
        at = np.searchsorted(self.key, length * self.RANKS + rank, side="right") - 1
        past = rank - self.first[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The better of two plans: exact combinations for all lengths first, or length by length."""
    plans = [_plan(histogram, capacity, rounds) for rounds in ((False, True), (True,))]
    return min(plans, key=lambda plan: plan.n_sequences)


def _plan(histogram: dict[int, int], capacity: int, rounds: tuple[bool, ...]) -> Plan:
    """Plan the sequences for so many pieces of each length (1 to ``capacity``).

    A round goes from the longest length down and consumes combinations that fill its gap exactly,
    as often as the counts allow. In a round that fills the rest, a length without such a
    combination is packed best fit: the longest length that fits, until an exact combination fills
    the rest or nothing fits. Each step uses up some length (or leaves fewer than it needs), so the
    number of steps grows with the distinct lengths only.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        counts[length] = n
    index = SumIndex(counts)
    taken = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    def use(lengths: tuple[int, ...], times: int) -> None:
        nonlocal n_sequences
        offset = 0
        for length, each in Counter(lengths).items():
            rows.append((length, int(taken[length]), n_sequences, each, offset))
            taken[length] += each * times
            counts[length] -= each * times
            offset += each * length
        n_sequences += times

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(counts[x]) // n for x, n in Counter(lengths).items())

    if counts[capacity]:
        use((capacity,), int(counts[capacity]))
    for fill_rest in rounds:
        for longest in range(capacity - 1, 0, -1):
            while counts[longest] > 0:
                lengths: tuple[int, ...] = (longest,)
                gap = capacity - longest
                with index.holding(longest):
                    rest = index.exact(gap)
                    if rest is None and fill_rest:
                        rest = _best_fit(index, gap)
                if rest is None:
                    break
                lengths += rest
                use(lengths, times(lengths))
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(columns[0] * Plan.RANKS + columns[1], columns[1], columns[2], columns[3], columns[4], n_sequences)


def _best_fit(index: SumIndex, gap: int) -> tuple[int, ...]:
    """The longest lengths that fit, one after another, or an exact combination as soon as one fits."""
    chosen: list[int] = []
    while gap > 0:
        with index.holding(*chosen):
            rest = index.exact(gap) if chosen else None
            if rest:
                return (*chosen, *rest)
            fits = np.flatnonzero(index.counts[1 : gap + 1] > 0)[::-1] + 1
            length = next((x for x in fits.tolist() if index.free(x) > 0), None)
        if length is None:
            break
        chosen.append(length)
        gap -= length
    return tuple(chosen)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset (long), placed in as few sequences as the plan finds.

    Lengths must be 1 to ``capacity``; a null or other length is an error. Rows may repeat; each is
    placed. Columns sequence_id and offset of ``pieces`` are replaced. The histogram (at most
    ``capacity`` rows) reaches the driver. Ranks within a length are dealt over groups of rows, so
    that a length which a third of all pieces have is not ranked in one task.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = stage_table(
        pieces.select(F.struct(*kept).alias("__piece"), F.col(length).cast("long").alias("__length"), F.monotonically_increasing_id().alias("__row")),
        "pieces",
    )
    histogram = {r["__length"]: r["n"] for r in numbered.groupBy("__length").agg(F.count("*").alias("n")).collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    plan = plan_packing(histogram, capacity)
    groups = max(LEAST_GROUPS, sum(histogram.values()) // GROUP_ROWS)
    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    before = Window.partitionBy("__length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("__length", "__group")
        .agg(F.count("*").alias("n"))
        .select("__length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("__length", "__group").orderBy("__row")
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(within) - 1)
        .join(starts, ["__length", "__group"])
        .withColumn("__rank", F.col("__rank") + F.col("__start"))
    )
    sent = pieces.sparkSession.sparkContext.broadcast(plan)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequence, offset = sent.value.place(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    found = ranked.select("__piece", placed("__length", "__rank").alias("__at"))
    return found.select("__piece.*", "__at.*")


def _little(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def token_pieces(path: str, text: str = "text", end: int = 0, capacity: int = CAPACITY) -> Column:
    """The pieces of each whole text: array of (start, length, ids_crc32) of its ids and ``end``.

    Only a text of more than ``capacity`` ids is cut, the last piece being the shorter one; null
    text counts as empty and so is one piece that holds ``end`` alone.
    """
    small_batches()
    last = _little([end])

    @F.arrow_udf("array<struct<start: long, length: long, ids_crc32: long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        table = worker_cache(("pieces", path), lambda: WordTable(path, SPACED, _little))
        offsets, start, length, crc = [0], [], [], []
        for parts in table.parts(texts.to_pylist()):
            ids = b"".join(parts) + last
            for at in range(0, len(ids), 4 * capacity):
                piece = ids[at : at + 4 * capacity]
                start.append(at // 4)
                length.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
            offsets.append(len(start))
        columns = [pa.array(x, pa.int64()) for x in (start, length, crc)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "ids_crc32"]))

    return pieces(F.col(text))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = docs.select(F.col(id_col), F.posexplode(token_pieces(path, text, capacity=capacity)).alias("piece", "p"))
    return pack(pieces.select(id_col, "piece", "p.start", "p.length", "p.ids_crc32"), capacity=capacity)

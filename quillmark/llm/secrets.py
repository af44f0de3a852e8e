"""Secret scans: spans by pattern, told apart by how many owners hold the same value.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import stage_table


def either_case(word: str) -> str:
    """``word`` with each ASCII letter in either case, alike in Java's and RE2's patterns."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the group that holds the value and the value's least length."""

    name: str
    pattern: str
    group: int
    least: int


_KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base kinds in the order in which they are listed. A failing match still uses up its text,
#: so the lengths are tested after matching where a shorter pattern could otherwise match later.
BASE_KINDS = (
    Kind("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates that count only if few owners hold them: long runs of mixed characters.
OWNED = Kind("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A value held by more owners than this is a widely copied example.
MAX_OWNERS = 2


#: Matches that are folded at a time, and letters of a text that are redacted at a time.
BLOCK, BLOCK_LETTERS = 64, 16_384


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``value``, which is evaluated once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """The array ``values`` in arrays of `BLOCK`, in order."""
    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, end, value's hash) of one kind; start and end in code points.

    The text between matches and the matches themselves alternate, so running sums of their
    lengths are the positions. An array that grows is copied at each step, so matches are folded
    block by block, each from the sum of the blocks before it.
    """
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, value: string>>)")
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda g, m: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")),
    )
    steps = F.filter(pairs, lambda x: x["m"].isNotNull())  # what follows the last match has none

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["n"]
        value = F.regexp_extract(x["m"], kind.pattern, kind.group)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.sha2(value, 256).alias("value"))
        passes = F.length(value) >= kind.least
        if kind is OWNED:
            for part in ("[a-z]", "[A-Z]", "[0-9]"):
                passes &= value.rlike(part)
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def fold(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def starts(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["g"] + x["n"]))
        return F.aggregate(widths, none, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    folded = _let(_let(steps, _blocks), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), fold)))
    return F.when(text.rlike(kind.pattern), folded).otherwise(empty)


def _outside(owned: Column, base: Column) -> Column:
    """The spans ``owned`` (by start) that overlap none of ``base``; a block of them looks only at
    the base spans that reach into it."""

    def near(block: Column) -> Column:
        first, last = block[0]["start"], F.element_at(block, -1)["end"]
        return F.struct(block.alias("own"), F.filter(base, lambda b: (b["start"] < last) & (first < b["end"])).alias("base"))

    def kept(x: Column) -> Column:
        return F.filter(x["own"], lambda o: ~F.exists(x["base"], lambda b: (o["start"] < b["end"]) & (b["start"] < o["end"])))

    held = F.flatten(F.transform(F.transform(_blocks(owned), near), kept))
    return F.when(F.size(owned) > 0, held).otherwise(owned)


def found_spans(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind; ``owned`` ones only outside base spans."""
    base = F.concat(*[_spans(text, kind, rank) for rank, kind in enumerate(BASE_KINDS)])
    both = F.struct(base.alias("base"), _spans(text, OWNED, len(BASE_KINDS)).alias("owned"))
    return _let(both, lambda x: F.array_sort(F.concat(x["base"], _outside(x["owned"], x["base"]))))


def scan(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``spans``, an array by start and kind.

    A span has start, rank (position in `BASE_KINDS`, one more for ``owned``), end, owners,
    repositories and live. Owners and repositories are the distinct ones in the whole corpus
    that hold the span's value; ``live`` says that at most ``max_owners`` do, otherwise the
    value is a widely copied example. Base spans are always returned, ``owned`` ones only if live.

    Null text counts as empty; a null owner or repository is one owner or repository of its own.
    Repeated rows each get their row. A column named spans in ``keep`` is replaced.
    Counting sums by (value, owner, repository) first, so a value that a third of all rows hold
    never meets in one task; the join back by value is between two written tables, whose
    skewed partitions Spark splits.
    """
    found = docs.select(
        F.struct(*[c for c in keep if c != "spans"]).alias("kept"),
        F.monotonically_increasing_id().alias("row"),
        F.struct(F.col(owner).alias("o")).alias("__owner"),
        F.struct(F.col(repository).alias("r")).alias("__repository"),
        found_spans(F.coalesce(F.col(text), F.lit(""))).alias("spans"),
    )
    found = stage_table(found, "spans")
    spotted = found.where(F.size("spans") > 0)
    each = spotted.select("row", "__owner", "__repository", F.explode("spans").alias("span"))
    by_owner = (
        each.groupBy(F.col("span.value").alias("value"), "__owner", "__repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "__owner")
        .agg(F.count("*").alias("n"))
    )
    held = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    held = stage_table(held, "held")
    told = (
        each.select("row", "span", F.col("span.value").alias("value"))
        .join(held, "value")
        .select("row", "span", "owners", "repositories", (F.col("owners") <= max_owners).alias("live"))
        .where(F.col("live") | (F.col("span.rank") < len(BASE_KINDS)))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("span.start", "span.rank", "span.end", "owners", "repositories", "live"))).alias("told"))
    )
    told = stage_table(told, "told")
    shape = dict(told.dtypes)["told"]
    nothing = F.expr(f"cast(array() as {shape})")
    with_spans = spotted.select("kept", "row").join(told, "row", "left").select("kept", F.coalesce("told", nothing).alias("spans"))
    without = found.where(F.size("spans") == 0).select("kept", nothing.alias("spans"))
    return with_spans.unionByName(without).select("kept.*", "spans")


def span_list(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping ``spans`` (by start) replaced by ``mark``.

    The text is taken in blocks, as finding a place in a text and adding to one take time in
    proportion to its length. A run's mark is in the block where it starts.
    """

    def step(acc: Column, s: Column, block: Column, first: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(block, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]), fresh).otherwise(acc["out"]).alias("out"),
        )

    def clean(block: Column, i: Column) -> Column:
        first = i * BLOCK_LETTERS
        # where the runs that start in earlier blocks end
        at = F.aggregate(spans, first, lambda acc, s: F.when(s["start"] < first, F.greatest(acc, s["end"])).otherwise(acc))
        own = F.filter(spans, lambda s: (s["start"] >= first) & (s["start"] < first + BLOCK_LETTERS))
        rest = lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] - first + 1, F.length(block)))
        return F.aggregate(own, F.struct(at.alias("at"), F.lit("").alias("out")), lambda acc, s: step(acc, s, block, first), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_LETTERS}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, clean), "")

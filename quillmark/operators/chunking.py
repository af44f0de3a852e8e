"""Prompt-sized chunks along sections, planned document by document."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.agent import canonical_body
from quillmark.schemas import CHUNKS

#: Digits of a chunk's number and count in a prompt.
COUNTER_DIGITS = 8
PLANNER = "section_runs_v1"


@dataclass(frozen=True)
class Block:
    block_id: str
    type: str
    text: str
    section_path: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    """``mode`` off: one chunk; force: always planned; auto: planned if the whole prompt is over the
    budget or there are ``min_blocks`` blocks."""

    mode: str = "auto"
    max_chars: int = 12_000
    overlap_blocks: int = 1
    min_blocks: int = 24


@dataclass(frozen=True)
class Part:
    context: tuple[Block, ...]
    overlap: tuple[Block, ...]
    new: tuple[Block, ...]

    @property
    def blocks(self) -> tuple[Block, ...]:
        return self.context + self.overlap + self.new


#: Gives the prompt of a part; number and count are null for an unplanned document.
Renderer = Callable[[Part, int | None, int | None], str]


def render(part: Part, number: int | None, count: int | None) -> str:
    """A plain prompt: a header of constant width and each block under its id, type and section."""
    head = "" if number is None else f"chunk {number:0{COUNTER_DIGITS}d} of {count:0{COUNTER_DIGITS}d}\n" + "".join(
        f"{name}: {', '.join(b.block_id for b in blocks)}\n" for name, blocks in (("new", part.new), ("overlap", part.overlap), ("context", part.context))
    )
    return head + "\n\n".join(f"[{b.block_id}]\ntype: {b.type}\nsection: {' > '.join(b.section_path)}\n{b.text}" for b in part.blocks)


def open_headings(blocks: list[Block], at: int) -> tuple[Block, ...]:
    """The last heading before ``at`` for each level of the section that the block there is in."""
    path = blocks[at].section_path
    if blocks[at].type == "heading":
        return ()
    last: dict[int, Block] = {}
    for b in blocks[:at]:
        n = len(b.section_path)
        if b.type == "heading" and n and b.section_path == path[:n]:
            last[n] = b
    return tuple(last[n] for n in sorted(last))


def plan(blocks: list[Block], config: Config, prompt: Renderer = render) -> list[tuple[Part, list[str]]]:
    """The parts of a document with their warnings; every block is new in exactly one part.

    Whole runs of one section are taken while the prompt fits. A run that does not fit an empty
    part is taken block by block; for that the overlap with the part before is given up first,
    oldest block first, then the context, outermost heading first. A block that still does not fit is a part of its own
    with a warning. An overlap of no blocks carries the whole part before, as far as it fits.
    """
    whole = Part((), (), tuple(blocks))
    size = len(prompt(whole, None, None))
    if config.mode == "off" or (config.mode == "auto" and size <= config.max_chars and len(blocks) < config.min_blocks):
        return [(whole, [] if size <= config.max_chars else ["CHUNK_PROMPT_OVER_BUDGET"])]
    parts: list[tuple[Part, list[str]]] = []
    at = 0
    while at < len(blocks):
        before = [b for b in parts[-1][0].new if b.type != "heading"] if parts else []
        part = Part(open_headings(blocks, at), tuple(before[-config.overlap_blocks :]), ())
        fits = lambda p: len(prompt(p, len(parts) + 1, 0)) <= config.max_chars
        while at < len(blocks):
            end = at + 1
            while end < len(blocks) and blocks[end].section_path == blocks[at].section_path:
                end += 1
            larger = Part(part.context, part.overlap, part.new + tuple(blocks[at:end]))
            if not fits(larger):
                break
            part, at = larger, end
        else:
            end = at
        if not part.new:
            part, at = _by_block(part, blocks, at, end, fits)
        parts.append((part, [] if fits(part) else ["CHUNK_OVERSIZED_BLOCK"]))
    return parts


def _by_block(part: Part, blocks: list[Block], at: int, end: int, fits: Callable[[Part], bool]) -> tuple[Part, int]:
    for block in blocks[at:end]:
        larger = Part(part.context, part.overlap, (*part.new, block))
        while larger.overlap and not fits(larger):
            larger = Part(larger.context, larger.overlap[1:], larger.new)
        while larger.context and not fits(larger):
            larger = Part(larger.context[1:], larger.overlap, larger.new)
        if fits(larger):
            part, at = larger, at + 1
            continue
        if not part.new:  # it fits nowhere
            part, at = larger, at + 1
        else:
            part = Part(larger.context, larger.overlap, part.new)
        break
    return part, at


def _fingerprint(part: Part, config: Config) -> str:
    ids = lambda blocks: [b.block_id for b in blocks]
    identity = {
        "blocks": ids(part.blocks), "new": ids(part.new), "overlap": ids(part.overlap), "context": ids(part.context),
        "texts": [" ".join(b.text.split()) for b in part.blocks], "section": part.new[0].section_path,
        "config": [PLANNER, COUNTER_DIGITS, config.mode, config.max_chars, config.overlap_blocks, config.min_blocks],
    }
    return hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def plan_chunks(blocks: DataFrame, config: Config = Config(), prompt: Renderer = render) -> DataFrame:
    """The chunks of every document; ``blocks``: document_id, block_id, order, type, text, section_path.

    The plan depends on rendered prompts, so a document is planned in one task; documents are
    independent and dealt by id.
    """
    names = [part.split()[0].strip("`") for part in CHUNKS.split(", ")]

    def planned(table: pa.Table) -> pa.Table:
        rows = table.sort_by("order").to_pylist()
        held = [Block(r["block_id"], r["type"], r["text"] or "", tuple(r["section_path"] or ())) for r in rows]
        if len({b.block_id for b in held}) < len(held) or len({r["order"] for r in rows}) < len(held):
            raise ValueError(f"blocks of {rows[0]['document_id']} repeat an id or an order")
        parts = plan(held, config, prompt)
        out = []
        for n, (part, warnings) in enumerate(parts, 1):
            text = prompt(part, n, len(parts)) if len(parts) > 1 else prompt(part, None, None)
            out.append(
                (
                    rows[0]["document_id"], f"chk_{n:08d}", n, list(part.new[0].section_path), *[[b.block_id for b in bs] for bs in (part.new, part.overlap, part.context)],
                    sum(len(b.text) for b in part.blocks), len(text), max(1, -(-len(text) // 4)), _fingerprint(part, config), warnings,
                )
            )
        strings = pa.list_(pa.string())
        kinds = [pa.string(), pa.string(), pa.int32(), strings, strings, strings, strings, pa.int64(), pa.int64(), pa.int64(), pa.string(), strings]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    used = blocks.select(F.col("document_id").cast("string").alias("document_id"), "block_id", "order", "type", "text", "section_path")
    return used.groupBy("document_id").applyInArrow(planned, CHUNKS)


def estimated_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long")


def chunk_bins(blocks: DataFrame, max_chars: int) -> DataFrame:
    """A plan without Python: blocks in bins of ``max_chars`` by the running length of the text before them."""
    w = Window.partitionBy("document_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    binned = blocks.withColumn("bin", F.floor(before / max_chars).cast("int"))
    return binned.groupBy("document_id", "bin").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("content_chars"), F.min("block_id").alias("first_block_id")
    ).withColumn("estimated_tokens", estimated_tokens(F.col("content_chars")))


def section_runs(blocks: DataFrame) -> DataFrame:
    """Consecutive blocks of one section: document_id, run, section_path, blocks, chars."""
    w = Window.partitionBy("document_id").orderBy("order")
    new = ~F.col("section_path").eqNullSafe(F.lag("section_path").over(w)) | F.lag("order").over(w).isNull()
    runs = blocks.withColumn("run", F.sum(new.cast("int")).over(w))
    return runs.groupBy("document_id", "run").agg(F.first("section_path").alias("section_path"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))



def request_fingerprint(adapter: Column, endpoint: Column, body: Column) -> Column:
    """Digest of a request: its adapter, endpoint and body, a JSON object, without secrets at any depth
    and whatever the order of its keys."""
    return F.sha2(F.to_json(F.struct(adapter.alias("adapter"), canonical_body(body).alias("body"), endpoint.alias("endpoint"))), 256)


def cell_maps(blocks: DataFrame, cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(document_id, block_id, prompt_text): table blocks as a prompt shows them, each row's cells with
    their ids, places and text.

    ``blocks``: document_id, block_id, section_path, text, table_id, first_row, last_row; ``cells``:
    table_id, cell_id, row, column, row_span, column_span, text; a cell stands in every row that it
    spans. ``headers``: block_id, cell_id and row of header rows shown again above a later block.
    """
    b = blocks.select("document_id", "block_id", "section_path", F.col("text").alias("block_text"), "table_id", "first_row", "last_row")
    spread = cells.withColumn("at", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
    shown = b.select("document_id", "block_id", "table_id", "first_row", "last_row").join(spread, "table_id").where("at between first_row and last_row").withColumn("place", F.lit("row"))
    if headers is not None:
        again = headers.select("block_id", "cell_id", F.col("row").alias("at")).distinct()
        above = b.select("document_id", "block_id", "table_id", "first_row", "last_row").join(again, "block_id").join(cells, ["table_id", "cell_id"]).withColumn("place", F.lit("repeated_header"))
        shown = shown.unionByName(above)
    one = F.concat(
        "cell_id", F.lit("(row="), F.col("row").cast("string"), F.lit(",column="), F.col("column").cast("string"), F.lit(",row_span="), F.col("row_span").cast("string"),
        F.lit(",column_span="), F.col("column_span").cast("string"), F.lit(",text="), F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(")"),
    )
    by_row = shown.groupBy("document_id", "block_id", "place", "at").agg(F.array_sort(F.collect_list(F.struct("column", "row", "cell_id", one.alias("one")))).alias("cs"))
    line = F.concat("place", F.lit(" "), F.col("at").cast("string"), F.lit(": "), F.array_join("cs.one", " | "))
    maps = by_row.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(F.struct((F.col("place") == "row").alias("primary"), "at", line.alias("line")))).alias("ls"))
    head = F.concat(
        F.lit("["), "block_id", F.lit("]\ntype: table\nsection_path: "), F.array_join("section_path", " > "), F.lit("\ntable_id: "), F.col("table_id").cast("string"), F.lit("\nprimary_rows: "),
        F.col("first_row").cast("string"), F.lit("-"), F.col("last_row").cast("string"), F.lit("\ncanonical_text: "), "block_text", F.lit("\ncell_map:\n"),
    )
    return b.join(maps, ["document_id", "block_id"]).select("document_id", "block_id", F.concat(head, F.array_join("ls.line", "\n")).alias("prompt_text"))

"""Loosely typed model items to typed candidates, with the first error of each item that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import strip

# Names that are accepted for each value of a field.
ALIASES = {
    "type": {
        "functional": "functional", "non_functional": "non_functional", "non-functional": "non_functional",
        "nonfunctional": "non_functional", "interface": "interface", "constraint": "constraint",
        "business": "business", "unknown": "unknown",
    },
    "ears_pattern": {
        "ubiquitous": "ubiquitous", "event_driven": "event_driven", "event-driven": "event_driven", "event": "event_driven",
        "state_driven": "state_driven", "state-driven": "state_driven", "state": "state_driven", "optional": "optional",
        "unwanted": "unwanted_behavior", "unwanted_behavior": "unwanted_behavior", "unwanted_behaviour": "unwanted_behavior",
        "unwanted-behavior": "unwanted_behavior", "unwanted-behaviour": "unwanted_behavior", "unknown": "unknown",
    },
    "priority": {"high": "high", "medium": "medium", "low": "low", "unknown": "unknown"},
    "verification_method": {
        "test": "test", "inspection": "inspection", "analysis": "analysis", "demonstration": "demonstration", "unknown": "unknown",
    },
}
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3, "unknown": 0.0}
CELL_ID = r"^cell_[0-9]{8}_r[0-9]{4}_c[0-9]{4}$"


def _key(raw: Column) -> Column:
    return F.replace(F.lower(strip(raw)), F.lit(" "), F.lit("_"))


def _raw(value: Column) -> Column:
    """The value as text; null and empty count as ``unknown``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def enum(value: Column, field: str) -> Column:
    """The value by its alias, ``unknown`` if there is none."""
    return F.coalesce(_lookup(ALIASES[field], _key(_raw(value))), F.lit("unknown"))


def confidence(value: Column) -> Column:
    """A number as it is, a word by its weight, else 0."""
    return F.coalesce(value.try_cast("double"), _lookup(CONFIDENCE_WORDS, _key(_raw(value))), F.lit(0.0))


def confidence_change(value: Column) -> Column:
    """What is logged for a confidence: nothing for numbers, the weight of a word, else ``unknown``."""
    number = value.try_cast("double")
    word = _lookup(CONFIDENCE_WORDS, _key(_raw(value)))
    return F.when(number.isNull(), F.coalesce(word.cast("string"), F.lit("unknown")))


def source_quote(quote: Column, block_type: Column) -> Column:
    """Trimmed; outside tables without a leading list mark and, of a piped row, the last cell."""
    bare = strip(quote)
    item = F.when(F.startswith(bare, F.lit("- ")), strip(F.substr(bare, F.lit(3)))).otherwise(bare)
    inner = F.regexp_replace(item, r"^\|+|\|+$", "")
    cell = F.when(F.startswith(item, F.lit("|")) & F.endswith(item, F.lit("|")), strip(F.element_at(F.split(inner, r"\|"), -1))).otherwise(item)
    return F.when(F.coalesce(block_type, F.lit("")) == "table", bare).otherwise(cell)


def changes(fields: dict[str, tuple[Column, Column]], confidence_value: Column, confidence_log: Column | None = None) -> Column:
    """Array of (field, input, normalized) for every field whose value is not what was given."""
    kind = "struct<field: string, input: string, normalized: string>"

    def entry(name: str, given: Column, made: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), given.alias("input"), made.alias("normalized")).cast(kind)

    listed = [F.when(given != made, entry(name, given, made)) for name, (given, made) in fields.items()]
    changed = confidence_change(confidence_value) if confidence_log is None else confidence_log
    listed.insert(0, F.when(changed.isNotNull(), entry("confidence", _raw(confidence_value), changed)))
    return F.array_compact(F.array(*listed))


class Field:
    """A field of a model item, a variant: JSON types decide, so that ``"2"`` is not 2 nor true 1."""

    def __init__(self, item: Column | str, name: str):
        self.value = F.try_variant_get(item, f"$.{name}", "variant")
        self.kind = F.schema_of_variant(self.value)
        self.missing = self.value.isNull()
        self.given = ~F.coalesce(self.kind == "VOID", F.lit(True))
        self.is_text = F.coalesce(self.kind == "STRING", F.lit(False))
        self.is_flag = F.coalesce(self.kind == "BOOLEAN", F.lit(False))
        self.is_list = F.coalesce(F.startswith(self.kind, F.lit("ARRAY")), F.lit(False))
        self.is_number = F.coalesce(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
        self.is_whole = F.coalesce(self.kind == "BIGINT", F.lit(False))
        self.text = _shown(self.value, self.kind)
        self.number = F.try_variant_get(self.value, "$", "double")

    @property
    def says(self) -> Column:
        """Not missing, null, empty, zero or false."""
        empty = F.coalesce(F.to_json(self.value).isin("null", '""', "false", "[]", "{}"), F.lit(True))
        return ~empty & ~(self.is_number & (self.number == 0))

    def members(self) -> Column:
        return F.try_variant_get(self.value, "$", "array<variant>")


def _shown(value: Column, kind: Column) -> Column:
    """The value as text; true and false with a capital."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def explode_items(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per item of a chunk's JSON payload; a payload that is no object with an array ``items``
    gives one row with the error of the whole chunk."""
    parsed = chunks.withColumn("__v", F.try_parse_json(F.col(payload)))
    items = F.try_variant_get("__v", "$.items", "array<variant>")
    is_object = F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    error = F.when(~F.coalesce(is_object, F.lit(False)), "MODEL_PAYLOAD_NOT_OBJECT").when(items.isNull(), "MODEL_PAYLOAD_ITEMS_MISSING")
    rows = parsed.select(*chunks.columns, error.alias("chunk_error"), F.posexplode_outer(items).alias("item_index", "__item"))
    rows = rows.where(F.col("item_index").isNotNull() | F.col("chunk_error").isNotNull())
    object_item = F.startswith(F.schema_of_variant("__item"), F.lit("OBJECT"))
    return rows.select(
        *chunks.columns, "chunk_error", "item_index", F.to_json("__item").alias("raw_item"), F.coalesce(object_item, F.lit(False)).alias("is_object"),
        F.col("__item").alias("item"),
    )


def coerce_items(items: DataFrame, blocks: DataFrame, context: DataFrame, table_blocks: DataFrame) -> DataFrame:
    """Typed candidates with ``error_code`` (null for those that are accepted).

    ``items``: document_id, chunk_id, item_index, is_object, item (a variant). ``context``: the blocks
    (document_id, chunk_id, block_id) that a chunk shows as context only. ``table_blocks``: blocks
    (document_id, block_id) whose sources must name cells. The code is that of the first check that
    fails; an item's siblings are not affected.
    """
    need = table_blocks.select("document_id", "block_id", F.lit(True).alias("needs_cells")).distinct()
    known = blocks.select("document_id", "block_id", F.col("type").alias("b_type"), "section_path", "page").join(need, ["document_id", "block_id"], "full").withColumnRenamed("block_id", "b_id")
    ctx = context.select("document_id", "chunk_id", F.col("block_id").alias("b_id"), F.lit(True).alias("is_context")).distinct()
    f = {n: Field("item", n) for n in ("title", "statement", "subject", "condition", "response", "source_block_id", "source_quote", "source_cell_ids", "source_table_row_index", "confidence", "tags", *ALIASES)}
    block, quoted, cell, row, sure, tag = (f[n] for n in ("source_block_id", "source_quote", "source_cell_ids", "source_table_row_index", "confidence", "tags"))
    rows = items.withColumn("b_id", block.text).join(known, ["document_id", "b_id"], "left").join(ctx, ["document_id", "chunk_id", "b_id"], "left")
    texts = cell.is_list & F.coalesce(F.forall(cell.members(), lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False))), F.lit(False))
    cells = F.when(texts, F.try_variant_get(cell.value, "$", "array<string>"))
    row_index = F.when(row.is_whole, F.try_variant_get(row.value, "$", "int"))
    has_cells, has_row = F.coalesce(F.size(cells) > 0, F.lit(False)), row.given
    bad_cells = cell.given & F.coalesce(cells.isNull() | (F.size(F.array_distinct(cells)) < F.size(cells)) | ~F.forall(cells, lambda c: c.rlike(CELL_ID)), F.lit(True))
    in_context = F.coalesce("is_context", F.lit(False))
    evidence = has_cells | has_row
    bad_text = F.lit(False)
    for name in ("title", "subject", "condition", "response"):
        bad_text |= f[name].given & ~f[name].is_text
    code = (
        F.when(~F.col("is_object"), "MODEL_ITEM_NOT_OBJECT")
        .when(~f["statement"].says | ~block.says | ~quoted.says, "MODEL_ITEM_MISSING_FIELD")
        .when(in_context & (cell.given | has_row), "MODEL_ITEM_CONTEXT_CELL_REFERENCE")
        .when(in_context, "MODEL_ITEM_INVALID")
        .when(bad_cells, "MODEL_ITEM_INVALID_CELL_IDS")
        .when(has_row & F.coalesce(row_index < 1, F.lit(True)), "MODEL_ITEM_INVALID_TABLE_ROW_INDEX")
        .when(evidence & F.col("b_type").isNull(), "MODEL_ITEM_INVALID_CELL_IDS")
        .when(evidence & (F.col("b_type") != "table"), "MODEL_ITEM_NON_TABLE_WITH_CELL_IDS")
        .when(has_cells & ~has_row, "MODEL_ITEM_TABLE_SOURCE_MISSING_ROW_INDEX")
        .when(has_row & ~has_cells, "MODEL_ITEM_TABLE_ROW_WITHOUT_CELL_IDS")
        .when(F.coalesce("needs_cells", F.lit(False)) & ~has_cells, "MODEL_ITEM_TABLE_SOURCE_MISSING_CELL_IDS")
        .when(bad_text, "MODEL_ITEM_SCHEMA_INVALID")
    )
    said = {n: F.when(f[n].says, f[n].text) for n in ALIASES}
    enums = {n: (_raw(said[n]), enum(said[n], n)) for n in ALIASES}
    quote = source_quote(quoted.text, F.col("b_type"))
    # numbers, flags and a missing confidence are taken as they are and logged nowhere
    number = F.when(sure.is_number | sure.is_flag, sure.number).when(sure.missing, F.lit(0.0))
    word = F.when(sure.says, sure.text)
    logged = changes({**enums, "source_quote": (quoted.text, quote)}, word, F.when(number.isNull(), confidence_change(word)))
    none = F.expr("cast(array() as array<string>)")
    named = F.transform(tag.members(), lambda t: F.coalesce(_shown(t, F.schema_of_variant(t)), F.lit("None")))
    tags = F.when(~tag.given, none).when(tag.is_list, named).otherwise(F.array(tag.text))
    return rows.select(
        "document_id", "chunk_id", "item_index", code.alias("error_code"), f["title"].text.alias("title"),
        *[made.alias(n) for n, (_, made) in enums.items()],
        *[f[n].text.alias(n) for n in ("statement", "subject", "condition", "response")],
        F.coalesce(number, confidence(word)).alias("confidence"), tags.alias("tags"), logged.alias("normalizations"),
        F.when(F.exists(logged, lambda x: x["normalized"] == "unknown"), "needs_recheck").otherwise("pending").alias("review_status"),
        F.struct(block.text.alias("block_id"), quote.alias("quote"), F.array_join("section_path", " > ").alias("section"), F.col("page"),
                 F.coalesce(cells, none).alias("cell_ids"), row_index.alias("row_index")).alias("source"),
    )


def reject_unprepared(candidates: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared, rejected): candidates with their cells in canonical order, and those whose cells
    break a rule, with error_code and error.

    ``candidates`` and ``selections`` share source_key; ``selections``: error, cell_ids as
    `tables.canonical_selection` gives them. A candidate without a selection cites no cells.
    """
    found = selections.select("source_key", F.col("error").alias("selection_error"), F.col("cell_ids").alias("canonical_cell_ids"))
    joined = candidates.join(found, "source_key", "left")
    none = F.expr("cast(array() as array<string>)")
    prepared = joined.where("selection_error is null").withColumn("canonical_cell_ids", F.coalesce("canonical_cell_ids", none)).drop("selection_error")
    code = F.when(F.contains("selection_error", F.lit("ROW")), "MODEL_ITEM_INVALID_TABLE_ROW_INDEX").otherwise("MODEL_ITEM_INVALID_CELL_IDS")
    rejected = joined.where("selection_error is not null").withColumn("error_code", code).withColumnRenamed("selection_error", "error").drop("canonical_cell_ids")
    return prepared, rejected


def normalized_requirements(df: DataFrame) -> DataFrame:
    """Statements without white space at their ends; an empty pattern or method is ``unknown``."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return df.withColumns({"statement": strip(F.col("statement")), "ears_pattern": known("ears_pattern"), "verification_method": known("verification_method")})


def items_of_chunks(items: DataFrame, chunk_blocks: DataFrame) -> DataFrame:
    """Fixture items (source_block_id) that each chunk would give: those that cite one of its blocks
    (document_id, chunk_id, block_id)."""
    held = chunk_blocks.select("document_id", "chunk_id", F.col("block_id").alias("source_block_id")).distinct()
    return held.join(items, ["document_id", "source_block_id"])

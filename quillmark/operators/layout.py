"""Page layout from extracted spans and lines: paragraphs, headings, repeated edges, continued tables.

Bytes of PDF files are not read here: no extractor is available, so spans are an input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import collapse_space

# Fixed values.
GAP_FLOOR, GAP_SHARE = 4.0, 0.6
FONT_FLOOR, FONT_SHARE = 2.0, 0.2
HEADING_RATIO, HEADING_POINTS, HEADING_CHARS = 1.15, 1.0, 160
SPACE_FLOOR, SPACE_SHARE = 0.75, 0.12
EDGE_PAGES, EDGE_SHARE, EDGE_DRIFT = 3, 0.5, 0.01
TOP_EDGE, BOTTOM_EDGE, TABLE_EDGE, TABLE_DRIFT = 0.08, 0.92, 0.08, 0.005


def paragraphs(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Lines (top, bottom, font_size, text) joined to paragraphs: a new one begins at a wide vertical
    gap or a change of the font size."""
    w = Window.partitionBy(*by).orderBy(order)
    height = F.col("bottom") - F.col("top")
    gap = F.col("top") - F.lag("bottom").over(w)
    tallest = F.greatest(height, F.lag(height).over(w))
    font = F.abs(F.col("font_size") - F.lag("font_size").over(w))
    smaller = F.least("font_size", F.lag("font_size").over(w))
    new = (gap > F.greatest(F.lit(GAP_FLOOR), GAP_SHARE * tallest)) | (font >= F.greatest(F.lit(FONT_FLOOR), FONT_SHARE * smaller))
    island = lines.withColumn("paragraph", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    out = island.groupBy(*by, "paragraph").agg(
        F.array_sort(F.collect_list(F.struct(order, "text"))).alias("ls"), F.max("font_size").alias("font_size"), F.count("*").alias("lines"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"),
    )
    return out.withColumn("text", F.array_join("ls.text", "\n")).drop("ls")


def joined_spans(spans: DataFrame, by: list[str], order: str) -> DataFrame:
    """Spans (x0, x1, font_size, text) of a line as text, with a space where the gap is wide enough."""
    w = Window.partitionBy(*by).orderBy(order)
    wide = (F.col("x0") - F.lag("x1").over(w)) > F.greatest(F.lit(SPACE_FLOOR), SPACE_SHARE * F.col("font_size"))
    spaced = F.endswith(F.lag("text").over(w), F.lit(" ")) | F.startswith("text", F.lit(" "))
    piece = F.when(F.coalesce(wide & ~spaced, F.lit(False)), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    pieces = spans.select(*by, F.struct(order, piece.alias("piece")).alias("p"))
    return pieces.groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*by, F.array_join("ps.piece", "").alias("text"))


def headings(blocks: DataFrame, by: list[str]) -> DataFrame:
    """``blocks`` (font_size, lines, text, bold) with heading: ``font`` for a size well above the
    median of its document, ``bold`` for a candidate, null otherwise; and level by size."""
    median = blocks.groupBy(*by).agg(F.median("font_size").alias("median_size"))
    joined = blocks.join(median, by)
    single = (F.col("lines") == 1) & (F.length("text") <= HEADING_CHARS)
    large = (F.col("font_size") >= HEADING_RATIO * F.col("median_size")) & (F.col("font_size") - F.col("median_size") >= HEADING_POINTS)
    told = joined.withColumn("heading", F.when(single & large, "font").when(single & F.col("bold"), "bold"))
    number = F.regexp_extract("text", r"^([0-9]+(?:\.[0-9]+)*)[.)]?\s", 1)
    by_size = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(F.when(F.col("heading") == "font", F.round("font_size", 1)))))
    level = F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).otherwise(F.least(F.lit(6), by_size))
    return told.withColumn("level", F.when(F.col("heading").isNotNull(), level))


def repeated_edges(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts at the top or bottom edge of at least three and half of a document's pages, in the same
    place: document_id, role, text, pages. They are named, not removed.

    ``lines``: document_id, page, text, x0, y0, x1, y1 (shares of the page); ``pages``:
    document_id, pages.
    """
    role = F.when(F.col("y0") <= TOP_EDGE, "header").when(F.col("y1") >= BOTTOM_EDGE, "footer")
    edge = lines.withColumn("role", role).where("role is not null").withColumn("key", F.lower(collapse_space(F.col("text"))))
    drift = [F.max(c) - F.min(c) <= EDGE_DRIFT for c in ("x0", "y0", "x1", "y1")]
    grouped = edge.groupBy("document_id", "role", "key").agg(F.count_distinct("page").alias("n"), F.min("text").alias("text"), (drift[0] & drift[1] & drift[2] & drift[3]).alias("still"))
    joined = grouped.where("still").join(pages, "document_id")
    kept = joined.where((F.col("n") >= EDGE_PAGES) & (F.col("n") >= EDGE_SHARE * F.col("pages")))
    return kept.select("document_id", "role", "text", F.col("n").alias("pages"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """Pairs of tables on adjacent pages that are one: document_id, page, table_id, next_table_id.

    ``tables``: document_id, page, table_id, y0, y1 (shares), label, header (array of struct<text,
    x0, x1>). Exactly one table ends at the page's bottom and one begins at the next one's top; the
    label is the same but for ``(continued)`` and the header cells agree in text and place.
    """
    base = F.lower(F.trim(F.regexp_replace("label", r"(?i)\s*\((continued|cont\.?)\)\s*$", "")))
    t = tables.withColumns({"base": base, "marked": F.col("label").rlike(r"(?i)\((continued|cont\.?)\)\s*$")})
    alone = lambda name: F.count("*").over(Window.partitionBy("document_id", "page")).alias(name)
    ends = t.where(F.col("y1") >= 1 - TABLE_EDGE).select("*", alone("n")).where("n = 1")
    starts = t.where(F.col("y0") <= TABLE_EDGE).select("*", alone("n")).where("n = 1")
    a, b = ends.alias("a"), starts.alias("b")
    joined = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("b.page") == F.col("a.page") + 1) & (F.col("a.base") == F.col("b.base")))
    near = lambda x, y: F.abs(x - y) <= TABLE_DRIFT
    same = F.zip_with("a.header", "b.header", lambda x, y: F.coalesce((x["text"] == y["text"]) & near(x["x0"], y["x0"]) & near(x["x1"], y["x1"]), F.lit(False)))
    kept = joined.where(F.col("b.marked") & F.forall(same, lambda ok: ok) & (F.col("a.table_id") != F.col("b.table_id")))
    return kept.select(F.col("a.document_id").alias("document_id"), F.col("a.page").alias("page"), F.col("a.table_id").alias("table_id"), F.col("b.table_id").alias("next_table_id"))


def text_in_rejected_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks that lie in a table which was not accepted: four fifths of their area, or their
    centre, within its box. Both: document_id, page and a box (x0, y0, x1, y1)."""
    b = blocks.alias("b").join(tables.alias("t"), ["document_id", "page"])
    wide = F.greatest(F.lit(0.0), F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0"))
    high = F.greatest(F.lit(0.0), F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0"))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    mid_x, mid_y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    centred = mid_x.between(F.col("t.x0"), F.col("t.x1")) & mid_y.between(F.col("t.y0"), F.col("t.y1"))
    return b.where((wide * high >= 0.8 * area) | centred).select("document_id", "page", "b.block_id", "t.table_id")

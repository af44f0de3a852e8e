"""Requirements as source maps, flat rows and workbooks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The columns of the flat export.
HEADERS = (
    "ID", "Title", "Type", "EARS Pattern", "Statement", "Subject", "Condition", "Response", "Priority", "Verification Method",
    "Confidence", "Review Status", "Source Section", "Source Block ID", "Source Quote", "Source Match Status", "Tags",
)


def source_map(requirements: DataFrame, id_col: str, sources: str, fields: list[str]) -> DataFrame:
    """A row per requirement and source, numbered from 0."""
    rows = requirements.select(id_col, F.posexplode(sources).alias("source_index", "s"))
    return rows.select(id_col, "source_index", *[F.col(f"s.{f}").alias(f) for f in fields])


def flat_rows(requirements: DataFrame) -> DataFrame:
    """The 17 columns of the export; the first source stands for all, tags are joined."""
    first = F.try_element_at("sources", F.lit(1))
    plain = ("id", "title", "type", "ears_pattern", "statement", "subject", "condition", "response", "priority", "verification_method", "confidence", "review_status")
    of_source = ("section", "block_id", "quote", "match_status")
    columns = [F.col(c) for c in plain] + [first[c] for c in of_source] + [F.array_join("tags", ", ")]
    return requirements.select(*[c.alias(h) for c, h in zip(columns, HEADERS)])


def workbook_bytes(rows: list[list]) -> bytes:
    """An .xlsx file of one sheet with a bold, frozen header row."""

    def cell(value, at: str, style: int) -> str:
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    def letter(n: int) -> str:
        return letter(n // 26 - 1) + chr(65 + n % 26) if n >= 26 else chr(65 + n)

    body = "".join(
        f'<row r="{r}">' + "".join(cell(v, f"{letter(c)}{r}", 1 if r == 1 else 0) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Requirements" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def workbooks(flat: DataFrame, document: str) -> DataFrame:
    """(document, xlsx) with a workbook of each document's flat rows, by ID."""
    columns = [c for c in flat.columns if c != document]

    def made(table: pa.Table) -> pa.Table:
        rows = table.sort_by(columns[0])
        body = [list(r) for r in zip(*(rows.column(c).to_pylist() for c in columns))]
        return pa.table({document: pa.array([rows.column(document)[0].as_py()], rows.schema.field(document).type), "xlsx": [workbook_bytes([columns, *body])]})

    return flat.groupBy(document).applyInArrow(made, f"{document} {dict(flat.dtypes)[document]}, xlsx binary")


def highlight(text: Column, start: Column, end: Column) -> Column:
    """The text before, in and after a range of code points."""
    return F.struct(
        F.substr(text, F.lit(1), start).alias("before"), F.substr(text, start + 1, end - start).alias("marked"), F.substr(text, end + 1).alias("after")
    )


def status_list(sources: Column) -> Column:
    """The match statuses of a requirement's sources, ``UNVERIFIED`` without any."""
    return F.when(F.size(sources) > 0, F.array_join(F.transform(sources, lambda s: s["match_status"]), ", ")).otherwise("UNVERIFIED")


def selection_identities(source: Column) -> Column:
    """What a source may be known by, best first: its key, its canonical cells, the cells as given, its
    table row, its range, its quote. ``source``: source_key, document_id, block_id, quote,
    canonical_cell_ids, cell_ids, row_index, start, end; any may be null."""
    base = [source[c].alias(c) for c in ("document_id", "block_id", "quote")]
    some = lambda c: F.coalesce(F.size(source[c]) > 0, F.lit(False))
    made = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("kind"), *base, *more))
    return F.array_compact(
        F.array(
            F.nullif(source["source_key"], F.lit("")),
            F.when(some("canonical_cell_ids"), made("canonical_cells", source["canonical_cell_ids"].alias("cells"))),
            F.when(some("cell_ids"), made("cells", source["cell_ids"].alias("cells"))),
            F.when(source["row_index"].isNotNull(), made("row", source["row_index"].alias("row"))),
            F.when(source["start"].isNotNull(), made("range", source["start"].alias("start"), source["end"].alias("end"))),
            made("quote"),
        )
    )


def selections(sources: DataFrame, by: list[str], order: str, source: str = "source") -> DataFrame:
    """(by, order, identity, occurrence): the best identity of each source, and how many earlier sources
    of the same key are known by it too, as their best identity or a lesser one."""
    named = sources.select(*by, order, selection_identities(F.col(source)).alias("ids"))
    known = named.select(*by, order, F.element_at("ids", 1).alias("best"), F.explode(F.array_distinct("ids")).alias("identity"))
    w = Window.partitionBy(*by, "identity").orderBy(order)
    counted = known.withColumn("occurrence", (F.row_number().over(w) - 1).cast("long"))
    return counted.where("identity = best").select(*by, order, "identity", "occurrence")

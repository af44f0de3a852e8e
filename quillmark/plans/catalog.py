"""Every registered query of the engine over the driver's tables, with the SQL that checks it.

The tables stand in for the engine's relations: each line of a document is a block, benchmark
passages are quotes, orders and lineitems are tables and cells, events and conversations are logs.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import geometry, rates, text
from quillmark.operators import agent, chunking, evaluate, evidence, export, items, layout, merge, migrate, quotes, reading, review, tables, validate
from quillmark.sources import artifacts, blocks
from quillmark.sources.tables import read_table as table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Documents as blocks ---------------------------------------------------------------------------

_BLOCKS_SQL = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT doc_id AS document_id, line AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS "order"
      FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '')
"""


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {_BLOCKS_SQL}
SELECT document_id, 'blk_' || CASE WHEN "order" < 10000 THEN lpad("order"::VARCHAR, 4, '0') ELSE "order"::VARCHAR END AS block_id,
       "order"::INTEGER AS "order", 'paragraph' AS type, text FROM b""")
def line_blocks(spark, sf_dir):
    return doc_blocks(spark, sf_dir)


_MD_SQL = """
m AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
x AS (SELECT k, unnest([{'n': 1, 't': 'heading', 'l': 1, 'x': 'Order ' || k}, {'n': 2, 't': 'paragraph', 'l': NULL, 'x': 'Status ' || s || chr(10) || 'Priority ' || p}, {'n': 3, 't': 'heading', 'l': 2, 'x': 'Lines'},
  {'n': 4, 't': 'list', 'l': NULL, 'x': '- a' || chr(10) || '2) b'}, {'n': 5, 't': 'blockquote', 'l': NULL, 'x': '> ' || s}, {'n': 6, 't': 'code', 'l': NULL, 'x': '```' || chr(10) || '# ' || p || chr(10) || '```'},
  {'n': 7, 't': 'table', 'l': NULL, 'x': '| ' || k || ' | b |'}, {'n': 8, 't': 'heading', 'l': 1, 'x': 'End'}]) AS b FROM m)
"""


@query(f"""WITH {_MD_SQL} SELECT k::VARCHAR AS document_id, 'blk_000' || b.n AS block_id, b.n::INTEGER AS "order", b.t AS type, b.x AS text, b.l::INTEGER AS level,
CASE WHEN b.n = 8 THEN 'End' WHEN b.n < 3 THEN 'Order ' || k ELSE 'Order ' || k || ' > Lines' END AS section FROM x""")
def md_blocks(spark, sf_dir):
    """Orders as Markdown with every kind of block, through the Markdown parser."""
    k, st, pr = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    parts = [F.lit("# Order "), k, F.lit("\n\nStatus "), st, F.lit("\nPriority "), pr, F.lit("\n## Lines\n- a\n2) b\n> "), st, F.lit("\n```\n# "), pr, F.lit("\n```\n| "), k, F.lit(" | b |\n\n# End\n")]
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*parts).alias("md"))
    found = blocks.parse(made, "o_orderkey", "md", "markdown")
    return found.select("document_id", "block_id", "order", "type", "text", "level", F.array_join("section_path", " > ").alias("section"))


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOCX file per customer: a heading and a table under a header row, of up to 45 rows; some are no files at all."""

    @F.arrow_udf("binary")
    def made(keys: pa.Array) -> pa.Array:
        def one(k: int) -> bytes:
            if k % 11 == 0:
                return b"no archive"
            w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
            head = "<w:tr><w:trPr><w:tblHeader/></w:trPr>" + cell("a") + cell("b") + "</w:tr>"
            rows = "".join("<w:tr>" + (cell(f"{k}-{r}", '<w:gridSpan w:val="2"/>') if r % 7 == 0 else cell(f"x{r}") + cell(f"p|{r}")) + "</w:tr>" for r in range(1, k % 45 + 1))
            body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Customer {k}</w:t></w:r></w:p><w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>{head}{rows}</w:tbl>'
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
                z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
            return out.getvalue()

        return pa.array([one(k) for k in keys.to_pylist()], pa.binary())

    return table(spark, sf_dir, "customer").select("c_custkey", made("c_custkey").alias("docx"))


@query(r"""WITH r AS (SELECT c_custkey AS k, unnest(range(0, c_custkey % 45 + 1)) AS r FROM customer WHERE c_custkey % 11 <> 0),
t AS (SELECT k, r, r // 20 AS g, CASE WHEN r = 0 THEN 'a | b' WHEN r % 7 = 0 THEN k || '-' || r || ' | ' || k || '-' || r ELSE 'x' || r || ' | p\|' || r END AS x FROM r)
SELECT k::VARCHAR AS document_id, (g + 2)::INTEGER AS "order", 'table' AS type, CASE WHEN g > 0 THEN 'a | b' || chr(10) ELSE '' END || string_agg(x, chr(10) ORDER BY r) AS text FROM t GROUP BY k, g UNION ALL
SELECT c_custkey::VARCHAR, 1, 'heading', 'Customer ' || c_custkey FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey::VARCHAR, 0, 'unreadable', 'BadZipFile: File is not a zip file' FROM customer WHERE c_custkey % 11 = 0""")
def docx_blocks(spark, sf_dir):
    """Row groups of twenty with the header again, merged cells in every column, and files that cannot be read."""
    return blocks.parse(docx_files(spark, sf_dir), "c_custkey", "docx", "docx").select("document_id", "order", "type", "text")


@query(f"""WITH {_BLOCKS_SQL}
SELECT document_id, count(*) AS block_count, sum(length(text))::BIGINT AS rendered_text_chars,
       CASE WHEN sum(length(text)) + 40 * count(*) >= 4000 THEN 'LARGE_DOCUMENT' ELSE '' END
       || CASE WHEN sum(length(text)) + 40 * count(*) >= 16000 THEN ',VERY_LARGE_DOCUMENT' ELSE '' END AS flags FROM b GROUP BY ALL""")
def doc_profile_flags(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    rows = doc_blocks(spark, sf_dir).withColumns({"section_path": none, "expected": F.array(F.lit("text_range")), "available": F.array(F.lit("text_range"))})
    found = agent.profile(rows, prompt_overhead=40)
    return found.select("document_id", "block_count", "rendered_text_chars", F.array_join("complexity_flags", ",").alias("flags"))


@query()
def html_sections(spark, sf_dir):
    """Blocks of every page with the open headings of each."""
    return blocks.parse(table(spark, sf_dir, "pages"), "page_id", "html", "html")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks: returned ones are headings of level 1, accepted ones of level 2."""
    level = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2)
    return numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("document_id"), F.col("line").alias("order"), F.concat("l_linestatus", F.col("l_partkey").cast("string")).alias("text"), level.alias("level"))


_OUTLINE_SQL = """
o AS (SELECT l_orderkey AS d, l_linestatus || l_partkey AS x, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
h AS (SELECT *, max(CASE WHEN f = 'R' THEN n END) OVER (PARTITION BY d ORDER BY n) AS h1, max(CASE WHEN f = 'A' THEN n END) OVER (PARTITION BY d ORDER BY n) AS h2 FROM o),
s AS (SELECT h.d, h.n, h.x, concat_ws(' > ', a.x, b.x) AS section FROM h LEFT JOIN o a ON a.d = h.d AND a.n = h.h1 LEFT JOIN o b ON b.d = h.d AND b.n = h.h2 AND h.h2 > coalesce(h.h1, 0))
"""


@query(f"WITH {_OUTLINE_SQL} SELECT d AS document_id, n AS \"order\", section FROM s")
def section_path_running(spark, sf_dir):
    """The open headings of every line, from windows alone."""
    return blocks.section_paths(outline(spark, sf_dir)).select("document_id", "order", F.array_join("section_path", " > ").alias("section"))


@query()
def render_markdown(spark, sf_dir):
    return blocks.render_markdown(blocks.parse(table(spark, sf_dir, "pages"), "page_id", "html", "html"))


@query(f"""WITH {_BLOCKS_SQL},
r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT document_id, floor(before / 2000)::INTEGER AS bin, count(*) AS blocks, sum(length(text))::BIGINT AS content_chars,
       min('blk_' || lpad("order"::VARCHAR, 4, '0')) AS first_block_id, greatest(1, ceil(sum(length(text)) / 4))::BIGINT AS estimated_tokens
FROM r GROUP BY document_id, floor(before / 2000)""")
def chunk_bins(spark, sf_dir):
    return chunking.chunk_bins(doc_blocks(spark, sf_dir), 2000)


@query()
def chunk_plan(spark, sf_dir):
    parsed = blocks.parse(table(spark, sf_dir, "pages"), "page_id", "html", "html")
    return chunking.plan_chunks(parsed, chunking.Config(mode="force", max_chars=2200, overlap_blocks=2))


@query(f"""WITH {_OUTLINE_SQL}, c AS (SELECT *, CASE WHEN section = lag(section) OVER (PARTITION BY d ORDER BY n) THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY d ORDER BY n) AS run FROM c)
SELECT d AS document_id, run::BIGINT AS run, section, count(*) AS blocks, sum(length(x))::BIGINT AS chars FROM r GROUP BY d, run, section""")
def section_runs(spark, sf_dir):
    found = chunking.section_runs(blocks.section_paths(outline(spark, sf_dir)))
    return found.select("document_id", "run", F.array_join("section_path", " > ").alias("section"), "blocks", "chars")


# Quotes ----------------------------------------------------------------------------------------

_RANGES_SQL = """
pairs AS (SELECT d.doc_id, q.item_id, d.text AS t, q.text AS q FROM documents d JOIN benchmark q ON contains(d.text, q.text) AND length(q.text) > 0),
ranges AS (SELECT doc_id, item_id, list_transform(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q),
                  lambda i: {'start': (i - 1)::INTEGER, 'end': (i - 1 + length(q))::INTEGER}) AS r FROM pairs)
"""


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quotes.exact_matches(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))


@query(f"""WITH {_RANGES_SQL}
SELECT doc_id, item_id, len(r)::INTEGER AS n, r[1].start AS first_start, r[len(r)]."end" AS last_end,
       CASE WHEN len(r) = 1 THEN 'UNIQUE_MATCH' ELSE 'AMBIGUOUS_MATCH' END AS status, CASE WHEN len(r) = 1 THEN r[1].start END AS selected_start FROM ranges""")
def quote_exact_ranges(spark, sf_dir):
    return quoted(spark, sf_dir).select(
        "doc_id", "item_id", F.size("ranges").alias("n"), F.element_at("ranges", 1)["start"].alias("first_start"),
        F.element_at("ranges", -1)["end"].alias("last_end"), "status", F.col("selected.start").alias("selected_start"),
    )


@query("""SELECT p_partkey, w AS quote, unnest(list_filter(range(1, length(p_name) - length(w) + 2), lambda i: substr(p_name, i, length(w)) = w)) - 1 AS start
FROM part, (VALUES ('a'), ('e'), ('re'), ('aa'), (' ')) AS q(w) WHERE contains(p_name, w)""")
def quote_overlapping_ranges(spark, sf_dir):
    wanted = spark.createDataFrame([("a",), ("e",), ("re",), ("aa",), (" ",)], "quote string")
    found = quotes.exact_matches(table(spark, sf_dir, "part"), wanted, "p_name")
    return found.select("p_partkey", "quote", F.explode("ranges").alias("r")).select("p_partkey", "quote", F.col("r.start").cast("long").alias("start"))


@query(f"""WITH {_RANGES_SQL}
SELECT d.lang, count(DISTINCT d.doc_id) AS documents, count(DISTINCT CASE WHEN r IS NOT NULL THEN d.doc_id END) AS grounded,
       count(r) AS quotes, count(CASE WHEN len(r) > 1 THEN 1 END) AS ambiguous, coalesce(sum(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE END), 0.0::DOUBLE) AS score
FROM documents d LEFT JOIN ranges USING (doc_id) GROUP BY d.lang""")
def grounding_status(spark, sf_dir):
    """Per language: documents, those that quote a benchmark passage, and how."""
    found = quoted(spark, sf_dir)
    status = quotes.quote_status(F.col("status"), F.lit("exact"), F.col("ranges"), F.lit(1.0), F.lit(True))
    hits = found.select(F.col("doc_id").alias("hit"), status.alias("grounding"), "status")
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(hits, F.col("doc_id") == F.col("hit"), "left")
    return joined.groupBy("lang").agg(
        F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("grounding") == "PASS_EXACT", F.col("doc_id"))).alias("grounded"),
        F.count("hit").alias("quotes"), F.count_if(F.col("status") == "AMBIGUOUS_MATCH").alias("ambiguous"),
        F.coalesce(F.sum(F.when(F.col("grounding") == "PASS_EXACT", 1.0)), F.lit(0.0)).alias("score"),
    )


_SOURCE_JSON = """'{"block_id":"blk_0001","canonical_cell_ids":[],"document_id":"' || doc_id || '","evidence_fingerprint":"f","quote":' || to_json(q)::VARCHAR || '}'"""


@query(f"WITH {_RANGES_SQL} SELECT doc_id, item_id, 'src_' || substr(sha256({_SOURCE_JSON}), 1, 24) AS source_key FROM pairs")
def source_keys(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    key = text.source_key(F.lit("f"), F.col("doc_id").cast("string"), F.lit("blk_0001"), F.col("quote"), none, F.lit(None).cast("int"))
    return quoted(spark, sf_dir).select("doc_id", "item_id", key.alias("source_key"))


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources that cite every line of each document, as it is, with other spaces, or changed."""
    own = doc_blocks(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    key = F.concat_ws("-", "document_id", "block_id", "kind")
    kinds = F.explode(
        F.array(
            F.struct(F.lit("as_is").alias("kind"), F.col("text").alias("quote")),
            F.struct(F.lit("spaced").alias("kind"), F.replace("text", F.lit(" "), F.lit(" \t")).alias("quote")),
            F.struct(F.lit("changed").alias("kind"), F.concat("text", F.lit(" #")).alias("quote")),
        )
    )
    sources = own.select("document_id", "block_id", kinds.alias("k")).select("document_id", "block_id", "k.kind", "k.quote").withColumn("source_key", key)
    return sources, own


@query(f"""WITH {_BLOCKS_SQL}, f AS (SELECT document_id::VARCHAR || '-blk_' || CASE WHEN "order" < 10000 THEN lpad("order"::VARCHAR, 4, '0') ELSE "order"::VARCHAR END || '-' AS k, text AS t, length(text) - length(ltrim(text)) AS a, length(rtrim(text)) AS e, contains(text, ' ') AS s FROM b)
SELECT k || 'as_is' AS source_key, 'UNIQUE_MATCH' AS status, 'exact' AS basis, 1.0::DOUBLE AS score, 0 AS start, length(t)::INTEGER AS "end" FROM f UNION ALL
SELECT k || 'spaced', 'UNIQUE_MATCH', CASE WHEN s THEN 'normalized' ELSE 'exact' END, CASE WHEN s THEN 0.95 ELSE 1.0 END::DOUBLE, a::INTEGER, e::INTEGER FROM f""")
def quote_normalized_ranges(spark, sf_dir):
    """All lines cited as they are and with other spaces: the ranges are those of the original."""
    sources, own = cited(spark, sf_dir)
    found = quotes.match_registry(sources.where("kind <> 'changed'"), own)
    return found.select("source_key", "status", "basis", "score", F.col("selected.start").alias("start"), F.col("selected.end").alias("end"))


@query()
def quote_registry(spark, sf_dir):
    """Exact, normalised and fuzzy matches of all cited lines, each source matched once."""
    sources, own = cited(spark, sf_dir)
    found = quotes.match_registry(sources, own)
    status = quotes.quote_status(F.col("status"), F.col("basis"), F.col("ranges"), F.col("score"), F.lit(True))
    return found.select("source_key", "status", "basis", "score", F.col("selected.start").alias("start"), F.col("selected.end").alias("end"), status.alias("grounding"))


_NORMAL = r"""trim(regexp_replace(regexp_replace(translate(text, '，。：；（）！？、“”‘’', ',.:;()!?,""'''''), '\s*\|\s*', '|', 'g'), '\s+', ' ', 'g'))"""


@query(f"""WITH {_BLOCKS_SQL} SELECT document_id, 'blk_' || CASE WHEN "order" < 10000 THEN lpad("order"::VARCHAR, 4, '0') ELSE "order"::VARCHAR END AS block_id, {_NORMAL} AS normalized FROM b""")
def quote_normalized(spark, sf_dir):
    return doc_blocks(spark, sf_dir).select("document_id", "block_id", text.normalized("text").alias("normalized"))


@query(f"""WITH {_RANGES_SQL}
SELECT doc_id, item_id, substr(t, greatest(1, r[1].start - 9), least(10, r[1].start)) AS before_end, substr(t, r[1].start + 1, length(q)) = q AS marked_is_quote,
       length(substr(t, r[1]."end" + 1)) AS after_chars FROM ranges JOIN pairs USING (doc_id, item_id)""")
def text_highlight(spark, sf_dir):
    found = quoted(spark, sf_dir)
    first = F.element_at("ranges", 1)
    cut = found.withColumn("h", export.highlight(F.col("text"), first["start"], first["end"]))
    tail = F.when(F.length("h.before") > 10, F.substr("h.before", F.length("h.before") - 9)).otherwise(F.col("h.before"))
    return cut.select("doc_id", "item_id", tail.alias("before_end"), (F.col("h.marked") == F.col("quote")).alias("marked_is_quote"), F.length("h.after").cast("long").alias("after_chars"))


@query(f"""WITH {_RANGES_SQL} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS occurrence FROM ranges""")
def selection_ordinals(spark, sf_dir):
    w = Window.partitionBy("item_id").orderBy("doc_id")
    return quoted(spark, sf_dir).select("item_id", "doc_id", F.row_number().over(w).cast("long").alias("occurrence"))


@query("""WITH s AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag AS q, l_linestatus AS k FROM lineitem),
b AS (SELECT *, CASE WHEN k = 'F' THEN 'src_' || q ELSE '{"kind":"row","document_id":"' || d || '","block_id":"b","quote":"' || q || '","row":1}' END AS best, '{"kind":"row","document_id":"' || d || '","block_id":"b","quote":"' || q || '","row":1}' AS lesser FROM s)
SELECT a.d AS document_id, a.n AS line, a.best AS identity, count(e.n) AS occurrence FROM b a LEFT JOIN b e ON e.d = a.d AND e.n < a.n AND (e.best = a.best OR e.lesser = a.best) GROUP BY a.d, a.n, a.best""")
def source_selections(spark, sf_dir):
    """Lines of an order as sources, some with a key: the how-manieth of its identity each is."""
    li = numbered_lines(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    source = F.struct(
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("src_"), "l_returnflag")).alias("source_key"), F.col("l_orderkey").cast("string").alias("document_id"), F.lit("b").alias("block_id"), F.col("l_returnflag").alias("quote"),
        none.alias("canonical_cell_ids"), none.alias("cell_ids"), F.lit(1).alias("row_index"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )
    return export.selections(li.select(F.col("l_orderkey").alias("document_id"), "line", source.alias("source")), ["document_id"], "line")


# Items -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN lower(substr(o_orderpriority, 3)) IN ('high', 'low', 'medium') THEN lower(substr(o_orderpriority, 3)) ELSE 'unknown' END AS priority,
CASE o_orderstatus WHEN 'F' THEN 'non_functional' WHEN 'O' THEN 'functional' ELSE 'unknown' END AS type FROM orders""")
def enum_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    given = F.when(F.col("o_orderstatus") == "F", " Non Functional ").when(F.col("o_orderstatus") == "O", "FUNCTIONAL").otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", items.enum(F.substr("o_orderpriority", F.lit(3)), "priority").alias("priority"), items.enum(given, "type").alias("type"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN 0.9 WHEN 'error' THEN 0.3 ELSE 0.0 END AS confidence,
CASE event_type WHEN 'view' THEN '0.9' WHEN 'error' THEN '0.3' WHEN 'click' THEN NULL ELSE 'unknown' END AS logged FROM events""")
def confidence_normalize(spark, sf_dir):
    given = F.when(F.col("event_type") == "click", F.col("value").cast("string")).when(F.col("event_type") == "view", "High").when(F.col("event_type") == "error", " low").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", items.confidence(given).alias("confidence"), items.confidence_change(given).alias("logged"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model items: their properties decide what is missing or cited."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 8
    item = F.struct(
        F.when(k != 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("statement"),
        F.concat(F.lit("blk_"), (F.col("event_id") % 5).cast("string")).alias("source_block_id"),
        F.when(k == 1, "- quoted ").when(k == 2, "| a | b |").otherwise(F.lit(" plain ")).alias("source_quote"),
        F.when(k == 3, F.array(F.lit("cell_00000001_r0001_c0001"))).when(k == 4, F.array(F.lit("cell_1"))).alias("source_cell_ids"),
        F.when((k == 3) & (F.col("event_id") % 16 == 3), 1).alias("source_table_row_index"),
        F.col("event_type").alias("type"), F.col("value").alias("confidence"), F.array("event_type").alias("tags"),
    )
    payload = F.when(k == 5, F.lit("[1]")).when(k == 6, F.lit('{"items": 3}')).otherwise(F.to_json(F.struct(F.array(item).alias("items"))))
    chunks = e.select(F.lit("d").alias("document_id"), F.col("event_id").cast("string").alias("chunk_id"), payload.alias("payload"))
    found = items.explode_items(chunks)
    known = spark.createDataFrame([("d", f"blk_{i}", "table" if i == 3 else "paragraph", ["A", "B"], i) for i in range(4)], "document_id string, block_id string, type string, section_path array<string>, page int")
    context = e.where("event_id % 7 = 0").select(F.lit("d").alias("document_id"), F.col("event_id").cast("string").alias("chunk_id"), F.lit("blk_0").alias("block_id"))
    need = spark.createDataFrame([("d", "blk_3")], "document_id string, block_id string")
    good = items.coerce_items(found.where("chunk_error is null"), known, context, need)
    bad = found.where("chunk_error is not null").select("chunk_id", F.col("chunk_error").alias("error_code"))
    return good.unionByName(bad, allowMissingColumns=True)


_ITEM_SQL = """
WITH e AS (SELECT *, event_id % 8 AS k, event_id % 5 AS b FROM events),
c AS (SELECT *, CASE WHEN k = 5 THEN 'MODEL_PAYLOAD_NOT_OBJECT' WHEN k = 6 THEN 'MODEL_PAYLOAD_ITEMS_MISSING' WHEN k = 0 THEN 'MODEL_ITEM_MISSING_FIELD'
  WHEN event_id % 7 = 0 AND b = 0 AND k IN (3, 4) THEN 'MODEL_ITEM_CONTEXT_CELL_REFERENCE' WHEN event_id % 7 = 0 AND b = 0 THEN 'MODEL_ITEM_INVALID'
  WHEN k = 4 THEN 'MODEL_ITEM_INVALID_CELL_IDS' WHEN k = 3 AND b = 4 THEN 'MODEL_ITEM_INVALID_CELL_IDS' WHEN k = 3 AND b <> 3 THEN 'MODEL_ITEM_NON_TABLE_WITH_CELL_IDS'
  WHEN k = 3 AND event_id % 16 <> 3 THEN 'MODEL_ITEM_TABLE_SOURCE_MISSING_ROW_INDEX' WHEN b = 3 AND k <> 3 THEN 'MODEL_ITEM_TABLE_SOURCE_MISSING_CELL_IDS' END AS error_code FROM e)
"""


@query(f"{_ITEM_SQL} SELECT error_code, count(*) AS items FROM c WHERE error_code IS NOT NULL GROUP BY error_code")
def items_rejected(spark, sf_dir):
    return coerced(spark, sf_dir).where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("items"))


@query(f"""{_ITEM_SQL} SELECT event_id::VARCHAR AS chunk_id, 'User ' || user_id AS statement, 'unknown' AS type,
CASE WHEN k = 1 THEN 'quoted' WHEN k = 2 AND b <> 3 THEN 'b' WHEN k = 2 THEN '| a | b |' ELSE 'plain' END AS quote, value AS confidence, event_type AS tags,
'needs_recheck' AS review_status, CASE WHEN b < 4 THEN 'A > B' END AS section FROM c WHERE error_code IS NULL""")
def items_coerced(spark, sf_dir):
    kept = coerced(spark, sf_dir).where("error_code is null")
    return kept.select("chunk_id", "statement", "type", F.col("source.quote").alias("quote"), "confidence", F.array_join("tags", ",").alias("tags"), "review_status", F.col("source.section").alias("section"))


#: Fields of an item, the code that it gets, its confidence and what is logged of it.
_TYPED = (
    ('"statement": 0', "MODEL_ITEM_MISSING_FIELD", 0.0, None), ('"statement": []', "MODEL_ITEM_MISSING_FIELD", 0.0, None), ('"statement": 5', None, 0.0, None),
    ('"statement": "s", "source_cell_ids": ["cell_00000001_r0001_c0001"], "source_table_row_index": "2"', "MODEL_ITEM_INVALID_TABLE_ROW_INDEX", 0.0, None),
    ('"statement": "s", "source_cell_ids": ["cell_00000001_r0001_c0001"], "source_table_row_index": 2.0', "MODEL_ITEM_INVALID_TABLE_ROW_INDEX", 0.0, None),
    ('"statement": "s", "source_cell_ids": ["cell_00000001_r0001_c0001"], "source_table_row_index": true', "MODEL_ITEM_INVALID_TABLE_ROW_INDEX", 0.0, None),
    ('"statement": "s", "source_cell_ids": ["cell_00000001_r0001_c0001"], "source_table_row_index": 2', "MODEL_ITEM_NON_TABLE_WITH_CELL_IDS", 0.0, None),
    ('"statement": "s", "source_cell_ids": [1]', "MODEL_ITEM_INVALID_CELL_IDS", 0.0, None), ('"statement": "s", "source_cell_ids": "cell_00000001_r0001_c0001"', "MODEL_ITEM_INVALID_CELL_IDS", 0.0, None),
    ('"statement": "s", "title": 5', "MODEL_ITEM_SCHEMA_INVALID", 0.0, None), ('"statement": "s", "confidence": true', None, 1.0, None), ('"statement": "s", "confidence": null', None, 0.0, "0.0"),
    ('"statement": "s", "confidence": "0.25"', None, 0.25, None), ('"statement": "s", "confidence": [1]', None, 0.0, "unknown"), ('"statement": "s", "confidence": 0.5, "tags": ["a", 1]', None, 0.5, None),
)


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({n}, {'NULL' if c is None else repr(c)}, {x}::DOUBLE, {'NULL' if g is None else repr(g)})" for n, (_, c, x, g) in enumerate(_TYPED))}) AS v(k, error_code, confidence, logged))
SELECT event_id::VARCHAR AS chunk_id, error_code, confidence, logged, CASE WHEN k = 2 THEN '5' ELSE 's' END AS statement, CASE WHEN k = 14 THEN 'a,1' ELSE '' END AS tags FROM events JOIN t ON event_id % {len(_TYPED)} = k WHERE k > 1""")
def items_typed(spark, sf_dir):
    """Items whose JSON types decide: numbers in quotes, flags, lists and nulls are not what they look like."""
    e = table(spark, sf_dir, "events")
    picked = F.element_at(F.array(*[F.lit(t[0]) for t in _TYPED]), (F.col("event_id") % len(_TYPED) + 1).cast("int"))
    payload = F.concat(F.lit('{"items": [{"source_block_id": "b", "source_quote": "q", '), picked, F.lit("}]}"))
    found = items.explode_items(e.select(F.lit("d").alias("document_id"), F.col("event_id").cast("string").alias("chunk_id"), payload.alias("payload")))
    known = spark.createDataFrame([("d", "b", "paragraph", ["A"], 1)], "document_id string, block_id string, type string, section_path array<string>, page int")
    none = spark.createDataFrame([], "document_id string, chunk_id string, block_id string")
    made = items.coerce_items(found, known, none, none.drop("chunk_id"))
    logged = F.get(F.transform(F.filter("normalizations", lambda x: x["field"] == "confidence"), lambda x: x["normalized"]), F.lit(0))
    return made.where(F.col("chunk_id").cast("long") % len(_TYPED) > 1).select("chunk_id", "error_code", "confidence", logged.alias("logged"), "statement", F.array_join("tags", ",").alias("tags"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'braced' END AS kind FROM events""")
def response_parse(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, '{"kind": "whole"}')
        .when(k == 1, 'Here:\n```json\n{"kind": "fenced"}\n```\n{"kind": 0}')
        .when(k == 2, 'I say {"kind": "braced"} now')
        .otherwise('["an array"]')
    )
    got = table(spark, sf_dir, "events").withColumn("v", artifacts.response_object(raw))
    return got.select("event_id", F.try_variant_get("v", "$.kind", "string").alias("kind"))


# Merging ---------------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as candidates: an order's lines of one part are variants of one requirement."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 2000).alias("document_id"), (F.col("l_partkey") % 50).alias("key"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("local_id"),
        F.concat(F.lit("chk_"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag")).alias("type"),
        F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise(F.col("l_linestatus")).alias("priority"), F.col("l_discount").alias("confidence"),
        F.array("l_returnflag", "l_linestatus").alias("tags"), F.lit("pending").alias("review_status"),
    )


_MERGE_SQL = """
c AS (SELECT l_orderkey % 2000 AS document_id, l_partkey % 50 AS key, l_orderkey || '-' || l_linenumber AS local_id, 'chk_' || l_linenumber AS chunk_id,
  CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END AS type, CASE WHEN l_linestatus <> 'O' THEN l_linestatus END AS priority, l_discount, l_returnflag, l_linestatus FROM lineitem),
g AS (SELECT document_id, key, min(local_id) AS first_id, count(*) AS variants, max(l_discount) AS confidence,
  array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), ',') AS tags, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunks,
  coalesce(list(DISTINCT type) FILTER (type <> 'unknown'), []) AS types, arg_min(type, local_id || '/' || type) AS first_type, coalesce(list(DISTINCT priority) FILTER (priority IS NOT NULL), []) AS priorities FROM c GROUP BY document_id, key)
"""


@query(f"""WITH {_MERGE_SQL} SELECT document_id, key, first_id AS local_id, variants, confidence, tags, chunks,
CASE WHEN first_type <> 'unknown' THEN first_type WHEN len(types) = 1 THEN types[1] ELSE first_type END AS type,
CASE WHEN len(types) > 1 OR len(priorities) > 1 THEN 'needs_recheck' ELSE 'pending' END AS review_status FROM g""")
def candidate_merge(spark, sf_dir):
    merged = merge.merge_candidates(candidates(spark, sf_dir), ["document_id", "key"], [F.concat_ws("/", "local_id", "type")], ("type", "priority"))
    return merged.select("document_id", "key", "local_id", "variants", "confidence", F.array_join("tags", ",").alias("tags"), F.array_join("source_chunk_ids", ",").alias("chunks"), "type", "review_status")


@query(f"""WITH {_MERGE_SQL} SELECT document_id, count(*) AS requirements, sum(variants - 1)::BIGINT AS collapsed,
sum((len(types) > 1)::INTEGER + (len(priorities) > 1)::INTEGER)::BIGINT AS field_conflicts FROM g GROUP BY document_id""")
def field_conflicts(spark, sf_dir):
    merged = merge.merge_candidates(candidates(spark, sf_dir), ["document_id", "key"], [F.concat_ws("/", "local_id", "type")], ("type", "priority"))
    return merged.groupBy("document_id").agg(F.count("*").alias("requirements"), F.sum(F.col("variants") - 1).alias("collapsed"), F.sum(F.size("field_conflicts")).alias("field_conflicts"))


@query("""SELECT document_id, n AS numbered, 'REQ-' || lpad(n::VARCHAR, 4, '0') AS id, local_id FROM (
SELECT document_id, local_id, row_number() OVER (PARTITION BY document_id ORDER BY local_id, key) AS n FROM (
SELECT l_orderkey % 2000 AS document_id, l_partkey % 50 AS key, min(l_orderkey || '-' || l_linenumber) AS local_id FROM lineitem GROUP BY ALL))""")
def requirement_ids(spark, sf_dir):
    merged = merge.merge_candidates(candidates(spark, sf_dir), ["document_id", "key"], [F.concat_ws("/", "local_id", "type")], ("type", "priority"))
    numbered = merge.number_requirements(merged, "document_id", "key")
    return numbered.select("document_id", F.substr("id", F.lit(5)).cast("long").alias("numbered"), "id", "local_id")


@query("""WITH r AS (SELECT lang AS document_id, 'REQ-' || doc_id AS id, md5(text) AS s, source AS i FROM documents),
a AS (SELECT document_id, 'normalized_statement_equal' AS reason, list_sort(list(DISTINCT id)) AS m FROM r GROUP BY document_id, s),
b AS (SELECT document_id, 'same_source_divergent_statement' AS reason, list_sort(list(DISTINCT id)) AS m FROM r GROUP BY document_id, i HAVING count(DISTINCT s) > 1)
SELECT DISTINCT document_id, reason, array_to_string(m, ',') AS members FROM (FROM a UNION ALL FROM b) WHERE len(m) > 1""")
def duplicate_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("document_id"), F.concat(F.lit("REQ-"), F.col("doc_id").cast("string")).alias("id"), F.md5(F.col("text").cast("binary")).alias("statement_key"), F.array("source").alias("source_identities"))
    return merge.duplicate_groups(rows).select("document_id", "reason", F.array_join("members", ",").alias("members"))


@query("""WITH r AS (SELECT coalesce(lang, '') AS document_id, 'REQ-' || doc_id AS id, doc_id AS o, md5(text) AS s, source AS i FROM documents),
k AS (SELECT document_id, 1 AS rank, s AS key, id, s, o FROM r UNION ALL SELECT document_id, 2, i, id, s, o FROM r WHERE i IS NOT NULL),
g AS (SELECT document_id, rank, key, list_sort(list(DISTINCT id)) AS m, count(DISTINCT s) AS n, min(o) AS o FROM k GROUP BY ALL HAVING count(DISTINCT id) > 1 AND (rank = 1 OR count(DISTINCT s) > 1)),
f AS (SELECT document_id, rank, m, min(o) AS o FROM g GROUP BY ALL), n AS (SELECT *, 'DUP-' || lpad((row_number() OVER (PARTITION BY document_id ORDER BY rank, o))::VARCHAR, 4, '0') AS group_id FROM f)
SELECT document_id, group_id, CASE rank WHEN 1 THEN 'normalized_statement_equal' ELSE 'same_source_divergent_statement' END AS reason, unnest(m) AS id FROM n""")
def duplicate_members(spark, sf_dir):
    """Documents of a language as requirements of one document: every member of each numbered group."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.coalesce("lang", F.lit("")).alias("document_id"), F.concat(F.lit("REQ-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("order"), F.md5(F.col("text").cast("binary")).alias("statement_key"), F.array_compact(F.array("source")).alias("source_identities"))
    return merge.duplicate_members(rows)


# Validation ------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'SCHEMA_ID_EMPTY,' ELSE '' END || CASE WHEN event_id % 4 = 1 THEN 'SCHEMA_STATEMENT_EMPTY,' ELSE '' END
|| CASE WHEN event_id % 5 = 0 THEN 'SCHEMA_SOURCES_EMPTY,' ELSE '' END || CASE WHEN value < 0 OR value > 1 THEN 'SCHEMA_CONFIDENCE_RANGE,' ELSE '' END AS codes, event_id % 3 AS warnings FROM events""")
def schema_issues(spark, sf_dir):
    e = F.col("event_id")
    found = validate.schema_issues(F.when(e % 9 == 0, " ").otherwise("id"), F.when(e % 4 == 1, "\t\n").otherwise("s"), (e % 5).cast("int"), F.col("value"), (e % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("i"))
    errors = F.transform(F.filter("i", lambda x: x["level"] == "error"), lambda x: F.concat(x["code"], F.lit(",")))
    return rows.select("event_id", F.array_join(errors, "").alias("codes"), F.size(F.filter("i", lambda x: x["level"] == "warning")).cast("long").alias("warnings"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND NOT (contains(text, 'when') OR contains(text, 'WHEN') OR contains(text, '当') OR contains(text, '时') OR contains(text, '后'))
THEN 'EARS_EVENT_TRIGGER_MISSING' ELSE '' END AS codes FROM documents""")
def ears_issues(spark, sf_dir):
    pattern = F.when(F.col("lang") == "en", "event_driven").otherwise("ubiquitous")
    found = validate.ears_issues(pattern, F.lit(""), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("codes"))


@query("""SELECT lang, count(*) AS documents, count(CASE WHEN NOT coalesce(quality = 1, false) OR NOT coalesce(toxic = 0, false) THEN 1 END) AS quarantined
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def quarantine_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = validate.quarantine(rows, F.col("quality") == 1, F.col("toxic") == 0)
    return split.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("quarantined").alias("quarantined"))


@query("""WITH r AS (SELECT user_id, count(*) AS items, count(CASE WHEN event_type <> 'error' THEN 1 END) AS accepted, count(CASE WHEN event_type = 'error' THEN 1 END) AS rejected,
count(CASE WHEN event_type = 'purchase' THEN 1 END) AS validated, count(CASE WHEN event_type = 'click' THEN 1 END) AS quarantined, count(CASE WHEN event_type = 'signup' THEN 1 END) AS failed
FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN accepted = 0 AND items > 0 AND rejected = items THEN 'failed' WHEN accepted = 0 OR (validated = 0 AND quarantined > 0) OR failed > 0 OR rejected > 0 OR quarantined > 0
  THEN 'completed_with_warnings' ELSE 'completed' END AS status,
CASE WHEN accepted = 0 AND rejected = items THEN NULL WHEN accepted = 0 AND failed > 0 THEN 'PARTIAL_EXECUTION_EMPTY_RESULT' WHEN accepted = 0 THEN 'NO_REQUIREMENTS_FOUND'
  WHEN validated = 0 AND quarantined > 0 THEN 'ALL_CANDIDATES_QUARANTINED' END AS zero_result_reason,
CASE WHEN accepted = 0 AND items > 0 AND rejected = items THEN '' ELSE array_to_string(list_filter([
  CASE WHEN accepted > 0 AND validated = 0 AND quarantined > 0 THEN 'ALL_CANDIDATES_QUARANTINED' END, CASE WHEN failed > 0 THEN 'PARTIAL_CHUNK_FAILURE' END,
  CASE WHEN rejected > 0 THEN 'MODEL_ITEMS_REJECTED' END, CASE WHEN quarantined > 0 THEN 'CANDIDATES_QUARANTINED' END], lambda x: x IS NOT NULL), ',') END AS codes FROM r""")
def run_manifest_counts(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("event_type") != "error").alias("accepted"), n("error").alias("rejected"), n("purchase").alias("validated"),
        n("click").alias("quarantined"), n("signup").alias("chunk_errors"),
    )
    zero = F.lit(0)
    counts = {c: F.col(c) for c in counted.columns} | dict.fromkeys(("locator_warnings", "field_conflicts", "over_budget", "oversized"), zero)
    out = counted.withColumns(validate.run_outcome(counts))
    return out.select("user_id", "status", "zero_result_reason", F.array_join("warning_codes", ",").alias("codes"))


_STATUSES = ("PASS", "UNVERIFIED", "WARNING_UNAVAILABLE", "WARNING_AMBIGUOUS", "FAIL_DERIVATION", "FAIL_INVALID_REFERENCE")
_MATRIX_SQL = f"""
m AS (SELECT p.policy, a.a AS text_status, b.b AS cell_status, v.v AS cell_available FROM
  (VALUES ('quote_only'), ('structured_if_available'), ('structured_required')) AS p(policy), (VALUES {", ".join(f"('{s}')" for s in _STATUSES)}) AS a(a),
  (VALUES {", ".join(f"('{s}')" for s in _STATUSES)}) AS b(b), (VALUES (true), (false)) AS v(v))
"""


def matrix(spark: SparkSession) -> DataFrame:
    """All combinations of a policy with the results of a text and a cell capability."""
    rows = [(p, a, b, v) for p in validate.POLICIES for a in _STATUSES for b in _STATUSES for v in (True, False)]
    made = spark.createDataFrame(rows, "policy string, text_status string, cell_status string, cell_available boolean")
    both = F.array(F.lit("text_range"), F.lit("table_cell"))
    return made.withColumns(
        {
            "expected": both, "available": F.when(F.col("cell_available"), both).otherwise(F.array(F.lit("text_range"))),
            "results": F.create_map(F.lit("text_range"), "text_status", F.lit("table_cell"), "cell_status"),
        }
    )


@query(f"""WITH {_MATRIX_SQL} SELECT policy, text_status, cell_status, cell_available,
CASE policy WHEN 'quote_only' THEN true WHEN 'structured_if_available' THEN NOT (starts_with(text_status, 'FAIL') OR (cell_available AND starts_with(cell_status, 'FAIL')))
  ELSE text_status = 'PASS' AND cell_status = 'PASS' END AS passes,
CASE policy WHEN 'quote_only' THEN false WHEN 'structured_required' THEN cell_status <> 'PASS' ELSE cell_available AND starts_with(cell_status, 'FAIL') END AS cell_blocks FROM m""")
def policy_matrix(spark, sf_dir):
    rows = matrix(spark)
    passes = validate.passes_policy(F.col("policy"), F.lit(True), F.col("expected"), F.col("available"), F.col("results"))
    blocked = validate.blocks_policy(F.col("policy"), F.lit(True), F.lit("table_cell"), F.col("available"), F.col("cell_status"))
    return rows.select("policy", "text_status", "cell_status", "cell_available", passes.alias("passes"), blocked.alias("cell_blocks"))


@query(f"""WITH {_MATRIX_SQL} SELECT DISTINCT text_status, cell_status, CASE WHEN 'FAIL_INVALID_REFERENCE' IN (text_status, cell_status) THEN 'FAIL_INVALID_REFERENCE'
WHEN 'FAIL_DERIVATION' IN (text_status, cell_status) THEN 'FAIL_DERIVATION' WHEN 'WARNING_AMBIGUOUS' IN (text_status, cell_status) THEN 'WARNING_AMBIGUOUS'
WHEN 'WARNING_UNAVAILABLE' IN (text_status, cell_status) THEN 'WARNING_UNAVAILABLE' WHEN text_status = 'PASS' AND cell_status = 'PASS' THEN 'PASS_STRUCTURED' ELSE 'UNVERIFIED' END AS locator_status FROM m""")
def locator_status(spark, sf_dir):
    rows = matrix(spark).select("text_status", "cell_status", "expected", "results").dropDuplicates(["text_status", "cell_status"])
    return rows.select("text_status", "cell_status", evidence.locator_status(F.col("expected"), F.col("results")).alias("locator_status"))


# Evaluation ------------------------------------------------------------------------------------

_PRF_SQL = """
c AS (SELECT source, count(CASE WHEN d.n_chars > 1000 THEN 1 END) AS candidates, count(CASE WHEN l.quality = 1 THEN 1 END) AS gold,
  count(CASE WHEN d.n_chars > 1000 AND l.quality = 1 THEN 1 END) AS matched FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source),
m AS (SELECT *, CASE WHEN candidates > 0 THEN matched / candidates WHEN gold > 0 THEN 0.0 ELSE 1.0 END AS precision, CASE WHEN gold > 0 THEN matched / gold ELSE 1.0 END AS recall FROM c),
p AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
"""


@query(f"WITH {_PRF_SQL} SELECT source, candidates, gold, matched, precision, recall, f1 FROM p")
def eval_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long, good = F.col("n_chars") > 1000, F.coalesce(F.col("quality") == 1, F.lit(False))
    counted = rows.groupBy("source").agg(F.count_if(long).alias("candidates"), F.count_if(good).alias("gold"), F.count_if(long & good).alias("matched"))
    return counted.withColumns(rates.precision_recall_f1(F.col("matched"), F.col("candidates"), F.col("gold")))


@query(f"""WITH {_PRF_SQL}, v AS (SELECT avg(precision) AS precision, avg(recall) AS recall, max(f1) AS f1 FROM p)
SELECT t.name, t.lim::DOUBLE AS "limit", t.value, coalesce(CASE WHEN ends_with(t.name, '_min') THEN t.value >= t.lim ELSE t.value <= t.lim END, false) AS passed FROM (
SELECT 'precision_min' AS name, 0.5 AS lim, precision AS value FROM v UNION ALL SELECT 'recall_min', 0.9, recall FROM v UNION ALL SELECT 'f1_max', 0.99, f1 FROM v
UNION ALL SELECT 'unknown_min', 0.1, NULL) t""")
def threshold_gate(spark, sf_dir):
    m = eval_prf(spark, sf_dir).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.max("f1").alias("f1"))
    long = m.unpivot([], ["precision", "recall", "f1"], "metric", "value")
    limits = spark.createDataFrame([("precision_min", 0.5), ("recall_min", 0.9), ("f1_max", 0.99), ("unknown_min", 0.1)], "name string, limit double")
    return evaluate.threshold_gate(long, limits)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as sources: candidates are odd lines, gold even ones, of one supplier in a group."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("group_id"), (F.col("l_partkey") % 20).cast("string").alias("block_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").cast("int").cast("string").alias("quote"), (F.col("l_linenumber") % 3).alias("source_index"), "l_linenumber",
    )
    c = rows.where("l_linenumber % 2 = 1").withColumnRenamed("id", "candidate_id")
    g = rows.where("l_linenumber % 2 = 0").withColumnRenamed("id", "gold_id")
    return evaluate.source_edges(c, g)


_EDGES_SQL = """
r AS (SELECT l_suppkey::VARCHAR AS group_id, (l_partkey % 20)::VARCHAR AS block_id, l_orderkey || '-' || l_linenumber AS id, l_quantity::INTEGER::VARCHAR AS quote, l_linenumber % 3 AS si, l_linenumber
  FROM lineitem),
e AS (SELECT c.group_id, c.id AS candidate_id, g.id AS gold_id, max(CASE WHEN c.quote = g.quote THEN 20 ELSE 10 END + 9 - c.si) AS quality
  FROM r c JOIN r g ON c.group_id = g.group_id AND c.block_id = g.block_id AND (contains(c.quote, g.quote) OR contains(g.quote, c.quote))
  WHERE c.l_linenumber % 2 = 1 AND g.l_linenumber % 2 = 0 GROUP BY ALL)
"""


@query(f"WITH {_EDGES_SQL} SELECT group_id, candidate_id, gold_id, quality FROM e")
def match_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("group_id", "candidate_id", "gold_id", "quality")


@query(f"""WITH {_EDGES_SQL}, t AS (SELECT *, max(quality) OVER (PARTITION BY group_id, candidate_id) AS best FROM e)
SELECT group_id, candidate_id, best AS quality, count(*) AS ties FROM t WHERE quality = best GROUP BY ALL HAVING count(*) > 1""")
def edge_ties(spark, sf_dir):
    return evaluate.edge_ties(edges(spark, sf_dir))


@query()
def match_assignment(spark, sf_dir):
    """The matching of each group over all orders; its size and weight are held against brute force in the tests."""
    return evaluate.match_one_to_one(edges(spark, sf_dir))


@query("""SELECT o_orderkey, n > 0 AS narrow, true AS every FROM (SELECT o_orderkey, count(CASE WHEN l_partkey % 20 IN (3, 7) THEN 1 END) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
def scope_filter(spark, sf_dir):
    """Orders as items whose lines are their sources: which count in a scope of two blocks, and in one of all."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set((F.col("l_partkey") % 20).cast("string")).alias("bs"))
    narrow = evaluate.in_scope(F.col("bs"), F.array(F.lit("3"), F.lit("7")))
    every = evaluate.in_scope(F.col("bs"), F.expr("cast(array() as array<string>)"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey").select("o_orderkey", narrow.alias("narrow"), every.alias("every"))


@query(f"""WITH {_PRF_SQL}, w AS (SELECT coalesce(source, '') AS s, 'f1' AS metric, f1 AS v FROM p UNION ALL SELECT coalesce(source, ''), 'recall', recall FROM p)
SELECT s AS "case", bool_and(v >= 0.5) AS passed, '# ' || s || chr(10) || chr(10) || '| Metric | Value | Result |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || metric || ' | ' || printf('%.6f', v) || ' | ' || CASE WHEN v >= 0.5 THEN 'pass' ELSE 'fail' END || ' |', chr(10) ORDER BY metric) || chr(10) AS report FROM w GROUP BY s""")
def case_reports(spark, sf_dir):
    """The metrics of each source as a report."""
    long = eval_prf(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("case"), "f1", "recall").unpivot(["case"], ["f1", "recall"], "metric", "value")
    return evaluate.case_reports(long.withColumn("passed", F.col("value") >= 0.5))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    x0, y0, w, h = (F.element_at("embedding", i).cast("double") for i in range(1, 5))
    space = F.when(F.col("vec_id") % 3 == 0, "pdf").otherwise("image")
    return v.select("vec_id", "label", geometry.box(x0, y0, x0 + F.abs(w), y0 + F.abs(h), space).alias("box"))


_BOX_SQL = """b AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE) AS x1,
embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE) AS y1, CASE WHEN vec_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS space FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"""


@query(f"""WITH {_BOX_SQL}, p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.space = b.space AS same,
greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s,
(a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM b a JOIN b ON a.label = b.label AND b.vec_id = a.vec_id + 1)
SELECT a_id, b_id, CASE WHEN same AND u - s > 0 THEN s / (u - s) ELSE 0.0 END AS iou FROM p""")
def iou_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    a, c = b.alias("a"), b.alias("c")
    near = a.join(c, (F.col("a.label") == F.col("c.label")) & (F.col("c.vec_id") == F.col("a.vec_id") + 1))
    return near.select(F.col("a.vec_id").alias("a_id"), F.col("c.vec_id").alias("b_id"), geometry.iou(F.col("a.box"), F.col("c.box")).alias("iou"))


@query(f"WITH {_BOX_SQL} SELECT label, space, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY ALL")
def bbox_union(spark, sf_dir):
    b = boxes(spark, sf_dir)
    out = b.groupBy("label", F.col("box.space").alias("space")).agg(geometry.union_of(F.col("box")).alias("u"))
    return out.select("label", "space", "u.x0", "u.y0", "u.x1", "u.y1")


@query("""WITH a AS (SELECT (l_suppkey % 20)::INTEGER AS g, l_linenumber AS page, CASE WHEN l_quantity > 10 THEN (l_linenumber + (l_quantity > 45)::INTEGER) END AS gold_page,
  list_distinct([l_returnflag, l_linestatus]) AS cells, CASE WHEN l_discount > 0.05 THEN ['N', 'F'] ELSE []::VARCHAR[] END AS gold, CASE WHEN l_tax > 0.02 THEN l_discount * 10 END AS iou, l_linenumber < 4 AS grounded FROM lineitem)
SELECT g, CASE WHEN count(gold_page) > 0 THEN count(CASE WHEN gold_page = page THEN 1 END) / count(gold_page) ELSE 1.0 END AS page_accuracy,
 CASE WHEN sum(CASE WHEN len(gold) > 0 THEN len(cells) ELSE 0 END) > 0 THEN sum(CASE WHEN len(gold) > 0 THEN len(list_intersect(cells, gold)) ELSE 0 END) / sum(CASE WHEN len(gold) > 0 THEN len(cells) ELSE 0 END) ELSE 1.0 END AS table_cell_precision,
 CASE WHEN sum(len(gold)) > 0 THEN sum(len(list_intersect(cells, gold))) / sum(len(gold)) ELSE 1.0 END AS table_cell_recall,
 coalesce(avg(iou), 1.0) AS bbox_iou_mean, CASE WHEN count(iou) > 0 THEN count(CASE WHEN iou >= 0.5 THEN 1 END) / count(iou) ELSE 1.0 END AS bbox_iou_pass_rate FROM a GROUP BY g""")
def locator_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    aligned = li.select(
        (F.col("l_suppkey") % 20).cast("int").alias("g"), F.col("l_linenumber").alias("page"), F.when(F.col("l_quantity") > 10, F.col("l_linenumber") + (F.col("l_quantity") > 45).cast("int")).alias("gold_page"),
        F.array("l_returnflag", "l_linestatus").alias("cells"), F.when(F.col("l_discount") > 0.05, F.array(F.lit("N"), F.lit("F"))).otherwise(F.expr("cast(array() as array<string>)")).alias("gold_cells"),
        F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 10).alias("iou"), F.lit(0.5).alias("iou_threshold"), (F.col("l_linenumber") < 4).alias("grounded"), F.lit(True).alias("located"),
    )
    m = evaluate.locator_metrics()
    return aligned.groupBy("g").agg(*[m[k].alias(k) for k in ("page_accuracy", "table_cell_precision", "table_cell_recall", "bbox_iou_mean", "bbox_iou_pass_rate")])


@query("""WITH e AS (SELECT o_custkey % 100 AS k, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), a AS (SELECT o_custkey % 100 AS k, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(e.k, a.k) AS k, sum(least(coalesce(e.n, 0), coalesce(a.n, 0)))::BIGINT AS true_positives, sum(coalesce(e.n, 0))::BIGINT AS expected, sum(coalesce(a.n, 0))::BIGINT AS actual FROM e FULL JOIN a ON e.k = a.k AND e.v = a.v GROUP BY coalesce(e.k, a.k)""")
def multiset_headings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 100)
    return evaluate.multiset_matches(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["k"], "o_orderpriority")


@query("""SELECT lang, 0.3 * avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END) + 0.25 * avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END) + 0.15 * avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END)
+ 0.3 * avg(CASE WHEN coalesce(l.toxic, 0) = 0 THEN 1.0 ELSE 0.0 END) AS proxy, avg(CASE WHEN l.quality = 1 THEN n_chars END) AS mean_chars FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def quality_proxy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    share = lambda c: rates.rate(F.count_if(F.coalesce(c, F.lit(False))), F.count("*"), 0.0)
    proxy = 0.3 * share(F.col("quality") == 1) + 0.25 * share(F.col("n_chars") > 500) + 0.15 * share(F.col("source").isNotNull()) + 0.3 * share(F.coalesce("toxic", F.lit(0)) == 0)
    return rows.groupBy("lang").agg(proxy.alias("proxy"), F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("mean_chars"))


# Evidence --------------------------------------------------------------------------------------


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (F.col("l_quantity") % 3 + 1).cast("int").alias("column"), F.lit(1).alias("row_span"), (F.col("l_quantity") % 2 + 1).cast("int").alias("column_span"))


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS r, (l_quantity % 3 + 1)::INTEGER AS c0, (l_quantity % 2 + 1)::INTEGER AS span FROM lineitem),
s AS (SELECT table_id, r, unnest(range(c0, c0 + span)) AS c FROM c), t AS (SELECT table_id, r, c, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT l_orderkey AS table_id, max(l_linenumber) AS rs FROM lineitem GROUP BY ALL)
SELECT table_id, 'OUT_OF_BOUNDS' AS problem, r::INTEGER AS row, c::INTEGER AS "column", n FROM t JOIN d USING (table_id) WHERE c > 3 OR r > rs UNION ALL
SELECT table_id, 'SLOT_OVERLAP', r::INTEGER, c::INTEGER, n FROM t WHERE n > 1 UNION ALL
SELECT table_id, 'SLOTS_EMPTY', NULL, NULL, rs * 3 - filled FROM d JOIN (SELECT table_id, count(*) AS filled FROM t JOIN d USING (table_id) WHERE c <= 3 AND r <= rs GROUP BY ALL) USING (table_id) WHERE rs * 3 > filled""")
def grid_topology_violations(spark, sf_dir):
    c = cells(spark, sf_dir)
    tables = c.groupBy("table_id").agg(F.max("row").alias("rows"), F.lit(3).alias("columns"), F.lit(True).alias("complete"))
    return evidence.grid_violations(c, tables)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))


_SPANS_SQL = "s AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER AS s, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER + l_quantity::INTEGER AS e FROM lineitem)"


@query(f"WITH {_SPANS_SQL} SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS span_line FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.s < b.e AND b.s < a.e AND a.l_linenumber < b.l_linenumber")
def interval_overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    met = evidence.overlapping(s.withColumnRenamed("l_linenumber", "line"), s.withColumnRenamed("l_linenumber", "span_line"), ["l_orderkey"])
    return met.where("line < span_line").select("l_orderkey", "line", "span_line")


@query(f"""WITH {_SPANS_SQL}, r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT l_orderkey, reach AS gap_start, s AS gap_end FROM r WHERE reach < s""")
def coverage_gaps(spark, sf_dir):
    return evidence.coverage_gaps(spans(spark, sf_dir), ["l_orderkey"])


@query(f"""WITH {_SPANS_SQL}, r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT l_orderkey, count(*) AS overlaps, max(reach - s) AS deepest FROM r WHERE reach > s GROUP BY l_orderkey""")
def range_overlaps(spark, sf_dir):
    found = evidence.overlaps_next(spans(spark, sf_dir), ["l_orderkey"])
    return found.groupBy("l_orderkey").agg(F.count("*").alias("overlaps"), F.max(F.col("reach") - F.col("start")).alias("deepest"))


_LINES_SQL = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem)"


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with line, their place in the order; l_linenumber may repeat within one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w).cast("long"))


@query("""SELECT l_orderkey, line, (sum(length(t) + 3) OVER (PARTITION BY l_orderkey ORDER BY line) - length(t) - 3)::BIGINT AS start, (sum(length(t) + 3) OVER (PARTITION BY l_orderkey ORDER BY line) - 3)::BIGINT AS "end"
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, l_returnflag || '\\|' || l_linestatus || '\\n' || l_partkey AS t FROM lineitem)""")
def cell_text_offsets(spark, sf_dir):
    raw = F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit("\r\n"), F.col("l_partkey").cast("string"))
    rows = numbered_lines(spark, sf_dir).select("l_orderkey", "line", text.cell_text(raw).alias("text"))
    return evidence.row_offsets(rows, ["l_orderkey"], ["line"]).select("l_orderkey", "line", "start", "end")


@query("""WITH g AS (SELECT l_orderkey, (l_linenumber - 1) // 2 AS g, min(l_linenumber) AS first_row, max(l_linenumber) AS last_row FROM lineitem WHERE l_quantity > 5 GROUP BY ALL),
x AS (SELECT l_orderkey, first_row, last_row, coalesce(lag(last_row) OVER (PARTITION BY l_orderkey ORDER BY first_row) + 1, 1) AS expected_first_row FROM g)
SELECT l_orderkey, first_row, last_row, expected_first_row FROM x WHERE first_row <> expected_first_row""")
def row_group_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 5")
    groups = li.groupBy("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("g")).agg(F.min("l_linenumber").alias("first_row"), F.max("l_linenumber").alias("last_row")).drop("g")
    return evidence.row_group_violations(groups, ["l_orderkey"])


@query("""SELECT o.o_orderkey, n AS rows, t AS view FROM (SELECT o_orderkey FROM orders) o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n,
string_agg(l_linenumber || ':' || l_partkey || '/' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""")
def table_view(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    view = evidence.table_view(table(spark, sf_dir, "orders").select("o_orderkey"), li, "o_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"])
    line = lambda r: F.transform(r["cells"], lambda c: F.concat(r["l_linenumber"].cast("string"), F.lit(":"), c["l_partkey"].cast("string"), F.lit("/"), c["l_suppkey"].cast("string")))
    return view.select("o_orderkey", F.when(F.col("rows").isNotNull(), F.size("rows")).cast("long").alias("rows"), F.array_join(F.flatten(F.transform("rows", line)), ";").alias("view"))


_FKS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"))


@query(" UNION ALL ".join(f"SELECT '{a}.{b}' AS relation, {b}::VARCHAR AS key, count(*) AS n FROM {a} WHERE {b} IS NOT NULL AND {b} NOT IN (SELECT {d} FROM {c} WHERE {d} IS NOT NULL) GROUP BY {b}" for a, b, c, d in _FKS))
def fk_violations(spark, sf_dir):
    out = None
    for a, b, c, d in _FKS:
        found = evidence.orphans(table(spark, sf_dir, a), table(spark, sf_dir, c), b, d, f"{a}.{b}")
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT 'lineitem' AS relation, l_orderkey || '/' || l_partkey AS key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def key_duplicates(spark, sf_dir):
    return evidence.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "lineitem")


@query("""SELECT doc_id::VARCHAR AS document_id, 'b' AS block_id, CASE WHEN doc_id % 5 = 0 THEN 'EVIDENCE_MISSING' WHEN doc_id % 5 = 1 THEN 'LENGTH_DIFFERS' WHEN doc_id % 5 = 2 THEN 'DIGEST_DIFFERS' WHEN doc_id % 5 = 3 THEN 'PAGE_DIFFERS' END AS problem
FROM documents WHERE doc_id % 5 < 4""")
def index_mismatches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"document_id": F.col("doc_id").cast("string"), "block_id": F.lit("b")})
    k = F.col("doc_id") % 5
    index = docs.where(k > 0).select("document_id", "block_id", (F.length("text") + (k == 1).cast("int")).alias("text_length"), F.when(k == 2, "0").otherwise(F.sha2("text", 256)).alias("text_sha256"), F.when(k == 3, 7).alias("page"))
    return evidence.index_mismatches(index, docs.select("document_id", "block_id", "text", F.lit(None).cast("int").alias("page")))


def located_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A range for each line of every order, and all lines as cells, two in a row."""
    rows = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit("b").alias("block_id"), "line", F.col("l_partkey").cast("string").alias("text"))
    placed = evidence.row_offsets(rows, ["document_id", "block_id"], ["line"])
    y = F.ceil(F.col("line") / 2)
    occ = placed.select(
        "document_id", "block_id", "start", "end", F.concat(F.lit("cell_"), F.col("line").cast("string")).alias("cell_id"), y.cast("int").alias("row_index"), F.col("line").alias("column_index"), F.lit(1).alias("page"),
        geometry.box(F.col("start").cast("double"), y.cast("double"), F.col("end").cast("double"), y + 1.0, F.lit("page")).alias("box"),
    )
    wanted = placed.select(F.concat_ws("-", "document_id", "line").alias("source_key"), "line", "document_id", "block_id", "start", (F.col("end") + 4 * (F.col("line") - 1)).alias("end"))
    return wanted, occ


_LOCATED_SQL = """
t AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, l_partkey::VARCHAR AS x FROM lineitem),
p AS (SELECT *, sum(length(x) + 3) OVER (PARTITION BY d ORDER BY line) - length(x) - 3 AS s, sum(length(x) + 3) OVER (PARTITION BY d ORDER BY line) - 3 AS e FROM t),
g AS (SELECT w.d, w.line, count(DISTINCT (c.line + 1) // 2) AS rows, min((c.line + 1) // 2) AS r, string_agg('cell_' || c.line, ',' ORDER BY c.line) AS cells
  FROM p w JOIN p c ON c.d = w.d AND w.s < c.e AND c.s < w.e + 4 * (w.line - 1) GROUP BY w.d, w.line)
"""


@query(f"""WITH {_LOCATED_SQL} SELECT d || '-' || line AS source_key, CASE WHEN rows > 1 THEN 'CROSSES_TABLE_ROWS' END AS error, CASE WHEN rows = 1 THEN r::INTEGER END AS row_index, CASE WHEN rows = 1 THEN cells END AS cell_ids, CASE WHEN rows = 1 THEN 1 END AS page FROM g""")
def table_row_locators(spark, sf_dir):
    """Ranges in serialised rows, derived to the row and cells that they lie in; the later the line, the further its range reaches."""
    wanted, occ = located_rows(spark, sf_dir)
    found = evidence.table_rows(wanted.drop("line"), occ)
    return found.select("source_key", "error", "row_index", F.array_join("cell_ids", ",").alias("cell_ids"), "page")


@query(f"""WITH {_LOCATED_SQL}, z AS (SELECT *, line % 3 AS k, (line + 1) // 2 AS own FROM g)
SELECT d || '-' || line AS source_key, CASE k WHEN 0 THEN 'WARNING_AMBIGUOUS' WHEN 1 THEN 'PASS' ELSE 'FAIL_DERIVATION' END AS text_status, k = 1 AS has_text, k = 0 AS provisional,
CASE WHEN k = 1 AND rows = 1 AND r = own AND cells = 'cell_' || line THEN 'cell_' || line END AS cells, CASE WHEN k = 1 THEN CASE WHEN rows = 1 AND r = own AND cells = 'cell_' || line THEN 'cells' ELSE 'block' END END AS page_basis,
CASE WHEN k = 1 THEN 7 END AS page, CASE k WHEN 0 THEN 'WARNING_AMBIGUOUS' WHEN 1 THEN 'UNVERIFIED' ELSE 'FAIL_DERIVATION' END AS locator_status FROM z""")
def enriched_sources(spark, sf_dir):
    """Every line of an order as a source that cites its own cell, with what matches and evidence say of it."""
    wanted, occ = located_rows(spark, sf_dir)
    k = F.col("line") % 3
    chosen = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    sources = wanted.select("source_key", "document_id", "block_id", F.ceil(F.col("line") / 2).cast("int").alias("row_index"), F.array(F.concat(F.lit("cell_"), F.col("line").cast("string"))).alias("canonical_cell_ids"))
    matches = wanted.select("source_key", F.when(k == 1, "UNIQUE_MATCH").when(k == 0, "AMBIGUOUS_MATCH").otherwise("NO_MATCH").alias("status"), F.lit("exact").alias("basis"), F.when(k == 1, chosen).alias("selected"), F.when(k == 0, chosen).alias("provisional"), F.lit(1.0).alias("score"))
    able = F.array(*[F.lit(c) for c in ("text_range", "table_cell", "page_region")])
    place = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit("page"))
    index = wanted.select("document_id", "block_id").distinct().select("*", F.lit(7).alias("page"), able.alias("expected"), able.alias("available"), place.alias("box"))
    found = evidence.enrich_sources(sources, matches, index, evidence.table_rows(wanted.drop("line"), occ))
    return found.select("source_key", "text_status", F.col("text_locator").isNotNull().alias("has_text"), F.col("provisional_text_locator").isNotNull().alias("provisional"), F.array_join("table_locator.cell_ids", ",").alias("cells"), F.col("page_locator.basis").alias("page_basis"), "page", "locator_status")


@query(f"""WITH {_BLOCKS_SQL} SELECT document_id, count(*) AS blocks, sum(length(text))::BIGINT AS chars, min(sha256(text)) AS least_digest FROM b GROUP BY document_id""")
def default_evidence(spark, sf_dir):
    """The text-only evidence of all lines; it never contradicts the blocks that it is made of."""
    rows = doc_blocks(spark, sf_dir).withColumn("page", F.lit(None).cast("int"))
    index, problems = evidence.ensure_index(rows)
    told = index.join(problems, ["document_id", "block_id"], "left_anti")
    return told.groupBy("document_id").agg(F.count("*").alias("blocks"), F.sum("text_length").cast("long").alias("chars"), F.min("text_sha256").alias("least_digest"))


def logical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as cells of a table with three columns; returned ones are empty."""
    li = numbered_lines(spark, sf_dir)
    return li.select(
        F.concat_ws("-", "l_orderkey", "line").alias("cell_id"), F.col("l_orderkey").alias("table_id"), (F.floor((F.col("line") - 1) / 3) + 1).cast("int").alias("row"),
        ((F.col("line") - 1) % 3 + 1).cast("int").alias("column"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("text"),
    )


@query("""WITH l AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag = 'R' AS e FROM lineitem),
c AS (SELECT t, count(*) AS k, max(CASE WHEN n = 1 THEN e::INTEGER END) AS e1, max(CASE WHEN n = 2 THEN e::INTEGER END) AS e2, max(CASE WHEN n = 3 THEN e::INTEGER END) AS e3 FROM l GROUP BY t)
SELECT t AS source_key, CASE WHEN k < 3 THEN 'UNKNOWN_CELL' WHEN e1 = 1 AND e3 = 1 THEN 'ALL_CELLS_EMPTY' WHEN e1 = 1 OR e3 = 1 THEN 'EMPTY_CELL_OUTSIDE' WHEN e2 = 0 THEN 'TEXT_LEFT_OUT' END AS error,
CASE WHEN k >= 3 AND e1 = 0 AND e3 = 0 AND e2 = 1 THEN t || '-1,' || t || '-3' END AS cell_ids FROM c""")
def canonical_cells(spark, sf_dir):
    """The first and third cell of each order's first row, as a source would cite them."""
    c = logical_cells(spark, sf_dir)
    t = c.groupBy("table_id").agg(F.max("row").alias("rows"), F.lit(False).alias("sparse"))
    picked = t.select(F.col("table_id").alias("source_key"), F.lit("b").alias("block_id"), "table_id", F.lit(1).alias("row_index"), F.array(F.concat(F.col("table_id").cast("string"), F.lit("-3")), F.concat(F.col("table_id").cast("string"), F.lit("-1"))).alias("cell_ids"))
    held = c.select(F.lit("b").alias("block_id"), "cell_id", F.col("row").alias("row_index"))
    return tables.canonical_selection(picked, c, t, held).select("source_key", "error", F.array_join("cell_ids", ",").alias("cell_ids"))


_CANONICAL_SQL = """
l AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag = 'R' AS e FROM lineitem),
c AS (SELECT t, count(*) AS k, max(CASE WHEN n = 1 THEN e::INTEGER END) AS e1, max(CASE WHEN n = 4 THEN e::INTEGER END) AS e4 FROM l GROUP BY t)
"""


@query(f"""WITH {_CANONICAL_SQL} SELECT t AS source_key, CASE WHEN t % 3 = 0 AND k < 4 THEN 'MODEL_ITEM_INVALID_CELL_IDS' WHEN t % 3 = 0 THEN 'MODEL_ITEM_INVALID_TABLE_ROW_INDEX'
WHEN t % 3 = 1 AND e1 = 1 THEN 'MODEL_ITEM_INVALID_CELL_IDS' END AS error_code, CASE WHEN t % 3 = 1 AND e1 = 0 THEN t || '-1' WHEN t % 3 = 2 THEN '' END AS cell_ids FROM c""")
def rejected_selections(spark, sf_dir):
    """Candidates that cite a cell of another row, their own first cell, or none: prepared or rejected."""
    c = logical_cells(spark, sf_dir)
    t = c.groupBy("table_id").agg(F.max("row").alias("rows"), F.lit(False).alias("sparse"))
    k = F.col("table_id") % 3
    at = lambda n: F.array(F.concat(F.col("table_id").cast("string"), F.lit(f"-{n}")))
    cited = F.when(k == 0, at(4)).when(k == 1, at(1)).otherwise(F.expr("cast(array() as array<string>)"))
    picked = t.select(F.col("table_id").alias("source_key"), F.lit("b").alias("block_id"), "table_id", F.when(k < 2, 1).alias("row_index"), cited.alias("cell_ids"))
    held = c.select(F.lit("b").alias("block_id"), "cell_id", F.col("row").alias("row_index"))
    prepared, rejected = items.reject_unprepared(picked.select("source_key"), tables.canonical_selection(picked, c, t, held))
    out = prepared.select("source_key", F.lit(None).cast("string").alias("error_code"), F.array_join("canonical_cell_ids", ",").alias("cell_ids"))
    return out.unionByName(rejected.select("source_key", "error_code", F.lit(None).cast("string").alias("cell_ids")))


@query(f"""WITH {_LINES_SQL}, c AS (SELECT l_orderkey AS t, line, (line - 1) // 3 + 1 AS r, (line - 1) % 3 + 1 AS c, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS x FROM l),
r AS (SELECT t, r, 'row ' || r || ': ' || string_agg(t || '-' || line || '(row=' || r || ',column=' || c || ',row_span=1,column_span=1,text="' || x || '")', ' | ' ORDER BY c) AS x FROM c GROUP BY t, r)
SELECT t AS document_id, '[b]' || chr(10) || 'type: table' || chr(10) || 'section_path: S > T' || chr(10) || 'table_id: ' || t || chr(10) || 'primary_rows: 1-' || max(r) || chr(10) || 'canonical_text: x' || chr(10) || 'cell_map:' || chr(10) || string_agg(x, chr(10) ORDER BY r) AS prompt_text FROM r GROUP BY t""")
def cell_maps(spark, sf_dir):
    """Each order's table as a prompt shows it."""
    c = logical_cells(spark, sf_dir)
    b = c.groupBy("table_id").agg(F.max("row").alias("last_row"))
    b = b.select(F.col("table_id").alias("document_id"), F.lit("b").alias("block_id"), F.array(F.lit("S"), F.lit("T")).alias("section_path"), F.lit("x").alias("text"), "table_id", F.lit(1).alias("first_row"), "last_row")
    return chunking.cell_maps(b, c).select("document_id", "prompt_text")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS root,
 first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rs FROM orders), p AS (SELECT *, n + (o_orderkey % 9 = 0)::INTEGER AS page FROM t), q AS (SELECT *, lag(page) OVER (PARTITION BY o_custkey ORDER BY n) AS pb,
 first_value(page) OVER (PARTITION BY o_custkey ORDER BY n) AS rp FROM p)
SELECT o_orderkey AS table_id, 'OTHER_BASIS' AS problem FROM q WHERE n > 1 AND s <> rs UNION ALL SELECT o_orderkey, 'PAGE_NOT_AFTER_ROOT' FROM q WHERE n > 1 AND page <= rp UNION ALL SELECT o_orderkey, 'PAGES_NOT_ADJACENT' FROM q WHERE n > 1 AND page <> pb + 1""")
def continuation_rules(spark, sf_dir):
    """A customer's orders as the parts of one table; some stand on the wrong page or differ from the first."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.row_number().over(w)
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("group_id"), n.alias("sequence"), F.when(n == 1, "start").otherwise("continuation").alias("role"),
        F.when(n > 1, F.first("o_orderkey").over(w)).alias("root_id"), (n + (F.col("o_orderkey") % 9 == 0).cast("int")).alias("page"), F.lit(3).alias("columns"), F.lit("T").alias("label"), F.col("o_orderstatus").alias("basis"),
    )
    return tables.continuation_violations(t)


@query("""WITH l AS (SELECT l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag AS f FROM lineitem)
SELECT id AS key, 'ORIGINAL_NOT_AT_ANCHOR' AS problem FROM l WHERE f = 'A' UNION ALL SELECT id, CASE f WHEN 'N' THEN 'PROJECTION_NOT_IN_SPAN' ELSE 'HEADER_NOT_PROJECTED' END FROM l WHERE f <> 'A' UNION ALL SELECT id, 'NOT_ONE_ORIGINAL' FROM l WHERE f <> 'A'""")
def occurrence_rules(spark, sf_dir):
    """Each cell occurs once, off its row or with a role that it cannot have."""
    c = logical_cells(spark, sf_dir).withColumn("is_header", F.lit(False))
    flags = numbered_lines(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "line").alias("cell_id"), "l_returnflag")
    role = F.when(F.col("l_returnflag") == "A", "original").when(F.col("l_returnflag") == "N", "row_span_projection").otherwise("repeated_header")
    o = c.join(flags, "cell_id").select(F.col("cell_id").alias("occurrence_id"), F.lit("b").alias("block_id"), "cell_id", (F.col("row") + F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("row_index"), role.alias("role"))
    b = spark.createDataFrame([("b", 1, 1, 99)], "block_id string, position int, first_row int, last_row int")
    return tables.occurrence_violations(o, c.select("cell_id", "table_id", "row", "row_span", "is_header"), b)


@query("""SELECT 'cells' AS relation, l_orderkey || '-' || n AS key, 'DIGEST_DIFFERS' AS problem FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE l_returnflag = 'A'""")
def record_invariants(spark, sf_dir):
    c = logical_cells(spark, sf_dir).withColumn("text_sha256", F.when(F.col("text") == "A", "0").otherwise(F.sha2("text", 256)))
    text_only = F.array(F.lit("text_range"))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), text_only.alias("expected"), text_only.alias("available"), F.lit(None).cast("int").alias("first_row"), F.lit(None).cast("int").alias("last_row"), F.lit(None).cast("string").alias("table_id"), F.expr("cast(array() as array<string>)").alias("cell_ids"), F.lit(None).cast("string").alias("box"), F.lit(None).cast("int").alias("page"))
    t = c.groupBy("table_id").agg(F.max("row").alias("rows"), F.max("column").alias("columns"))
    return tables.record_violations(b, c, t)


@query("""SELECT event_id, sha256('{"a":[' || event_id || ',"é"],"k":' || json_extract_string(props, '$.k') || '}') AS fingerprint FROM events""")
def evidence_fingerprints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "a" : ['), F.col("event_id").cast("string"), F.lit(', "é"]}'))
    return e.select("event_id", tables.fingerprint(payload).alias("fingerprint"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'FAIL_INVALID_REFERENCE' WHEN event_id % 3 = 1 THEN 'PASS' WHEN event_id % 3 = 2 THEN 'WARNING_AMBIGUOUS' ELSE 'FAIL_DERIVATION' END AS text_status,
CASE WHEN event_id % 7 = 0 THEN 'WARNING_UNAVAILABLE' WHEN event_id % 5 <> 4 AND event_id % 3 = 2 THEN 'WARNING_AMBIGUOUS' WHEN event_id % 4 = 0 THEN 'FAIL_DERIVATION' WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL_INVALID_REFERENCE' END AS cell_status FROM events""")
def capability_results(spark, sf_dir):
    e = F.col("event_id")
    status = F.when(e % 3 == 1, "UNIQUE_MATCH").when(e % 3 == 2, "AMBIGUOUS_MATCH").otherwise("NO_MATCH")
    found = tables.text_result(status, F.when(e % 3 == 1, 1), e % 5 != 4)
    rows = table(spark, sf_dir, "events").select("event_id", found["status"].alias("text_status"))
    derived = F.when(e % 4 != 0, F.array(F.lit("c1")))
    stated = F.when(e % 2 == 0, F.array(F.lit("c1"))).otherwise(F.array(F.lit("c2")))
    return rows.withColumn("cell_status", tables.checked_result(e % 7 != 0, stated, derived, F.col("text_status")))


# Layout ----------------------------------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as lines of a page: quantities make the gaps, taxes the font."""
    li = numbered_lines(spark, sf_dir)
    top = 20.0 * F.col("line") + F.col("l_quantity") / 10
    return li.select("l_orderkey", "line", top.alias("top"), (top + 10).alias("bottom"), (10 + F.round(F.col("l_tax") * 50)).alias("font_size"), F.col("l_returnflag").alias("text"))


@query(f"""WITH {_LINES_SQL}, m AS (SELECT l_orderkey, line, 20.0::DOUBLE * line + l_quantity / 10 AS t, 10 + round(l_tax * 50) AS f, l_returnflag AS x FROM l),
n AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - (lag(t) OVER w + 10) > greatest(4.0, 0.6 * greatest(t + 10 - t, lag(t) OVER w + 10 - lag(t) OVER w)) OR abs(f - lag(f) OVER w) >= greatest(2.0, 0.2 * least(f, lag(f) OVER w)) THEN 1 ELSE 0 END AS b FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)),
p AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY line) AS p FROM n)
SELECT l_orderkey, p::BIGINT AS paragraph, max(f) AS font_size, count(*) AS lines, string_agg(x, chr(10) ORDER BY line) AS text FROM p GROUP BY l_orderkey, p""")
def paragraph_islands(spark, sf_dir):
    return layout.paragraphs(lines(spark, sf_dir), ["l_orderkey"], "line").select("l_orderkey", "paragraph", "font_size", "lines", "text")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, 8 + o_orderkey % 7 AS f, o_orderpriority AS t FROM orders), m AS (SELECT o_custkey, median(f) AS m FROM b GROUP BY ALL),
h AS (SELECT *, CASE WHEN f >= 1.15 * m AND f - m >= 1 THEN 'font' WHEN o_orderkey % 5 = 0 THEN 'bold' END AS h FROM b JOIN m USING (o_custkey))
SELECT o_orderkey, h AS heading FROM h""")
def heading_signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = o.select("o_custkey", "o_orderkey", (8 + F.col("o_orderkey") % 7).cast("double").alias("font_size"), F.lit(1).alias("lines"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 5 == 0).alias("bold"))
    return layout.headings(b, ["o_custkey"]).select("o_orderkey", "heading")


@query(f"""WITH {_LINES_SQL}, x AS (SELECT l_orderkey, line, l_returnflag AS t, 30.0 * line AS x0, 30.0 * line + 28 + l_quantity % 3 AS x1 FROM l)
SELECT l_orderkey, string_agg(CASE WHEN gap > 1.2 THEN ' ' || t ELSE t END, '' ORDER BY line) AS text FROM (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY line), 0) AS gap FROM x) GROUP BY l_orderkey""")
def joined_spans(spark, sf_dir):
    x0 = 30.0 * F.col("line")
    rows = numbered_lines(spark, sf_dir).select("l_orderkey", "line", x0.alias("x0"), (x0 + 28 + (F.col("l_quantity") % 3)).alias("x1"), F.lit(10.0).alias("font_size"), F.col("l_returnflag").alias("text"))
    return layout.joined_spans(rows, ["l_orderkey"], "line")


@query(f"""WITH {_LINES_SQL}, n AS (SELECT l_orderkey, count(*) AS pages FROM l GROUP BY ALL), e AS (SELECT l_orderkey, l_returnflag AS text, count(*) AS c, max(l_tax) - min(l_tax) AS drift FROM l GROUP BY ALL)
SELECT l_orderkey AS document_id, 'header' AS role, text, c AS pages FROM e JOIN n USING (l_orderkey) WHERE c >= 3 AND c >= 0.5 * pages AND drift < 0.052""")
def repeated_edges(spark, sf_dir):
    """Lines of an order as pages, each with its return flag as a header that drifts with the tax."""
    li = numbered_lines(spark, sf_dir)
    y = 0.01 + 0.19 * F.col("l_tax")
    rows = li.select(F.col("l_orderkey").alias("document_id"), F.col("line").alias("page"), F.col("l_returnflag").alias("text"), F.lit(0.1).alias("x0"), y.alias("y0"), F.lit(0.9).alias("x1"), (y + 0.02).alias("y1"))
    return layout.repeated_edges(rows, li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("pages")))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)
SELECT a.o_custkey AS document_id, a.page::INTEGER AS page, a.o_orderkey AS table_id, b.o_orderkey AS next_table_id FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND b.page = a.page + 1 AND a.o_orderstatus = b.o_orderstatus""")
def continued_tables(spark, sf_dir):
    """Orders of a customer as tables on pages, the next one continuing the one before."""
    o = table(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    header = F.array(F.struct(F.col("o_orderstatus").alias("text"), F.lit(0.1).alias("x0"), F.lit(0.4).alias("x1")))
    t = o.select(F.col("o_custkey").alias("document_id"), page.alias("page"), F.col("o_orderkey").alias("table_id"), F.lit(0.02).alias("y0"), F.lit(0.97).alias("y1"), F.concat(F.lit("Table "), F.col("o_custkey").cast("string"), F.lit(" (continued)")).alias("label"), header.alias("header"))
    return layout.continued_tables(t)


@query(f"""WITH {_LINES_SQL}, b AS (SELECT l_orderkey AS d, line, floor(line / 2) * 20 AS y, CASE WHEN line = 1 THEN 0 WHEN l_quantity % 2 = 0 THEN 1 ELSE 2 END AS c FROM l),
n AS (SELECT d, y, count(DISTINCT c) AS k FROM b WHERE line > 1 GROUP BY d, y), s AS (SELECT d, coalesce(max(k), 0) > 1 AS two FROM b LEFT JOIN n USING (d) GROUP BY d)
SELECT d::VARCHAR AS document_id, 1 AS page, line::VARCHAR AS block_id, (row_number() OVER (PARTITION BY d ORDER BY CASE WHEN two THEN c ELSE 0 END, y, c, line))::INTEGER AS reading_order, CASE WHEN two AND c > 0 THEN c ELSE 1 END::INTEGER AS column_index FROM b JOIN s USING (d)""")
def reading_order(spark, sf_dir):
    """Lines of an order as blocks of a page in up to two columns under a wide one."""
    li = numbered_lines(spark, sf_dir)
    left = F.when(F.col("line") == 1, 0.0).when(F.col("l_quantity") % 2 == 0, 0.0).otherwise(55.0)
    right = F.when(F.col("line") == 1, 100.0).otherwise(left + 40)
    y = F.floor(F.col("line") / 2) * 20.0
    rows = li.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.col("line").cast("string").alias("block_id"), F.col("line").alias("source"), left.alias("x0"), y.cast("double").alias("y0"), right.alias("x1"), (y + 15.0).alias("y1"), F.lit(100.0).alias("width"))
    return reading.reading_order(rows)


# Reviews, runs and logs ------------------------------------------------------------------------


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "restore").when(F.col("event_type") == "view", "request_recheck").otherwise("edit")
    fields = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("statement"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("tags"))).otherwise(F.array(F.lit("id")))
    return e.select("user_id", "event_id", action.alias("action"), fields.alias("fields"), F.lit(None).cast("int").alias("expected_revision"))


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, event_type AS t, event_id % 3 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 'pending' AS st, 0 AS rev, 0 AS bad FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT s.user_id, a.n, CASE WHEN t = 'click' AND st IN ('pending', 'needs_recheck') THEN 'approved' WHEN t = 'error' AND st <> 'rejected' THEN 'rejected' WHEN t = 'signup' AND st = 'rejected' THEN 'pending'
  WHEN t = 'view' THEN 'needs_recheck' WHEN t = 'purchase' AND f = 0 THEN 'needs_recheck' ELSE st END,
 rev + CASE WHEN (t = 'click' AND st IN ('pending', 'needs_recheck')) OR (t = 'error' AND st <> 'rejected') OR (t = 'signup' AND st = 'rejected') OR t = 'view' OR (t = 'purchase' AND f < 2) THEN 1 ELSE 0 END,
 bad + CASE WHEN (t = 'click' AND st IN ('pending', 'needs_recheck')) OR (t = 'error' AND st <> 'rejected') OR (t = 'signup' AND st = 'rejected') OR t = 'view' OR (t = 'purchase' AND f < 2) THEN 0 ELSE 1 END
 FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)
SELECT user_id, arg_max(st, n) AS status, arg_max(rev, n) AS revision, arg_max(bad, n) AS rejected_actions FROM s GROUP BY user_id""")
def review_fold(spark, sf_dir):
    return review.fold_reviews(review_actions(spark, sf_dir), "user_id", ["event_id"]).drop("log")


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, event_type AS t, event_id % 3 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 'pending' AS st, '' AS before, 0 AS rev, '' AS action, false AS ok FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT user_id, n, CASE WHEN good THEN nxt ELSE st END, st, rev + good::INTEGER, action, good FROM (SELECT s.user_id, a.n, s.st, s.rev,
 CASE t WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'restore' WHEN 'view' THEN 'request_recheck' ELSE 'edit' END AS action,
 CASE t WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'needs_recheck' ELSE CASE WHEN f = 0 THEN 'needs_recheck' ELSE s.st END END AS nxt,
 (t = 'click' AND s.st IN ('pending', 'needs_recheck')) OR (t = 'error' AND s.st <> 'rejected') OR (t = 'signup' AND s.st = 'rejected') OR t = 'view' OR (t = 'purchase' AND f < 2) AS good
 FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1))
SELECT user_id, rev AS revision, action, before, st AS after FROM s WHERE ok""")
def review_log(spark, sf_dir):
    return review.review_log(review.fold_reviews(review_actions(spark, sf_dir), "user_id", ["event_id"]), "user_id")


@query("""WITH c AS (SELECT conv_id, turn, role FROM conversations WHERE (conv_id + turn) % 11 <> 0), w AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM c)
SELECT conv_id, 'FIRST_EVENT' AS problem, turn AS sequence FROM w WHERE b IS NULL AND role <> 'user' UNION ALL SELECT conv_id, 'LAST_EVENT', turn FROM w WHERE a IS NULL AND role <> 'assistant' UNION ALL
SELECT conv_id, 'SEQUENCE_REPEATED', turn FROM w WHERE b = turn UNION ALL SELECT conv_id, 'SEQUENCE_GAP', turn FROM w WHERE turn - b > 1""")
def trace_consistency(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 11 <> 0")
    return agent.trace_problems(c, "conv_id", "turn", "role", "user", ("assistant",))


@query("""SELECT user_id, count(CASE WHEN k = 'decision' THEN 1 END) AS steps, count(CASE WHEN k = 'planner_request' THEN 1 END) AS planner_calls, 1 + count(CASE WHEN k = 'tool_started' THEN 1 END) AS tool_invocations,
count(CASE WHEN k = 'policy_rejection' THEN 1 END) AS policy_rejections, count(CASE WHEN k = 'error' THEN 1 END) AS errors FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'planner_request' WHEN 'purchase' THEN 'tool_started' WHEN 'signup' THEN 'policy_rejection' ELSE event_type END AS k FROM events) GROUP BY user_id""")
def trace_counters(spark, sf_dir):
    names = {"click": "decision", "view": "planner_request", "purchase": "tool_started", "signup": "policy_rejection"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")], F.col("event_type"))
    return agent.trace_counters(table(spark, sf_dir, "events").withColumn("k", kind), "user_id", "k")


@query("""SELECT event_id, user_id, repeat FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS repeat FROM events) WHERE repeat > 1""")
def action_loops(spark, sf_dir):
    found = agent.action_loops(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "props"])
    return found.select("event_id", "user_id", F.col("repeat").cast("long").alias("repeat"))


_FINISH_SQL = """
m AS (SELECT * FROM (VALUES ('completed'), ('completed_with_warnings'), ('needs_human'), ('failed')) AS o(outcome), (VALUES (0), (1)) AS a(attempts), (VALUES ('failed'), ('completed_with_warnings'), ('completed'), ('running')) AS s(status),
 (VALUES (0), (3)) AS v(validated), (VALUES ('none'), ('NO_REQUIREMENTS_FOUND'), ('OTHER')) AS w(warning), (VALUES ('none'), ('ALL_CHUNKS_FAILED')) AS e(error))
"""


@query(f"""WITH {_FINISH_SQL} SELECT *, CASE WHEN attempts = 0 THEN outcome IN ('needs_human', 'failed') WHEN status = 'failed' THEN outcome = 'failed' OR (outcome = 'needs_human' AND error = 'ALL_CHUNKS_FAILED')
WHEN status = 'completed_with_warnings' THEN outcome = 'completed_with_warnings' OR (outcome = 'needs_human' AND warning = 'NO_REQUIREMENTS_FOUND')
WHEN status = 'completed' THEN CASE WHEN validated > 0 AND warning = 'none' THEN outcome = 'completed' ELSE outcome = 'failed' OR (outcome = 'needs_human' AND warning = 'NO_REQUIREMENTS_FOUND') END ELSE false END AS allowed FROM m""")
def finish_lattice(spark, sf_dir):
    rows = [
        (o, a, s, v, w, e)
        for o in ("completed", "completed_with_warnings", "needs_human", "failed") for a in (0, 1) for s in ("failed", "completed_with_warnings", "completed", "running")
        for v in (0, 3) for w in ("none", "NO_REQUIREMENTS_FOUND", "OTHER") for e in ("none", "ALL_CHUNKS_FAILED")
    ]
    made = spark.createDataFrame(rows, "outcome string, attempts int, status string, validated int, warning string, error string")
    codes = F.when(F.col("warning") == "none", F.expr("cast(array() as array<string>)")).otherwise(F.array("warning"))
    ok = agent.finish_allowed(F.col("outcome"), F.col("attempts"), F.col("status"), F.col("validated"), F.lit(0), F.lit(True), codes, F.col("error"), F.nullif("warning", F.lit("none")))
    return made.withColumn("allowed", ok)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'AGENT_TOOL_FORBIDDEN' WHEN o_orderkey % 4 = 0 THEN 'AGENT_CHUNKING_MODE_FORBIDDEN' WHEN o_totalprice::INTEGER % 40000 NOT BETWEEN 1000 AND 32000 THEN 'AGENT_PROMPT_BUDGET_OUT_OF_RANGE'
WHEN o_custkey % 6 > 3 THEN 'AGENT_OVERLAP_OUT_OF_RANGE' END AS violation FROM orders""")
def tool_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tool = F.when(F.col("o_orderstatus") == "P", "other").otherwise("run_requirement_extraction")
    mode = F.when(F.col("o_orderkey") % 4 == 0, "force").otherwise("auto")
    price = F.rint("o_totalprice").cast("int") % 40000  # halves to even, as the SQL's cast
    return o.select("o_orderkey", agent.tool_violation(tool, F.array(F.lit("run_requirement_extraction")), mode, F.array(F.lit("auto")), price, F.col("o_custkey") % 6).alias("violation"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS calls, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS failed_calls, sum(o_orderkey)::BIGINT AS seconds, CASE WHEN count(tok) = count(*) THEN sum(tok)::BIGINT END AS tokens
FROM (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS tok FROM orders) GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def usage_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("tokens", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")))
    return agent.usage_rollup(o, ["o_orderstatus", "o_orderpriority"], ["tokens"], "o_orderkey", F.col("o_totalprice") > 200000)


@query("""SELECT o_custkey, "F", "O", CASE WHEN "F" <> 0 THEN "O" / "F" END AS ratio FROM (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F", sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O" FROM orders GROUP BY ALL)
WHERE "F" IS NOT NULL AND "O" IS NOT NULL""")
def paired_modes(spark, sf_dir):
    return agent.paired_modes(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ("F", "O"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PDF_TABLE_SKIPPED:page=' || user_id || ',rows=-2' WHEN 1 THEN 'PDF_PAGE_NO_EXTRACTABLE_TEXT:page=' || user_id WHEN 2 THEN 'PARSER_WARNING' ELSE 'SHORT' END AS warnings FROM events""")
def safe_warnings(spark, sf_dir):
    k = F.col("event_id") % 4
    user = F.col("user_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("PDF_TABLE_SKIPPED rows=-2 page = "), user, F.lit(" huge=99999999 page=5"))).when(k == 1, F.concat(F.lit("page "), user, F.lit(" has no extractable text"))).when(k == 2, "free text page=3").otherwise("SHORT: nothing")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(agent.safe_warnings(F.array(raw, raw)), ";").alias("warnings"))


@query("""SELECT event_id, '{"a":[{"c":1.5},[true,null]],"k":' || json_extract_string(props, '$.k') || '}' AS safe FROM events""")
def nested_secrets_dropped(spark, sf_dir):
    """Secrets go at any depth, however their keys are written; types stay."""
    e = table(spark, sf_dir, "events")
    dirty = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "X-Api-Key": "x", "a": [{"My-Password": 1, "c": 1.5}, [true, null]], "cookie": {"b": 2}}'))
    return e.select("event_id", agent.canonical_body(dirty).alias("safe"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS safe FROM events""")
def secret_keys_dropped(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    dirty = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "API_KEY": "x", "my_password": "y"}'))
    return e.select("event_id", agent.sanitized(dirty).alias("safe"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_type, event_id FROM events)
SELECT user_id AS run, step, CASE WHEN step % 17 = 0 THEN 'NOT_RECORDED' ELSE 'REQUEST_DIFFERS' END AS problem FROM e WHERE step % 17 = 0 OR (event_id % 10 = 0 AND event_type <> 'click')""")
def replay_mismatches(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(w).cast("long"))
    asked = e.select(F.col("user_id").alias("run"), "step", F.sha2("event_type", 256).alias("request_fingerprint"))
    held = e.where("step % 17 <> 0").select(F.col("user_id").alias("run"), "step", F.sha2(F.when(F.col("event_id") % 10 == 0, "click").otherwise(F.col("event_type")), 256).alias("request_fingerprint"))
    return agent.replay_mismatches(asked, held)


@query("""SELECT user_id, 'kinds' AS "check", list_sort(list(DISTINCT event_type)) = ['click', 'error', 'purchase', 'signup', 'view'] AS passed FROM events GROUP BY user_id UNION ALL SELECT user_id, 'n', count(*) = 60 FROM events GROUP BY user_id""")
def agent_checks(spark, sf_dir):
    actual = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    expected = actual.select("user_id", kinds.alias("kinds"), F.lit(60).cast("long").alias("n"))
    return agent.exact_checks(expected, actual, "user_id")


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN f > 0 THEN 'PARTIAL_CHUNK_FAILURE' END, CASE WHEN v = 0 AND q > 0 THEN 'ALL_CANDIDATES_QUARANTINED' END, CASE WHEN r > 0 THEN 'MODEL_ITEMS_REJECTED' END], lambda x: x IS NOT NULL), ',') AS facts, f > 0 AS retryable
FROM (SELECT user_id, count(CASE WHEN event_type = 'signup' AND event_id % 9 = 0 THEN 1 END) AS f, count(CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 1 END) AS v, count(CASE WHEN event_type = 'click' THEN 1 END) AS q, count(CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 END) AS r FROM events GROUP BY user_id)""")
def inspection_facts(spark, sf_dir):
    n = lambda kind, by: F.count_if((F.col("event_type") == kind) & (F.col("event_id") % by == 0))
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(n("signup", 9).alias("chunks_failed"), n("purchase", 29).alias("validated"), n("click", 1).alias("quarantined"), n("error", 7).alias("rejected"))
    none = F.expr("cast(array() as array<string>)")
    found = agent.inspection_facts({c: F.col(c) for c in counted.columns}, none, none, F.lit("other"))
    return counted.select("user_id", F.array_join(found["facts"], ",").alias("facts"), found["retryable"].alias("retryable"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'TASK_NOT_READABLE' WHEN o_orderkey % 3 = 0 THEN 'RUN_GENERATION_MISMATCH' WHEN o_orderkey % 5 = 0 THEN 'EVIDENCE_FINGERPRINT_MISMATCH' END AS code FROM orders""")
def task_guards(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    code = agent.task_readable(status, (k % 3 == 0).cast("int"), F.lit(0), F.when(k % 5 != 0, "f"), F.lit("f"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))


@query("""SELECT doc_id, trim(text, ' ' || chr(10)) AS statement, 'unknown' AS ears_pattern, CASE WHEN lang = 'en' THEN 'en' ELSE 'unknown' END AS verification_method FROM documents""")
def requirement_defaults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \n "), "text", F.lit("\n")).alias("statement"), F.lit(None).cast("string").alias("ears_pattern"), F.when(F.col("lang") == "en", "en").otherwise("").alias("verification_method"))
    return items.normalized_requirements(docs)


@query("""SELECT event_id, sha256('{"adapter":"' || event_type || '","body":"{\\"k\\":' || json_extract_string(props, '$.k') || '}","endpoint":"e"}') AS fingerprint FROM events""")
def request_fingerprints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    dirty = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "Authorization": "x"}'))
    return e.select("event_id", chunking.request_fingerprint(F.col("event_type"), F.lit("e"), dirty).alias("fingerprint"))


@query("""SELECT event_id, sha256('{"adapter":"a","body":"{\\"a\\":{\\"c\\":[2,{\\"d\\":' || event_id || '}]},\\"k\\":\\"' || event_type || '\\",\\"z\\":null}","endpoint":"e"}') AS fingerprint, true AS same FROM events""")
def request_digests(spark, sf_dir):
    """Bodies with nested and hyphenated secrets, their keys in two orders: one digest, types kept."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    one = F.concat(F.lit('{"z": null, "k": "'), kind, F.lit('", "a": {"c": [2, {"X-Api-Key": 1, "d": '), n, F.lit('}], "My-Password": {"e": 1}}}'))
    two = F.concat(F.lit('{"a": {"my_password": 2, "c": [2, {"d": '), n, F.lit(', "api-key": "y"}]}, "Cookie": "c", "k": "'), kind, F.lit('", "z": null}'))
    made = [chunking.request_fingerprint(F.lit("a"), F.lit("e"), body) for body in (one, two)]
    return table(spark, sf_dir, "events").select("event_id", made[0].alias("fingerprint"), (made[0] == made[1]).alias("same"))


@query(f"WITH {_RANGES_SQL} SELECT doc_id, item_id FROM pairs WHERE item_id % 3 = 0")
def source_key_mismatches(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    key = text.source_key(F.lit("f"), F.col("doc_id").cast("string"), F.lit("blk_0001"), F.col("quote"), none, F.lit(None).cast("int"))
    stated = F.when(F.col("item_id") % 6 == 0, "src_0").when(F.col("item_id") % 3 != 0, key)
    return quotes.key_mismatches(quoted(spark, sf_dir).withColumn("source_key", stated), key).select("doc_id", "item_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'table_cell' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN ',' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'text_range' ELSE '' END AS missing,
CASE WHEN o_orderkey % 5 = 0 THEN 'page_region' ELSE '' END AS forbidden, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS passed FROM orders""")
def capability_observations(spark, sf_dir):
    k = F.col("o_orderkey")
    held = F.array_compact(F.array(F.when(k % 2 != 0, "text_range"), F.when(k % 3 != 0, "table_cell"), F.when(k % 5 == 0, "page_region")))
    found = evaluate.capability_observation(F.array(F.lit("text_range"), F.lit("table_cell")), F.array(F.lit("page_region")), held)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found["missing"], ",").alias("missing"), F.array_join(found["forbidden"], ",").alias("forbidden"), found["passed"].alias("passed"))


@query("SELECT o_orderkey, least(2.0::DOUBLE, 2000.0::DOUBLE / (o_custkey + 500), 2000.0::DOUBLE / (o_orderkey % 3000 + 1)) AS scale FROM orders")
def preview_scales(spark, sf_dir):
    scale = geometry.preview_scale(F.col("o_custkey") + 500, F.col("o_orderkey") % 3000 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", scale.alias("scale"))


# Export, search and migration ------------------------------------------------------------------


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requirements, quoted benchmark passages as their sources."""
    found = quoted(spark, sf_dir).select("doc_id", F.struct(F.col("item_id").alias("n"), F.lit("S").alias("section"), F.format_string("blk_%04d", F.col("item_id")).alias("block_id"), F.col("quote"), F.lit("PASS_EXACT").alias("match_status")).alias("s"))
    sources = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(sources, "doc_id", "left")
    none = F.lit(None).cast("string")
    return docs.select(
        F.format_string("REQ-%04d", "doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("type"), *[none.alias(c) for c in ("ears_pattern", "statement", "subject", "condition", "response", "priority", "verification_method")],
        F.lit(0.5).alias("confidence"), F.lit("pending").alias("review_status"), F.coalesce("sources", F.expr("cast(array() as array<struct<n: bigint, section: string, block_id: string, quote: string, match_status: string>>)")).alias("sources"), F.array("lang", "source").alias("tags"),
    )


_ID = "'REQ-' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END"


@query(f"""WITH {_RANGES_SQL}, f AS (SELECT doc_id, min(item_id) AS item_id FROM ranges GROUP BY doc_id)
SELECT {_ID} AS id, lang AS type, CASE WHEN f.item_id IS NOT NULL THEN 'blk_' || lpad(f.item_id::VARCHAR, 4, '0') END AS block_id, b.text AS quote, CASE WHEN f.item_id IS NOT NULL THEN 'PASS_EXACT' END AS match_status, lang || ', ' || source AS tags
FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN benchmark b ON b.item_id = f.item_id""")
def export_rows(spark, sf_dir):
    flat = export.flat_rows(requirements(spark, sf_dir))
    return flat.select(F.col("ID").alias("id"), F.col("Type").alias("type"), F.col("Source Block ID").alias("block_id"), F.col("Source Quote").alias("quote"), F.col("Source Match Status").alias("match_status"), F.col("Tags").alias("tags"))


@query(f"""WITH {_RANGES_SQL} SELECT {_ID} AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY item_id) - 1)::INTEGER AS source_index, 'blk_' || lpad(item_id::VARCHAR, 4, '0') AS block_id, 'PASS_EXACT' AS match_status FROM ranges""")
def source_map(spark, sf_dir):
    return export.source_map(requirements(spark, sf_dir), "id", "sources", ["block_id", "match_status"])


@query(f"""WITH {_RANGES_SQL} SELECT {_ID} AS id, coalesce(s, 'UNVERIFIED') AS statuses, s IS NOT NULL AS any_grounded FROM documents LEFT JOIN (SELECT doc_id, string_agg('PASS_EXACT', ', ') AS s FROM ranges GROUP BY doc_id) USING (doc_id)""")
def source_statuses(spark, sf_dir):
    r = requirements(spark, sf_dir)
    return r.select("id", export.status_list(F.col("sources")).alias("statuses"), quotes.grounded(F.transform("sources", lambda s: s["match_status"]))["any_grounded"].alias("any_grounded"))


@query()
def workbooks(spark, sf_dir):
    """A workbook per language, as its size in bytes and a digest."""
    flat = export.flat_rows(requirements(spark, sf_dir)).withColumn("document", F.col("Type"))
    return export.workbooks(flat, "document").select("document", F.octet_length("xlsx").alias("bytes"), F.sha2("xlsx", 256).alias("digest"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '#00000001')""")
def search_filter(spark, sf_dir):
    wanted = F.lower(F.trim(F.lit("  #00000001 ")))
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.contains(F.lower(F.coalesce("c_name", F.lit(""))), wanted)).select("c_custkey", "c_name")


@query("""SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS pending, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS approved, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS needs_recheck, count(CASE WHEN o_orderstatus = 'X' THEN 1 END) AS rejected FROM orders""")
def status_summary(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), n("O").alias("pending"), n("F").alias("approved"), n("P").alias("needs_recheck"), n("X").alias("rejected"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("text", F.lit("!")).cast("binary"))).otherwise(F.md5(F.col("text").cast("binary"))).alias("key"))
    return migrate.source_changes(old, new, ["doc_id"], "key")


_CHANGES_SQL = """o AS (SELECT doc_id, md5(text) AS k FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS k FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT doc_id, o.k AS old, n.k AS new, CASE WHEN o.k IS NULL THEN 'bound' WHEN n.k IS NULL THEN 'lost' WHEN o.k = n.k THEN 'kept' ELSE 'rebound' END AS change FROM o FULL JOIN n USING (doc_id))"""


@query(f"WITH {_CHANGES_SQL} SELECT doc_id, old, new, change FROM c")
def migration_diff(spark, sf_dir):
    return changed(spark, sf_dir)


@query(f"""WITH {_CHANGES_SQL} SELECT count(*) AS total, count(DISTINCT old) AS old_ids, count(DISTINCT new) AS new_ids, count(DISTINCT CASE WHEN change = 'rebound' THEN old || '>' || new END) AS rebound_pairs,
count(DISTINCT CASE WHEN change = 'bound' THEN new END) AS newly_bound, count(CASE WHEN change = 'lost' THEN 1 END) AS lost FROM c""")
def migration_statistics(spark, sf_dir):
    return migrate.change_statistics(changed(spark, sf_dir))

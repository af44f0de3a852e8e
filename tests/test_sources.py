import io
import zipfile

from pyspark.sql import functions as F

from quillmark.operators import chunking
from quillmark.sources import artifacts, blocks

MARKDOWN = """# Title

intro line
second line
## Part
- one
- two

| a | b |
|---|---|
> quoted
> more
```python
x = 1

# not a heading
```
### Deep
text
## Other
1. first
   
tail"""


def test_markdown_blocks():
    got = blocks.markdown_blocks(MARKDOWN)
    assert [b["type"] for b in got] == ["heading", "paragraph", "heading", "list", "table", "blockquote", "code", "heading", "paragraph", "heading", "list", "paragraph"]
    assert got[1]["text"] == "intro line\nsecond line" and got[6]["text"].endswith("# not a heading\n```")
    assert got[8]["section_path"] == ["Title", "Part", "Deep"] and got[-1]["section_path"] == ["Title", "Other"]
    assert [b["block_id"] for b in got][:2] == ["blk_0001", "blk_0002"] and blocks.markdown_blocks("") == []
    assert blocks.markdown_blocks("```\nopen")[0]["text"] == "```\nopen"


def test_html_blocks():
    got = blocks.html_blocks("<title>x</title><h1>A</h1><p>one <b>two</b></p><script>p('<p>no</p>')</script><h3>C</h3><ul><li>i<li>j</ul><table><tr><td>1<td>2</tr></table>")
    assert [(b["type"], b["text"]) for b in got] == [("heading", "A"), ("paragraph", "one two"), ("heading", "C"), ("list", "i"), ("list", "j"), ("table", "1 | 2")]
    assert got[-1]["section_path"] == ["A", "C"]


def docx(body: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def cell(text, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def test_docx_blocks():
    heading = '<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p>'
    item = "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t> an  item </w:t></w:r></w:p>"
    rows = f"<w:tr>{cell('wide', '<w:gridSpan w:val=&quot;2&quot;/>'.replace('&quot;', chr(34)))}</w:tr>" + f"<w:tr>{cell('a|b', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('c')}</w:tr>" + f"<w:tr>{cell('', '<w:vMerge/>')}{cell('d')}</w:tr>"
    got = blocks.docx_blocks(docx(f"{heading}<w:p/>{item}<w:tbl>{rows}</w:tbl>" + "<w:tbl>" + f"<w:tr>{cell('r')}</w:tr>" * 45 + "</w:tbl>"))
    assert [b["type"] for b in got] == ["heading", "list", "table", "table", "table", "table"]
    assert got[0]["level"] == 2 and got[1]["text"] == "an item"
    assert got[2]["text"] == "wide | wide\na\\|b | c\na\\|b | d"
    assert [b["text"].count("r") for b in got[3:]] == [20, 20, 5]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / "b.HTML").write_text("<p>y</p>")
    (tmp_path / "c.docx").write_bytes(docx("<w:p><w:r><w:t>z</w:t></w:r></w:p>"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = blocks.read_documents(spark, str(tmp_path)).collect()
    assert sorted((r.document_id[-4:], r.type, r.text) for r in got) == [(".pdf", "unsupported", "pdf"), ("HTML", "paragraph", "y"), ("a.md", "heading", "T"), ("a.md", "paragraph", "x"), ("docx", "paragraph", "z")]


def test_window_sections_agree_with_parsers(spark):
    parsed = blocks.parse(spark.createDataFrame([("d", MARKDOWN), ("e", "### c\na\n# x\nb"), ("n", None)], "id string, t string"), "id", "t", "markdown")
    again = blocks.section_paths(parsed.withColumnRenamed("section_path", "want"))
    assert again.where("section_path <> want").count() == 0 and again.count() == 16
    rendered = blocks.render_markdown(parsed).where("document_id = 'e'").first().markdown
    assert rendered == "### c\n\na\n\n# x\n\nb\n"


def test_line_blocks(spark):
    got = blocks.line_blocks(spark.createDataFrame([(1, "a\n \n　\nb"), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert [(r.document_id, r.block_id, r.text) for r in got] == [(1, "blk_0001", "a"), (1, "blk_0002", "b")]


def test_packages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": "reqir_v4", "items": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    (tmp_path / "c.json").write_text('{"schema_version": "reqir_v9", "items": [{"id": "4"}]}')
    got = artifacts.read_packages(spark, str(tmp_path), "struct<id: string>").collect()
    assert sorted((r.path[-6:], r.error, r.item.id if r.item else None) for r in got) == [("a.json", None, "1"), ("a.json", None, "2"), ("b.json", None, "3"), ("c.json", "UNSUPPORTED_VERSION", None)]
    items = spark.createDataFrame([("d", 2, "y"), ("d", 1, "x")], "doc string, `order` int, id string")
    package = artifacts.write_package(items, "doc", F.struct(F.col("doc").alias("document"))).first().package
    assert package == '{"schema_version":"reqir_v4","metadata":{"document":"d"},"items":[{"id":"x"},{"id":"y"}]}'


def test_recorded_items(spark):
    schema = "request_fingerprint string, chunk_id string, chunk_fingerprint string, block_ids array<string>"
    asked = spark.createDataFrame([("f1", "c1", "x", ["b"]), ("f2", "c2", "x", ["b"]), ("f3", "c3", "x", ["b"]), ("f4", "c4", "x", ["b"]), ("f5", "c5", "x", ["b"])], schema)
    held = spark.createDataFrame([("f1", "c1", "x", ["b"], "{}"), ("f2", "c9", "x", ["b"], "{}"), ("f3", "c3", "y", ["b"], "{}"), ("f4", "c4", "x", ["c"], "{}")], schema + ", payload string")
    got = {r.request_fingerprint: (r.error_code, r.payload) for r in artifacts.recorded_items(asked, held).collect()}
    assert got == {"f1": (None, "{}"), "f2": ("RECORDED_CHUNK_ID_MISMATCH", None), "f3": ("RECORDED_CHUNK_FINGERPRINT_MISMATCH", None), "f4": ("RECORDED_BLOCK_IDS_MISMATCH", None), "f5": ("RECORDED_RESPONSE_MISSING", None)}


def held(n, size=60):
    out, path = [], ()
    for i in range(n):
        if i % 5 == 0:
            path = (f"S{i // 10}",) if i % 10 == 0 else (*path[:1], f"T{i}")
            out.append(chunking.Block(f"blk_{i:04d}", "heading", path[-1], path))
        else:
            out.append(chunking.Block(f"blk_{i:04d}", "paragraph", "x" * size, path))
    return out


def test_chunks_cover_all_blocks_within_the_budget():
    for overlap in (0, 1, 3):
        rows = held(50)
        parts = chunking.plan(rows, chunking.Config("force", 900, overlap))
        assert [b for p, _ in parts for b in p.new] == rows
        assert all(len(chunking.render(p, i, len(parts))) <= 900 for i, (p, w) in enumerate(parts, 1)) and not any(w for _, w in parts)
        assert any(p.overlap for p, _ in parts)
    parts = chunking.plan(held(10, 3000), chunking.Config("force", 900, 1))
    assert sum(w == ["CHUNK_OVERSIZED_BLOCK"] for _, w in parts) == 8
    whole = chunking.plan(held(10), chunking.Config("off", 100))
    assert len(whole) == 1 and whole[0][1] == ["CHUNK_PROMPT_OVER_BUDGET"]
    assert len(chunking.plan(held(10), chunking.Config("auto", 100_000))) == 1 < len(chunking.plan(held(30), chunking.Config("auto", 1500)))


def test_chunk_rows(spark):
    rows = [("d", b.block_id, i, b.type, b.text, list(b.section_path)) for i, b in enumerate(held(30))] + [("e", "blk_0000", 1, "paragraph", None, None)]
    df = spark.createDataFrame(rows, "document_id string, block_id string, `order` int, type string, text string, section_path array<string>")
    got = chunking.plan_chunks(df, chunking.Config("force", 900, 1)).collect()
    assert sorted(x for r in got if r.document_id == "d" for x in r.new_block_ids) == [b.block_id for b in held(30)]
    assert [r.chunk_id for r in got if r.document_id == "e"] == ["chk_00000001"] and len({r.chunk_fingerprint for r in got}) == len(got)


def test_texts_are_spread_over_all_cores(spark, tmp_path):
    from quillmark.sources.tables import read_table

    for name in ("documents", "region"):
        spark.range(20).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert read_table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == cores
    assert read_table(spark, str(tmp_path), "region").rdd.getNumPartitions() == 1
    spark.range(0, 100, 1, cores + 3).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.id for r in read_table(spark, str(tmp_path), "pages").collect()) == list(range(100))

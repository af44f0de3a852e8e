import pytest
from pyspark.sql import functions as F

from quillmark.operators import agent, items, reading, tables

CELLS = "cell_id string, table_id string, row int, column int, row_span int, column_span int, text string"


def test_canonical_selection(spark):
    cells = [("a", "t", 1, 1, 2, 1, "A"), ("b", "t", 1, 2, 1, 1, "B"), ("e", "t", 1, 3, 1, 1, "  "), ("c", "t", 1, 4, 1, 1, "C"), ("d", "t", 2, 3, 1, 1, "D"), ("x", "u", 1, 1, 1, 1, "X")]
    occ = [("blk", c[0], r) for c in cells for r in range(c[2], c[2] + c[4])]
    asked = [
        ("ok", "blk", "t", 1, ["c", "b", "a"]), ("empty_between", "blk", "t", 1, ["b", "e", "c"]), ("omits", "blk", "t", 1, ["a", "c"]), ("outside", "blk", "t", 1, ["b", "e"]),
        ("all_empty", "blk", "t", 1, ["e"]), ("row2", "blk", "t", 2, ["a"]), ("gap", "blk", "t", 2, ["a", "d"]), ("off", "blk", "t", 2, ["b"]), ("foreign", "blk", "t", 1, ["x"]),
        ("unknown", "blk", "t", 1, ["zz"]), ("twice", "blk", "t", 1, ["a", "a"]), ("none", "blk", "t", None, []), ("row_only", "blk", "t", 1, []), ("no_row", "blk", "t", None, ["a"]), ("no_table", "blk", None, 1, ["a"]),
    ]
    got = tables.canonical_selection(
        spark.createDataFrame(asked, "source_key string, block_id string, table_id string, row_index int, cell_ids array<string>"),
        spark.createDataFrame(cells, CELLS), spark.createDataFrame([("t", 2, True), ("u", 1, False)], "table_id string, rows int, sparse boolean"),
        spark.createDataFrame(occ, "block_id string, cell_id string, row_index int"),
    )
    assert {r.source_key: (r.error, r.cell_ids) for r in got.collect()} == {
        "ok": (None, ["a", "b", "c"]), "empty_between": (None, ["b", "c"]), "omits": ("TEXT_LEFT_OUT", None), "outside": ("EMPTY_CELL_OUTSIDE", None), "all_empty": ("ALL_CELLS_EMPTY", None),
        "row2": (None, ["a"]), "gap": ("UNKNOWN_GAP", None), "off": ("CELL_NOT_IN_ROW", None), "foreign": ("CELL_OF_ANOTHER_TABLE", None), "unknown": ("UNKNOWN_CELL", None),
        "twice": ("CELLS_REPEATED", None), "none": (None, []), "row_only": ("ROW_WITHOUT_CELLS", None), "no_row": ("CELLS_WITHOUT_ROW", None), "no_table": ("BLOCK_WITHOUT_TABLE", None),
    }


def test_occurrence_rules(spark):
    cells = spark.createDataFrame([("h", "t", 1, 1, True), ("s", "t", 2, 2, False), ("m", "t", 2, 1, False)], "cell_id string, table_id string, row int, row_span int, is_header boolean")
    blocks = spark.createDataFrame([("b1", 1, 1, 2), ("b2", 2, 3, 4)], "block_id string, position int, first_row int, last_row int")
    rows = [("o1", "b1", "h", 1, "original"), ("o2", "b2", "h", 1, "repeated_header"), ("o3", "b1", "s", 2, "original"), ("o4", "b2", "s", 3, "row_span_projection"), ("o5", "b1", "s", 2, "duplicate_text_occurrence"), ("bad1", "b1", "h", 1, "repeated_header"), ("bad2", "b2", "s", 2, "row_span_projection"), ("bad3", "b2", "m", 2, "duplicate_text_occurrence")]
    got = tables.occurrence_violations(spark.createDataFrame(rows, "occurrence_id string, block_id string, cell_id string, row_index int, role string"), cells, blocks)
    assert sorted(map(tuple, got.collect())) == [("bad1", "HEADER_NOT_PROJECTED"), ("bad2", "PROJECTION_NOT_IN_SPAN"), ("bad3", "DUPLICATE_WITHOUT_SUPPORT"), ("m", "NOT_ONE_ORIGINAL")]


def test_fingerprints_are_canonical(spark):
    rows = spark.createDataFrame([('{"b": 1.00004, "a": [-0.00001]}',), ('{"a":[0.0],"b":1.0}',), ('{"a":[0.0],"b":1.1}',), (None,)], "j string")
    got = [r.f for r in rows.select(tables.fingerprint(F.col("j")).alias("f")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    with pytest.raises(ValueError):
        tables.canonical(float("nan"))


def block(block_id, x0, y0, x1, y1, source, **more):
    return {"block_id": block_id, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "source": source, **more}


def test_columns_are_read_one_after_another():
    rows = [block("r1", 55, 20, 95, 30, 1), block("l1", 0, 20, 45, 30, 2), block("title", 0, 0, 100, 10, 3), block("l2", 0, 40, 45, 50, 4), block("bar", 0, 60, 100, 70, 5), block("r2", 55, 80, 95, 90, 6), block("l3", 0, 82, 45, 90, 7), block("lost", None, None, None, None, 3.5)]
    got = reading.order_blocks(rows, 100)
    assert [b["block_id"] for b, _ in got] == ["title", "lost", "l1", "l2", "r1", "bar", "l3", "r2"]
    assert [c for _, c in got] == [1, 1, 1, 1, 2, 1, 1, 2]
    single = [block("b", 0, 20, 45, 30, 1), block("a", 50, 0, 95, 10, 2)]
    assert [b["block_id"] for b, _ in reading.order_blocks(single, 100)] == ["a", "b"]
    assert reading.order_blocks([block("x", None, None, None, None, 1)], 100)[0][1] == 1


def test_bold_headings(spark):
    schema = "document_id string, page int, reading_order int, column_index int, type string, text string, bold boolean, font_size double, x0 double, y0 double, x1 double, y1 double, width double, height double"
    place = (0.0, 100.0, 50.0, 110.0, 100.0, 1000.0)
    rows = [
        ("d", 1, 1, 1, "paragraph", "Scope", True, 10.0, *place), ("d", 1, 2, 1, "paragraph", "Body text.", False, 10.0, 0.0, 120.0, 50.0, 130.0, 100.0, 1000.0),
        ("d", 1, 3, 1, "paragraph", "Name: value", True, 10.0, 0.0, 140.0, 50.0, 150.0, 100.0, 1000.0), ("d", 1, 4, 1, "paragraph", "It must hold", True, 10.0, 0.0, 160.0, 50.0, 170.0, 100.0, 1000.0),
        ("d", 1, 5, 1, "paragraph", "2.1 Numbered", True, 10.0, 0.0, 400.0, 50.0, 410.0, 100.0, 1000.0), ("d", 1, 6, 1, "paragraph", "Far away", True, 10.0, 0.0, 500.0, 50.0, 510.0, 100.0, 1000.0),
        ("d", 1, 7, 1, "paragraph", "Text.", False, 10.0, 0.0, 700.0, 50.0, 710.0, 100.0, 1000.0), ("d", 1, 8, 1, "paragraph", "Last", True, 10.0, 0.0, 900.0, 50.0, 910.0, 100.0, 1000.0), ("d", 2, 1, 1, "paragraph", "Top text.", False, 10.0, 0.0, 100.0, 50.0, 110.0, 100.0, 1000.0),
    ]
    got = reading.bold_headings(spark.createDataFrame(rows, schema)).where("is_heading").select("text").collect()
    assert sorted(r.text for r in got) == ["2.1 Numbered", "Last", "Scope"]


def test_fixture_items_go_to_their_chunks(spark):
    found = items.items_of_chunks(spark.createDataFrame([("d", "b1", "i"), ("d", "b9", "j")], "document_id string, source_block_id string, item string"), spark.createDataFrame([("d", "c1", "b1"), ("d", "c2", "b1"), ("e", "c3", "b1")], "document_id string, chunk_id string, block_id string"))
    assert sorted((r.chunk_id, r.item) for r in found.collect()) == [("c1", "i"), ("c2", "i")]


def test_exact_checks_of_lists(spark):
    a = spark.createDataFrame([("x", [1, 2], None), ("y", [1], "e")], "case string, steps array<int>, error string")
    b = spark.createDataFrame([("x", [1, 2], None), ("y", [1, 3], "e")], "case string, steps array<int>, error string")
    got = {(r.case, r.check): r.passed for r in agent.exact_checks(a, b, "case").collect()}
    assert got == {("x", "steps"): True, ("x", "error"): True, ("y", "steps"): False, ("y", "error"): True}

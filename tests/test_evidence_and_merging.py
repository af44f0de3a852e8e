"""Operators that compose others, against literal cases."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as t
from quillmark.operators import evaluate, export, merge, quotes, validate
from quillmark.sources import artifacts, blocks


def test_duplicate_members_and_marks(spark):
    rows = [("d", "R1", 1, "s1", ["i1"]), ("d", "R2", 2, "s1", ["i2"]), ("d", "R3", 3, "s2", ["i2", "i3"]), ("d", "R4", 4, "s3", ["i3", "i4"]), ("d", "R3", 3, "s2", ["i4"]), ("e", "R1", 1, "s1", ["i1"])]
    found = merge.duplicate_members(spark.createDataFrame(rows, "document_id string, id string, order int, statement_key string, source_identities array<string>"))
    groups = {}
    for r in found.collect():
        groups.setdefault((r.document_id, r.group_id, r.reason), set()).add(r.id)
    # the sources i3 and i4 have the same members and are one group
    assert groups == {("d", "DUP-0001", "normalized_statement_equal"): {"R1", "R2"}, ("d", "DUP-0002", "same_source_divergent_statement"): {"R2", "R3"}, ("d", "DUP-0003", "same_source_divergent_statement"): {"R3", "R4"}}
    marks = {r.id: (r.duplicate_group_id, r.possible_group_id) for r in merge.duplicate_marks(found).collect()}
    assert marks == {"R1": ("DUP-0001", "DUP-0001"), "R2": ("DUP-0001", "DUP-0002"), "R3": ("DUP-0002", "DUP-0003"), "R4": ("DUP-0003", "DUP-0003")}


def test_strict_gate(spark):
    good = spark.createDataFrame([("a", True)], "document_id string, valid boolean")
    bad = good.union(spark.createDataFrame([("b", False)], good.schema))
    validate.require_valid("strict", source=good)
    validate.require_valid("quarantine", source=bad)
    with pytest.raises(ValueError, match="locator"):
        validate.require_valid("strict", source=good, locator=bad)
    with pytest.raises(ValueError, match="unknown"):
        validate.require_valid("loose", source=good)


def test_scope(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["b"]), (["a"], []), ([], ["b"]), (None, ["b"])], "bs array<string>, scope array<string>")
    assert [r[0] for r in rows.coalesce(1).select(evaluate.in_scope(F.col("bs"), F.col("scope"))).collect()] == [True, False, True, False, False]


def test_selection_ladder(spark):
    schema = "d string, n int, source struct<source_key: string, document_id: string, block_id: string, quote: string, canonical_cell_ids: array<string>, cell_ids: array<string>, row_index: int, start: int, end: int>"
    base = ("d", "b", "q")
    rows = [("d", 1, ("k", *base, ["c"], None, None, None, None)), ("d", 2, (None, *base, ["c"], None, None, None, None)), ("d", 3, ("k", *base, None, None, None, None, None)), ("d", 4, (None, *base, None, None, 2, 0, 5)), ("d", 5, (None, *base, None, None, None, None, None))]
    got = {r.n: r for r in export.selections(spark.createDataFrame(rows, schema), ["d"], "n").collect()}
    # 2 is known by its cells, as 1 is too; 5 is known by its quote, as all are
    assert [got[n].occurrence for n in range(1, 6)] == [0, 1, 1, 0, 4] and got[1].identity == got[3].identity == "k"
    assert '"row":2' in got[4].identity and '"canonical_cells"' in got[2].identity


def test_ranges_of_long_texts_without_ascii(spark):
    text = "äö€" * 1_000_000 + "end" + "äö€"
    rows = spark.createDataFrame([(text, "end"), ("a" * 3000, "aa"), (r"x\Ey\E.", r"\E"), ("€€€", "€€"), ("ab", ""), ("ab", "abc")], "text string, quote string")
    got = [[tuple(x) for x in r.x] for r in rows.coalesce(1).select(t.exact_ranges(F.col("text"), F.col("quote")).alias("x")).collect()]
    assert got[0] == [(3_000_000, 3_000_003)] and got[1] == [(i, i + 2) for i in range(2999)]
    assert got[2:] == [[(1, 3), (4, 6)], [(0, 2), (1, 3)], [], []]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_short_quotes_and_copies(spark, limit):
    texts = ["a bc de", "a bc de", "é ü", "", None, "bcd"]
    wanted = ["bc", "c d", "é", " ", "a bc de", "bcd", "", None, "zz", "bc de"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    q = spark.createDataFrame(list(enumerate(wanted)), "id int, quote string")
    got = sorted(tuple(r) for r in quotes.contained_quotes(d, q, max_broadcast_bytes=limit).select("doc", "id").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, w in enumerate(wanted) if x and w and w in x)


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.xyz").write_text("?")
    (tmp_path / "e.lines").write_text("one\ntwo")
    blocks.register_parser("lines", lambda x: [{"block_id": f"blk_{n:04d}", "order": n, "type": "paragraph", "text": y, "section_path": [], "level": None} for n, y in enumerate(x.split("\n"), 1)], ("lines",))
    try:
        got = sorted((r.document_id.split("/")[-1], r.order, r.type) for r in blocks.read_documents(spark, str(tmp_path)).collect())
    finally:
        del blocks.PARSERS["lines"], blocks.SUFFIXES["lines"]
    assert got == [("a.md", 1, "heading"), ("a.md", 2, "paragraph"), ("b.md", 0, "unreadable"), ("c.docx", 0, "unreadable"), ("d.xyz", 0, "unsupported"), ("e.lines", 1, "paragraph"), ("e.lines", 2, "paragraph")]
    with pytest.raises(ValueError):
        blocks.register_parser("other", len, ("md",))


def test_cases_are_found_in_any_folder(spark, tmp_path):
    for name, body in (("a/x", '{"case_id": "one", "mode": "mock"}'), ("b", "[1"), ("c/d/e", '{"case_id": "two"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "case.json").write_text(body)
    got = artifacts.read_cases(spark, str(tmp_path), "case_id string, mode string").collect()
    assert sorted((r.folder.split("/")[-1], r.case_id) for r in got if r.case_id) == [("e", "two"), ("x", "one")] and len(got) == 3


def test_parsers_paths_are_those_of_windows(spark):
    text = "# A\n\n### B\n\nx\n\n## C\n\ny\n\n# D\n\nz"
    parsed = blocks.parse(spark.createDataFrame([("d", text)], "id string, t string"), "id", "t", "markdown").withColumnRenamed("section_path", "parsed")
    got = blocks.section_paths(parsed).collect()
    assert all(r.parsed == r.section_path for r in got) and len(got) == 7

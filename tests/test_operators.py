import itertools
import random
import time
import zipfile
import io

from pyspark.sql import functions as F

from quillmark.functions import rates
from quillmark.operators import agent, evaluate, evidence, export, items, layout, merge, quotes, review, validate
from quillmark.streaming import logs


def test_merge_collapses_and_marks_conflicts(spark):
    schema = "doc string, key string, local string, chunk_id string, type string, priority string, confidence double, tags array<string>, review_status string"
    rows = [("d", "a", "1", "c1", "functional", "unknown", 0.2, ["x"], "pending"), ("d", "a", "2", "c2", "constraint", "high", 0.9, ["y", "x"], "pending"), ("d", "b", "3", "c1", "unknown", None, 0.1, [], "pending")]
    got = {r.key: r for r in merge.merge_candidates(spark.createDataFrame(rows, schema), ["doc", "key"], [F.col("local")], ("type", "priority")).collect()}
    a = got["a"]
    assert (a.variants, a.confidence, a.tags, a.source_chunk_ids, a.field_conflicts, a.review_status, a.type, a.priority) == (2, 0.9, ["x", "y"], ["c1", "c2"], ["type"], "needs_recheck", "functional", "high")
    assert (got["b"].type, got["b"].priority, got["b"].review_status) == ("unknown", None, "pending")


def test_duplicate_groups(spark):
    rows = [("d", "R1", "s1", ["i1"]), ("d", "R2", "s1", ["i2"]), ("d", "R3", "s2", ["i2", "i3"]), ("e", "R1", "s1", ["i1"])]
    got = merge.duplicate_groups(spark.createDataFrame(rows, "document_id string, id string, statement_key string, source_identities array<string>")).collect()
    assert sorted((r.reason, r.members) for r in got) == [("normalized_statement_equal", ["R1", "R2"]), ("same_source_divergent_statement", ["R2", "R3"])]


def brute_assignment(edges, n, m):
    best = (0, 0, 0)
    for k in range(min(n, m), 0, -1):
        for chosen in itertools.combinations(range(len(edges)), k):
            if len({edges[e][0] for e in chosen}) == k == len({edges[e][1] for e in chosen}):
                best = max(best, (k, sum(edges[e][2] for e in chosen), -sum(chosen)))
        if best[0]:
            return best
    return best


def test_assignment_is_largest_then_heaviest():
    rng = random.Random(1)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        pairs = [(a, b) for a in range(n) for b in range(m) if rng.random() < 0.6]
        edges = [(a, b, rng.choice([10, 19, 20, 29, 69])) for a, b in pairs]
        got = evaluate.assign(edges, n, m)
        assert len({edges[e][0] for e in got}) == len(got) == len({edges[e][1] for e in got})
        assert (len(got), sum(edges[e][2] for e in got), -sum(got)) == brute_assignment(edges, n, m)


def test_matching_prefers_more_pairs(spark):
    schema = "group_id string, block_id string, {0}_id string, quote string, source_index int"
    c = spark.createDataFrame([("g", "b1", "C1", "specific", 0), ("g", "b2", "C1", "shared", 1), ("g", "b1", "C2", "specific", 0)], schema.format("candidate"))
    g = spark.createDataFrame([("g", "b1", "G1", "specific", 0), ("g", "b2", "G2", "shared", 0)], schema.format("gold"))
    edges = evaluate.source_edges(c, g)
    assert {(r.candidate_id, r.gold_id) for r in evaluate.match_one_to_one(edges).collect()} == {("C1", "G2"), ("C2", "G1")}
    statements = spark.createDataFrame([("g", "C1", "s"), ("g", "C2", "t")], "group_id string, candidate_id string, statement string")
    accepted = spark.createDataFrame([("g", "G1", "s", False), ("g", "G1", "t", True), ("g", "G2", "s", True)], "group_id string, gold_id string, statement string, primary boolean")
    got = {(r.candidate_id, r.gold_id): r.quality for r in evaluate.statement_edges(edges, statements, accepted).collect()}
    assert got == {("C1", "G1"): 59, ("C2", "G1"): 69, ("C1", "G2"): 68}


def test_empty_denominators(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (2, 4, 1)], "gold int, cand int, hit int")
    p = rates.precision_recall_f1(F.col("hit"), F.col("cand"), F.col("gold"))
    assert [tuple(r) for r in rows.select(p["precision"], p["recall"], p["f1"]).collect()] == [(1, 1, 1), (0, 0, 0), (0, 1, 0), (0.25, 0.5, 1 / 3)]
    assert rows.select(rates.known_total(F.when(F.col("gold") > 0, F.col("gold")))).first()[0] is None


def test_items_first_error_wins(spark):
    chunks = spark.createDataFrame([("d", "c1", '{"items": [{"statement": "s", "source_block_id": "b1", "source_quote": " - q ", "type": "Non Functional", "confidence": "HIGH", "tags": "t"}, 3, {"statement": ""}]}'), ("d", "c2", "[]"), ("d", "c3", '{"items": {}}'), ("d", "c4", "not json"), ("d", "c5", '{"items": []}')], "document_id string, chunk_id string, payload string")
    found = items.explode_items(chunks)
    blocks = spark.createDataFrame([("d", "b1", "paragraph", ["A", "B"], 2)], "document_id string, block_id string, type string, section_path array<string>, page int")
    none = spark.createDataFrame([], "document_id string, chunk_id string, block_id string")
    got = sorted(items.coerce_items(found.where("chunk_error is null"), blocks, none, none).collect(), key=lambda r: r.item_index)
    assert [r.error_code for r in got] == [None, "MODEL_ITEM_NOT_OBJECT", "MODEL_ITEM_MISSING_FIELD"]
    a = got[0]
    assert (a.type, a.confidence, a.tags, a.source.quote, a.source.section, a.review_status) == ("non_functional", 0.9, ["t"], "q", "A > B", "pending")
    assert [(n.field, n.input, n.normalized) for n in a.normalizations][:2] == [("confidence", "HIGH", "0.9"), ("type", "Non Functional", "non_functional")]
    assert sorted((r.chunk_id, r.chunk_error) for r in found.where("chunk_error is not null").collect()) == [("c2", "MODEL_PAYLOAD_NOT_OBJECT"), ("c3", "MODEL_PAYLOAD_ITEMS_MISSING"), ("c4", "MODEL_PAYLOAD_NOT_OBJECT")]


def test_review_states(spark):
    schema = "id string, seq int, action string, fields array<string>, expected_revision int"
    rows = [("a", 1, "approve", None, None), ("a", 2, "reject", None, 1), ("a", 3, "approve", None, None), ("b", 1, "edit", ["statement"], None), ("b", 2, "edit", ["id"], None), ("b", 3, "approve", None, 0), ("c", 1, "approve", None, None), ("c", 2, "edit", ["tags"], None), ("c", 3, "restore", None, None)]
    folded = review.fold_reviews(spark.createDataFrame(rows, schema), "id", ["seq"])
    got = {r.id: (r.status, r.revision, r.rejected_actions) for r in folded.collect()}
    assert got == {"a": ("rejected", 2, 1), "b": ("needs_recheck", 1, 2), "c": ("approved", 2, 1)}
    assert [tuple(r) for r in review.review_log(folded, "id").where("id = 'a'").collect()] == [("a", 1, "approve", "pending", "approved"), ("a", 2, "reject", "approved", "rejected")]


def test_grid_and_locators(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 2, 1, 1, 1), (1, 2, 2, 1, 1), (2, 1, 1, 2, 1), (2, 2, 1, 1, 1), (2, 1, 3, 1, 1)], "table_id int, row int, column int, row_span int, column_span int")
    tables = spark.createDataFrame([(1, 2, 2, True), (2, 2, 2, True)], "table_id int, rows int, columns int, complete boolean")
    got = sorted((r.table_id, r.problem, r.row, r.column, r.n) for r in evidence.grid_violations(cells, tables).na.fill(0).collect())
    assert got == [(2, "OUT_OF_BOUNDS", 1, 3, 1), (2, "SLOTS_EMPTY", 0, 0, 2), (2, "SLOT_OVERLAP", 2, 1, 2)]
    occ = spark.createDataFrame([("d", "b", 0, 3, "c1", 1, 1, 1, None), ("d", "b", 6, 9, "c2", 1, 2, 1, None), ("d", "b", 10, 12, "c3", 2, 1, 1, None)], "document_id string, block_id string, start int, end int, cell_id string, row_index int, column_index int, page int, box struct<x0: double, y0: double, x1: double, y1: double, space: string>")
    asked = spark.createDataFrame([("k1", "d", "b", 1, 8), ("k2", "d", "b", 8, 11)], "source_key string, document_id string, block_id string, start int, end int")
    rows = evidence.table_rows(asked, occ)
    got = {r.source_key: (r.error, r.row_index, r.cell_ids) for r in rows.collect()}
    assert got == {"k1": (None, 1, ["c1", "c2"]), "k2": ("CROSSES_TABLE_ROWS", None, None)}
    matches = spark.createDataFrame([("k1", 1, [(1, 8)]), ("k2", 1, [(8, 11)])], "source_key string, row_index int, ranges array<struct<start: int, end: int>>")
    got = {r.source_key: r.status for r in quotes.select_by_table(matches, rows).collect()}
    assert got == {"k1": "UNIQUE_MATCH", "k2": "NO_MATCH"}


def test_policies_and_outcomes(spark):
    one = spark.range(1)
    text = F.array(F.lit("text_range"))
    result = F.create_map(F.lit("text_range"), F.lit("PASS"))
    assert one.select(evidence.locator_status(text, result)).first()[0] == "PASS_DERIVED"
    none = F.expr("cast(array() as array<string>)")
    assert one.select(validate.passes_policy(F.lit("structured_required"), F.lit(True), none, none, result)).first()[0] is False
    rows = spark.createDataFrame([("a", "error", "X"), ("a", "warning", "Y"), ("b", "warning", "Z")], "document_id string, level string, code string")
    assert sorted(map(tuple, validate.merge_reports(rows.where("code < 'Y'"), rows.where("code >= 'Y'")).collect())) == [("a", False, 2), ("b", True, 1)]


def test_profile_flags(spark):
    schema = "document_id string, type string, text string, section_path array<string>, expected array<string>, available array<string>"
    rows = [("d", "heading", "T", ["T"], ["text_range"], ["text_range"]), ("d", "table", "x" * 4000, ["T"], ["text_range", "table_cell"], ["text_range"])]
    r = agent.profile(spark.createDataFrame(rows, schema)).first()
    assert (r.block_count, r.section_count, r.available_text_range, r.available_table_cell) == (2, 1, 2, 0)
    assert r.complexity_flags == ["HAS_TABLES", "HAS_UNAVAILABLE_TABLE_EVIDENCE", "LARGE_DOCUMENT"]


def test_rejected_table_text(spark):
    b = spark.createDataFrame([("d", 1, "b1", 0.0, 0.0, 10.0, 10.0), ("d", 1, "b2", 50.0, 50.0, 60.0, 60.0)], "document_id string, page int, block_id string, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, "t", 0.0, 0.0, 9.0, 9.5)], "document_id string, page int, table_id string, x0 double, y0 double, x1 double, y1 double")
    assert [r.block_id for r in layout.text_in_rejected_tables(b, t).collect()] == ["b1"]


def test_workbook_opens():
    data = export.workbook_bytes([["ID", "Text"], ["R1", "a<b & c"], [2.5, None]])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 'r="B2"' in sheet and "a&lt;b &amp; c" in sheet and "<v>2.5</v>" in sheet and 'state="frozen"' in sheet


def test_streams(spark, tmp_path):
    schema = "id string, seq int, action string, fields array<string>, ts timestamp"
    stamp = "2024-01-01 00:00:00"
    for i, rows in enumerate([[("a", 1, "approve"), ("b", 1, "restore")], [("a", 2, "reject"), ("a", 3, "approve")]]):
        spark.createDataFrame([(*r, None) for r in rows], "id string, seq int, action string, fields array<string>").withColumn("ts", F.lit(stamp).cast("timestamp")).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = logs.review_states(stream, "id").writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    last = {r.id: r for r in sorted(spark.table("states").collect(), key=lambda r: r.revision + r.refused)}
    assert (last["a"].revision + last["a"].refused, last["b"].status, last["b"].refused) == (3, "pending", 1)
    counted = logs.windowed_counts(stream, "ts", "action", "1 hour", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/d").start()
    counted.processAllAvailable()
    counted.stop()
    assert {r.action: r.n for r in spark.table("counts").collect()} == {"approve": 2, "restore": 1, "reject": 1}
    assert logs.review_step("approved", "edit", ["tags"]) == "approved" and logs.review_step("pending", "edit", ["id"]) is None

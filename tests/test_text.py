import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import text as t
from quillmark.operators import quotes


def test_exact_ranges_overlap_and_are_ambiguous(spark):
    assert t.match_quote("repeat / repeat", "repeat")[:3] == ("AMBIGUOUS_MATCH", "exact", [(0, 6), (9, 15)])
    rows = spark.createDataFrame([("repeat / repeat", "repeat"), ("aaa", "aa"), ("abc", ""), ("😀a😀a", "😀a"), ("ab", "abc")], "text string, quote string")
    got = [[tuple(x) for x in r.x] for r in rows.select(t.exact_ranges(F.col("text"), F.col("quote")).alias("x")).collect()]
    assert got == [[(0, 6), (9, 15)], [(0, 2), (1, 3)], [], [(0, 2), (2, 4)], []]


def test_normalised_ranges_map_back():
    assert t.match_quote("A　B / A B", "A  B")[:3] == ("AMBIGUOUS_MATCH", "normalized", [(0, 3), (6, 9)])
    text = "😀  系统应记录事件。"
    status, basis, ranges, score = t.match_quote(text, "系统应记录事件.")
    assert (status, basis, score) == ("UNIQUE_MATCH", "normalized", 0.95) and text[slice(*ranges[0])] == "系统应记录事件。"
    assert t.normalize_text("| A | B |") == "|A|B|"
    assert t.normalize_text("  a \n b | c  ") == "a b|c"
    assert t.match_quote("block", "") == ("NO_MATCH", "none", [], 0.0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 \t\n|，。　é́ﬁ①😀", max_size=30))
def test_normalising_keeps_a_map(text):
    plain, ranges = t.normalize_with_ranges(text)
    assert len(plain) == len(ranges) and t.normalize_text(plain) == plain
    assert all(0 <= a < b <= len(text) for a, b in ranges) and [a for a, _ in ranges] == sorted(a for a, _ in ranges)
    assert plain.replace(" ", "") == unicodedata.normalize("NFKC", plain).replace(" ", "")


def test_registry_matches_each_key_once(spark):
    blocks = spark.createDataFrame([("d", "b1", "The system shall log events."), ("d", "b2", "a b")], "document_id string, block_id string, text string")
    rows = [("k1", "d", "b1", "shall log"), ("k1", "d", "b1", "shall log"), ("k2", "d", "b2", "a\tb"), ("k3", "d", "b1", "The system shall log event"), ("k4", "d", "b9", "x"), ("k5", "d", "b1", "nothing alike"), ("k6", "d", "b1", "The system shall log evnts.")]
    found = quotes.match_registry(spark.createDataFrame(rows, "source_key string, document_id string, block_id string, quote string"), blocks)
    status = quotes.quote_status(F.col("status"), F.col("basis"), F.col("ranges"), F.col("score"), F.col("source_key") != "k4")
    got = {r.source_key: r for r in found.withColumn("grounding", status).collect()}
    assert len(got) == 6
    assert {k: r.grounding for k, r in got.items()} == {"k1": "PASS_EXACT", "k2": "PASS_NORMALIZED", "k3": "PASS_EXACT", "k4": "FAIL_NOT_FOUND", "k5": "FAIL_NOT_FOUND", "k6": "WARNING_FUZZY"}
    assert tuple(got["k1"].selected) == (11, 20) and got["k4"].score == 0


def test_many_quotes_join_by_word(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=40))) for i in range(40)]
    asked = [(i, " ".join(docs[rng.randrange(40)][1].split()[3 : 3 + rng.randint(1, 6)])) for i in range(20)] + [(99, ""), (98, "absent one two")]
    d, q = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(asked, "id int, quote string")
    want = sorted((i, j) for i, t_ in docs for j, s in asked if s and s in t_)
    for limit in (1 << 20, 1):
        got = quotes.contained_quotes(d, q, max_broadcast_bytes=limit).select("doc", "id").collect()
        assert sorted(map(tuple, got)) == want


def test_source_keys_tell_rows_apart(spark):
    none = F.expr("cast(array() as array<string>)")
    rows = spark.createDataFrame([(None,), (1,), (2,)], "row int")
    keys = [r.k for r in rows.select(t.source_key(F.lit("f"), F.lit("d"), F.lit("b"), F.lit("é"), none, F.col("row")).alias("k")).collect()]
    assert len(set(keys)) == 3 and all(len(k) == 28 and k.startswith("src_") for k in keys)
    assert keys[0] == "src_" + __import__("hashlib").sha256('{"block_id":"b","canonical_cell_ids":[],"document_id":"d","evidence_fingerprint":"f","quote":"é"}'.encode()).hexdigest()[:24]

import hashlib
import re

from pyspark.sql import functions as F

from quillmark.llm import secrets as sec

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LIVE = "Ab3" + "kQ9z" * 6
KEY = "AKIA" + "Z9" * 8
ROWS = [
    (1, f"password = '{LIVE}' and {KEY}", "a"),
    (2, f"é😀 PassWord:'abcdef' x {LIVE[:-1]}X", "a"),
    (3, "secret: token: abcdefgh", "b"),
    (4, "token=token=abcdef passwd:12345", "b"),
    (5, "0123456789abcdef01234567 " + "f" * 23 + " " + "AKIAB " * 3, None),
    (6, f"copied {KEY} twice {KEY}", "b"),
    (7, f"copied {KEY}", "c"),
    (8, f"copied {KEY}", None),
    (9, "", "c"),
    (10, None, "c"),
    (None, "api_key=zzzzzz, apikey: \"yyyyyy\"", "c"),
    (12, "x " * 20_000 + "passwd='deadbeefdeadbeefdeadbeef'" + "\n" + "apikey=qwerty " * 300, "c"),
    (1, f"password = '{LIVE}' and {KEY}", "a"),
]


def brute(rows):
    found = []
    for _, text, _ in rows:
        text = text or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        own = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 20 and all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]"))]
        own = [o for o in own if not any(o[0] < b[2] and b[0] < o[2] for b in base)]
        found.append(sorted(base + own))
    owners, repositories = {}, {}
    for (doc, _, owner), spans in zip(rows, found):
        for s in spans:
            owners.setdefault(s[3], set()).add(owner)
            repositories.setdefault(s[3], set()).add((owner, doc))
    return [[(s[0], s[1], s[2], len(owners[s[3]]), len(repositories[s[3]]), len(owners[s[3]]) <= 2) for s in spans if s[1] < 3 or len(owners[s[3]]) <= 2] for spans in found]


def test_scan_matches_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, source string, row string")
    got = sec.scan(docs, ["doc_id", "text", "row"]).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    want = [(r[0], r[1], s) for r, s in zip(ROWS, brute(ROWS))]
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in got), key=key) == sorted(want, key=key)
    assert any(s[5] is False for _, _, spans in want for s in spans) and any(s[1] == 3 for _, _, spans in want for s in spans)


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([("é😀abcdefghij", [(1, 0, 4), (2, 2, 3), (3, 1, 6), (8, 0, 9)]), ("plain", []), ("", [])], "t string, s array<struct<start: int, rank: int, end: int>>")
    got = df.select(sec.redacted(F.col("t"), F.col("s"), "#").alias("r")).collect()
    assert got[0].r == "é" + "#" + "ef" + "#" + "hij"
    assert got[1].r == "plain" and got[2].r == ""


def test_span_list_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sec.scan(docs, ["doc_id"]).count() == 0
    one = spark.createDataFrame([([(4, 1, 9)],)], "s array<struct<start: int, rank: int, end: int>>")
    text = one.select(sec.span_list(F.col("s"), ("a", "b")).alias("x")).first().x
    assert text == "b:4:9" and len(hashlib.sha256(text.encode()).hexdigest()) == 64


def many_spans():
    """Texts whose spans fill many blocks, with characters beyond the basic plane between them."""
    live = "".join(f"é😀 token={'k' * (i % 9)}Q{i} {LIVE}{i} AKIA{i:016d} {i:030x}\n" for i in range(700))
    return [(1, live, "a"), (2, "x" * 16_380 + " password=" + "s" * 40_000 + " end", "b"), (3, "secret=abcdef" * 64, "b"), (4, "é" * 16_384 + "token=abcdefgh", "b")]


def test_many_spans_match_brute_force(spark):
    rows = many_spans()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in sec.scan(docs, ["doc_id"]).collect()}
    assert got == {r[0]: s for r, s in zip(rows, brute(rows))}
    assert len(got[1]) > 20 * sec.BLOCK


def test_redaction_over_blocks_matches_brute_force(spark):
    rows = many_spans()
    spans = [[s[:3] for s in found] for found in brute(rows)]
    df = spark.createDataFrame([(r[0], r[1], s) for r, s in zip(rows, spans)], "i long, t string, s array<struct<start: int, rank: int, end: int>>")
    got = {r.i: r.r for r in df.select("i", sec.redacted(F.col("t"), F.col("s"), "#").alias("r")).collect()}
    for (i, text, _), found in zip(rows, spans):
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], "#"]
            at = max(at, end)
        assert got[i] == "".join(out) + text[at:]

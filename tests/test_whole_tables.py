"""Queries without SQL run on whole tables, held against brute force."""

import os

import duckdb
import pytest

from quillmark.operators import evidence
from quillmark.plans.catalog import QUERIES, located_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def brute_edges():
    rows = duckdb.sql(f"SELECT l_suppkey::VARCHAR, l_partkey % 20, l_orderkey, l_linenumber, l_quantity::INTEGER::VARCHAR FROM '{SF}/lineitem.parquet'").fetchall()
    odd = [r for r in rows if r[3] % 2]
    gold = {}
    for r in rows:
        if r[3] % 2 == 0:
            gold.setdefault(r[:2], []).append(r)
    name = lambda r: f"{r[2]}-{r[3]}"
    found = {}
    for c in odd:
        for g in gold.get(c[:2], []):
            if c[4] in g[4] or g[4] in c[4]:
                quality = (20 if c[4] == g[4] else 10) + 9 - c[3] % 3
                pairs = found.setdefault(c[0], {})
                pairs[name(c), name(g)] = max(quality, pairs.get((name(c), name(g)), 0))
    return found


def most_pairs(pairs):
    at, held = {}, {}
    for c, g in pairs:
        at.setdefault(c, []).append(g)

    def place(c, seen):
        for g in at[c]:
            if g not in seen:
                seen.add(g)
                if g not in held or place(held[g], seen):
                    held[g] = c
                    return True
        return False

    return sum(place(c, set()) for c in at)


def test_assignment_covers_the_orders_not_divisible_by_four(spark):
    want = brute_edges()
    got = {}
    for r in QUERIES["match_assignment"](spark, SF).collect():
        assert want[r.group_id][r.candidate_id, r.gold_id] == r.quality
        got.setdefault(r.group_id, []).append((r.candidate_id, r.gold_id))
    assert got.keys() == want.keys()
    for group, pairs in got.items():
        assert len({c for c, _ in pairs}) == len({g for _, g in pairs}) == len(pairs) == most_pairs(want[group])
    assert any(int(c.split("-")[0]) % 4 for pairs in got.values() for c, _ in pairs)


def test_registry_covers_every_line(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    blank = "".join(map(chr, [*range(9, 14), *range(28, 33)]))
    lines = {f"{i}-blk_{n:04d}": x for i, t in texts for n, x in enumerate((x for x in (t or "").split("\n") if x.strip(blank)), 1)}
    got = {r.source_key: r for r in QUERIES["quote_registry"](spark, SF).collect()}
    assert got.keys() == {f"{k}-{kind}" for k in lines for kind in ("as_is", "spaced", "changed")}
    assert any("blk_0002" in k for k in got)
    for key, line in lines.items():
        r = got[f"{key}-as_is"]
        assert (r.status, r.basis, r.score, r.start, r.end, r.grounding) == ("UNIQUE_MATCH", "exact", 1.0, 0, len(line), "PASS_EXACT")
        assert got[f"{key}-spaced"].grounding == ("PASS_NORMALIZED" if " " in line else "PASS_EXACT")
        assert not got[f"{key}-changed"].grounding.startswith("PASS")


def test_every_line_is_a_cell_and_gets_a_locator(spark):
    wanted, occ = located_rows(spark, SF)
    counts = dict(duckdb.sql(f"SELECT l_orderkey, count(*) FROM '{SF}/lineitem.parquet' GROUP BY ALL").fetchall())
    got = {r.source_key: r for r in evidence.table_rows(wanted.withColumn("end", wanted["start"] + 1), occ).collect()}
    assert max(counts.values()) > 4 and got.keys() == {f"{o}-{n}" for o, k in counts.items() for n in range(1, k + 1)}
    for o, k in counts.items():
        for n in range(1, k + 1):
            r = got[f"{o}-{n}"]
            assert r.error is None and r.row_index == (n + 1) // 2 and r.cell_ids == [f"cell_{n}"]

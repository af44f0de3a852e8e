"""Vectors of any size, length and number of rows, against brute force."""

import math

import numpy as np
from test_vectors import usable

from quillmark.llm import epsilon_join, permutation


def cosine(a, b):
    scale = lambda v: [x / max(map(abs, v)) for x in v]
    a, b = scale(a), scale(b)
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def rows_of_all_kinds(seed, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=(6, 3, 6, 9)[i % 4]) * (1.0, 1e300, 1e-300, 1e-12)[i // 7 % 4]
        rows.append((i, v.tolist()))
    rows += [(50, rows[50][1]), (50, [1e300, -1e300, 2.0, 0.0, 1e299, 5.0]), (100, rows[8][1]), (7, rows[0][1]), (7, rows[4][1])]
    return rows + [(None, rows[0][1]), (300, None), (350, []), (400, [0.0] * 6), (450, [float("nan")] * 6), (500, [1.0, None, 2.0]), (550, [1.0] * 5)]


def test_search_takes_every_row_of_any_length(spark):
    rows = rows_of_all_kinds(2)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, d string")
    got = permutation.search(df, df.where(permutation.divisible("vec_id", 50)), shard_rows=50, block_queries=2).collect()
    held = {(i, tuple(v)) for i, v in rows if i is not None and usable(v)}
    want = []
    for i, v in held:
        if i % 50 == 0:
            found = sorted((-cosine(w, v), j) for j, w in held if j != i and len(w) == len(v))
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:5], 1)]
    assert len(got) == len(want) and sum(r.query_id == 50 for r in got) == 10
    for a, b in zip(sorted(map(tuple, got), key=lambda r: (r[0], r[1], r[3])), sorted(want, key=lambda r: (r[0], r[1], r[3]))):
        assert a[:2] == b[:2] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-12)
    assert {r[:3] for r in map(tuple, got)} == {r[:3] for r in want}


def test_links_of_doubles_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(epsilon_join, "SEGMENT_ROWS", 8)
    monkeypatch.setattr(epsilon_join, "LEAF_ROWS", 4)
    monkeypatch.setattr(epsilon_join, "TILE_SEGMENTS", 2)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        base = rng.normal(size=5) if i % 3 == 0 else np.array(rows[-1][1]) / max(map(abs, rows[-1][1])) + rng.normal(scale=0.05, size=5)
        rows.append((i, (base * (1.0, 1e300, 1e-300)[i % 5 % 3]).tolist(), i // 3 % 2))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, point int")
    got = {r.vec_id: r for r in epsilon_join.near_duplicates(df).collect()}
    links = {i: [j for j, b, m in rows if j != i and m == k and cosine(a, b) >= 0.98] for i, a, k in rows}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert sum(map(len, links.values())) > 100
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))

import math

import numpy as np
import pytest

from quillmark.llm import epsilon_join, permutation
from quillmark.llm.vectors import cosines

NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def rows_with_groups(seed, n, dims, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[0] + rng.normal(scale=0.07, size=(40, dims)).astype(np.float32)
    x[-30:] = x[1]
    label = rng.integers(0, labels, n)
    label[n // 2 : n // 2 + 40] = label[0]
    label[-30:] = label[1]
    return x, label


@pytest.mark.parametrize("segment_rows", [1024, 50])
def test_near_duplicates_match_brute_force(spark, monkeypatch, segment_rows):
    monkeypatch.setattr(epsilon_join, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(epsilon_join, "LEAF_ROWS", 16)
    x, label = rows_with_groups(1, 400, 8)
    rows = [(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, NAN] + [0.0] * 6, 1), (903, [INF] + [1.0] * 7, 1), (904, [None] + [1.0] * 7, 1), (905, x[1].tolist(), None)]
    rows += [(906, [1.0, 0.0], 2), (907, [2.0, 0.0], 2), (908, [], 2), rows[3], (None, x[0].tolist(), int(label[0])), (909, [-0.0, 3.0], 2), (910, [0.0, 3.0], 2)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, weight int")
    links = {i: set() for i in range(len(rows))}
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                if cosines(np.array([a]), np.array([b]))[0] >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    want = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((r[0], len(links[i]), least, None if r[0] is None else r[0] == least))
    got = [tuple(r) for r in epsilon_join.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert epsilon_join.near_duplicates(empty).count() == 0
    bare = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, epsilon_join.near_duplicates(bare).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_nearest(rows, k=5):
    held = {}
    for i, v in rows:
        if i is not None and usable(v) and len(v) == len(rows[0][1]):
            held[i] = min(held.get(i, v), v)
    ids = np.array(sorted(held))
    x = np.array([held[i] for i in ids.tolist()], np.float32).astype(float)
    found = {}
    for at, i in enumerate(ids.tolist()):
        if i % 50 == 0:
            score = cosines(x, x[at][None, :])
            order = [j for j in np.lexsort((ids, -score)).tolist() if j != at][:k]
            found[i] = [(int(ids[j]), float(score[j])) for j in order]
    return found


def run_search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = permutation.search(df, df.where(permutation.divisible("vec_id", 50)), **more).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_search_is_exact_where_all_is_reranked(spark):
    x, _ = rows_with_groups(3, 300, 6)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 6), (1100, [NAN] * 6), (1150, [1.0] * 5), (None, x[0].tolist()), (300, x[1].tolist()), rows[50], (299, x[7].tolist())]
    got, want = run_search(spark, rows, shard_rows=60, block_queries=2), brute_nearest(rows)
    assert got == want


def test_footrule_counts_missing_pivots():
    rng = np.random.default_rng(0)
    orders = np.array([rng.permutation(9)[:4] for _ in range(60)])
    files = permutation.InvertedFiles(orders, 9)
    for order in orders[:10]:
        place = lambda o, p: list(o).index(p) if p in o else 4
        want = [sum(abs(place(order, p) - place(o, p)) for p in range(9)) for o in orders]
        assert files.footrule(order).tolist() == want


def test_recall_on_hard_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got, want = run_search(spark, rows, shard_rows=3000), brute_nearest(rows)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_search_of_nothing(spark):
    assert run_search(spark, [(1, [1.0, 2.0])]) == {}
    assert run_search(spark, [(50, [1.0, 2.0])]) == {}
    assert run_search(spark, [(50, None), (7, [1.0])]) == {}

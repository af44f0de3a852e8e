import random

import numpy as np
from test_simhash import brute_components

from quillmark.llm import near_copies as nc


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [brute_set(t) for _, t in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    label = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[label[i]] = min(doc_id, least.get(label[i], doc_id))
    return sorted(least.values())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows + [(1000, ""), (1001, None), (1002, " \n")]


def test_near_copies_go_though_their_fingerprints_are_far(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in nc.one_of_each_group(docs).collect())
    assert got == brute_kept(rows) and len(got) < len(rows) - 60


def test_a_large_group_is_dealt_and_stays_whole(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(90)] + [(500, "unlike anything else here today")]
    monkeypatch.setattr(nc.near_copy_links, "__defaults__", (8,))
    got = sorted(r.doc_id for r in nc.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_kept(rows) == [0, 500]


def test_the_limit_itself_counts():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert nc.similar(a, b) and not nc.similar(a[:8], b[:8])

import random

import numpy as np
import xxhash

from quillmark.llm import simhash as sh
from quillmark.llm.components import connected_components, star_forest


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, links):
    parent = {r: r for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {r: find(r) for r in rows}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, "one", "ONE two", "a\tb\x0bc\nd", "É é\u00a0x y z", " \n "]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 90))) for _ in range(50)]
    texts.append("long word " * 70_000)
    for text in texts:
        got = sh.simhash(None if text is None else text.encode())
        assert got % (1 << 64) == brute_fingerprint(text)


def test_close_values_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, size=500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, size=500).astype(np.uint64)
    assert (sh.group_keys(x, 3) == sh.group_keys(y, 3)).any(axis=1).all()


def test_star_forest_keeps_connectivity():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    node, root = star_forest(a, b)
    nodes = set(a) | set(b)
    assert brute_components(nodes, zip(a, b)) == brute_components(nodes, zip(node, root))
    assert len(node) < len(nodes)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    assert got == want


def test_links_connect_all_close_pairs_in_large_cells(spark):
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 64, dtype=np.uint64)
    values = {int(centre ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k)))) for k in rng.integers(0, 5, 400)}
    values |= {int(v) for v in rng.integers(0, 1 << 64, size=300, dtype=np.uint64)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 3]
    for cell_rows in (1024, 16):
        got = {r.node: r.component for r in connected_components(sh.fingerprint_links(fps, 3, cell_rows)).collect()}
        want = brute_components(values, links)
        assert {v: got.get(v, v) for v in values} == want


def test_groups_with_nulls_copies_and_clashing_names(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "other")
    rows = [(5, base, "x"), (3, base, "x"), (9, near, None), (None, base, "x"), (4, None, "x"), (6, "", "x"), (6, "", "x"), (8, "unlike anything " + "z " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sh.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    label = brute_components(range(len(rows)), links)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            least[label[i]] = min(doc_id, least.get(label[i], doc_id))
    want = sorted(((r[0] is None, r[0] or 0), f % (1 << 64), least[label[i]]) for i, (r, f) in enumerate(zip(rows, fps)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint % (1 << 64), r.component_id) for r in got) == want


def test_empty_table(spark):
    assert sh.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0

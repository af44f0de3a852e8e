"""The near-duplicate stage links by SimHash and by shingle sets, and follows chains of both."""

import corpus_pipeline as pipe
from test_near_copies import brute_set, corpus
from test_simhash import brute_components, brute_fingerprint


def bits(a, b):
    return bin(brute_fingerprint(a) ^ brute_fingerprint(b)).count("1")


def similarity(a, b):
    a, b = brute_set(a), brute_set(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "aa", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in pipe.drop_near_duplicates(spark, docs, "").collect())


def test_a_chain_of_a_fingerprint_and_a_set(spark):
    base, one, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 31), ("x", 20), ("y", 20)))
    long, changed, short = f"{base} " * 40 + one, f"{base} " * 40 + other, f"{base} {base} {one}"
    # long and changed agree in their fingerprints only, long and short in their sets only
    assert bits(long, changed) <= 3 and similarity(long, changed) < 0.5
    assert bits(long, short) > 3 and similarity(long, short) == 1 and bits(changed, short) > 3
    assert kept(spark, [(9, long), (2, changed), (5, short), (7, "unlike anything else here today")]) == [2, 7]
    assert kept(spark, [(1, long), (2, changed)]) == [1]


def test_all_links_of_both_kinds(spark):
    rows = corpus(11)
    near = lambda a, b: bits(a, b) <= 3 or similarity(a, b) >= 0.8
    label = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(rows[i][1], rows[j][1])])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[label[i]] = min(doc_id, least.get(label[i], doc_id))
    assert kept(spark, rows) == sorted(least.values())

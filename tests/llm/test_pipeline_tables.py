"""The pipeline's stages on tables of any kind, and the near-duplicate stage by its rule."""

import random

import corpus_pipeline as pipe
from test_near_copies import brute_kept

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("__toxic", "__lang", "__row", "__sketch", "a.b", "back`tick", "p", "doc", "spans", "__TOXIC_")


def folder(spark, path, rows, labels):
    schema = DOCS + "".join(f", `{c.replace('`', '``')}` string" for c in EXTRA)
    spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in EXTRA]) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def corpus():
    rng = random.Random(7)
    words = {"aa": ["theo", "anre", "hein", "ofor"], "bb": ["schung", "ichder", "pfau", "keit"]}
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        text = " ".join(rng.choice(words[lang]) + rng.choice("abcdefghij") for _ in range(40))
        rows.append((i, text + (" scum idiot moron" if i % 5 == 0 else ""), lang, f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[i][1] + " er", rows[i][2], "s0", 1) for i in (1, 2, 3)] + [rows[7], rows[7]]
    rows += [(300, None, None, None, None), (301, "", "aa", "s", 0), (302, "token = abcdefgh1 " + rows[11][1] * 300, "aa", "s1", 5), (None, rows[13][1] + " x", "aa", None, None)]
    return rows


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = corpus()
    labels = [(i, 1, int(i % 5 == 0)) for i in range(120)]
    docs = folder(spark, str(tmp_path), rows, labels)
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.count() >= docs.count()
            break
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        for r in docs.collect():
            assert [r[c] for c in EXTRA] == [f"{c}{r.doc_id}" for c in EXTRA]
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect()} >= {300, 301} and docs.where("doc_id < 120 and doc_id % 5 = 0").count() == 0
        if name == "language_id":
            assert docs.where("doc_id in (300, 301)").count() == 0 and docs.where("doc_id = 7").count() == 3
        if name == "simhash":
            told = [(r.doc_id, r.text) for r in before.where("doc_id is not null").collect()]
            assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == brute_kept(told)
            assert docs.where("doc_id in (200, 201, 202, 203)").count() == 0
        if name == "secrets":
            assert docs.where("doc_id = 302 and text like '%abcdefgh1%'").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    folder(spark, str(tmp_path), [], [])
    out = pipe.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id"} <= set(out.columns)

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import bpe, packing
from quillmark.llm.tokens import BYTE_LEVEL, SPACED, WordTable

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "  ", "a  b", "a \n b", "\n\n x", "x \n", "<|endoftext|> a <|endoftext|>b", "don't we'll  's 'S", "İSTANBUL ΣΑΣ ß ﬁ", "a b  c",
    "é ñ é", "\x1c a\x85b", "日本 語", "12 345 ²½", "a\r\n\tb", "“quoted” – it's…", "word " * 3000, "longest" * 500, "same", "same",
]
_R = random.Random(4)
TEXTS += ["".join(_R.choice(" \n\tabA1's.é_İ   ß-ñ“”") for _ in range(_R.randint(0, 40))) for _ in range(2000)]


@pytest.mark.parametrize(("path", "splitter"), [(BYTE, BYTE_LEVEL), (WORD, SPACED)])
def test_word_table_equals_tokenizer(path, splitter, monkeypatch):
    monkeypatch.setattr("quillmark.llm.tokens.TABLE_WORDS", 300)
    table = WordTable(path, splitter, list)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert [[i for p in parts for i in p] for parts in table.parts(TEXTS)] == want


def test_bpe_columns(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = df.select("text", bpe.encode(BYTE).alias("ids"), bpe.digests(BYTE).alias("d")).withColumn("back", bpe.decode(BYTE)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.back, r.d.n_tokens) == (ids, back, len(ids))
        assert r.d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    odd = spark.createDataFrame([([220, 159],), (None,), ([],)], "ids array<int>").select(bpe.decode(BYTE).alias("t")).collect()
    assert [r.t for r in odd] == [tokenizer.decode([220, 159], skip_special_tokens=False), None, ""]
    assert df.limit(0).select(bpe.digests(BYTE)).count() == 0


def verify(rows, capacity):
    """rows of (sequence, offset, length): each sequence is filled without gaps, up to capacity."""
    at = {}
    for sequence, offset, length in sorted(rows):
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
    assert max(at.values()) <= capacity
    return len(at)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.geometric(0.08, 400) if seed % 2 else rng.integers(1, 65, 400))
    plan = packing.plan_packing(dict(Counter(lengths.tolist())), 64)
    rank = np.zeros(400, np.int64)
    for x in set(lengths.tolist()):
        rank[lengths == x] = np.arange((lengths == x).sum())
    sequence, offset = plan.place(lengths.astype(np.int64), rank)
    used = verify(list(zip(sequence.tolist(), offset.tolist(), lengths.tolist())), 64)
    assert used == plan.n_sequences
    first_fit = []
    for x in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, s in enumerate(first_fit) if s + x <= 64), None)
        first_fit.append(x) if at is None else first_fit.__setitem__(at, first_fit[at] + x)
    assert used <= len(first_fit) * 1.02


def test_index_finds_sums_under_counts():
    counts = np.zeros(33, np.int64)
    counts[[3, 5, 7]] = [1, 2, 1]
    index = packing.SumIndex(counts)
    assert index.exact(7) == (7,) and sorted(index.exact(10)) == [3, 7] and sorted(index.exact(13)) == [3, 5, 5] and index.exact(9) is None
    counts[7] = 0
    assert index.exact(10) == (5, 5)
    counts[5] = 1
    assert index.exact(10) is None and index.exact(13) is None


@pytest.mark.parametrize("seed", range(8))
def test_index_misses_no_sum(seed):
    """Singles, pairs and triples against all combinations, while counts fall and some lengths are held."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(40, np.int64)
    for x in rng.integers(1, 30, 14):
        counts[x] += 1
    index = packing.SumIndex(counts)
    while counts.sum() > 3:
        for held in ([], [int(rng.choice(np.flatnonzero(counts)))]):
            with index.holding(*held):
                left = Counter({x: int(n) for x, n in enumerate(counts.tolist())})
                left.subtract(held)
                pieces = sorted(left.elements())
                for total in range(1, 40):
                    sums = [n for n in (1, 2, 3) if any(sum(c) == total for c in combinations(pieces, n))]
                    found = index.exact(total)
                    assert (found is not None) == bool(sums)
                    if found:
                        assert sum(found) == total and len(found) == sums[0] and all(left[x] >= found.count(x) for x in found)
        counts[rng.choice(np.flatnonzero(counts))] -= 1


def test_pack_documents(spark):
    tokenizer = Tokenizer.from_file(WORD)
    rows = [(i if i != 3 else None, t, 9) for i, t in enumerate([*TEXTS[:80], "long text " * 4000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long")
    got = packing.pack_documents(df, WORD).collect()
    verify([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[doc_id, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_pack_edges(spark):
    assert packing.pack(spark.createDataFrame([], "length long")).count() == 0
    hot = spark.range(3000).select(F.lit(700).alias("length"), F.col("id").alias("offset"))
    assert verify([(r.sequence_id, r.offset, r.length) for r in packing.pack(hot).collect()], 2048) == 1500
    for bad in (None, 0, 2049):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length long"))

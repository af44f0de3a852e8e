"""Byte-level BPE: encoding through distinct words, decoding through a table of pieces."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm.common import small_batches, worker_cache
from quillmark.llm.tokens import BYTE_LEVEL, WordTable, byte_pieces


def encode(path: str, text: str = "text") -> Column:
    """The ids (array<int>) of each whole text; null text counts as empty."""
    small_batches()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        table = worker_cache(("ids", path), lambda: WordTable(path, BYTE_LEVEL, lambda x: np.array(x, np.int32)))
        none = np.empty(0, np.int32)
        parts = [np.concatenate([none, *p]) for p in table.parts(texts.to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *parts])))

    return ids(F.col(text))


def decode(path: str, ids: str = "ids") -> Column:
    """The text of each list of ids, special tokens kept; null ids give null, and bytes that are
    no UTF-8 are replaced."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        pieces = byte_pieces(Tokenizer.from_file(path))
        return pa.array([None if x is None else b"".join([pieces[i] for i in x]).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return text(F.col(ids))


def _digest_table(path: str) -> WordTable:
    pieces = byte_pieces(Tokenizer.from_file(path))
    digits = [str(i).encode() for i in range(len(pieces))]

    def made(ids: list[int]) -> tuple[bytes, int, bytes]:
        return b",".join([digits[i] for i in ids]), len(ids), b"".join([pieces[i] for i in ids])

    return WordTable(path, BYTE_LEVEL, made)


def digests(path: str, text: str = "text") -> Column:
    """A struct (n_tokens, ids_sha256, decoded_sha256) for each whole text: the ids joined by
    commas, and the decoded text. The ids of each distinct word are joined and looked up in the
    table of pieces once, then joined back by position; null text counts as empty."""
    small_batches()

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def of(texts: pa.Array) -> pa.Array:
        table = worker_cache(("digests", path), lambda: _digest_table(path))
        n, ids, decoded = [], [], []
        for parts in table.parts(texts.to_pylist()):
            n.append(sum([p[1] for p in parts]))
            ids.append(hashlib.sha256(b",".join([p[0] for p in parts if p[1]])).hexdigest())
            plain = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
            decoded.append(hashlib.sha256(plain.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(F.col(text))

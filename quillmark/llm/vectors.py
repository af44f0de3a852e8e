"""What the vector operators share: which vectors take part, and exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def component_type(*frames_and_columns: tuple[DataFrame, str]) -> str:
    """``float`` where all these columns hold floats, else ``double``: no component is rounded."""
    return "float" if all(dict(df.dtypes)[c] == "array<float>" for df, c in frames_and_columns) else "double"


def plain(vector: Column | str, kind: str) -> Column:
    """The vector's components as ``kind``, negative zeros as zeros."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    zero = F.lit(0.0).cast(kind)
    return F.transform(vector.cast(f"array<{kind}>"), lambda x: F.when(x == 0, zero).otherwise(x))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Vectors of one length as rows, in double precision, fit for squaring (`tame`)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return tame(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions))


def tame(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, times a power of two, which leaves cosines as they are."""
    most = np.abs(x).max(axis=1, initial=0)
    wild = (most > 1e100) | ((most < 1e-100) & (most > 0))
    if wild.any():
        x = x.copy()
        x[wild] = np.ldexp(x[wild], -np.frexp(most[wild])[1][:, None])
    return x


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def units(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``. A row's value depends on that row
    alone, so equal vectors always have equal cosines."""
    return (a * b).sum(axis=1) / (norms(a) * norms(b))

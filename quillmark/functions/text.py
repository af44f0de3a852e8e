"""Text functions: normalisation with a map back to the original, quote ranges, ids and keys."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.schemas import MATCH, RANGE

# Punctuation that counts as its ASCII form.
PUNCTUATION = {
    "，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "！": "!", "？": "?", "、": ",",
    "“": '"', "”": '"', "‘": "'", "’": "'",
}
_PUNCTUATION = str.maketrans(PUNCTUATION)
_GAPS = re.compile(r"\s*\|\s*|\s+")
#: A block is grounded fuzzily from this ratio on.
FUZZY = 0.85
EXACT_SCORE, NORMALIZED_SCORE = 1.0, 0.95

Range = tuple[int, int]


def _clusters(text: str) -> Iterator[Range]:
    """A character with the combining marks that follow it."""
    at = 0
    while at < len(text):
        marks = sum(1 for _ in takewhile(unicodedata.combining, text[at + 1 : at + 64]))
        end = at + 1 + marks
        while marks == 63 and end < len(text) and unicodedata.combining(text[end]):
            end += 1
        yield at, end
        at = end


def normalize_with_ranges(text: str) -> tuple[str, list[Range]]:
    """The text in compatibility form with ASCII punctuation, single spaces and tight pipes, and
    for each of its characters the range of the original that it comes from."""
    if text.isascii():
        plain, origin = text, [(i, i + 1) for i in range(len(text))]
    else:
        parts, origin = [], []
        for a, b in _clusters(text):
            part = unicodedata.normalize("NFKC", text[a:b]).translate(_PUNCTUATION)
            parts.append(part)
            origin += [(a, b)] * len(part)
        plain = "".join(parts)
    out, ranges, at = [], [], 0
    for gap in _GAPS.finditer(plain):
        a, b = gap.span()
        out.append(plain[at:a])
        ranges += origin[at:a]
        out.append("|" if "|" in gap[0] else " ")
        ranges.append((min(r[0] for r in origin[a:b]), max(r[1] for r in origin[a:b])))
        at = b
    out.append(plain[at:])
    ranges += origin[at:]
    joined = "".join(out)
    left, right = len(joined) - len(joined.lstrip(" ")), len(joined.rstrip(" "))
    return joined[left:right], ranges[left:right]


class _Forms(dict):
    """Each character's compatibility form with ASCII punctuation, worked out once."""

    def __missing__(self, code: int) -> str:
        self[code] = unicodedata.normalize("NFKC", chr(code)).translate(_PUNCTUATION)
        return self[code]


_FORMS = _Forms()


def normalize_text(text: str) -> str:
    """The text of `normalize_with_ranges`; without combining marks each character stands for itself."""
    if not text.isascii():
        if any(map(unicodedata.combining, set(text))):
            return normalize_with_ranges(text)[0]
        text = text.translate(_FORMS)
    return _GAPS.sub(lambda gap: "|" if "|" in gap[0] else " ", text).strip(" ")


def occurrences(text: str, quote: str) -> Iterator[int]:
    """Where ``quote`` begins in ``text``, overlapping occurrences included."""
    at = text.find(quote) if quote else -1
    while at >= 0:
        yield at
        at = text.find(quote, at + 1)


def match_quote(text: str | None, quote: str | None) -> tuple[str, str, list[Range], float]:
    """(status, basis, ranges of the original, score): exact, else normalised, else a fuzzy ratio."""
    if text is None or quote is None:
        return "NO_MATCH", "none", [], 0.0
    found, basis, score = [(at, at + len(quote)) for at in occurrences(text, quote)], "exact", EXACT_SCORE
    wanted = "" if found else normalize_text(quote)
    if wanted and wanted in normalize_text(text):
        plain, origin = normalize_with_ranges(text)
        spans = [origin[at : at + len(wanted)] for at in occurrences(plain, wanted)]
        found = sorted({(min(a for a, _ in s), max(b for _, b in s)) for s in spans})
        basis, score = "normalized", NORMALIZED_SCORE
    if not found:
        return "NO_MATCH", "none", [], difflib.SequenceMatcher(None, quote, text).ratio()
    return ("UNIQUE_MATCH" if len(found) == 1 else "AMBIGUOUS_MATCH"), basis, found, score


def normalized(text: Column | str) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize_text(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def quote_match(text: Column | str, quote: Column | str) -> Column:
    """`match_quote` for each row, as a struct (status, basis, ranges, score)."""

    @F.arrow_udf(MATCH)
    def of(texts: pa.Array, quotes: pa.Array) -> pa.Array:
        found = [match_quote(t, q) for t, q in zip(texts.to_pylist(), quotes.to_pylist())]
        ranges = [[{"start": a, "end": b} for a, b in f[2]] for f in found]
        columns = [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.string()),
            pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([f[3] for f in found], pa.float64()),
        ]
        return pa.StructArray.from_arrays(columns, names=["status", "basis", "ranges", "score"])

    return of(text, quote)


#: Numbers that `sums_before` adds up at a time.
_RUN = 256


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of all before it. Runs are added up first, so that the work
    grows with the array's length and not with its square."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _RUN).cast("int")), lambda r: total(F.slice(numbers, r * _RUN + 1, F.lit(_RUN))))
    before = F.aggregate(runs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    held = F.transform(F.array(F.struct(numbers.alias("n"), before.alias("b"))), lambda h: F.transform(
        h["n"], lambda x, i: F.get(h["b"], F.floor(i / _RUN).cast("int")) + total(F.slice(h["n"], F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN))
    ))
    return F.element_at(held, 1)


def exact_ranges(text: Column, quote: Column) -> Column:
    """All occurrences, overlapping ones included, without Python: array of (start, end).

    The text is cut in front of every occurrence; lengths of the pieces say where they begin.
    """
    n = F.length(quote)
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split(text, literal), lambda p: F.length(p))
    starts = sums_before(pieces)
    # the first piece is an occurrence only if the text begins with the quote
    hits = F.slice(starts, F.when(F.startswith(text, quote), 1).otherwise(2), F.size(starts))
    ranges = F.transform(hits, lambda i: F.struct(i.cast("int").alias("start"), (i + n).cast("int").alias("end")))
    return F.when(F.contains(text, quote) & (n > 0), ranges).otherwise(F.expr(f"cast(array() as array<{RANGE}>)"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cell_text(text: Column) -> Column:
    """A cell's text for a serialised row: one kind of newline, then backslash, pipe and newline escaped."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    escaped = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(escaped, F.lit("\n"), F.lit("\\n"))


def identifier(form: str, number: Column) -> Column:
    """``number`` in a printf form; unlike padding this never cuts a long number."""
    return F.format_string(form, number)


def source_key(fingerprint: Column, document: Column, block: Column, quote: Column, cells: Column, row: Column) -> Column:
    """``src_`` and 24 hex digits of the canonical JSON of a source: sorted keys, the row only if present."""
    fields = {
        "block_id": block, "canonical_cell_ids": cells, "document_id": document,
        "evidence_fingerprint": fingerprint, "quote": quote, "source_table_row_index": row,
    }
    json = F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]))
    return F.concat(F.lit("src_"), F.substring(F.sha2(json, 256), 1, 24))

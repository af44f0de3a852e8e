"""Language identification by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import release_memory, small_batches, worker_cache

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Lengths of the subwords taken from ``<word>``; the whole word counts as well.
LENGTHS = (2, 3, 4)
#: Labelled rows that are fitted for each language, in all, and for each language whatever the sum;
#: `fit` may be told other bounds. Every language is fitted, however many there are.
ROWS_PER_LANGUAGE, MAX_ROWS, LEAST_ROWS = 1000, 8000, 20
#: Languages whose shares are broadcast; those of more are joined by language.
MAX_BROADCAST_LANGUAGES = 100_000
#: Times as many hashes pass the threshold, on average, as are wanted; fewer than wanted is as good
#: as impossible, and would only make the sample smaller.
OVERSAMPLED = 4
#: Words remembered by a task at most, and their letters; then it starts anew.
CACHE_WORDS, CACHE_LETTERS = 200_000, 8_000_000
#: Letters of texts that are judged together.
BATCH_LETTERS = 1_000_000
UNKNOWN = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every subword of ``words``, which hold letters only."""
    marked = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(words)), length)
    last = end[owner]
    at = np.arange(len(codes))
    owners, hashes = [], []
    rolling = codes.copy()
    with np.errstate(over="ignore"):
        for n in range(2, max(LENGTHS) + 1):
            rolling = rolling[:-1] * _MULTIPLIER + codes[n - 1 :]
            if n in LENGTHS:
                fits = at[: len(rolling)] + n <= last[: len(rolling)]
                owners.append(owner[: len(rolling)][fits])
                hashes.append((rolling[fits] + np.uint64(n)) * _MULTIPLIER)
        # the whole word: a sum over positions that does not need a window
        within = (at - (end - length)[owner]).astype(np.uint64)
        mixed = (codes + within * _MULTIPLIER) * (codes ^ _MULTIPLIER)
        owners.append(np.arange(len(words)))
        hashes.append(np.add.reduceat(mixed, end - length) * _MULTIPLIER)
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    return owners, (hashes >> np.uint64(64 - 16)).astype(np.int64)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text with their counts."""
    words = [w for w in map(letters, text.lower().split()) if w]
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    distinct, times = np.unique(words, return_counts=True)
    owner, bucket = subwords(distinct.tolist())
    counts = np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used].astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: logits of each bucket: the embeddings times the softmax weights
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: a text whose score is below this is rejected
    threshold: float

    def logits(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table[used] / counts.sum() + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


class WordSums:
    """Each distinct word's summed logits and number of subwords, worked out once per task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1))
        self.letters = 0

    def _add(self, words: list[str]) -> None:
        plain = [letters(w) for w in words]
        first, need = len(self.place), len(self.place) + len(words)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((need, self.sums.shape[1]))])
        self.sums[first:need] = 0
        kept = [i for i, w in enumerate(plain) if w]
        if kept:
            owner, bucket = subwords([plain[i] for i in kept])
            rows = self.model.table[bucket]
            for k in range(rows.shape[1]):
                self.sums[first + np.array(kept), k] = np.bincount(owner, weights=rows[:, k], minlength=len(kept))
            self.sums[first + np.array(kept), -1] = np.bincount(owner, minlength=len(kept))
        for i, word in enumerate(words):
            self.place[word] = first + i
            self.letters += len(word)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; new words are worked out for many texts at a time."""
        at = 0
        while at < len(texts):
            split: list[list[str]] = []
            size = 0
            while at < len(texts) and size < BATCH_LETTERS:
                size += len(texts[at] or "")
                split.append((texts[at] or "").lower().split())
                at += 1
            new = {w for words in split for w in words if w not in self.place}
            if len(self.place) + len(new) > CACHE_WORDS or self.letters > CACHE_LETTERS:
                self._clear()  # the cache starts anew
                new = {w for words in split for w in words}
            if new:
                self._add(list(new))
            for words in split:
                yield self._judge(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))

    def _judge(self, words: np.ndarray) -> tuple[str, float]:
        total = self.sums[words].sum(axis=0)
        if not total[-1]:
            return UNKNOWN, 0.0
        p = self.model.scores(total[:-1] / total[-1] + self.model.bias)
        best = int(p.argmax())
        return self.model.languages[best], min(1.0, float(p[best]))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in one byte each, or two or four where one needs them."""
    most = values.max(initial=0)
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unpacked(value: bytes, n: int) -> np.ndarray:
    return np.frombuffer(value, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(value) // n])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            used, counts = bucket_counts(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label]), pa.array([len(used)], pa.int32()), pa.array([_packed(used)], pa.binary()), pa.array([_packed(counts)], pa.binary())],
                names=["label", "n", "used", "counts"],
            )


def fit(
    labelled: DataFrame, text: str = "text", label: str = "lang", order: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 6,
    max_rows: int = MAX_ROWS, least_rows: int = LEAST_ROWS,
) -> LanguageModel:
    """Fit on the ``rows_per_language`` rows of each language that come first by the hash of ``order``.

    Bucket counts of so many whole texts reach the driver. No more than ``max_rows`` are taken in
    all, dealt evenly, but ``least_rows`` of each language at least; no language is left out. Rows
    with a null label or text, or without a letter, are not used; repeated rows count once. A
    quarter of the rows is kept from the fit and sets the temperature and the score below which a
    text is rejected. Without rows every text is `UNKNOWN`.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(label).alias("l"), F.xxhash64(order, text).alias("h"), F.col(text).alias("t")).where(
        r"l IS NOT NULL AND t RLIKE '\\p{L}'"
    )
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).collect()
    wanted = max(1, min(rows_per_language, max(least_rows, max_rows // max(1, len(sizes)))))
    # Few hashes of each language pass a threshold from its count; they alone are ranked, so the
    # rows that meet in a task are about as many as are wanted, however many a language has.
    shares = labelled.sparkSession.createDataFrame([(r["l"], min(1.0, OVERSAMPLED * wanted / r["n"])) for r in sizes], "l string, share double")
    # so that rows stay where they are; more languages than this hold no share of the rows worth a task
    shares = F.broadcast(shares) if len(sizes) <= MAX_BROADCAST_LANGUAGES else shares
    passing = rows.select("l", "h").join(shares, "l").where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    ranked = Window.partitionBy("l").orderBy("h")
    chosen = passing.select("l", "h").distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= wanted)
    sample = rows.join(F.broadcast(chosen.select("l", "h")), ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t"))
    table = sample.select("l", "t").mapInArrow(_counted, "label string, n int, used binary, counts binary").toArrow()
    labels, n = table.column("label").to_pylist(), table.column("n").to_pylist()
    used, counts = ([_unpacked(v, k) for v, k in zip(table.column(c).to_pylist(), n)] for c in ("used", "counts"))
    del table
    model = train(labels, used, counts, epochs)
    del used, counts
    release_memory()
    return model


def train(labels: list[str], used: list[np.ndarray], counts: list[np.ndarray], epochs: int = 6, batch: int = 64, rate: float = 0.5) -> LanguageModel:
    """Stochastic gradient descent (AdaGrad steps) on softmax(mean embedding @ weights + bias)."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in labels])
    # the order of the rows must not depend on how the tasks ended
    key = [(labels[i], len(used[i]), int(counts[i].sum()), used[i][:8].tolist()) for i in range(len(labels))]
    order = np.array(sorted(range(len(labels)), key=key.__getitem__))
    rng = np.random.default_rng(7)
    order = rng.permutation(order)
    held, fitted = order[: len(order) // 4], order[len(order) // 4 :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    seen = [np.full_like(x, 1e-6) for x in (embedding, weights, bias)]
    for _ in range(epochs):
        fitted = rng.permutation(fitted)
        for at in range(0, len(fitted), batch):
            rows = fitted[at : at + batch]
            columns, inverse = np.unique(np.concatenate([used[i] for i in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(columns)))
            sizes = [len(used[i]) for i in rows]
            x[np.repeat(np.arange(len(rows)), sizes), inverse] = np.concatenate([counts[i] / counts[i].sum() for i in rows])
            mean = x @ embedding[columns]
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            steps = (x.T @ (p @ weights.T), mean.T @ p, p.sum(axis=0))
            seen[0][columns] += steps[0] ** 2
            embedding[columns] -= rate * steps[0] / np.sqrt(seen[0][columns])
            for value, total, step in ((weights, seen[1], steps[1]), (bias, seen[2], steps[2])):
                total += step**2
                value -= rate * step / np.sqrt(total)
    model = LanguageModel(languages, embedding @ weights, bias, 1.0, 0.0)
    calibrate(model, [(used[i], counts[i]) for i in held], y[held])
    return model


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Set the temperature by likelihood, and the threshold so that of a thousand right answers
    about two are rejected; it never exceeds a half."""
    if not rows:
        return
    logits = np.array([model.logits(*r) for r in rows])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    p = np.array([model.scores(z) for z in logits])
    right = p.argmax(axis=1) == y
    if right.any():
        model.threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], 0.002)))


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct (lang, score, accepted) for each whole text; `UNKNOWN` with score 0 if it is null or has no letter.

    Equal texts, however often they are repeated, get equal values; an empty table gives no rows.
    Only the column ``text`` is read, so other columns may have any names.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        held = worker_cache(name, lambda: WordSums(sent.value))
        found = list(held.predict(texts.to_pylist()))
        lang, score = [f[0] for f in found], [f[1] for f in found]
        accepted = [f[0] != UNKNOWN and f[1] >= sent.value.threshold for f in found]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["lang", "score", "accepted"]
        )

    return of(F.col(text))

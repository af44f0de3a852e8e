"""Toxicity severity by cumulative-link ordinal regression on hashed words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import list_rows, release_memory, small_batches, worker_cache

#: Words are hashed into so many features; a feature is whether a text has it.
FEATURES = 1 << 20
#: Labelled rows that are fitted at most, unless `fit` is told another bound.
MAX_ROWS = 10_000
PREFIXES = (4, 5, 6)
#: Signed root of the likelihood ratio, and weight of the graded rows, that a feature needs to get a weight.
EVIDENCE, LEAST_WEIGHT = 4.5, 2.5
#: Features that tell copies among the labelled rows.
SKETCH = 4
#: Words remembered by a task at most; then it starts anew.
CACHE_WORDS = 300_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_features(word: str) -> tuple[int, ...]:
    """The features of a lower-case word: itself, without ASCII punctuation at its edges, and its
    first four, five and six letters, which many inflected forms share."""
    plain = word.strip(_EDGES)
    parts = [plain] + [f"{plain[:n]}*" for n in PREFIXES if len(plain) > n]
    return tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts)


def features(text: str | None) -> np.ndarray:
    return np.array(sorted({f for w in set((text or "").lower().split()) for f in word_features(w)}), np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - cuts[k - 1]): one weight vector, ascending cuts."""

    columns: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, score: float | np.ndarray) -> np.ndarray:
        return _sigmoid(np.asarray(score)[..., None] - self.cuts)


class TrainingRows:
    """The training rows' features, distinct within a row, with a weight for each row. They are counted
    row by row: no second copy of all features is made."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows, self.n = rows, len(rows)
        self.held = np.zeros(FEATURES, np.int32)
        for row in rows:
            self.held[row] += 1
        self.used = np.flatnonzero(self.held)
        self.weight = np.ones(self.n)
        if self.n:
            self._share_copies()

    def _share_copies(self) -> None:
        """Rows with the same `SKETCH` least uncommon features are copies; they share one weight."""
        sketch = np.full((self.n, SKETCH), -1)
        sketch[:, 0] = -1 - np.arange(self.n)
        most = max(2, self.n // 100)
        for i, row in enumerate(self.rows):
            uncommon = row[(self.held[row] >= 2) & (self.held[row] <= most)]
            mixed = np.sort((uncommon.astype(np.int64) * 0x9E3779B1) % 0xFFFFFFFB)[:SKETCH]
            sketch[i, : len(mixed)] = mixed
        _, group, size = np.unique(sketch, axis=0, return_inverse=True, return_counts=True)
        self.weight = 1.0 / size[group.ravel()]

    def evidence(self, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed root of the likelihood ratio of each feature in `used`, positive where it speaks for
        toxic rows, and the weight of its toxic rows."""
        sums = np.zeros((2, FEATURES))
        for row, weight, marked in zip(self.rows, self.weight.tolist(), toxic.tolist()):
            sums[int(marked), row] += weight
        in0, in1 = sums[:, self.used]
        share = self.weight[toxic].sum() / self.weight.sum()
        both = np.maximum(in1 + in0, 1e-9)
        ratio = sum(np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / (both * p)), 0) for n, p in ((in1, share), (in0, 1 - share)))
        return np.sign(in1 / both - share) * np.sqrt(np.maximum(2 * ratio, 0)), in1

    def telling(self, toxic: np.ndarray, evidence: float = EVIDENCE, least_weight: float = 0.0) -> np.ndarray:
        """The features that speak for toxic rows with more than this evidence."""
        found, in1 = self.evidence(toxic)
        return self.used[(found > evidence) & (in1 >= least_weight)]

    def places(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index in ``columns``) of every feature that a row has of them."""
        place = np.full(FEATURES, -1, np.int32)
        place[columns] = np.arange(len(columns))
        at = [place[row] for row in self.rows]
        at = [x[x >= 0] for x in at]
        return np.repeat(np.arange(self.n), [len(x) for x in at]), np.concatenate(at)


def minimise(objective, x: np.ndarray, steps: int = 200, memory: int = 12) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``objective`` gives a value and its gradient."""
    value, slope = objective(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d = slope.copy()
        kept = []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            kept.append(a)
            d -= a * y
        if pairs:
            s, y, r = pairs[-1]
            d /= r * (y @ y)
        else:
            d /= max(1.0, np.abs(d).max())
        for (s, y, r), a in zip(pairs, reversed(kept)):
            d += (a - r * (y @ d)) * s
        falls, size = slope @ d, 1.0
        while size > 1e-10:
            new_value, new_slope = objective(x - size * d)
            if new_value <= value - 1e-4 * size * falls:
                break
            size /= 2
        else:
            break
        s, y = -size * d, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = value - new_value <= 1e-9 * max(1.0, abs(value))
        x, value, slope = x + s, new_value, new_slope
        if done:
            break
    return x


def ordinal_loss(
    owner: np.ndarray, at: np.ndarray, row_weight: np.ndarray, grades: np.ndarray, weights: np.ndarray, cuts: np.ndarray, ridge: float
) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised negative log-likelihood, and its gradient by weight and by cut.

    P(grade = g) = P(grade >= g) - P(grade >= g + 1), where the first and the last are 1 and 0.
    ``owner`` and ``at`` say which row has which weight's feature.
    """
    n, n_grades = len(grades), len(cuts) + 1
    index, edge = np.arange(n), np.full((n, 1), np.inf)
    score = np.bincount(owner, weights=weights[at], minlength=n)
    p = _sigmoid(np.concatenate([edge, score[:, None] - cuts, -edge], axis=1))
    upper, lower = p[index, grades], p[index, grades + 1]
    mass = np.maximum(upper - lower, 1e-12)
    toward = row_weight * (1 - upper - lower)  # d log P / d score
    by_cut = np.bincount(grades + 1, weights=row_weight * lower * (1 - lower) / mass, minlength=n_grades + 1)
    by_cut -= np.bincount(grades, weights=row_weight * upper * (1 - upper) / mass, minlength=n_grades + 1)
    by_weight = ridge * weights - np.bincount(at, weights=toward[owner], minlength=len(weights))
    return float(-(row_weight * np.log(mass)).sum() + ridge / 2 * (weights @ weights)), by_weight, -by_cut[1:n_grades]


def fit_ordinal(rows: list[np.ndarray] | TrainingRows, grades: np.ndarray, n_grades: int, ridge: float = 0.1, evidence: float = EVIDENCE) -> OrdinalModel:
    """The penalised likelihood's maximum over one weight vector, nowhere negative, and ascending cuts.

    A weight is given to every feature that speaks for a graded text with more than ``evidence``,
    however many they are; all others stay at zero, so that noise does not add up over long texts.
    Weights are constrained to zero or more, so nothing that a text says besides can excuse it:
    those that the fit would make negative are set to zero and the rest is fitted again. Cuts are
    kept ascending by fitting the logarithms of their differences. Rows that are copies of each
    other share one row's weight.
    """
    grades = np.asarray(grades, np.int64)
    toxic = grades > 0
    if not len(grades) or toxic.all() or not toxic.any():
        # one class only: no feature can tell, the cuts alone say which
        least = -30.0 if len(grades) and toxic.all() else 30.0
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), least + np.arange(n_grades - 1))
    data = rows if isinstance(rows, TrainingRows) else TrainingRows(rows)
    columns = data.telling(toxic, evidence, LEAST_WEIGHT)
    counts = np.bincount(grades, weights=data.weight, minlength=n_grades) + 1.0
    above = counts[::-1].cumsum()[::-1][1:] / counts.sum()
    cuts = -np.log(above / (1 - above))
    start = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    while True:
        owner, at = data.places(columns)

        def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
            weights, first, gaps = v[: len(columns)], v[len(columns)], np.exp(np.clip(v[len(columns) + 1 :], -12, 4))
            cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
            value, by_weight, by_cut = ordinal_loss(owner, at, data.weight, grades, weights, cuts, ridge)
            return value, np.concatenate([by_weight, [by_cut.sum()], [by_cut[k + 1 :].sum() * g for k, g in enumerate(gaps)]])

        best = minimise(objective, np.concatenate([np.zeros(len(columns)), start]))
        weights = best[: len(columns)]
        if (weights >= 0).all():
            cuts = best[len(columns)] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(best[len(columns) + 1 :], -12, 4)))])
            return OrdinalModel(columns, weights, cuts)
        columns, start = columns[weights >= 0], best[len(columns) :]


def severity_grades(rows: list[np.ndarray] | TrainingRows, labels: np.ndarray) -> np.ndarray:
    """Grades from 0 (clean) on. Labels of more than two values are grades themselves, in their order.

    Yes-or-no labels say nothing of severity: their toxic rows are parted into 1 (toxic) and 2
    (severe), those with more features that speak for toxic texts than the median toxic row has.
    The upper threshold is then only as good as this rule; the lower one rests on the labels alone.
    """
    labels = np.asarray(labels)
    values, grades = np.unique(labels, return_inverse=True)
    if len(values) > 2:
        return grades.astype(np.int64)
    toxic = labels > 0
    if not len(toxic) or not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    data = rows if isinstance(rows, TrainingRows) else TrainingRows(rows)
    telling = np.zeros(FEATURES, bool)
    telling[data.telling(toxic)] = True
    marks = np.fromiter((telling[row].sum() for row in data.rows), np.int64, data.n)
    return toxic.astype(np.int64) + (toxic & (marks > np.median(marks[toxic])))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([features(t) for t in texts], pa.list_(pa.int32()))],
            names=["id", "toxic", "features"],
        )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fit on the ``max_rows`` labelled ids that come first by hash; their features reach the driver.

    ``label`` is 0 or 1, or a grade. Null ids, labels or texts are not used; an id that is labelled
    twice has the greater label; an id that many rows repeat counts once, with the smallest of its
    texts. Other columns, whatever their names, are not read. Without two classes, as on empty
    tables, the model calls every text the one that it saw, or clean.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("toxic"))
        .dropna()
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).where("t IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("t").alias("t"))
    table = sample.mapInArrow(_sampled, "id long, toxic int, features array<int>").toArrow()
    order = np.argsort(table.column("id").to_numpy()).tolist()
    rows, labelled = list_rows(table.column("features")), table.column("toxic").to_numpy()[order]
    data = TrainingRows([rows[i] for i in order])
    grades = severity_grades(data, labelled)
    model = fit_ordinal(data, grades, max(3, int(grades.max(initial=0)) + 1))
    del table, rows, data, order
    release_memory()
    return model


class _Weights(dict):
    """Word to those of its features that have a weight; filled as words come."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.known = dict(zip(model.columns.tolist(), model.weights.tolist()))

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in word_features(word) if f in self.known)
        if len(word) <= 64:
            self[word] = found
        return found

    def score(self, text: str | None) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = set().union(*set(map(self.__getitem__, (text or "").lower().split())))
        return sum(self.known[f] for f in sorted(found))


def predict(df: DataFrame, model: OrdinalModel, text: str = "text") -> Column:
    """A struct (severity, p_toxic, grade) for each whole text.

    ``severity`` is the expected grade, the sum of P(grade >= k); ``p_toxic`` is P(grade >= 1).
    A null or empty text has no features and is judged by the cuts alone. Equal texts, however often
    they are repeated, get equal values; an empty table gives no rows. Only the column ``text`` is
    read, so other columns may have any names.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.arrow_udf("struct<severity: double, p_toxic: double, grade: int>")
    def of(texts: pa.Array) -> pa.Array:
        held = worker_cache(name, lambda: _Weights(sent.value))
        scores = np.array([held.score(t) for t in texts.to_pylist()])
        p = sent.value.at_least(scores) if len(scores) else np.empty((0, len(sent.value.cuts)))
        mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(mass.argmax(axis=1).astype(np.int32))], names=["severity", "p_toxic", "grade"]
        )

    return of(F.col(text))

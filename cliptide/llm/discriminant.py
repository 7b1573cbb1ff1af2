"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import byte_texts, remainder, text_batches, text_or_empty, written
from cliptide.session import broadcast_when_small

HELD_OUT_PARTS, LIMIT = 5, 0.3
#: Parts of the labelled documents, by digest, that the settings are chosen by leaving out in turn.
FOLDS = 4
#: Share of the pooled covariance in that of a class, share of its mean variance on the diagonal, and factors on the
#: log-density difference; the combination with the least loss on the parts left out is taken.
POOLED, ROUND, TEMPER = (0.0, 0.1, 0.3, 0.6, 1.0), (0.0001, 0.001, 0.01, 0.1), (0.05, 0.1, 0.2, 0.5, 1.0)
#: Added to counts before the logarithm of a ratio.
PSEUDO = 0.5

LETTER, UPPER, DIGIT, SPACE, MARK, OTHER, HIGH = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x80:] = HIGH
for _chars, _kind in (
    ("abcdefghijklmnopqrstuvwxyz", LETTER),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
    ("0123456789", DIGIT),
    (" \t\n\x0b\x0c\r", SPACE),
    (".,;:?'\"-()", MARK),
):
    KIND[[ord(c) for c in _chars]] = _kind

FEATURES = (
    "upper", "digits", "marks", "others", "high", "word_length", "length_spread", "sentence_length",
    "repeats", "variety", "alone", "lines_again", "line_length", "glued",
)


def log_ratio(part: float, rest: float) -> float:
    return float(np.log((part + PSEUDO) / (rest + PSEUDO)))


def statistics(text: bytes) -> list[float] | None:
    """``FEATURES`` of a whole text: logarithms of ratios of counts; None for a text without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return None
    kinds = KIND[np.frombuffer(text, np.uint8)]
    counts = np.bincount(kinds, minlength=7)
    letters = int(counts[LETTER] + counts[UPPER] + counts[HIGH])
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [line.strip() for line in text.split(b"\n") if line.strip()]
    once = [a == b for a, b in zip(words, words[1:], strict=False)]
    # symbols other than sentence marks right after a letter
    glued = int(((kinds[1:] == OTHER) & ((kinds[:-1] == LETTER) | (kinds[:-1] == HIGH) | (kinds[:-1] == UPPER) | (kinds[:-1] == OTHER))).sum())
    ends = text.count(b".") + text.count(b"!") + text.count(b"?")
    distinct = len(set(words))
    bare = sum(not w.isalnum() and len(w) == 1 and w < b"\x80" for w in words)
    return [
        log_ratio(counts[UPPER], letters - counts[UPPER]),
        log_ratio(counts[DIGIT], letters),
        log_ratio(counts[MARK], letters),
        log_ratio(counts[OTHER], letters),
        log_ratio(counts[HIGH], letters),
        float(np.log(sizes.mean())),
        float(np.log1p(sizes.std())),
        log_ratio(ends, n),
        log_ratio(sum(once), n - sum(once)),
        log_ratio(distinct, n) + 0.2 * float(np.log1p(n)),  # a longer text repeats its words more
        log_ratio(bare, n),
        log_ratio(len(lines) - len(set(lines)), len(set(lines))),
        log_ratio(n, len(lines)),
        log_ratio(glued, letters),
    ]


@dataclass(frozen=True)
class Gaussian:
    """A class: its mean, the Cholesky factor of its covariance, and the logarithm of the factor's determinant."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, factor, float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant that both classes share: half the squared Mahalanobis distance and the determinant."""
        away = np.linalg.solve(self.factor, (x - self.mean).T)
        return -0.5 * (away**2).sum(0) - self.log_det


@dataclass(frozen=True)
class Moments:
    """Count, sum and sum of outer products of the statistics of a class; moments of parts add up."""

    n: float
    total: np.ndarray
    outer: np.ndarray

    @classmethod
    def none(cls) -> Moments:
        d = len(FEATURES)
        return cls(0.0, np.zeros(d), np.zeros((d, d)))

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.outer + other.outer)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.outer - other.outer)

    def mean(self) -> np.ndarray:
        return self.total / self.n

    def scatter(self) -> np.ndarray:
        return self.outer - self.n * np.outer(self.mean(), self.mean())


@dataclass(frozen=True)
class Model:
    """Both classes, scale of the statistics, factor on the difference, and the share of class 1."""

    prior: float
    scale: np.ndarray | None = None
    good: Gaussian | None = None
    poor: Gaussian | None = None
    temper: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        x = x / self.scale
        return self.good.log_density(x) - self.poor.log_density(x)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.good is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.temper * self.difference(x) + np.log(self.prior / (1 - self.prior)), -700, 700)))


def fitted(classes: tuple[Moments, Moments], pooled: float, round_: float, temper: float) -> Model:
    """Class covariances shrunk towards the pooled one, then towards a multiple of the identity.

    ``classes`` holds the moments of labels 0 and 1. If one has fewer than two documents, the share of label 1 is all that is known.
    """
    n = classes[0].n + classes[1].n
    prior = float(np.clip(classes[1].n / n if n else 0.5, 0.001, 0.999))
    if min(c.n for c in classes) < 2:
        return Model(prior)
    both = classes[0] + classes[1]
    scale = np.sqrt(np.maximum(np.diag(both.scatter()) / n, 1e-12))
    within = (classes[0].scatter() + classes[1].scatter()) / np.outer(scale, scale) / n
    fits = []
    for c in classes:
        own = c.scatter() / np.outer(scale, scale) / c.n
        mixed = (1 - pooled) * own + pooled * within
        level = max(np.trace(mixed) / len(mixed), 1e-6)
        fits.append(Gaussian.of(c.mean() / scale, (1 - round_) * mixed + (round_ * level + 1e-9) * np.eye(len(mixed))))
    return Model(prior, scale, fits[1], fits[0], temper)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): statistics of each text; x is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            x = pa.array([statistics(t) for t in byte_texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["doc_id", "held_out", "x"])

    rows = docs.select("doc_id", F.coalesce(remainder(HELD_OUT_PARTS) == 0, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, x array<double>")


def labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, fold, x) of every described document outside the held-out part with a label 0 or 1; each label of a document counts."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return table.filter(~F.col("held_out") & F.col("x").isNotNull()).join(broadcast_when_small(known, 64), "doc_id").select("label", fold, "x")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments by label and fold. Tasks add theirs up, so a row of moments per task and class is all that moves."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            label, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for key in {*zip(label.tolist(), fold.tolist(), strict=True)}:
                part = x[(label == key[0]) & (fold == key[1])]
                held[key] = held.get(key, Moments.none()) + Moments(float(len(part)), part.sum(0), part.T @ part)
        rows = [(k[0], k[1], place, v) for k, m in held.items() for place, v in enumerate([m.n, *m.total, *m.outer.ravel()])]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())],
            names=["label", "fold", "place", "value"],
        )

    sums = rows.mapInArrow(run, "label int, fold int, place int, value double").groupBy("label", "fold", "place").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.collect():  # 2 * FOLDS * (1 + d + d * d) numbers
        found.setdefault((r.label, r.fold), np.zeros(1 + d + d * d))[r.place] = r.value
    return {k: Moments(v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for k, v in found.items()}


def losses(rows: DataFrame, models: dict[int, list[Model]]) -> np.ndarray:
    """Sum of log losses over all rows of each setting, every row under the models that did not see its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models[0]))
        for batch in batches:
            label, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for f in set(fold.tolist()):
                here = fold == f
                for k, model in enumerate(models[f]):
                    p = np.clip(model.probability(x[here]), 1e-9, 1 - 1e-9)
                    total[k] -= np.log(np.where(label[here] == 1, p, 1 - p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["setting", "loss"])

    out = np.zeros(len(models[0]))
    for r in rows.mapInArrow(run, "setting bigint, loss double").groupBy("setting").agg(F.sum("loss").alias("loss")).collect():
        out[r.setting] = r.loss
    return out


def train(table: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled document outside the held-out part; ``table`` comes from ``described``.

    Only moments and losses reach the driver, whatever the number of labels. Without documents of both classes the model
    is the share of label 1 alone, 0.5 without any.
    """
    rows = written(labelled(table, labels))
    found = moments(rows)
    whole = tuple(sum((found.get((label, f), Moments.none()) for f in range(FOLDS)), Moments.none()) for label in (0, 1))
    settings = [(p, r, t) for p in POOLED for r in ROUND for t in TEMPER]
    if min(c.n for c in whole) < 2 * FOLDS:
        return fitted(whole, POOLED[-2], ROUND[-1], 1.0)
    models = {
        f: [fitted(tuple(whole[label] - found.get((label, f), Moments.none()) for label in (0, 1)), *s) for s in settings]
        for f in range(FOLDS)
    }
    return fitted(whole, *settings[int(np.argmin(np.round(losses(rows, models), 6)))])


def scored(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted); a text without words gets the share of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            scores = np.full(len(column), model.prior)
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                scores[known] = model.probability(matrix(column.drop_null()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Texts are read once and whole; what remains of each is a row of ``FEATURES``. Null texts count as empty; a null id is neither held
    out nor labelled; repeated rows are scored alike, and each counts with its label; other columns are ignored.
    """
    table = written(described(docs))
    return scored(table, train(table, labels))

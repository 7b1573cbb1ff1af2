"""Toxicity by compression distance: windows compressed with two zstandard dictionaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import byte_texts, remainder, text_batches, text_or_empty

#: Labelled documents of each class that the classifier is fitted on at most, taken in digest order of their ids.
TRAIN_DOCS = 1500
#: Words per window, bytes of the trained dictionary, and words that mark toxic text in front of it.
WINDOW, COMMON_BYTES, MARKS = 6, 8 << 10, 80
#: A word marks a class if this share of its documents holds it, so many times more often than the others, and the
#: log-likelihood of that (documents times log of the ratio) is at least so large; chance words stay below.
MARK_SHARE, MARK_RATIO, MARK_STRENGTH = 0.01, 4.0, 14.0
#: Shortest match that the compressor takes; gains below and above are counted with the ends.
MIN_MATCH, GAINS = 4, (-4, 12)
FEATURES = 2 * (GAINS[1] - GAINS[0] + 1) + 1
HELD_OUT_PARTS = 5


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of the calibrated threshold."""

    toxic: bytes
    plain: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    empty: float


#: Everything in ASCII but letters and digits parts words; upper case is lowered.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Words in windows that follow each other; the last may be shorter."""
    words = text.translate(FOLD).split()
    return [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


class Scorer:
    """Compressed lengths under both dictionaries."""

    def __init__(self, toxic: bytes, plain: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.toxic, self.plain = (
            zstandard.ZstdCompressor(dict_data=self.ready(raw, params), compression_params=params) for raw in (toxic, plain)
        )

    @staticmethod
    def ready(raw: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressionDict:
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        return data

    def features(self, text: bytes) -> np.ndarray:
        """How many windows the toxic dictionary shortens by how many bytes more than the other does.

        The counts over gains from ``GAINS[0]`` to ``GAINS[1]`` stand once over the number of windows and
        once over its root, beside the logarithm of that number.
        """
        parts = windows(text)
        if not parts:
            return np.zeros(FEATURES)
        a, b = self.toxic.compress, self.plain.compress
        gain = np.array([len(b(p)) - len(a(p)) for p in parts])
        counts = np.bincount(np.clip(gain, *GAINS) - GAINS[0], minlength=GAINS[1] - GAINS[0] + 1)
        n = len(parts)
        return np.concatenate([counts / n, counts / np.sqrt(n), [np.log(n)]])


def marks(own: list[set[bytes]], other: list[set[bytes]]) -> list[bytes]:
    """Words that mark one class, the strongest last, where a compressor finds them nearest."""
    mine, theirs = Counter(w for s in own for w in s), Counter(w for s in other for w in s)
    odds = {w: n / max(len(own), 1) * max(len(other), 1) / (theirs[w] + 0.5) for w, n in mine.items() if n > max(1, MARK_SHARE * len(own))}
    strength = {w: mine[w] * np.log(x) for w, x in odds.items() if x >= MARK_RATIO}
    return sorted((w for w, x in strength.items() if x >= MARK_STRENGTH), key=lambda w: (strength[w], w))


def dictionaries(toxic: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionary of toxic text and the one of ordinary text.

    Both hold what is trained on ordinary text, so that equal words compress alike; the toxic one
    starts with the words that mark toxic text most strongly.
    """
    toxic, plain = sorted(set(toxic)), sorted(set(plain))
    sets = [[set(t.translate(FOLD).split()) for t in texts] for texts in (toxic, plain)]
    parts = [p for t in plain for p in windows(t)]
    try:
        base = zstandard.train_dictionary(4 * COMMON_BYTES, parts, k=64, d=8).as_bytes()[-COMMON_BYTES:]
    except (zstandard.ZstdError, ValueError):
        base = b" ".join(parts)[-COMMON_BYTES:]  # too little to train on
    return b" ".join([*marks(*sets)[-MARKS:], base]), b" " + base


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic fit; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(toxic: list[bytes], plain: list[bytes], prior: float) -> Model:
    """Dictionaries from every other document of a class, thresholds from the rest, then the other way round.

    ``prior`` is the share of toxic documents among all labelled ones that may be learned from.
    """
    if not toxic or not plain:
        return Model(b" ", b" ", (-20.0 if not toxic else 20.0,) + (0.0,) * FEATURES, (0.0,) * FEATURES, (1.0,) * FEATURES, 0.0 if not toxic else 1.0)
    x, y = [], []
    for half in (0, 1):
        scorer = Scorer(*dictionaries(toxic[half::2], plain[half::2]))
        for texts, label in ((toxic[1 - half :: 2], 1.0), (plain[1 - half :: 2], 0.0)):
            x += [scorer.features(t) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x).reshape(-1, FEATURES), np.array(y)
    if len(set(y.tolist())) < 2:
        return Model(b" ", b" ", (-2.0,) + (0.0,) * FEATURES, (0.0,) * FEATURES, (1.0,) * FEATURES, 0.0)
    center, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - center) / scale, y)
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(*dictionaries(toxic, plain), tuple(w), tuple(center), tuple(scale), prior)


def probability(model: Model, scorer: Scorer, text: bytes) -> float:
    if not text.split():
        return float(model.empty)
    z = (scorer.features(text) - np.array(model.center)) / np.array(model.scale)
    return float(1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents outside the held-out part; at most ``most`` of each class reach the driver.

    Labels that are null, of unknown documents or of held-out ones are not used; documents whose labels
    differ count for each. Both classes are read up to the bound, and the true share of the toxic class
    among all usable labels is counted over the whole table to set the threshold.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & (remainder(HELD_OUT_PARTS) != 0)).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    )
    row = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    picked = [
        usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label in (0, 1)
    ]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * most rows
    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "toxic", "text")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    )
    texts, marks = rows.column("text").cast(pa.binary()).to_pylist(), rows.column("toxic").to_pylist()
    toxic = [t for t, m in zip(texts, marks, strict=True) if m == 1 and t.split()]
    plain = [t for t, m in zip(texts, marks, strict=True) if m == 0 and t.split()]
    return fit(toxic, plain, float(np.clip((row.k or 0) / max(row.n, 1), 0.001, 0.999)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Null and empty texts get the share of toxic documents as their score; a null id is not held out;
    repeated rows are scored alike; whole texts are read, in windows of ``WINDOW`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.plain)
        for batch in text_batches(batches):
            scores = pa.array([probability(model, scorer, t) for t in byte_texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(remainder(HELD_OUT_PARTS) == 0, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, whose text the model does not hold for toxic (same rules as ``score``)."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.plain)
        for batch in text_batches(batches):
            texts = [t if t is not None else b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([probability(model, scorer, t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

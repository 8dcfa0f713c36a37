"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader with L1 and L2 penalties (most stay exactly zero), then one
temperature makes the probabilities honest. Document frequencies are counted over every learnable row; the regression
is fitted on a bounded sample (``per_label`` rows of each language). Whole texts are scored in Arrow batches.

Null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled row exists. Ties go
to the first language in sorted order. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import bounded_sample

DIM = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def _fold_ascii() -> np.ndarray:
    table = np.full(128, 32, np.uint32)
    for c in range(97, 123):
        table[c] = c
    return table


_ASCII = _fold_ascii()


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the hashed character n-grams of a text.

    ASCII characters other than letters count as one blank, runs of blanks as one.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    blank = np.concatenate([[True], points == 32])
    points = np.concatenate([[np.uint32(32)], points[~(blank[1:] & blank[:-1])], [np.uint32(32)]])
    rolled = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    features = [rolled]
    for n in ORDERS[1:]:
        longer = (features[-1][: len(points) - n + 1] ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) + rolled[n - 1 :]
        features.append(longer)
    hashed = np.concatenate(features)
    hashed = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 15)
    counts = np.bincount(hashed.astype(np.int64), minlength=DIM)
    kept = np.flatnonzero(counts)
    return kept, counts[kept]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, set(text)))


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    if not has_letter(text):
        return None
    kept, counts = ngram_counts(text)
    values = np.log1p(counts) * idf[kept]
    return kept, (values / (np.sqrt((values * values).sum()) or 1.0)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if has_letter(text := text.as_py()):
                seen[ngram_counts(text)[0]] += 1
                rows += 1
    kept = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(seen[kept], rows))], ["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies over every row (one text column); the driver gets DIM numbers."""
    counts = texts.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = counts.column("feature").to_numpy(), counts.column("n").to_numpy()
    rows = n[feature < 0].sum() if len(n) else 0
    df = np.zeros(DIM)
    df[feature[feature >= 0]] = n[feature >= 0]
    return np.log((1.0 + rows) / (1.0 + df)) + 1.0


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, found) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (found := _vector(text.as_py(), idf)) is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in rows], pa.string()),
                pa.array([x[1][0].astype(np.int32).tobytes() for x in rows], pa.binary()),
                pa.array([x[1][1].tobytes() for x in rows], pa.binary())], ["lang", "features", "weights"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.3, l2: float = 0.1) -> np.ndarray:
    """Multinomial logistic weights (DIM x classes) by per-coordinate FTRL with elastic-net penalties."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    order = np.random.RandomState(11)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            kept, values, label = rows[i]
            zi, ni = z[kept], n[kept]
            w = weights(zi, ni)
            score = values @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1.0
            g = values[:, None] * p[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[kept] = zi + g - step * w
            n[kept] = ni + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that gives held-back labels the greatest likelihood."""
    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 61))
    return float(min(grid, key=loss)) if len(scores) else 1.0


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _vector(text, self.idf) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        s = (found[1] @ self.weights[found[0]]) / self.temperature
        p = np.exp(s - s.max())
        return self.languages[int(np.argmax(s))], float(1.0 / p.sum())


def fit(labelled: DataFrame, per_label: int = 1000, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> LanguageModel:
    """Learn from rows with a language. Frequencies come from all of them, the weights from the bounded sample."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key"))
    idf = inverse_frequencies(rows.select("text"))
    drawn = bounded_sample(rows, "lang", "key", per_label).select("lang", "text").mapInArrow(_vectors(idf), "lang string, features binary, weights binary").collect()
    drawn.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    languages = sorted({r[0] for r in drawn})
    data = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32), languages.index(r[0])) for r in drawn]
    back = data[::5] if len(data) >= 50 else []
    weights = ftrl([x for i, x in enumerate(data) if i % 5 or not back], max(1, len(languages))).astype(np.float32)
    scores = np.array([v @ weights[k] for k, v, _ in back]).reshape(len(back), max(1, len(languages)))
    return LanguageModel(languages, idf, weights, temperature(scores, np.array([x[2] for x in back], int)))


def identify(docs: DataFrame, model: LanguageModel, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``. The model's size is DIM x languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            guesses = [own.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return slim.mapInArrow(run, f"{schema}, lang_pred string, score double")

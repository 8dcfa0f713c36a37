"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of two rows of two hashed tables, so a stranger must collide twice to look like a known
word. Filters of several widths slide over the whole text, their largest answers feed a logistic layer. Fitting uses a
bounded sample of labelled rows (``per_label`` of each label); the vectors start from the words' smoothed log odds.
A quarter of the sample is held back for one decision threshold per language; at scoring the language is guessed
from the text's own words, and scores are bent so that each language's threshold lies at 0.5.

Null and empty texts get the score of no evidence. Without labelled rows of both kinds every score is 0. Repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import broadcast_if_small, discard, spread_table, store, text_chunks, word_bounds, word_hashes

ROWS = 1 << 15
WIDTH = 6
SPANS = (1, 2, 3)
FILTERS = 6
PART_ROWS = 4000
FOLDS = 4
#: Scores are counted in bins of their logit, moves of parameters as multiples of 2**-40: sums do not depend on their order.
_BINS = 1 << 16
_SPOKEN = 4 * FOLDS
_UNIT = float(1 << 40)
#: Words are runs of ASCII letters and bytes of longer characters.
_LETTERS = spread_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def _rows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(ROWS - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(ROWS - 1)).astype(np.int64)


def hashed_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the hashes of their words and each text's first word (one more at the end)."""
    for _, _, data, offsets in text_chunks(column, 1 << 20):
        starts, ends, index = word_bounds(data, offsets, _LETTERS)
        yield word_hashes(data, starts, ends), index


@dataclass
class ToxicityModel:
    tables: list[np.ndarray]
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    words_by_language: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    known: bool = True

    def pooled(self, hashes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest filter answers of each text, and the words they stand at. Texts end in zero vectors."""
        texts, m = len(index) - 1, len(hashes)
        best = np.zeros((texts, len(SPANS) * FILTERS), np.float32)
        where = np.full((texts, len(SPANS) * FILTERS), -1, np.int64)
        if not m:
            return best, where
        one, two = _rows(hashes)
        vectors = self.tables[0][one] + self.tables[1][two]
        last = np.repeat(index[1:], np.diff(index))  # end of each word's text
        filled = np.flatnonzero(np.diff(index) > 0)
        at = np.arange(m)
        for k, span in enumerate(SPANS):
            answer = np.tile(self.biases[span], (m, 1))
            for j in range(min(span, m)):
                part = vectors[j:] @ self.filters[span][j]
                part[at[: m - j] + j >= last[: m - j]] = 0
                answer[: m - j] += part
            np.maximum(answer, 0, out=answer)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            best[filled, columns] = np.maximum.reduceat(answer, index[filled], axis=0)
            if texts == 1:
                where[0, columns] = answer.argmax(0)
        return best, where

    def raw(self, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(hashes, index)
        return 1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias, -30, 30)))

    def language_of(self, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The place of each text's likeliest language; the last place stands for none."""
        guess = np.full(len(index) - 1, len(self.languages), np.int64)
        filled = np.flatnonzero(np.diff(index) > 0)
        if len(filled) and self.languages:
            votes = np.add.reduceat(self.words_by_language[_rows(hashes)[0]], index[filled], axis=0)
            guess[filled] = votes.argmax(1)
        return guess

    def scores(self, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(index) - 1)
        raw = self.raw(hashes, index)
        cut = self.thresholds[self.language_of(hashes, index)]
        return np.where(raw < cut, 0.5 * raw / cut, 0.5 + 0.5 * (raw - cut) / (1 - cut))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [h[i[r] : i[r + 1]].tobytes() for h, i in hashed_words(batch.column(2)) for r in range(len(i) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), batch.column(3)], ["label", "lang", "words", "draw"])


def _seen(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Documents of each label that hold a word of each table row: (table, label, row)."""
    seen = np.zeros((2, 2, ROWS))
    for words, label in zip(docs, labels, strict=True):
        for side, rows in enumerate(_rows(words)):
            seen[side, label, np.unique(rows)] += 1
    return seen


def _start(seen: np.ndarray, n: np.ndarray) -> ToxicityModel:
    """The untrained model: vectors from the log odds of ``_seen`` counts over ``n`` documents of each label."""
    random = np.random.RandomState(5)
    tables = [random.normal(0, 0.01, (ROWS, WIDTH)).astype(np.float32) for _ in range(2)]
    for side, table in enumerate(tables):
        rate = (seen[side] + 0.5) / (np.maximum(n, 1)[:, None] + 1.0)
        odds = np.log(rate[1] / rate[0]) * seen[side].sum(0) / (seen[side].sum(0) + 8)  # rare words count for little
        table[:, 0] = np.clip(odds, -2, 4) / 4
    filters = {s: random.normal(0, 0.1, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS}
    biases = {s: np.full(FILTERS, -0.3, np.float32) for s in SPANS}
    for s in SPANS:
        filters[s][0, 0] += 1
    return ToxicityModel(tables, filters, biases, np.full(len(SPANS) * FILTERS, 0.2, np.float32), -1.0)


def _flat(model: ToxicityModel) -> np.ndarray:
    """All parameters in rows of WIDTH, those of the tables first."""
    small = np.concatenate([*[model.filters[s].ravel() for s in SPANS], *[model.biases[s] for s in SPANS], model.out, [model.out_bias]])
    small = np.concatenate([small, np.zeros(-len(small) % WIDTH)])
    return np.concatenate([*model.tables, small.reshape(-1, WIDTH)]).astype(np.float64)


def _shaped(flat: np.ndarray) -> ToxicityModel:
    """The model of ``_flat`` rows."""
    tables = [flat[:ROWS].astype(np.float32), flat[ROWS : 2 * ROWS].astype(np.float32)]
    small, at = flat[2 * ROWS :].ravel().astype(np.float32), 0
    filters, biases = {}, {}
    for s in SPANS:
        filters[s] = small[at : at + s * WIDTH * FILTERS].reshape(s, WIDTH, FILTERS).copy()
        at += s * WIDTH * FILTERS
    for s in SPANS:
        biases[s] = small[at : at + FILTERS].copy()
        at += FILTERS
    return ToxicityModel(tables, filters, biases, small[at : at + len(SPANS) * FILTERS].copy(), float(small[at + len(SPANS) * FILTERS]))


def _train(docs: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float = 0.02, start: ToxicityModel | None = None) -> ToxicityModel:
    """Stochastic descent from ``start``, or from the log odds of ``docs`` themselves."""
    random = np.random.RandomState(5)
    model = _shaped(_flat(start or _start(_seen(docs, labels), np.bincount(labels, minlength=2))))
    tables, filters, biases = model.tables, model.filters, model.biases
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        order = random.permutation(len(docs))
        for first in range(0, len(order), 64):
            some = order[first : first + 64]
            p = model.raw(np.concatenate([docs[i] for i in some]), np.concatenate([[0], np.cumsum([len(docs[i]) for i in some])]))
            for i in some[np.abs(p - labels[some]) >= 0.02]:
                words = docs[i]
                best, where = model.pooled(words, np.array([0, len(words)]))
                wrong = 1 / (1 + np.exp(-float(np.clip(best[0] @ model.out + model.out_bias, -30, 30)))) - labels[i]
                back = wrong * model.out
                model.out -= step * (wrong * best[0] + 1e-4 * model.out)
                model.out_bias -= step * wrong
                one, two = _rows(words)
                for c in np.flatnonzero((best[0] > 0) & (where[0] >= 0)):
                    s, f, at = SPANS[c // FILTERS], c % FILTERS, where[0, c]
                    for j in range(min(s, len(words) - at)):
                        a, b = one[at + j], two[at + j]
                        vector, weight = tables[0][a] + tables[1][b], filters[s][j, :, f].copy()
                        filters[s][j, :, f] -= step * back[c] * vector
                        tables[0][a] -= step * back[c] * weight
                        tables[1][b] -= step * back[c] * weight
                    biases[s][f] -= step * back[c]
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: float = 0.5) -> float:
    """The cut between scores that gives the best F1, drawn towards ``prior`` when few positives are known.

    Each (score, label) stands for ``counts`` rows.
    """
    positives = int(counts[labels == 1].sum())
    if positives == 0 or positives == counts.sum():
        return prior
    values, place = np.unique(-scores, return_inverse=True)
    hits = np.cumsum(np.bincount(place, counts * (labels == 1)))
    f1 = 2 * hits / (np.cumsum(np.bincount(place, counts)) + positives)
    top = int(np.argmax(f1))
    below = -values[top + 1] if top + 1 < len(values) else 0.0
    cut = (-values[top] + below) / 2
    share = positives / (positives + 20)
    return float(np.clip(share * cut + (1 - share) * prior, 0.05, 0.95))


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str, lang_col: str, key_col: str) -> DataFrame:
    """(label, lang, words, draw) of every document marked 0 or 1, stored; ``draw`` is a hash of id and text."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(key_col).alias("_key"), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(key_col).alias("_key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(broadcast_if_small(known, ["_key", "label"]), "_key").select("label", "lang", "text", F.xxhash64("_key", "text", F.lit(22)).alias("draw"))
    return store(rows.mapInArrow(_hashed, "label int, lang string, words binary, draw long"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, lang, words, fold) -> (kind, lang, place, n): documents by fold, table, label and row; words by language and row."""
    seen, spoken = np.zeros((FOLDS, 2, 2, ROWS)), {}
    for batch in batches:
        docs = [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
        labels, folds = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        for fold in range(FOLDS):
            own = np.flatnonzero(folds == fold)
            seen[fold] += _seen([docs[i] for i in own], labels[own])
        for words, lang in zip(docs, batch.column(1).to_pylist(), strict=True):
            if lang is not None:
                spoken[lang] = spoken.get(lang, 0) + np.bincount(_rows(words)[0], minlength=ROWS)
    for kind, lang, n in [*[(k, None, n) for k, n in enumerate(seen.reshape(-1, ROWS))], *[(_SPOKEN, lang, n) for lang, n in spoken.items()]]:
        place = np.flatnonzero(n)
        columns = [pa.array(np.full(len(place), kind, np.int32)), pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(n[place].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "lang", "place", "n"])


def _trained(rows: DataFrame, n: int, starts: list[ToxicityModel], epochs: int) -> list[ToxicityModel]:
    """For each start the mean of the models trained on parts of about PART_ROWS of the ``n`` rows (label, words, draw, fold).

    The model of place k learns from all folds but k, the last one from all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def train(part: pa.Table) -> pa.Table:
        drawn = sorted(zip(*[part.column(x).to_pylist() for x in ("label", "words", "fold")], strict=True))
        found = []
        for k, start in enumerate(shared.value):
            used = [(label, np.frombuffer(words, np.uint64)) for label, words, fold in drawn if fold != k]
            own = _train([words for _, words in used], np.array([label for label, _ in used], int), epochs, start=start)
            moved = np.rint((_flat(own) - _flat(start)) * _UNIT).astype(np.int64)
            place = np.flatnonzero(moved.any(1))
            found.append(pa.table({"model": np.full(len(place), k, np.int32), "place": place, **{f"m{j}": moved[place, j] for j in range(WIDTH)}}))
        return pa.concat_tables(found)

    parts = rows.withColumn("part", F.pmod("draw", F.lit(-(-n // PART_ROWS)))).select("part", "label", "words", "fold")
    moves = parts.groupBy("part").applyInArrow(train, "model int, place long, " + ", ".join(f"m{j} long" for j in range(WIDTH)))
    mean = moves.groupBy("model", "place").agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in range(WIDTH)], F.count("*").alias("parts")).toArrow()
    model, place, parts = (mean.column(x).to_numpy() for x in ("model", "place", "parts"))
    moved = np.stack([mean.column(f"m{j}").to_numpy() for j in range(WIDTH)], 1) / _UNIT / parts[:, None]
    flats = [_flat(start) for start in starts]
    for k, flat in enumerate(flats):
        flat[place[model == k]] += moved[model == k]
    return [_shaped(flat) for flat in flats]


def _score_counts(rows: DataFrame, models: list[ToxicityModel]) -> DataFrame:
    """(guess, bin, label, n) of rows (label, words, fold): how many have which guessed language and which score by their fold's model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, guess = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, (words, fold) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(words, np.uint64), np.array([0, len(words) // 8])
                raw[i], guess[i] = shared.value[fold].raw(*own)[0], shared.value[fold].language_of(*own)[0]
            bins = ((np.log(raw / (1 - raw)) + 31) / 62 * _BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(guess), pa.array(bins), batch.column(0)], ["guess", "bin", "label"])

    return rows.mapInArrow(run, "guess long, bin long, label int").groupBy("guess", "bin", "label").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 4, label_col: str = "toxic", text_col: str = "text", lang_col: str = "lang",
        key_col: str = "doc_id") -> ToxicityModel:
    """Learn from every document that ``labels(key_col, label_col)`` marks 0 or 1. ``lang_col`` only sorts words by language for the thresholds."""
    stored = rows = _labelled(docs, labels, label_col, text_col, lang_col, key_col)
    total = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(total) < 2:
        empty = [np.zeros((ROWS, WIDTH), np.float32)] * 2
        return ToxicityModel(empty, {}, {}, np.zeros(0), 0.0, known=False)
    fold = F.pmod(F.xxhash64("draw"), F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("fold", fold)
    size = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "label").count().collect():
        size[r[0], r[1]] = r[2]
    counted = rows.select("label", "lang", "words", "fold").mapInArrow(_word_counts, "kind int, lang string, place long, n long")
    counted = counted.groupBy("kind", "lang", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (counted.column(x).to_numpy() for x in ("kind", "place", "n"))
    own = kind < _SPOKEN
    seen = np.zeros((4 * FOLDS, ROWS))
    seen[kind[own], place[own]] = n[own]
    seen = seen.reshape(FOLDS, 2, 2, ROWS)

    spoken = counted.column("lang").combine_chunks().dictionary_encode()
    known = sorted(x for x in spoken.dictionary.to_pylist() if x is not None)
    rank = np.array([known.index(x) for x in spoken.dictionary.to_pylist()] or [0])
    words = np.full((ROWS, max(1, len(known))), 0.1)
    words[place[~own], rank[spoken.indices.filter(pa.array(~own)).to_numpy()]] += n[~own]
    words = np.log(words / words.sum(0)).astype(np.float32)

    split = size.sum() >= 200
    folds = [[x for x in range(FOLDS) if x != k] for k in range(FOLDS + 1)]
    starts = [_start(seen[used].sum(0), size[used].sum(0)) for used in folds]
    models = [replace(m, languages=known, words_by_language=words) for m in _trained(rows, int(size.sum()), starts, epochs)]
    model = models[FOLDS]
    judged = _score_counts(rows.select("label", "words", "fold"), models[:FOLDS] if split else [model] * FOLDS).toArrow()
    guess, label, n, bins = (judged.column(x).to_numpy() for x in ("guess", "label", "n", "bin"))
    scores = 1 / (1 + np.exp(-((bins + 0.5) / _BINS * 62 - 31)))
    everywhere = best_threshold(scores, label, n)
    cuts = [best_threshold(scores[guess == k], label[guess == k], n[guess == k], everywhere) for k in range(len(known))]
    discard(stored)
    return replace(model, thresholds=np.array([*cuts, everywhere]))


def score(docs: DataFrame, model: ToxicityModel, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``score``. The model has a fixed size, some megabytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.scores(h, i) for h, i in hashed_words(batch.column(batch.num_columns - 1))]
            values = np.concatenate(found) if found else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], [*batch.schema.names[:-1], "score"])

    return slim.mapInArrow(run, f"{schema}, score double")

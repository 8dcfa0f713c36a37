"""Quality: a sparse rule ensemble compiled into Spark column expressions.

Statistics of the whole text are Spark columns. On a bounded sample of labelled rows (``per_label`` of each label)
shallow trees are grown on residuals; every path becomes a conjunctive rule; lasso logistic regression keeps a few
rules. Rules, weights and the final sigmoid are one column expression, so scoring runs inside the JVM.

Null texts count as empty; empty texts have all statistics 0 and are scored like any other. Without labelled rows of
both kinds every score is the share of label 1 (0.5 without labels). Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitframe.llm.common import sampled_texts

STATISTICS = ("chars", "words", "word_length", "upper", "digits", "marks", "loud", "distinct_words", "distinct_lines", "line_words", "long_word", "mixed")


def with_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with one double column ``_s_<name>`` for each statistic."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = df.withColumn("_words", F.split(text, r"\s+")).withColumn("_lines", F.split(text, "\n"))
    chars = F.length(text).cast("double")
    words = F.when(chars > 0, F.size("_words")).otherwise(0).cast("double")
    lines = F.when(chars > 0, F.size("_lines")).otherwise(0).cast("double")
    without = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    columns = {
        "chars": F.log1p(chars),
        "words": F.log1p(words),
        "word_length": ratio(chars, words),
        "upper": ratio(without("[A-Z]+"), chars),
        "digits": ratio(without("[0-9]+"), chars),
        "marks": ratio(without(r"[!-/:-@\[-`{-~]+"), chars),
        "loud": ratio(without("[!#$%&*|]+"), words),
        "distinct_words": ratio(F.size(F.array_distinct("_words")).cast("double"), words),
        "distinct_lines": ratio(F.size(F.array_distinct("_lines")).cast("double"), lines),
        "line_words": ratio(words, lines),
        "long_word": ratio(F.size(F.filter("_words", lambda w: F.length(w) > 15)).cast("double"), words),
        "mixed": ratio(without("[A-Za-z\\s]+"), chars),
    }
    return df.withColumns({f"_s_{name}": columns[name] for name in STATISTICS}).drop("_words", "_lines")


@dataclass
class Rule:
    """A conjunction of (statistic, above or not, cut)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for place, above, cut in self.tests:
            out &= (x[:, place] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for place, above, cut in self.tests:
            name = F.col(f"_s_{STATISTICS[place]}")
            out = out & ((name > cut) if above else (name <= cut))
        return out


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _split(x: np.ndarray, target: np.ndarray, rows: np.ndarray, places: np.ndarray, least: int) -> tuple[int, float] | None:
    """The test that lowers the squared error of the rows most."""
    best, found = 1e-9, None
    y = target[rows]
    for place in places:
        values = x[rows, place]
        order = np.argsort(values, kind="stable")
        v, sums, n = values[order], np.cumsum(y[order]), len(rows)
        left = np.arange(1, n)
        gain = sums[:-1] ** 2 / left + (sums[-1] - sums[:-1]) ** 2 / (n - left) - sums[-1] ** 2 / n
        gain[(v[1:] <= v[:-1]) | (left < least) | (n - left < least)] = -1
        k = int(np.argmax(gain)) if n > 1 else 0
        if n > 1 and gain[k] > best:
            best, found = gain[k], (int(place), float((v[k] + v[k + 1]) / 2))
    return found


def _grow(x: np.ndarray, target: np.ndarray, random: np.random.RandomState, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Every path of one tree, and the tree's own answer."""
    rules, answer = [], np.zeros(len(x))

    def down(rows: np.ndarray, tests: tuple) -> None:
        if tests:
            rules.append(Rule(tests))
        answer[rows] = target[rows].mean()
        places = random.choice(x.shape[1], max(3, x.shape[1] * 2 // 3), replace=False)
        if len(tests) < depth and len(rows) >= 2 * least and (test := _split(x, target, rows, places, least)):
            above = x[rows, test[0]] > test[1]
            down(rows[~above], (*tests, (test[0], False, test[1])))
            down(rows[above], (*tests, (test[0], True, test[1])))

    down(np.arange(len(x)), ())
    return rules, answer


def lasso(features: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal gradient; the bias is free."""
    n, k = features.shape
    design = np.hstack([features, np.ones((n, 1))])
    step = 4.0 * n / (np.linalg.norm(design, 2) ** 2 + 1e-9)
    w = np.zeros(k + 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - step * (design.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], float(w[-1])


def learn_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3) -> RuleModel:
    if not len(y):
        return RuleModel([], np.zeros(0), 0.0)
    if y.min() == y.max():
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        return RuleModel([], np.zeros(0), float(np.log(share / (1 - share))))
    random = np.random.RandomState(13)
    rules: dict[tuple, Rule] = {}
    total = np.zeros(len(y))
    for _ in range(trees):
        target = y - 1 / (1 + np.exp(-total))
        pick = random.choice(len(y), max(2, len(y) * 2 // 3), replace=False)
        found, _ = _grow(x[pick], target[pick], random, depth, max(5, len(y) // 200))
        for rule in found:
            rules.setdefault(rule.tests, rule)
        leaf = np.zeros(len(y))
        for rule in found:  # deeper rules come later and overwrite
            held = rule.holds(x)
            inside = pick[held[pick]]
            leaf[held] = target[inside].mean() if len(inside) else 0.0
        total += 1.5 * leaf
    kept = list(rules.values())
    features = np.column_stack([r.holds(x) for r in kept]).astype(float) if kept else np.zeros((len(y), 0))
    weights, bias = lasso(features, y, penalty)
    chosen = [i for i in np.argsort(-np.abs(weights), kind="stable") if abs(weights[i]) > 1e-3]
    return RuleModel([kept[i] for i in chosen], weights[chosen], bias)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, label_col: str = "quality", text_col: str = "text", key_col: str = "doc_id") -> RuleModel:
    """Learn from the documents that ``labels(key_col, label_col)`` marks 0 or 1. The thinned label is put back to its share by the bias."""
    drawn, total = sampled_texts(docs, labels, label_col, per_label, {"text": text_col}, key_col)
    drawn = with_statistics(drawn, "text").select("label", *[f"_s_{s}" for s in STATISTICS]).toArrow()
    y = drawn.column(0).to_numpy().astype(float)
    x = np.column_stack([drawn.column(i + 1).to_numpy() for i in range(len(STATISTICS))]).astype(float).reshape(len(y), len(STATISTICS))
    order = np.lexsort([*x.T, y])
    model = learn_rules(x[order], y[order])
    if 0 < y.mean() < 1:
        model.bias += float(np.log(total[1] / total[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: RuleModel, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``score``."""
    slim = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("_text"))
    return with_statistics(slim, "_text").select(*keep, model.column().alias("score"))

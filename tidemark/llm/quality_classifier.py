"""A quality classifier that is a sparse ensemble of rules.

Small trees are boosted on a bounded labelled sample's statistics; every path from a root to a node is a rule, a
conjunction of thresholds. A lasso logistic regression gives weights to the rules, most of them 0, and the others
compile into one column expression, so that scoring is a projection inside Spark over statistics that are
themselves column expressions: no Python, no shuffle.

Learning sees at most max_rows labelled rows, in the order of a hash of the id; a dozen numbers of each come to the
driver.

Defined results: null and empty texts have all statistics 0 and are scored like others. Repeated rows get equal
scores. With no usable labels, or labels of one class, every document gets that class's rate (0.5 without any). An
empty table gives no rows. Labels, lang, source and doc_id are never inputs; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import stats
from tidemark.llm.common import text_of, training_sample, words

FEATURES = ("n_words", "word_length", "unique_words", "line_words", "dup_lines", "symbols", "marks", "digits", "capitals", "stops", "pipes", "longest_word")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES, all doubles."""
    own = docs.select(F.col("doc_id"), text_of().alias("_t")).withColumn("_w", words(F.col("_t")))
    t, w = F.col("_t"), F.col("_w")
    n = stats.counts(t)
    per_word = F.greatest(F.size(w), F.lit(1))
    per_char = F.greatest(F.length(t), F.lit(1))
    cols = {
        "n_words": F.size(w),
        "word_length": stats.word_chars(t) / per_word,
        "unique_words": F.size(F.array_distinct(w)) / per_word,
        "line_words": F.size(w) / n["n_lines"],
        "dup_lines": stats.duplicate_lines(t) / n["n_lines"],
        "symbols": n["n_symbols"] / per_word,
        "marks": n["n_marks"] / per_word,
        "digits": n["n_digits"] / per_char,
        "capitals": n["n_upper"] / per_char,
        "stops": n["n_stops"] / per_word,
        "pipes": n["n_pipes"] / per_word,
        "longest_word": F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)),
    }
    return own.select("doc_id", *[cols[k].cast("double").alias(k) for k in FEATURES])


#: A condition is (feature, above, threshold): value > threshold, or value <= threshold.
Condition = tuple[int, bool, float]
RulePath = tuple[Condition, ...]


def _holds(rule: RulePath, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in rule:
        out &= (x[:, j] > at) == above
    return out


def _grow(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: RulePath, least: int, leaves: list[tuple[RulePath, np.ndarray, float]], rules: list[RulePath]) -> None:
    """One regression tree by Newton gain over binned thresholds."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best, gain = None, 1e-6
    if depth and len(rows) >= 2 * least:
        for j, at in enumerate(edges):
            if not len(at):
                continue
            bin_ = np.searchsorted(at, x[rows, j], side="left")  # bin b holds values in (at[b-1], at[b]]
            gl = np.cumsum(np.bincount(bin_, gradient[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(bin_, hessian[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(bin_, minlength=len(at) + 1))[:-1]
            own = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            own[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(np.argmax(own))
            if own[k] > gain:
                best, gain = (j, float(at[k])), own[k]
    if best is None:
        leaves.append((path, rows, float(-g / (h + 1))))
        return
    j, at = best
    for above in (False, True):
        deeper = (*path, (j, above, at))
        rules.append(deeper)
        _grow(x, edges, gradient, hessian, rows[(x[rows, j] > at) == above], depth - 1, deeper, least, leaves, rules)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, pace: float = 0.3, bins: int = 48, share: float = 0.6, seed: int = 7) -> list[RulePath]:
    """The paths of boosted trees, each grown on a random share of the rows; without repeats."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [at[at < x[:, j].max()] if len(x) else at for j, at in enumerate(edges)]
    random, f, rules = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        leaves: list[tuple[RulePath, np.ndarray, float]] = []
        rows = np.flatnonzero(random.random(len(y)) < share)
        _grow(x, edges, p - y, p * (1 - p), rows, depth, (), max(5, len(y) // 400), leaves, rules)
        for path, _, value in leaves:
            f[_holds(path, x)] += pace * value
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, m = z.shape
    v = np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    pace = 1 / (0.25 * (float(v @ (z.T @ (z @ v))) / n + 1) * 1.05)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    w1, b1, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ w1 + b1, -60, 60))) - y
        to = w1 - pace * (z.T @ r) / n
        new = np.sign(to) * np.maximum(np.abs(to) - pace * penalty, 0)
        new_b, t1 = b1 - pace * float(r.mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        w1, b1 = new + (t - 1) / t1 * (new - w), new_b + (t - 1) / t1 * (new_b - b)
        w, b, t = new, new_b, t1
    return w, b


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[RulePath, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score between 0 and 1, over columns named as FEATURES."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for j, above, at in rule:
                c = F.col(FEATURES[j])
                holds = holds & (c > at if above else c <= at)
            logit += F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return RuleEnsemble(float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -9, 9)))
    rules = extract_rules(x, y)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64)
    w, b = lasso_logistic(z, y, penalty)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> RuleEnsemble:
    sample = training_sample(labels, label, max_rows)
    rows = features(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"))
    got = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "y", *FEATURES).collect()
    got = np.array(sorted(tuple(r) for r in got), float).reshape(-1, len(FEATURES) + 2)
    return fit_rules(got[:, 2:], got[:, 1])


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, FEATURES and score."""
    return features(docs).withColumn("score", model.column())

"""A toxicity classifier regularised by counterfactuals.

Features are the words of a document and the beginnings of its words (4 to 7 letters, for inflected forms), present
or not. For each labelled training document that has identity terms, counterfactuals are made by swapping every identity
term in its text for another of the same kind. Training minimises

    mean logistic loss + l2 |w|^2 + counterfactual * mean (score(x) - score(swapped x))^2,

so identity terms can't carry weight of their own and neutral mentions of a group don't raise the score.

Identity terms are a list of kinds (IDENTITY_TERMS, a parameter), and terms found in the sample itself, in whatever
languages it holds: frequent words that both classes use alike, in pairs that are each other's nearest by the words
that stand beside them (find_terms). The model says how many pairs it was trained with, and their terms.

Learning sees a bounded sample of labelled rows (max_rows, in the order of a hash of the id); only counts of
the most telling words, of bounded lists of terms and neighbours, and that sample's sparse rows come to the driver.
Scoring is one pass over the documents without a shuffle, in Arrow batches, about a megabyte of text at a time.

Defined results: null and empty texts have no features and get the intercept's score. Texts of any length are scored
whole. Ties between features of equal weight of evidence, and between terms, go to the lesser by code point. Repeated rows
get equal scores. With no usable labels, or labels of one class alone, every document gets that class's rate (0 without
any). An empty table gives no rows. Other columns are kept and never used, but for one that is named as the score,
which gives way to it; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, free, quoted, slices, text_of, training_sample
from tidemark.shipping import ship

#: Terms for groups of people, by kind; a term is swapped for another of its kind.
IDENTITY_TERMS = {
    "faith": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    "faiths": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"],
    "origin": ["african", "american", "arab", "asian", "european", "indian", "mexican", "chinese"],
    "colour": ["black", "white", "brown"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"],
    "person": ["man", "woman"],
    "people": ["men", "women"],
    "gender": ["male", "female", "transgender"],
    "age": ["old", "young"],
    "ability": ["blind", "deaf", "disabled"],
}
#: Words that terms are found among, and words that count as their neighbours.
TERMS, NEIGHBOURS = 300, 500
#: How far from chance the label rate of a found term may be, in standard deviations, and how alike its twin's neighbours are.
BALANCED, ALIKE = 1.5, 0.5
_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, marked with a star."""
    return [word, *[f"{word[:k]}*" for k in range(4, min(7, len(word)) + 1)]]


def features(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


def swaps_of(kinds: Iterable[Sequence[str]]) -> dict[str, tuple[str, str]]:
    """For each term the next and the last of its kind; a term of several kinds belongs to the first."""
    out: dict[str, tuple[str, str]] = {}
    for kind in kinds:
        own = [t for t in dict.fromkeys(kind) if t not in out]
        if len(own) > 1:
            out |= {t: (own[(i + 1) % len(own)], own[i - 1]) for i, t in enumerate(own)}
    return out


def swapped(found: set[str], swaps: dict[str, tuple[str, str]]) -> list[set[str]]:
    """The counterfactuals of a document's words: each identity term becomes the next, or the last, of its kind."""
    if found.isdisjoint(swaps):
        return []
    out = [{swaps[w][k] if w in swaps else w for w in found} for k in (0, 1)]
    return out[:1] if out[0] == out[1] else out


def twins(counts: np.ndarray, alike: float = ALIKE) -> list[tuple[int, int]]:
    """Pairs of rows that are each other's nearest by cosine of positive pointwise mutual information, ALIKE or more."""
    total = counts.sum()
    if not total:
        return []
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(counts > 0, np.maximum(np.log(counts / expected), 0.0), 0.0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near = v @ v.T
    np.fill_diagonal(near, -1.0)
    best = near.argmax(axis=1)
    return [(i, int(j)) for i, j in enumerate(best) if i < j and best[j] == i and near[i, j] >= alike]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    #: Training documents and counterfactuals that the penalty saw, and the found kinds of terms.
    n_pairs: int = 0
    found_terms: list[tuple[str, ...]] = field(default_factory=list)
    _of_word: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def telling(self, word: str) -> tuple[str, ...]:
        """The features of a word that have weight; remembered for a bounded number of words."""
        got = self._of_word.get(word)
        if got is None:
            if len(self._of_word) > 50_000:
                self._of_word.clear()
            got = self._of_word[word] = tuple(f for f in word_features(word) if f in self.weights)
        return got

    def score(self, text: str) -> float:
        """Between 0 and 1; 1 is toxic."""
        weights = self.weights
        found = {f for w in word_set(text) for f in self.telling(w)}
        z = self.intercept + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.array([j for r in rows for j in r], np.int64)


def fit_logistic(x: list[list[int]], y: np.ndarray, pairs: list[tuple[int, list[int]]], n_features: int, l2: float, counterfactual: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept; pairs: (row of x, features of its counterfactual). Accelerated gradient descent."""
    at, col = _sparse(x)
    # a pair's gap lies in the features that only one of the two has
    lost, won = _sparse([sorted(set(x[i]) - set(c)) for i, c in pairs]), _sparse([sorted(set(c) - set(x[i])) for i, c in pairs])
    pair, feature = np.concatenate([lost[0], won[0]]), np.concatenate([lost[1], won[1]])
    sign = np.concatenate([np.ones(len(lost[0])), -np.ones(len(won[0]))])
    n, m, w, b = len(y), max(1, len(pairs)), np.zeros(n_features), 0.0

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], n) + b, -60, 60)))
        g = np.bincount(col, (p - y)[at], n_features) / n + 2 * l2 * w
        if len(pair):
            gap = np.bincount(pair, sign * w[feature], len(pairs))
            g += 2 * counterfactual / m * np.bincount(feature, sign * gap[pair], n_features)
        return g, float((p - y).mean())

    rate = 0.05
    m1, m2, c1, c2 = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        pace = rate * min(1.0, 4 * (1 - (t - 1) / steps))
        w = w - pace * (m1 / up) / (np.sqrt(m2 / down) + 1e-8)
        b -= pace * (c1 / up) / (np.sqrt(c2 / down) + 1e-8)
    return w, float(b)


def find_terms(seen: DataFrame, counts: DataFrame, base: float, n: int = TERMS, neighbours: int = NEIGHBOURS) -> list[tuple[str, str]]:
    """Pairs of terms that stand for one another in the sample: among the n most frequent words whose rate of toxic
    documents is near to the base rate, those that are each other's nearest by the words before and after them.

    seen: (text); counts: (word, n, n1). At most n terms times two sides of the neighbours are counted.
    """
    own = counts.where(~F.col("word").endswith("*") & (F.length("word") > 1)).withColumn("z", (F.col("n1") - F.col("n") * F.lit(base)) / F.sqrt(F.col("n") * F.lit(base * (1 - base))))
    beside = {r["word"]: i for i, r in enumerate(own.orderBy(F.col("n").desc(), "word").limit(neighbours).collect())}
    terms = sorted(r["word"] for r in own.where(F.abs("z") <= BALANCED).orderBy(F.col("n").desc(), "word").limit(n).collect())
    place = {t: i for i, t in enumerate(terms)}
    if len(terms) < 2:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    own = _WORD.findall(text.lower())
                    for before, word, after in zip(["", *own], own, [*own[1:], ""]):
                        if (k := place.get(word)) is not None:
                            if before in beside:
                                met[k, beside[before]] += 1
                            if after in beside:
                                met[k, len(beside) + beside[after]] += 1
        rows = sorted(met.items())
        arrays = [pa.array([i for (i, _), _ in rows], pa.int32()), pa.array([j for (_, j), _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "beside", "n"])

    table = np.zeros((len(terms), 2 * len(beside)))
    for r in seen.select("text").mapInArrow(count, "term int, beside int, n long").groupBy("term", "beside").agg(F.sum("n").alias("n")).collect():
        table[r["term"], r["beside"]] = r["n"]
    return [(terms[i], terms[j]) for i, j in twins(table)]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, max_words: int = 2_000, min_docs: int = 5, least_z: float = 4.0, l2: float = 1e-4,
    counterfactual: float = 1.0, terms: dict[str, list[str]] | None = None, find: bool = True,
) -> ToxicityModel:
    """Learn from at most max_rows labelled documents, with the max_words features that tell the classes apart best:
    those whose count among the toxic ones is least_z standard deviations or more from what chance gives.

    terms: identity terms by kind (IDENTITY_TERMS if None); find: whether further ones are looked for in the sample.
    """
    ship(docs.sparkSession)
    sample = training_sample(labels, label, max_rows)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("y", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 18):
                own = [sorted(features(word_set(t))) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.string()))], ["y", "text", "features"])

    seen = cut(rows.mapInArrow(split, "y int, text string, features array<string>"), "toxic")
    total, ones = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total or ones in (0, total):
        rate = float(ones / total) if total else 0.0
        return ToxicityModel({}, float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -9, 9)))
    base = ones / total
    counts = cut(seen.select("y", F.explode("features").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).where(F.col("n") >= min_docs), "counts")
    telling = F.abs(F.col("n1") - F.col("n") * F.lit(base)) / F.sqrt(F.col("n") * F.lit(base * (1 - base)))
    vocabulary = [r["word"] for r in counts.where(telling >= least_z).orderBy(telling.desc(), "word").limit(max_words).collect()]
    pairs_of_terms = find_terms(seen, counts, base) if find else []
    swaps = swaps_of([*(IDENTITY_TERMS if terms is None else terms).values(), *pairs_of_terms])
    vocabulary += sorted(set(swaps) - set(vocabulary))
    place = {w: j for j, w in enumerate(vocabulary)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = [], []
            for own in batch.column(1):
                own = own.as_py()
                x.append([place[f] for f in own if f in place])
                others = swapped({f for f in own if not f.endswith("*")}, swaps)
                c.append([sorted(place[f] for f in features(o) if f in place) for o in others])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.list_(pa.int32())))], ["y", "x", "c"])

    kept = seen.select("y", "features").mapInArrow(index, "y int, x array<int>, c array<array<int>>").collect()  # max_rows rows of a bounded vocabulary
    x, y = [r["x"] for r in kept], np.array([r["y"] for r in kept], float)
    pairs = [(i, c) for i, r in enumerate(kept) for c in r["c"]]
    free(seen, counts)
    w, b = fit_logistic(x, y, pairs, len(vocabulary), l2, counterfactual)
    return ToxicityModel({v: float(w[j]) for v, j in place.items() if w[j]}, b, len(pairs), pairs_of_terms)


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """docs with a score column, in one pass; every other column stays as it is."""
    ship(docs.sparkSession)
    kept = docs.select(*[quoted(c) for c in docs.columns if c != column or c == "text"])
    at, names = kept.columns.index("text"), [f"c{i}" for i in range(len(kept.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                scores = pa.array([model.score(t.as_py() or "") for t in batch.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, "score"])

    named = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)], T.StructField("score", T.DoubleType())])
    return kept.toDF(*names).mapInArrow(run, named).toDF(*kept.columns, column)

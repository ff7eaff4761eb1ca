"""Quality rules under weak supervision: rules vote or abstain, and their accuracies are estimated, not given.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (at most 3 ** rules of them, gathered by one pre-aggregated pass) estimates the
share of good documents and, for each rule, how often it votes good and bad on either class. A document is kept if
its posterior probability of being good is at least 0.5, instead of having to pass all rules; the base limits on
length and repetition hold besides.

Only column expressions touch the rows; the text is read once, and what follows works on one row of numbers a
document, written to the shared folder.

Defined results: null and empty texts have no words: all counts are 0, base_failed is true, kept is false. Repeated
rows get equal results. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import stats
from tidemark.llm.common import cut, text_of


@dataclass(frozen=True)
class Rule:
    """Votes good where good holds, else bad where bad holds, else abstains; SQL conditions over the statistics."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0).cast("int").alias(self.name)


RULES = (
    Rule("symbols", "100 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("letters", "10 * n_others < word_chars", "5 * n_others > word_chars"),
    Rule("plain_words", "100 * n_plain > 85 * n_words", "100 * n_plain < 65 * n_words"),
    Rule("capitals", "10 * n_upper < word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("marks", "50 * n_marks < n_words", "5 * n_marks > n_words"),
    Rule("lines", "n_dup_lines = 0 and n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "50 * n_repeat_words < n_words", "5 * n_repeat_words > n_words"),
    Rule("stutters", "50 * n_stutters < n_words", "8 * n_stutters > n_words"),
    Rule("lists", "n_pipes = 0", "10 * n_pipes > n_words"),
)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that the rules use."""
    text = text_of()
    own = docs.select(F.col("doc_id"), text.alias("_t")).withColumn("_h", stats.word_hashes(F.col("_t")))
    t, h = F.col("_t"), F.col("_h")
    plain = stats.counts(t)
    return own.select(
        "doc_id",
        F.size(h).cast("long").alias("n_words"),
        stats.word_chars(t).alias("word_chars"),
        stats.duplicate_lines(t).alias("n_dup_lines"),
        stats.repeated_words(h).alias("n_repeat_words"),
        stats.stutters(h).alias("n_stutters"),
        *[plain[k].alias(k) for k in ("n_symbols", "n_lines", "n_upper", "n_marks", "n_pipes", "n_others", "n_plain")],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class LabelModel:
    prior: float
    #: For each rule: chance of a good vote, and of a bad one, on good documents and on bad ones.
    votes: list[tuple[float, float, float, float]]

    def posterior(self, rules: tuple[Rule, ...] = RULES) -> Column:
        """Probability that a row is good, from its vote columns."""
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (good1, bad1, good0, bad0) in zip(rules, self.votes, strict=True):
            logit += F.when(F.col(rule.name) == 1, math.log(good1 / good0)).when(F.col(rule.name) == -1, math.log(bad1 / bad0)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def fit(patterns: Iterable[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, good_on_good: float = 0.99, good_on_bad: float = 0.7, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    Rules start as follows: of votes on good documents good_on_good are good, of those on bad ones good_on_bad, as a
    bad document mostly fails one rule and passes the others. An abstention says nothing about the class. Votes are smoothed, and no rule may end up worse than chance: it
    would have turned its meaning around.
    """
    patterns = sorted(patterns)
    first = (good_on_good, 1 - good_on_good, good_on_bad, 1 - good_on_bad)
    prior, votes = 0.8, [first] * n_rules
    for _ in range(rounds):
        before = (prior, votes)
        good_n = bad_n = smooth
        seen = [[smooth * v for v in first] for _ in range(n_rules)]
        for pattern, n in patterns:
            logit = math.log(prior / (1 - prior))
            for v, (good1, bad1, good0, bad0) in zip(pattern, votes, strict=True):
                logit += math.log(good1 / good0) if v == 1 else math.log(bad1 / bad0) if v == -1 else 0.0
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
            good_n += n * p
            bad_n += n * (1 - p)
            for own, v in zip(seen, pattern, strict=True):
                if v:
                    own[0 if v == 1 else 1] += n * p
                    own[2 if v == 1 else 3] += n * (1 - p)
        prior = min(0.99, max(0.01, good_n / (good_n + bad_n)))
        votes = []
        for good1, bad1, good0, bad0 in seen:
            on_good, on_bad = good1 / (good1 + bad1), good0 / (good0 + bad0)
            on_good, on_bad = min(0.999, max(0.001, on_good)), min(0.999, max(0.001, on_bad))
            if on_good < on_bad:
                on_good = on_bad = (on_good + on_bad) / 2
            votes.append((on_good, 1 - on_good, on_bad, 1 - on_bad))
        if abs(prior - before[0]) < 1e-9 and all(abs(a - b) < 1e-9 for x, y in zip(votes, before[1], strict=True) for a, b in zip(x, y, strict=True)):
            break
    return LabelModel(prior, votes)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the statistics, base_failed, a vote column for each rule, posterior and kept."""
    measured = cut(measure(docs), "stats")
    voted = measured.select("*", base_failed().alias("base_failed"), *[r.vote() for r in rules])
    names = [r.name for r in rules]
    found = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most 3 ** rules rows
    model = fit([(tuple(r[k] for k in names), r["_n"]) for r in found], len(rules))
    return voted.withColumn("posterior", model.posterior(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))



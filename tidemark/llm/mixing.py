"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate, the expected number of its copies in the mix, at most cap. The token constraints overlap:
every source is to hold its target, and every length class (LENGTHS) the share of tokens that it has in the input, so that
a change of sources doesn't turn into a change of lengths. Among all rates entropy balancing takes the ones nearest to 1 in
relative entropy over tokens, ``sum_i size_i * (r_i log r_i - r_i + 1)``. Sources are met exactly; classes as far as cap
and sources allow: what is missing is fined quadratically, ``sum_l (missing_l)^2 / (2 * slack * total)``.

The solution tilts exponentially: ``r_i = min(cap, exp(lambda_source + mu_class))``. lambda and mu minimise the convex dual. For a
given mu each source's lambda solves alone, so Newton steps go over mu, with the Schur complement as Hessian. Every
step is one distributed pass over the sources (a row each, tokens by class), which sums value, gradient and Hessian; only
these few numbers come to the driver.

Rates become copies in blocks of each source (documents dealt by a hash of the id, so that a source with a third of
all rows is spread): from the largest document down, a document gets the number of copies, at most cap, that
brings the block's tokens nearest to what the rates so far ask for; what is left over passes on to the next. The last
documents are small, so each block ends close to its target; single copies more or less bring it closer. Blocks of a
few long documents try several ways of rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back, cut, small, text_of
from tidemark.shipping import ship

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK_ROWS = 512
#: Lengths in words at which a new class begins.
LENGTHS = (100, 300, 1000)
#: How dear a class's missing tokens are, as a share of all tokens.
SLACK = 1e-3


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Tokens for each source: all tokens shared by weight, none above cap times its own, the excess reshared."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        unit = rest / sum(weight[s] for s in open_) if open_ else 0.0
        above = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not above:
            return {s: float(cap * sizes[s]) if s in full else unit * weight[s] for s in order}
        full.update(above)


def source_tilts(sizes: np.ndarray, goal: np.ndarray, mu: np.ndarray, cap: float = CAP) -> np.ndarray:
    """lambda of each source (row of sizes, tokens by class) at which min(cap, exp(lambda + mu)) meets its goal, by bisection;
    infinite where only cap meets it, minus infinite where nothing is asked for."""
    own = sizes.sum(axis=1)
    some = (own > 0) & (goal > 0)
    full = some & (goal >= cap * own * (1 - 1e-12))
    ratio = np.log(np.where(some, goal, 1.0) / np.where(some, own, 1.0))
    low, high = ratio - mu.max(), np.full(len(own), math.log(cap) - mu.min())
    for _ in range(100):
        mid = (low + high) / 2
        over = (sizes * np.minimum(cap, np.exp(np.minimum(mid[:, None] + mu, 50)))).sum(axis=1) > goal
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return np.where(full, np.inf, np.where(some, (low + high) / 2, -np.inf))


def dual_terms(sizes: np.ndarray, goal: np.ndarray, mu: np.ndarray, cap: float = CAP) -> tuple[float, np.ndarray, np.ndarray]:
    """What these sources add to the dual's value, gradient and Hessian in mu, with each lambda at its best."""
    lam, top = source_tilts(sizes, goal, mu, cap), math.log(cap)
    live, full = np.isfinite(lam), np.isposinf(lam)
    z, s = lam[live, None] + mu, sizes[live]
    rate = np.minimum(cap, np.exp(np.minimum(z, 50)))
    value = float((s * np.where(z <= top, rate, cap * (1 + z - top))).sum() - (lam[live] * goal[live]).sum() + (sizes[full] * cap * (1 + mu - top)).sum())
    gradient = (s * rate).sum(axis=0) + cap * sizes[full].sum(axis=0)
    moving = np.where(z < top, s * rate, 0.0)
    whole = moving.sum(axis=1)
    hessian = np.diag(moving.sum(axis=0)) - (moving / np.where(whole > 0, whole, 1.0)[:, None]).T @ moving
    return value, gradient, hessian


def balance(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], goal: np.ndarray, total: float, slack: float = SLACK, tolerance: float = 1e-9, most: int = 50) -> tuple[np.ndarray, int]:
    """mu by damped Newton steps, and the number of steps; sums gives dual_terms over all sources."""

    def at(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, hessian = sums(mu)
        return value - mu @ goal + slack * total / 2 * mu @ mu, gradient - goal + slack * total * mu, hessian + slack * total * np.eye(len(mu))

    mu, steps = np.zeros(len(goal)), 0
    value, gradient, hessian = at(mu)
    while steps < most and np.abs(gradient).max(initial=0.0) > tolerance * max(total, 1.0):
        step, scale, steps = np.linalg.solve(hessian, gradient), 1.0, steps + 1
        while True:
            new = mu - scale * step
            tried = at(new)
            if tried[0] <= value - 1e-4 * scale * float(gradient @ step) or scale < 1e-6:
                break
            scale /= 2
        mu, (value, gradient, hessian) = new, tried
    return mu, steps


def size_of(text: Column) -> Column:
    """Words of a text, counted where it is read."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_class(size: Column, lengths: tuple[int, ...] = LENGTHS) -> Column:
    """From 0 to len(lengths)."""
    return sum(((size >= n).cast("int") for n in lengths), F.lit(0))


def rates(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, lengths: tuple[int, ...] = LENGTHS, slack: float = SLACK, most_sources: int = 100_000) -> DataFrame:
    """(source, source_size, target, source_rows, rates), a row for each source; rates: one for each length class.

    Targets depend on the order of all sources, so the size of each comes to the driver, and no more of it. More than
    most_sources of them is an error: that many targets need another way to share.
    """
    spark, n = sized.sparkSession, len(lengths) + 1
    ship(spark)
    of_class = [F.sum(F.when(length_class(F.col("size"), lengths) == k, F.col("size")).otherwise(0)).cast("double") for k in range(n)]
    cells = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"), F.array(*of_class).alias("sizes")), "cells")
    found = cells.select("source", "source_size").limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = {r["source"]: int(r["source_size"]) for r in found}
    goal = targets(sizes, weights, cap)
    asked = spark.createDataFrame(list(goal.items()), "source string, target double")
    both = cells.join(F.broadcast(asked.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = cut(both, "asked").coalesce(max(1, len(found) // 1000))

    def arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.array(batch["sizes"].tolist(), float).reshape(-1, n), batch["target"].to_numpy(float)

    def sums(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                value, gradient, hessian = dual_terms(*arrays(batch), mu, cap)
                flat = [value, *gradient, *hessian.ravel()]
                yield pd.DataFrame({"k": range(len(flat)), "x": flat})

        got = {r["k"]: r["x"] for r in rows.select("sizes", "target").mapInPandas(part, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
        flat = np.array([got.get(k, 0.0) for k in range(1 + n + n * n)])
        return float(flat[0]), flat[1 : n + 1], flat[n + 1 :].reshape(n, n)

    whole = np.array([x or 0.0 for x in rows.agg(*[F.sum(F.col("sizes")[k]) for k in range(n)]).first()])
    total = float(sum(goal.values()))
    mu, _ = balance(sums, whole * (total / max(whole.sum(), 1.0)), total, slack)

    def tilted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, target = arrays(batch)
            rate = np.minimum(cap, np.exp(np.minimum(source_tilts(own, target, mu, cap)[:, None] + mu, 50)))
            yield batch.drop(columns="sizes").assign(rates=list(rate))

    return rows.mapInPandas(tilted, "source string, source_size long, source_rows long, target double, rates array<double>")


def _rounded(size: np.ndarray, rate: np.ndarray, cap: int, up: float) -> tuple[np.ndarray, float]:
    """Copies and what they leave of the tokens asked for; shares of up and more become a copy."""
    copies, owed = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size)):
        owed += rate[i] * size[i]
        copies[i] = min(cap, max(0, math.floor((owed / size[i] if size[i] else rate[i]) + 1 - up)))
        owed -= size[i] * copies[i]
    more, less = np.where((copies < cap) & (size > 0), size, np.inf), np.where((copies > 0) & (size > 0), size, np.inf)
    while abs(owed) > 0.5:  # evened out by one copy more or less, as long as that brings it nearer
        left = np.abs(owed - more) if owed > 0 else np.abs(owed + less)
        i, change = int(left.argmin()), 1 if owed > 0 else -1
        if left[i] >= abs(owed) - 1e-9:
            break
        copies[i] += change
        owed -= change * size[i]
        more[i], less[i] = size[i] if copies[i] < cap else np.inf, size[i] if copies[i] else np.inf
    return copies, owed


def round_block(block: pd.DataFrame, cap: int = CAP) -> pd.DataFrame:
    """copies for the documents of one block, see the module's text."""
    block = block.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable")
    size, rate = block["size"].to_numpy(np.int64), block["rate"].to_numpy(np.float64)
    best = _rounded(size, rate, cap, 0.5)
    for up in (0.3, 0.7, 0.1, 0.9):
        if abs(best[1]) <= 0.002 * float((rate * size).sum()):
            break
        best = min(best, _rounded(size, rate, cap, up), key=lambda x: abs(x[1]))
    block = block.assign(copies=best[0])
    return block[["doc_id", "size", "source_size", "target", "rate", "copies", "_row"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, _row): a row for each document; _row tells the whole row.

    Defined results: a null source is one of its own, ordered last; null texts have size 0. Texts of any length are
    counted whole. Documents of size 0 get their rate rounded like others, taking no tokens. Ties of size go by a hash of the
    id, then by the id. Repeated rows are decided one by one. An empty table gives no rows. Sources whose target reaches cap
    times their size have rate cap. Results depend on ids, sources and sizes alone; other columns are ignored.
    """
    ship(docs.sparkSession)
    sized = cut(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(text_of()).alias("size"), row_key(docs).alias("_row")), "sizes")
    by_source = small(cut(rates(sized, weights, cap).withColumnRenamed("source", "_source"), "rates"), 100_000)
    joined = sized.join(by_source, sized["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", F.get("rates", length_class(F.col("size")))).drop("rates")
    order = F.xxhash64("doc_id", F.lit("mix"))
    # at most 65,536 blocks a source; a block has about block_rows documents up to 33 million a source
    blocks = F.least(F.greatest(F.ceil(F.col("source_rows") / block_rows), F.lit(1)), F.lit(65_536))
    dealt = joined.withColumns({"_order": order, "_block": F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks)})
    # ids go through pandas as text: a column of numbers with a null would become one of floats there
    schema = "doc_id string, size long, source_size long, target double, rate double, copies long, _row string"
    found = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("source", "_block").applyInPandas(lambda block: round_block(block, cap), schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def row_key(docs: DataFrame) -> Column:
    """128 bits of id, source and text, nulls marked: what tells documents apart even where an id repeats."""
    marked = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(*marked, F.lit(k))), 16, "0") for k in ("a", "b")])


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix, each as often as it has copies; columns as in docs, whatever their names are.

    Equal rows share the copies that mix decided for them. Past BROADCAST_ROWS documents in the mix, texts go through one
    shuffle on their row's hash.
    """
    own = aside(docs, "doc_id", "source", "text")
    by_row = mix(own, weights, cap).groupBy("_row").agg(F.max("copies").alias("_copies"), F.min("copies").alias("_least"), F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    copies = cut(by_row.where("_copies > 0"), "copies")
    keyed, even, uneven = own.withColumn("_row", row_key(own)), copies.where("_copies = _least"), copies.where("_copies > _least")
    columns = own.columns
    taken = keyed.join(small(even), "_row").select(*columns, "_copies")
    if not uneven.isEmpty():
        # equal rows of which some have more copies than others: each takes its share of their sum
        placed = keyed.join(small(uneven), "_row").withColumn("_k", F.row_number().over(Window.partitionBy("_row").orderBy("_row")).cast("long"))
        share = F.expr("(_sum * _k) div _n - (_sum * (_k - 1)) div _n")
        taken = taken.unionByName(placed.withColumn("_copies", share).where("_copies > 0").select(*columns, "_copies"))
    return back(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))), docs, ("doc_id", "source", "text"))

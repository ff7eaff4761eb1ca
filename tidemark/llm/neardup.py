"""Near duplicates by ProbMinHash: signatures of weighted shingles, banding, and exact verification.

A document's shingles are its runs of five words (lower case; a shorter text is one shingle), weighted by how often
they occur. Similarity is the probability Jaccard of the weights, ``J_P(a, b) = sum_i 1 / sum_j max(a_j/a_i, b_j/b_i)``
over shingles i in both; for sets it is the plain Jaccard. ProbMinHash gives each shingle a Poisson process of
arrivals whose rate is its weight, seeded by the shingle; an arrival falls on a random register, and each register keeps
the shingle that arrived first. Two documents agree on a register with probability J_P. A shingle's process ends as
soon as its time passes the latest of the document's registers, so long texts need little more than one arrival each.

Equal texts become one before any pairing. Registers are banded, and a bucket of a band is settled without pairing
all its members. The bucket's head is its most popular member, the one with the most company over all its buckets:
in a family of copies that is one with few edits of its own, near to all others. All members are verified against the head
on whole shingles (a star). Large buckets whose members then still lie in different components take their next most
popular member as head, for members of other components, round after round, until a round finds no new link. These
steps are linear in the members of the buckets, and join nearly all that belongs together. A head is compared with its
members in blocks of text, each a task's work of its own, so its text goes along once a block and not once a pair.

What they leave is settled for good, in two steps. First an exact filter: shingles have one order over all texts, rare ones
first, and a text's prefix ends where what follows holds less than the threshold of its weight; two texts at the threshold
share a shingle of both prefixes. Texts of buckets with several components that share no prefix shingle with another
component are out; pages that have only a frequent template in common are. Of the others, in every such bucket the members outside its
largest component are compared with all members of other components on whole shingles, block by block; only links
become rows. So no pair of a bucket stays untried unless its ends are connected already or it can't reach the threshold.
Components come from label propagation with pointer jumping.

Buckets and nodes of many members are never one task's work: what a bucket's members look up (its head, whether it is settled)
is broadcast, if not for all buckets then for those of more than HOT members; nodes of more than HOT links are salted.

The threshold is 0.8. With 25 bands of 5 registers a pair at 0.8 misses all buckets with probability 0.00005.

Defined results: null and empty texts, and texts of white space, are equal only to equal texts (null counts as
empty). Texts of any length are compared whole, about a megabyte of them at a time. Rows that repeat a doc_id and text are one
document. An empty table gives no rows. A class is named by its smallest doc_id; ties and repeated rows don't change it.
Other columns are kept whatever their names are, but for class_id, class_size and kept, which give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, attach, back, cut, free, is_empty, is_small, slices, small, text_of
from tidemark.shipping import ship

SHINGLE = 5
BANDS = 25
ROWS = 5
THRESHOLD = 0.8
#: Buckets of at most so many texts take no further heads: comparing their members directly is as cheap.
FEW = 16
#: Bytes of text that are compared at once with as many others, about.
BLOCK = 1 << 19
#: Members that a hub is compared with at once, at most about.
MEMBERS = 64
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Members of a bucket, or links of a node, beyond which it is dealt out.
HOT = 1_000
#: Rows of what buckets look up that are broadcast.
SIDE = 200_000
#: So many of the most frequent shingles come last in prefixes, in order of their counts.
FREQUENT = 20_000

_MUL1, _MUL2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_weights(data: np.ndarray, ends: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles of texts that lie one after the other in data, UTF-8 in
    lower case; ends: where each text ends. Sorted by document and shingle."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = black.copy()
    first[1:] &= ~black[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    first[cuts] = black[cuts]
    letters = data[black]
    if not len(letters):
        return empty
    starts = np.flatnonzero(first[black])
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    word = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place], starts)
    word = mix(word + lengths.astype(np.uint64) * _GOLD)
    doc = np.searchsorted(ends, np.flatnonzero(first), side="right")
    n_words = np.bincount(doc, minlength=len(ends))
    run = word * np.uint64(3)
    for k in range(1, width):
        shifted, same, n = np.zeros_like(word), np.zeros(len(word), bool), max(0, len(word) - k)
        shifted[:n] = word[k:]
        same[:n] = doc[k:] == doc[:n]
        run = np.where(same, mix(run) + shifted * np.uint64(2 * k + 3), run)
    left = np.cumsum(n_words)[doc] - np.arange(len(word))  # words from here to the document's end
    starts_doc = np.append(True, doc[1:] != doc[:-1])
    keep = (left >= width) | (starts_doc & (n_words[doc] < width))
    doc, run = doc[keep], mix(run[keep])
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]))
    at = np.flatnonzero(new)
    return doc[at], run[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers shingles, by ProbMinHash; rows of documents without shingles are 0."""
    time = np.full(n_docs * registers, np.inf)
    got = np.zeros(n_docs * registers, np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    alone = size[doc] == 1
    table = got.reshape(n_docs, registers)
    table[doc[alone]] = shingle[alone, None]  # every register's first arrival is of the only shingle
    doc, shingle, rate = doc[~alone], shingle[~alone], 1 / weight[~alone]
    clock = np.zeros(len(doc))
    state = shingle.copy()
    latest = np.full(n_docs, np.inf)
    while len(doc):
        state = state + _GOLD
        draw = mix(state)
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(u) * rate
        alive = clock < latest[doc]
        doc, shingle, rate, clock, state = doc[alive], shingle[alive], rate[alive], clock[alive], state[alive]
        if not len(doc):
            break
        at = doc * registers + (mix(draw[alive] ^ _MUL2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, at, clock)
        won = time[at] == clock
        got[at[won]] = shingle[won]
        left = np.unique(doc)
        latest[left] = time.reshape(n_docs, registers)[left].max(axis=1)
        alive = clock < latest[doc]
        doc, shingle, rate, clock, state = doc[alive], shingle[alive], rate[alive], clock[alive], state[alive]
    return got.reshape(n_docs, registers)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_docs x bands hashes of each band's registers, as signed 64-bit numbers."""
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), (len(table), bands)).copy()
    cube = table[:, : bands * rows].reshape(len(table), bands, rows)
    for k in range(rows):
        key = mix(key ^ cube[:, :, k]) + _GOLD
    return key.view(np.int64)


def _lower(column: pa.Array) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, bands): a key that equal texts share, and the band hashes (null without words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, CHUNK):
                texts, n = _lower(batch.column(2)), batch.num_rows
                doc, shingle, weight = shingle_weights(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
                keys = band_keys(signatures(doc, shingle, weight, n, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=n) > 0
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "text_key", "bands"])

    keyed = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key binary, bands array<bigint>")


def text_key():
    return F.unhex(F.md5(text_of()))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two documents as (sorted shingles, weights), in n log n: the sum over j of max(a_j s, b_j) with
    s = b_i / a_i changes its shape only where s passes some b_j / a_j."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1] / a[1].sum(), b[1] / b[1].sum()
    xa, yb = x[ia], y[ib]
    only_a, only_b = 1 - xa.sum(), 1 - yb.sum()
    ratio = yb / xa
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], xa[order], yb[order]
    below_x, above_y = np.append(0, np.cumsum(xs)), np.append(np.cumsum(ys[::-1])[::-1], 0)
    k = np.searchsorted(r, ratio, side="right")
    # max(x_j / x_i, y_j / y_i) is x_j / x_i where y_j / x_j <= y_i / x_i, else y_j / y_i
    total = (below_x[k] + only_a) / xa + (above_y[k] + only_b) / yb
    return float((1 / total).sum())


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (hub, other) at the threshold or above, on whole texts. texts: (text_key, text, bytes).

    A hub's others are dealt into blocks of text, and the hub's text is sent to each block.
    """
    ship(pairs.sparkSession)
    sized = pairs.join(texts.select(F.col("text_key").alias("other"), "bytes"), "other")
    blocks = cut(sized.groupBy("hub").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK), F.ceil(F.count(F.lit(1)) / MEMBERS)).alias("blocks")), "blocks")
    dealt = pairs.join(small(blocks), "hub").select("hub", "other", F.pmod(F.xxhash64("other"), "blocks").alias("block"))
    others = dealt.join(texts.select(F.col("text_key").alias("other"), "text"), "other").select("hub", "block", F.col("other").alias("key"), "text")
    hubs = blocks.join(texts.select(F.col("text_key").alias("hub"), "text"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("key"), "text")

    def run(group: pa.Table) -> pa.Table:
        hub, rows = group.column("hub")[0].as_py(), list(zip(group.column("key").to_pylist(), group.column("text").to_pylist(), strict=True))
        found = block_links([(k, b"hub", t) for k, t in rows if k == hub], [(k, b"", t) for k, t in rows if k != hub], threshold)
        a, b, similarity = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(similarity, pa.float64())})

    return others.unionByName(hubs).groupBy("hub", "block").applyInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, label), a cut table of all nodes of the edges (a, b): the label is the component's smallest node.

    Links of nodes of more than hot links are dealt to so many parts, and those nodes' labels go to each part.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs, parts = None, F.coalesce("parts", F.lit(1))
    if both._cut_rows > hot:
        hubs = cut(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("b", F.ceil(F.col("n") / hot).alias("parts")), "hubs")
        hubs = None if is_empty(hubs) else hubs
    if hubs:
        dealt = cut(both.join(small(hubs), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part")), "dealt")
        free(both)
        both = dealt

    def at_neighbours(labels: DataFrame) -> DataFrame:
        own = labels.select(F.col("node").alias("b"), "label")
        if is_small(labels):
            return both.join(F.broadcast(own), "b")
        if not hubs:
            return both.join(own, "b")
        own = own.join(small(hubs), "b", "left").select("b", "label", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        return both.join(own, ["b", "part"])

    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        near = at_neighbours(labels).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        if is_small(labels):
            jump = F.broadcast(jump)
        else:  # many nodes share a label: it is looked up once for each, and hot ones don't come together
            jump = small(cut(step.select("label").distinct().join(jump, "label"), "jump"))
        new = step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new = cut(new.withColumn("fell", F.col("label") < F.col("old")), "labels")
        free(labels)
        if new.where("fell").isEmpty():
            free(both)
            return renamed(new.select("node", "label"), new)
        labels = renamed(new.select("node", "label"), new)


def renamed(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, with all rows of a cut table, known as that table."""
    df._cut_path, df._cut_rows = table._cut_path, table._cut_rows
    return df


def merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels (node, label) after further links new (a, b), both cut tables: only components that new joins are looked at."""
    nodes = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut(nodes.join(labels, "node", "left").select("node", F.col("label").alias("had"), F.coalesce("label", "node").alias("label")), "ends")

    def end(side: str) -> DataFrame:
        own = ends.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        return F.broadcast(own) if is_small(ends) else own

    joined = new.join(end("a"), "a").join(end("b"), "b").where("a_label != b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    over = components(cut(joined, "joined"))
    fresh = ends.where("had is null").select("node", "label")
    moved = labels.unionByName(fresh).join(small(renamed(over.select(F.col("node").alias("label"), F.col("label").alias("to")), over)), "label", "left")
    found = cut(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
    free(ends, over, labels)
    return found


def _fetch(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text, bytes) of the wanted keys, once each. Only their texts are shuffled if the keys are few."""
    wanted = small(cut(keys.distinct(), "wanted"))
    own = docs.select(text_key().alias("text_key"), text_of().alias("text"))
    once = own.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return cut(once.withColumn("bytes", F.octet_length("text").cast("long")), "texts")


def _at_buckets(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """rows (bucket, members, ...) joined with side (a cut table; bucket, members, ...) on the bucket. Broadcast if side is
    small, else for buckets of more than HOT members, of which there are few: all members divided by HOT at most."""
    if is_small(side, SIDE):
        return rows.join(F.broadcast(side.drop("members")), "bucket", how)
    few = cut(side.where(F.col("members") > HOT).drop("members"), "hot")
    hot = rows.where(F.col("members") > HOT).join(small(few), "bucket", how)
    return hot.unionByName(rows.where(F.col("members") <= HOT).join(side.where(F.col("members") <= HOT).drop("members"), "bucket", how))


def _populous(distinct: DataFrame) -> DataFrame:
    """(bucket, members, text_key, rank) for buckets with two texts or more; rank orders texts by their company."""
    buckets = distinct.select(F.explode("bands").alias("bucket"), "text_key")
    shared = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    if is_small(shared, SIDE):
        of_texts = buckets.join(F.broadcast(shared), "bucket")
    else:
        hot = shared.where(F.col("members") > HOT)
        of_texts = buckets.join(small(cut(hot, "hot")), "bucket").unionByName(buckets.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(shared.where(F.col("members") <= HOT), "bucket"))
    by_text = of_texts.groupBy("text_key").agg(F.sum("members").alias("company"), F.collect_list(F.struct("bucket", "members")).alias("own"))
    out = by_text.select("text_key", F.struct("company", "text_key").alias("rank"), F.explode("own").alias("o"))
    found = cut(out.select("o.bucket", "o.members", "text_key", "rank"), "members")
    free(shared)
    return found


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their labels."""
    known = members.join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("members").alias("members")).where("lo != hi").select("bucket", "members")
    return _at_buckets(known, cut(mixed, "mixed"), "left_semi")


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, shingle, weight) of texts that have words each: where each text's shingles start, and all shingles."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    doc, shingle, weight = shingle_weights(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    return np.searchsorted(doc, np.arange(len(texts) + 1)), shingle, weight


def block_links(left: list[tuple[bytes, bytes, str]], right: list[tuple[bytes, bytes, str]], threshold: float) -> list[tuple[bytes, bytes, float]]:
    """(a, b, similarity) between two lists of (text_key, label, text) where labels differ; all texts have words.

    The probability Jaccard is at most the sum of the smaller shares of each shingle, which is made for all of right
    at once; what passes is measured exactly, as a plain Jaccard where no shingle repeats.
    """
    if not left or not right:
        return []
    (at, own, weight), (to, others, their_weight) = _shingles([x[2] for x in left]), _shingles([x[2] for x in right])
    words, place = np.unique(others, return_inverse=True)
    sizes, total = np.diff(to), np.add.reduceat(their_weight, to[:-1])
    share, plain = their_weight / np.repeat(total, sizes), total == sizes
    number: dict[bytes, int] = {}
    labels, keys = np.array([number.setdefault(x[1], len(number)) for x in right]), [x[0] for x in right]
    held, out = np.zeros(len(words)), []
    for k, (key, label, _) in enumerate(left):
        mine = slice(at[k], at[k + 1])
        n, own_total = at[k + 1] - at[k], weight[mine].sum()
        where = np.minimum(np.searchsorted(words, own[mine]), len(words) - 1)
        both = words[where] == own[mine]
        held[where[both]] = weight[mine][both] / own_total
        smaller = np.add.reduceat(np.minimum(held[place], share), to[:-1])
        near = np.flatnonzero(smaller >= threshold - 1e-9)
        near = near[labels[near] != number.get(label, -1)]
        if len(near):
            met = np.add.reduceat((held > 0)[place], to[:-1], dtype=np.int64)
        for j in near:
            if plain[j] and own_total == n:
                score = float(met[j] / (n + sizes[j] - met[j]))
            else:
                theirs = slice(to[j], to[j + 1])
                score = probability_jaccard((own[mine], weight[mine]), (others[theirs], their_weight[theirs]))
            if score >= threshold - 1e-12:
                out.append((min(key, keys[j]), max(key, keys[j]), score))
        held[where[both]] = 0.0
    return out


def prefixes(own: np.ndarray, share: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """Of a text's shingles and their shares, in the order of rank and shingle, those up to where less than the threshold
    follows. Texts whose smaller shares sum to the threshold share one of both prefixes: their first common shingle."""
    order = np.lexsort((own, rank))
    left = np.cumsum(share[order][::-1])[::-1]
    return own[order[left >= threshold - 1e-9]]


def _possible(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the open members (bucket, members, text_key, label) whose text shares a prefix shingle with another component's."""
    ship(rest.sparkSession)
    open_ = cut(rest.select("text_key", "label").distinct().join(texts.select("text_key", "text"), "text_key"), "open")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for batch in slices(whole, 2, CHUNK):
                yield batch, *_shingles(batch.column(2).to_pylist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shingle, _ in each(batches):
            own, n = np.unique(shingle, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["shingle", "n"])

    common = open_.select("text_key", "label", "text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    common = common.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).collect()  # at most FREQUENT pairs of numbers
    frequent = np.array(sorted((r["shingle"], r["n"]) for r in common), np.int64).reshape(-1, 2)
    known, counts = frequent[:, 0].copy(), frequent[:, 1].copy()

    def cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, shingle, weight in each(batches):
            signed = shingle.view(np.int64)
            place = np.minimum(np.searchsorted(known, signed), max(len(known) - 1, 0))
            rank = np.where(known[place] == signed, counts[place], 0) if len(known) else np.zeros(len(signed), np.int64)
            heads = [prefixes(signed[i:j], weight[i:j] / weight[i:j].sum(), rank[i:j], threshold) for i, j in zip(at, at[1:])]
            of = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h in heads]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(heads))], ["text_key", "label", "shingle"])

    heads = cut(open_.select("text_key", "label", "text").mapInArrow(cut_off, "text_key binary, label binary, shingle long"), "prefixes")
    met = heads.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("shingle")
    alive = cut(heads.join(small(cut(met, "met")), "shingle", "left_semi").select("text_key").distinct(), "alive")
    free(open_, heads)
    return rest.join(small(alive), "text_key", "left_semi")


def _across(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of texts that share a bucket, lie in different components and are near.

    rest: (bucket, members, text_key, label) of open buckets; buckets of the same members count once. Of each bucket, members
    outside its largest component meet all members, in blocks of text; each two blocks are a row of their own, dealt
    by bucket and block, so that a large bucket is the work of many tasks and its pairs never become rows.
    """
    ship(rest.sparkSession)
    rest = cut(_possible(rest, texts, threshold), "possible")
    same = [F.bit_xor(F.xxhash64("text_key", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    once = rest.groupBy("bucket").agg(*same, F.count(F.lit(1)).alias("n"), F.first("members").alias("members")).groupBy("h1", "h2", "n").agg(F.min(F.struct("bucket", "members")).alias("b"))
    once = cut(once.select("b.bucket", "b.members"), "once")
    members = cut(_at_buckets(rest, once, "left_semi").join(texts.select("text_key", "bytes"), "text_key"), "open")
    by_label = members.groupBy("bucket", "label").agg(F.sum("bytes").alias("bytes"), F.first("members").alias("members"))
    sizes = by_label.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.max(F.struct("bytes", "label")).alias("main"), F.first("members").alias("members"))
    share = F.col("main.bytes")
    sizes = cut(sizes.select("bucket", "members", F.col("main.label").alias("main"), F.greatest(F.ceil(F.col("all") / BLOCK), F.lit(1)).alias("blocks"), F.greatest(F.ceil((F.col("all") - share) / BLOCK), F.lit(1)).alias("outer_blocks")), "blocks")
    known = _at_buckets(members, sizes).join(texts.select("text_key", "text"), "text_key")
    member, place = F.struct("text_key", "label", "text"), F.xxhash64("text_key", F.lit("block"))
    inner = known.groupBy("bucket", F.pmod(place, "blocks").alias("j")).agg(F.collect_list(member).alias("right"))
    outer = known.where("label != main").groupBy("bucket", F.pmod(place, "outer_blocks").alias("i"), "blocks").agg(F.collect_list(member).alias("left"))
    meet = outer.select("bucket", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(side: pa.Scalar) -> list[tuple[bytes, bytes, str]]:
            return list(zip(*[side.values.field(k).to_pylist() for k in ("text_key", "label", "text")], strict=True))

        for batch in batches:
            found = [x for left, right in zip(batch.column(0), batch.column(1), strict=True) for x in block_links(listed(left), listed(right), threshold)]
            a, b, similarity = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(similarity, pa.float64())], ["a", "b", "similarity"])

    return meet.join(inner, ["bucket", "j"]).select("left", "right").mapInArrow(run, "a binary, b binary, similarity double")


def links(docs: DataFrame, distinct: DataFrame, threshold: float = THRESHOLD, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) that connect every component, and the components' labels.

    distinct: (text_key, bands), a row for each text.
    """
    populous = _populous(distinct)
    last = cut(populous.groupBy("bucket").agg(F.max("rank").alias("head"), F.first("members").alias("members")), "heads")
    star = _at_buckets(populous, last).where("rank != head").select(F.col("head.text_key").alias("hub"), F.col("text_key").alias("other"))
    done = cut(star.distinct(), "star")
    texts = _fetch(docs, populous.select("text_key"))
    edges = cut(verify(done, texts, threshold), "links")
    labels, large = components(edges), populous.where(F.col("members") > few)
    while True:
        rest = cut(_labelled(large, labels), "open")
        if is_empty(rest):
            break
        lower = _at_buckets(rest, last).where("rank < head").groupBy("bucket").agg(F.max(F.struct("rank", "label")).alias("next"), F.first("members").alias("members"))
        heads = cut(lower.select("bucket", F.col("next.rank").alias("head"), F.col("next.label").alias("head_label"), "members"), "heads")
        wanted = _at_buckets(rest, heads).where("label != head_label").select(F.col("head.text_key").alias("hub"), F.col("text_key").alias("other"))
        tries = cut(wanted.distinct().join(done, ["hub", "other"], "left_anti").join(done.select(F.col("hub").alias("other"), F.col("other").alias("hub")), ["hub", "other"], "left_anti"), "tries")
        new = cut(verify(tries, texts, threshold), "links")
        free(last)
        last, done = heads, cut(done.union(tries.select("hub", "other")), "tried")
        if is_empty(new):
            break
        free(rest)
        edges, labels = cut(edges.union(new), "links"), merged(labels, new)
    # no link has come since rest was made, so large buckets needn't be looked at again
    still = _labelled(populous.where(F.col("members") <= few), labels).unionByName(rest)
    new = cut(_across(cut(still, "open"), texts, threshold).distinct(), "links")
    free(texts, populous, done)
    return (edges, labels) if is_empty(new) else (cut(edges.union(new).distinct(), "links"), merged(labels, new))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(text_key, class_id, class_size): a row for each distinct text that has copies or near copies."""
    signed = sign(docs, bands, rows).groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    distinct = cut(signed, "signed")
    _, labels = links(docs, distinct, threshold)
    named = distinct.select("text_key", "first_id", "n").join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").where("label is not null or n > 1")
    named = cut(named.withColumn("label", F.coalesce("label", "text_key")), "named")
    sums = cut(named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size")), "sums")
    free(distinct)
    return cut(attach(named, sums, "label", "class_size").select("text_key", "class_id", "class_size", "n"), "classes")


def mark(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with class_id, class_size and kept: of each class the row with the smallest doc_id is kept."""
    own = aside(docs, "doc_id", "text")
    found = classes(own, bands, rows, threshold).select(F.col("text_key").alias("_key"), F.col("class_id").alias("_class"), F.col("class_size").alias("_size"), F.col("n").alias("_n"))
    joined = attach(own.withColumn("_key", text_key()), found, "_key", "_n")
    class_id = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_class"))
    added = {"class_id": class_id, "class_size": F.coalesce("_size", F.lit(1)).cast("long"), "kept": class_id.eqNullSafe(F.col("doc_id"))}
    return back(joined.withColumns(added), docs, ("doc_id", "text"), added)

"""Packing documents into training sequences of a fixed token capacity, balanced by attention cost.

A document of n tokens costs ``linear * n + quadratic * n * n`` (its own attention block). Documents are tokenised
and packed in the task that reads them: tokens never cross the network, and each task holds one block of about
``block_tokens`` tokens (and one document more) at a time. Inside a block, full-length pieces of long documents get
sequences of their own; what remains is taken in descending order of cost, each going to the sequence with the
lowest cost among those with room. The block opens exactly as many sequences as its tokens need, so when no
sequence has room for a whole piece it is cut and fills the emptiest one: at most one sequence's worth of padding
is left per block, whatever the lengths are.

Defined results: a null or empty text is one token (the end token). A text of any length is cut into as many pieces
as it needs; a block may exceed its size by the last document. Documents of equal cost are taken in the order of their rows, and
of sequences of equal cost the first. Repeated rows are packed once each. An empty table gives no pieces. Other columns
are ignored. A retried task gives the same pieces, as all depends only on the rows of its partition and their order in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.shipping import ship

PIECES = (
    "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_cost double"
)
#: Letters (lower case too) of Latin scripts, where Python's and the tokenizer's Unicode tables agree.
_LETTERS = "a-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile("[^\t\n\r\x20-\x7eÀ-įı-ɏ]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
_open: dict[str, WordEncoder] = {}


class WordEncoder:
    """ids of texts under a word-wise BPE tokenizer file, with a bounded cache of whole words.

    Words are independent under this kind of tokenizer, so a text is split once and its words are looked up. Texts
    with characters outside plain Latin go through the tokenizer itself.
    """

    def __init__(self, path: str, most_words: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold a token of its own are left to the tokenizer.
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}
        self.most_words = most_words
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        lower = text.lower()
        if _ODD.search(text) or _ODD.search(lower) or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found, cache = _WORDS.findall(lower), self.cache
        try:
            return b"".join([cache[w] for w in found])
        except KeyError:
            if len(cache) > self.most_words:
                cache.clear()
            split = self.tokenizer.model.tokenize
            for w in set(found):
                if w not in cache:
                    spelt = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                    cache[w] = b"".join([t.id.to_bytes(4, "little") for t in split(spelt)])
            return b"".join([cache[w] for w in found])


def encoder(path: str) -> WordEncoder:
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """(document, start, length, sequence, offset) of each piece, and each sequence's cost; lengths >= 1."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    cost, room, used = np.zeros(n), np.full(n, capacity, np.int64), np.zeros(n, np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, seq, int(used[seq])))
        used[seq] += length
        room[seq] -= length
        cost[seq] += linear * length + quadratic * length * length

    full, seq = lengths // capacity, 0
    for doc in np.flatnonzero(full):
        for k in range(int(full[doc])):
            put(int(doc), k * capacity, capacity, seq)
            seq += 1
    rest = lengths - full * capacity
    live = np.arange(seq, n)
    for doc in np.argsort(-rest, kind="stable"):  # the cost grows with the length, so this is descending cost
        start, left = int(full[doc]) * capacity, int(rest[doc])
        while left:
            if not len(live) or room[live].max() == 0:
                raise AssertionError("tokens and room differ")
            fits = live[room[live] >= left]
            to = int(fits[np.argmin(cost[fits])]) if len(fits) else int(live[np.argmax(room[live])])
            length = min(left, int(room[to]))
            put(int(doc), start, length, to)
            if room[to] == 0:
                live = live[live != to]
            start, left = start + length, left - length
    return pieces, cost


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """A row for each piece, see PIECES; offset and length place it in its sequence."""
    ship(docs.sparkSession)
    schema = PIECES.format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[object, bytes]] = []
        size, kind = 0, pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal first, size
            pieces, cost = assign(np.array([len(b) // 4 for _, b in held]), capacity, linear, quadratic)
            d, s, n, q, o = (list(x) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(memoryview(held[i][1])[4 * a : 4 * (a + m)]) for i, a, m in zip(d, s, n, strict=True)]
            out = [[held[i][0] for i in d], s, n, crc, [len(held[i][1]) // 4 for i in d], [first + k for k in q], o, cost[q].tolist()]
            first += len(cost)
            held.clear()
            size = 0
            kinds = [kind, *[pa.int64()] * 6, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append((doc.as_py(), encode(text.as_py()) + end))
                size += len(held[-1][1]) // 4
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)

"""Byte-level functions: checksums, variable-length integers, bloom filters, log framing and internal keys.

The column versions work on Arrow batches; masking and internal keys are plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Checksum polynomial and mask, bloom hash, log framing.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
HASH_SEED, HASH_MUL = 0xBC9F1D34, 0xC6A4A793
BITS_PER_KEY, PROBES, MOST_PROBES, LEAST_BITS = 10, 6, 30, 64
BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
U32 = 0xFFFFFFFF


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= U32
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ U32


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & U32


def unmask(masked: int) -> int:
    rotated = (masked - MASK_DELTA) & U32
    return (rotated >> 17 | rotated << 15) & U32


def mask_column(crc: Column) -> Column:
    """mask over a long column holding 32 unsigned bits."""
    rotated = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(U32))
    return (rotated + F.lit(MASK_DELTA)) % F.lit(1 << 32)


def unmask_column(masked: Column) -> Column:
    rotated = F.pmod(masked - F.lit(MASK_DELTA), F.lit(1 << 32))
    return F.shiftright(rotated, 17).bitwiseOR(F.shiftleft(rotated, 15)).bitwiseAND(F.lit(U32))


def put_uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it); ValueError if it is cut off or over 64 bits."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise ValueError("cut off")
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            if value >> 64:
                break
            return value, at
    raise ValueError("over 64 bits")


def bloom_hash(key: bytes) -> int:
    """32 bits; whole little-endian words first, then what is left as one smaller number."""
    h = HASH_SEED ^ len(key) * HASH_MUL & U32
    whole = len(key) // 4 * 4
    for word in np.frombuffer(key[:whole], "<u4").tolist():
        h = (h + word) * HASH_MUL & U32
        h ^= h >> 16
    if rest := key[whole:]:
        h = (h + int.from_bytes(rest, "little")) * HASH_MUL & U32
        h ^= h >> 24
    return h


def bloom_positions(h: int, bits: int, probes: int) -> list[int]:
    step = (h >> 17 | h << 15) & U32
    return [((h + i * step) & U32) % bits for i in range(probes)]


def bloom_build(keys: list[bytes]) -> bytes:
    size = (max(LEAST_BITS, BITS_PER_KEY * len(keys)) + 7) // 8
    bits = np.zeros(size * 8, np.uint8)
    for k in keys:
        bits[bloom_positions(bloom_hash(k), size * 8, PROBES)] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([PROBES])


def bloom_may_contain(filter_: bytes, key: bytes) -> bool:
    """False only for a key that was not put in; a filter that can't be read says maybe."""
    if len(filter_) < 2 or filter_[-1] > MOST_PROBES:
        return True
    bits = (len(filter_) - 1) * 8
    return all(filter_[p >> 3] >> (p & 7) & 1 for p in bloom_positions(bloom_hash(key), bits, filter_[-1]))


class Damage(Exception):
    """kind is "corrupt" or "truncated"."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def frame(records: list[bytes], offset: int = 0) -> bytes:
    """Log bytes of the records, continuing a log that has so many bytes. Checksums of all fragments are made together."""
    bodies: list[bytes] = []
    gaps: list[int] = []  # zeros before each fragment
    room, gap = BLOCK - offset % BLOCK, 0
    for record in records:
        left, kind = memoryview(record), FULL
        while True:
            if room < HEADER:
                room, gap = BLOCK, gap + room
            piece = left[: room - HEADER]
            left = left[len(piece) :]
            if left.nbytes:
                kind = FIRST if kind == FULL else MIDDLE
            elif kind != FULL:
                kind = LAST
            bodies.append(bytes([kind]) + bytes(piece))
            gaps.append(gap)
            room, gap = room - HEADER - len(piece), 0
            if not left.nbytes:
                break
            kind = FIRST
    out = bytearray()
    for gap, body, crc in zip(gaps, bodies, crc32c_many(bodies).tolist(), strict=True):
        out += bytes(gap) + mask(crc).to_bytes(4, "little") + (len(body) - 1).to_bytes(2, "little") + body
    return bytes(out)


def _fragments(log: bytes) -> tuple[list[tuple[bytes, int]], str | None]:
    """(body, stored checksum) of the fragments as their headers say, up to one that doesn't fit: then "past the end"."""
    at, out = 0, []
    while True:
        room = min(BLOCK - at % BLOCK, len(log) - at)
        if at >= len(log) or room < HEADER and at + room >= len(log):
            return out, None
        if room < HEADER or (not any(log[at : at + HEADER]) and not any(log[at : at + room])):
            at += room
            continue
        size = int.from_bytes(log[at + 4 : at + 6], "little")
        if HEADER + size > room:
            return out, "past the end"
        out.append((log[at + 6 : at + HEADER + size], int.from_bytes(log[at : at + 4], "little")))
        at += HEADER + size


def unframe(log: bytes) -> Iterator[bytes]:
    """The records of a log; Damage where it isn't whole. Padding counts only if the block's rest is zero."""
    found, end = _fragments(log)
    held = None
    for (body, stored), crc in zip(found, crc32c_many([b for b, _ in found]).tolist(), strict=True):
        kind = body[0]
        if crc != unmask(stored) or kind not in (FULL, FIRST, MIDDLE, LAST) or (held is None) == (kind in (MIDDLE, LAST)):
            raise Damage("corrupt")
        held = (held or b"") + body[1:]
        if kind in (FULL, LAST):
            yield held
            held = None
    if end or held is not None:
        raise Damage("corrupt" if held is None else "truncated")


def readable(log: bytes) -> tuple[list[bytes], str]:
    """The records before the first damage, and "ok", "corrupt" or "truncated"."""
    out: list[bytes] = []
    try:
        for record in unframe(log):
            out.append(record)
    except Damage as e:
        return out, e.kind
    return out, "ok"


def encode_batch(seq: int, entries: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """entries: (kind, key, value); a deletion has no value."""
    out = bytearray(seq.to_bytes(8, "little") + len(entries).to_bytes(4, "little"))
    for kind, key, value in entries:
        out += bytes([kind]) + put_uvarint(len(key)) + key
        if kind:
            out += put_uvarint(len(value or b"")) + (value or b"")
    return bytes(out)


def decode_batch(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    """ValueError if anything is missing, left over or unknown."""
    if len(data) < 12:
        raise ValueError("cut off")
    seq, n, at, out = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:12], "little"), 12, []

    def chunk(at: int) -> tuple[bytes, int]:
        size, at = get_uvarint(data, at)
        if at + size > len(data):
            raise ValueError("cut off")
        return data[at : at + size], at + size

    for _ in range(n):
        if at >= len(data) or data[at] > 1:
            raise ValueError("unknown kind")
        kind = data[at]
        key, at = chunk(at + 1)
        value = None
        if kind:
            value, at = chunk(at)
        out.append((kind, key, value))
    if at != len(data):
        raise ValueError("left over")
    return seq, out


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """Hex of key, kind byte and seq as 7 bytes, little-endian; null where seq or kind is out of bounds."""
    big = F.lpad(F.hex(seq), 14, "0")
    little = F.concat(*[F.substring(big, 13 - 2 * i, 2) for i in range(7)])
    return F.when(seq.between(0, (1 << 56) - 1) & kind.between(0, 1), F.concat(F.hex(F.encode(key, "UTF-8")), F.lpad(F.hex(kind), 2, "0"), little))


def valid_internal_key(ikey: Column) -> Column:
    """Whether a hex string is long enough for an internal key and its kind is known; null is no key."""
    n = F.length(ikey)
    return F.coalesce((n >= 16) & (n % 2 == 0) & F.substring(ikey, n - 15, F.lit(2)).isin("00", "01"), F.lit(False))


def split_internal_key(ikey: Column) -> tuple[Column, Column, Column]:
    """(key hex, seq, kind) of a hex internal key."""
    n = F.length(ikey)
    tail = F.substring(ikey, n - 15, F.lit(16))
    big = F.concat(*[F.substring(tail, 15 - 2 * i, 2) for i in range(7)])
    return F.substring(ikey, F.lit(1), n - 16), F.conv(big, 16, 10).cast("long"), F.conv(F.substring(tail, 1, 2), 16, 10).cast("int")


def _ragged(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each string starts, its length, and the order from the longest to the shortest."""
    lengths = np.array([len(b) for b in data], np.int64)
    return np.frombuffer(b"".join(data) + b"\0" * 4, np.uint8), np.cumsum(lengths) - lengths, lengths, np.argsort(-lengths, kind="stable")


_CRC_ARRAY = np.array(_CRC, np.uint32)


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """crc32c of each string, one byte place of all of them at a time."""
    flat, start, lengths, order = _ragged(data)
    crc, sized = np.full(len(data), U32, np.uint32), lengths[order]
    for place in range(int(lengths.max(initial=0))):
        at = order[: np.searchsorted(-sized, -place, side="left")]
        if len(at) <= 8:  # few long ones are left
            for i in at:
                crc[i] = crc32c(data[i][place:], int(crc[i]) ^ U32) ^ U32
            break
        crc[at] = _CRC_ARRAY[(crc[at] ^ flat[start[at] + place]) & np.uint32(255)] ^ (crc[at] >> np.uint32(8))
    return crc ^ np.uint32(U32)


def bloom_hash_many(data: list[bytes]) -> np.ndarray:
    """bloom_hash of each string, one word of all of them at a time."""
    flat, start, lengths, order = _ragged(data)
    flat, mul = flat.astype(np.uint32), np.uint32(HASH_MUL)
    h = np.uint32(HASH_SEED) ^ (lengths.astype(np.uint32) * mul)
    whole = lengths // 4
    sized = whole[order]
    for place in range(int(whole.max(initial=0))):
        at = order[: np.searchsorted(-sized, -place, side="left")]
        byte = start[at] + 4 * place
        word = flat[byte] | flat[byte + 1] << np.uint32(8) | flat[byte + 2] << np.uint32(16) | flat[byte + 3] << np.uint32(24)
        h[at] = (h[at] + word) * mul
        h[at] ^= h[at] >> np.uint32(16)
    at = np.flatnonzero(lengths % 4)
    rest = np.zeros(len(at), np.uint32)
    for k in range(3):
        rest |= np.where(k < lengths[at] % 4, flat[start[at] + 4 * whole[at] + k], 0).astype(np.uint32) << np.uint32(8 * k)
    h[at] = (h[at] + rest) * mul
    h[at] ^= h[at] >> np.uint32(24)
    return h


def bloom_may_contain_many(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """bloom_may_contain of each key, against one filter."""
    if len(filter_) < 2 or filter_[-1] > MOST_PROBES:
        return np.ones(len(keys), bool)
    bits = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little")
    h = bloom_hash_many(keys)
    step, out = h >> np.uint32(17) | h << np.uint32(15), np.ones(len(keys), bool)
    for i in range(filter_[-1]):
        out &= bits[(h + np.uint32(i) * step) % np.uint32(len(bits))] == 1
    return out


def bloom_build_many(keys: list[bytes]) -> bytes:
    """bloom_build, all keys at once."""
    size = (max(LEAST_BITS, BITS_PER_KEY * len(keys)) + 7) // 8
    bits, h = np.zeros(size * 8, np.uint8), bloom_hash_many(keys)
    step = h >> np.uint32(17) | h << np.uint32(15)
    for i in range(PROBES):
        bits[(h + np.uint32(i) * step) % np.uint32(size * 8)] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([PROBES])


def _over(data: pd.Series, many: Callable[[list[bytes]], np.ndarray]) -> pd.Series:
    some = data.notna().to_numpy()
    out = pd.Series(pd.array([None] * len(data), "Int64"))
    out[some] = many([bytes(b) for b in data[some]]).astype(np.int64)
    return out


def _crc_batch(data: pd.Series) -> pd.Series:
    return _over(data, crc32c_many)


def _hash_batch(data: pd.Series) -> pd.Series:
    return _over(data, bloom_hash_many)


def crc32c_column(data: Column) -> Column:
    return F.pandas_udf(_crc_batch, "long")(data)


def bloom_hash_column(data: Column) -> Column:
    return F.pandas_udf(_hash_batch, "long")(data)


def bloom_group(rows: pd.DataFrame) -> pd.DataFrame:
    """For groupBy(f).applyInPandas over distinct (f, k): the run's filter is made and probed once for all its keys, and for
    as many absent ones (each key with an x behind it)."""
    keys = [k.encode() for k in sorted(rows["k"])]
    filter_ = bloom_build_many(keys)
    own, absent = bloom_may_contain_many(filter_, keys), bloom_may_contain_many(filter_, [k + b"x" for k in keys])
    return pd.DataFrame({"f": [rows["f"].iloc[0]], "n_keys": [len(keys)], "found": [int(own.sum())], "false_positives": [int(absent.sum())]})

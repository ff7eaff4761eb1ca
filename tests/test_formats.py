"""Byte formats against known vectors, round trips, and damage of every kind."""

import numpy as np
import pytest

from tidemark.functions import codec, edits, table_format as tf


def entries(n=200, versions=3):
    out = [(tf.encode_key(b"key%04d" % i, 10 * i + s, s % 2), b"some value here" if s % 2 else b"") for i in range(n) for s in range(versions, 0, -1)]
    return sorted(out, key=lambda e: tf.rank(e[0]))


def test_internal_keys():
    for key in (b"", b"a", b"some/longer/key"):
        for seq in (0, 1, 2**56 - 1):
            for kind in (0, 1):
                assert tf.split_key(tf.encode_key(key, seq, kind)) == (key, seq, kind)
    order = [(b"b", 1), (b"a", 1), (b"a", 5), (b"a", 3), (b"c", 9)]
    assert sorted(order, key=lambda x: tf.rank(tf.encode_key(*x, 1))) == [(b"a", 5), (b"a", 3), (b"a", 1), (b"b", 1), (b"c", 9)]
    for bad in ((b"k", 2**56, 1), (b"k", -1, 1), (b"k", 1, 2)):
        with pytest.raises(tf.BadFormat):
            tf.encode_key(*bad)
    assert not tf.valid_key(b"short") and not tf.valid_key(b"k\x02" + bytes(7)) and tf.valid_key(b"\x01" + bytes(7))


def test_seek_key_lands_on_the_newest_visible_version():
    keys = [tf.encode_key(b"k", s, t) for s in (100, 12, 11, 10, 9, 0) for t in (1, 0)]
    seek = tf.rank(tf.encode_key(b"k", 10, 1))
    visible = [tf.split_key(k)[1] for k in sorted(keys, key=tf.rank) if tf.rank(k) >= seek]
    assert visible == [10, 10, 9, 9, 0, 0]


def test_blocks():
    own = entries(50)
    data = tf.encode_block(own)
    assert list(tf.decode_block(data)) == own and list(tf.decode_block(tf.encode_block([]))) == []
    assert int.from_bytes(data[-4:], "little") == -(-len(own) // 16)
    with pytest.raises(tf.BadFormat):
        tf.encode_block(own[::-1])
    for bad in (b"", b"\x01", b"\xff\xff\xff\xff", b"\x05\x01\x00a" + bytes(4), b"\x00\x09\x00a" + bytes(4), b"\x80" + bytes(4)):
        with pytest.raises(tf.BadFormat):
            list(tf.decode_block(bad))


def test_a_block_of_known_bytes():
    a, b = tf.encode_key(b"ab", 1, 1), tf.encode_key(b"ac", 2, 0)
    want = b"\x00\x0a\x01" + a + b"v" + b"\x01\x09\x00" + b[1:] + bytes(4) + b"\x01\x00\x00\x00"
    assert tf.encode_block([(a, b"v"), (b, b"")]) == want


def test_handles_and_footer():
    assert tf.decode_handle(tf.encode_handle(300, 7)) == (300, 7, 3) and tf.encode_handle(300, 7) == b"\xac\x02\x07"
    footer = tf.encode_footer((1, 2), (2**63, 2**63))
    assert len(footer) == 48 and tf.decode_footer(footer) == ((1, 2), (2**63, 2**63)) and footer.endswith(tf.MAGIC)
    for bad in (footer[:-1], footer[:-1] + b"x", b"\x80" * 40 + tf.MAGIC):
        with pytest.raises(tf.BadFormat):
            tf.decode_footer(bad)


def test_tables():
    own = entries()
    table = tf.encode_table(own, 512)
    blocks, filter_ = tf.decode_table(table)
    assert [e for b in blocks for e in b] == own and len(blocks) > 10
    assert all(codec.bloom_may_contain(filter_, tf.split_key(k)[0]) for k, _ in own)
    assert [e for b in tf.decode_table(tf.encode_table([], 512))[0] for e in b] == []
    sizes = [len(tf.encode_block(b)) for b in blocks]
    assert all(512 <= n < 512 + 64 for n in sizes[:-1])


def test_every_flipped_bit_is_seen():
    own = entries(100)
    table = tf.encode_table(own, 512)
    for at in range(0, len(table), 37):
        bad = bytearray(table)
        bad[at] ^= 0x40
        try:
            blocks, _ = tf.decode_table(bytes(bad))
        except tf.BadFormat:
            continue
        assert len(table) - tf.FOOTER <= at < len(table) - len(tf.MAGIC) and [e for b in blocks for e in b] == own  # padding of the footer


def test_edits():
    edit = edits.Edit(b"order", 42, 99, 123456, [(0, 1), (2, 3)], [(0, 7, 100, b"a", b"z"), (6, 8, 2**40, b"", b"\xff")])
    data = edit.encode()
    assert edits.decode(data) == edit and edits.decode(b"") == edits.Edit()
    assert edits.Edit(log_number=0).encode() == b"\x02\x00" and edits.decode(b"\x02\x00").next_file is None
    for bad in (b"\x07", data[:-1], b"\x01\x05ab", b"\x80"):
        with pytest.raises(edits.UnknownEdit):
            edits.decode(bad)
    log = codec.frame([data, edits.Edit(last_seq=5).encode()])
    assert [e.last_seq for e in edits.decode_manifest(log)] == [123456, 5]
    for bad in (log[:10], log[:-1], b"\1" + log[1:], log[:20] + bytes([log[20] ^ 1]) + log[21:]):
        with pytest.raises(codec.Damage):
            edits.decode_manifest(bad)


def test_batches_of_strings_equal_single_ones():
    random = np.random.default_rng(4)
    data = [random.bytes(int(n)) for n in random.integers(0, 70, 300)] + [b"", b"123456789"]
    assert codec.crc32c_many(data).tolist() == [codec.crc32c(d) for d in data] and codec.crc32c_many([]).tolist() == []
    assert codec.bloom_hash_many(data).tolist() == [codec.bloom_hash(d) for d in data]
    keys = sorted({d for d in data})
    filter_ = codec.bloom_build(keys)
    assert codec.bloom_build_many(keys) == filter_
    probes = keys + [k + b"x" for k in keys]
    for f in (filter_, b"", b"\x00", b"\x00\x1f", b"\xff" * 8 + b"\x06"):
        assert codec.bloom_may_contain_many(f, probes).tolist() == [codec.bloom_may_contain(f, k) for k in probes]

import pytest

from tests.oracle import oracle_rows, rows_of
from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows_of(df)
    assert got or name in ("live_rows", "range_scan")  # these keys and runs begin at sf0.01
    if name in catalog.ORACLES:
        names, want = oracle_rows(catalog.ORACLES[name], sf)
        assert names == sorted(df.columns)
        assert got == want


def test_codecs_on_tables(spark, sf):
    assert catalog.QUERIES["wal_roundtrip"](spark, sf).where("not same").isEmpty()
    probe = catalog.QUERIES["bloom_probe"](spark, sf)
    assert probe.where("found != n_keys").isEmpty()
    assert catalog.QUERIES["internal_key_codec"](spark, sf).where("not same").isEmpty()


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

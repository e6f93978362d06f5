"""Hashes, the bloom filter, the log and table files."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvtide.functions import hashing, text
from kvtide.functions.hashing import BloomFilter, murmur3_32
from kvtide.operators.mutations import WriteBatch
from kvtide.sources import sst, wal
from kvtide.sources.wal import Record


def test_murmur_vectors():
    known = {b"": 0, b"a": 0x3C2569B2, b"ab": 0x9BBFD75F, b"abc": 0xB3DD93FA, b"abcd": 0x43ED676A, b"abcde": 0xE89B9AF6}
    assert [int(x) & 0xFFFFFFFF for x in murmur3_32(known)] == list(known.values())
    assert int(murmur3_32([b"abc"], 42)[0]) == 1313807976 and int(murmur3_32([b""], 1)[0]) & 0xFFFFFFFF == 0x514E28B7


def test_hash_columns(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    got = df.select(hashing.murmur3(F.col("b")).alias("m"), hashing.crc32(F.col("b")).alias("c")).collect()
    assert got[0].m & 0xFFFFFFFF == 0xB3DD93FA and got[0].c == zlib.crc32(b"abc") and got[1].m is None


def test_bloom(spark):
    b = BloomFilter(20_000).add(b"present:%d" % i for i in range(20_000))
    assert b.might_contain([b"present:%d" % i for i in range(20_000)]).all()
    assert b.might_contain([b"absent:%d" % i for i in range(20_000)]).mean() < 0.03
    again = BloomFilter.from_bytes(b.to_bytes())
    assert again.to_bytes() == b.to_bytes() and (again.bits, again.probes) == (191701, 7)
    df = spark.range(500).select(F.format_string("item:%d", "id").cast("binary").alias("key"))
    made = hashing.build_bloom(df, 500)
    assert made.to_bytes() == BloomFilter(500).add(b"item:%d" % i for i in range(500)).to_bytes()
    assert df.filter(~hashing.might_contain(made, F.col("key"))).count() == 0
    assert BloomFilter(0).bits == 64 and BloomFilter(10, 7.0).bits == BloomFilter(10, 0.01).bits


record = st.builds(lambda k, v, s, d, e: Record(k, b"" if d else v, s, 2 if d else 1, e), st.binary(min_size=1, max_size=20), st.binary(max_size=50), st.integers(1, 1 << 60), st.booleans(), st.integers(0, 1 << 60))


@settings(max_examples=60, deadline=None)
@given(st.lists(record, max_size=8), st.binary(max_size=6))
def test_log_round_trip_and_torn_tail(records, tail):
    data = b"".join(map(wal.encode_record, records))
    got = wal.recover(data)
    assert got.records == records and not got.truncated
    torn = wal.recover(data + b"\x12" + tail[:3])
    assert torn.records == records and torn.truncated and torn.valid_bytes == len(data)


def test_log_batches_and_damage():
    b = WriteBatch().put("a", "1").delete("b").put("c", "3", expires_at_ms=77)
    data = wal.encode_batch(b, 5)
    assert wal.recover(data).records == [Record(b"a", b"1", 5, 1, 0), Record(b"b", b"", 6, 2, 0), Record(b"c", b"3", 7, 1, 77)]
    assert wal.encode_batch(WriteBatch(), 1) == b""
    assert wal.recover(data[:-1]) == wal.Recovered([], 0, 0, True)
    bad = bytearray(data + data)
    bad[20] ^= 1
    with pytest.raises(wal.CorruptLog):
        wal.recover(bytes(bad))
    bad = bytearray(data)
    bad[-1] ^= 1  # a bad last frame is a torn one
    assert wal.recover(bytes(bad)).truncated


def test_log_sources(spark, tmp_path):
    records = [Record(b"key:%05d" % i, b"v", i + 1, 1, 0) for i in range(5000)] + [Record(b"key:00010", b"", 5001, 2, 0), Record(b"key:00020", b"", 5002, 2, 0)]
    half = len(records) // 2
    (tmp_path / "000001.wal").write_bytes(b"".join(map(wal.encode_record, records[:half])))
    (tmp_path / "000002.wal").write_bytes(b"".join(map(wal.encode_record, records[half:])) + bytes.fromhex("123456789ABCDE"))
    spark.dataSource.register(wal.WalDataSource)
    for df in (wal.read_wal(spark, f"file://{tmp_path}"), spark.read.format("kvwal").load(str(tmp_path))):
        assert df.count() == 5002 and df.agg(F.max("seq")).first()[0] == 5002


@pytest.mark.parametrize("lz4", [True, False])
def test_table_files(spark, tmp_path, lz4):
    records = [Record(b"key:%06d" % i, b"val:%06d" % i, i + 1, 1, 0) for i in range(10_000)]
    data = sst.encode_table(records, lz4)
    t = sst.Table(data)
    assert list(t) == records and (t.footer.min_key, t.footer.max_key, t.footer.entries) == (b"key:000000", b"key:009999", 10_000)
    assert t.get(b"key:004321") == records[4321] and t.get(b"key:004321", 5) is None
    assert t.get(b"key:999999") is None and t.get(b"aaa:below") is None and t.get(b"key:000000x") is None
    (tmp_path / "000001.sst").write_bytes(data)
    assert sst.read_sst(spark, f"file://{tmp_path}").agg(F.sum("seq")).first()[0] == 50_005_000
    for bad in (data[:5], data[:-1] + b"x", data[:-8] + b"\0\0\0\2" + data[-4:]):
        with pytest.raises(ValueError):
            sst.Table(bad)
    assert list(sst.Table(sst.encode_table([]))) == []


def test_compression_pays():
    records = [Record(b"key:%06d" % i, b"repetitive-payload-data-padding-string-for-compression-%d" % (i % 5), i + 1, 1, 0) for i in range(5000)]
    assert len(sst.encode_table(records)) < len(sst.encode_table(records, lz4=False)) / 2


def test_text_functions(spark):
    r = spark.range(1).select(text.file_name(F.lit(42), "sst").alias("f"), text.shortened(F.lit("abcdefgh"), 6).alias("s"), text.shortened(F.lit("abc"), 6).alias("t")).first()
    assert tuple(r) == ("000042.sst", "abc...", "abc")


def test_one_long_key_costs_only_itself():
    keys = [b"k%d" % i for i in range(20_000)] + [b"x" * (8 << 20), b""]
    got = murmur3_32(keys, 7)
    assert [int(murmur3_32([k], 7)[0]) for k in (*keys[:5], *keys[-2:])] == [*got[:5].tolist(), *got[-2:].tolist()]


def test_bloom_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hashing, "_PIECE", 16)
    df = spark.range(3000).select(F.format_string("item:%d", "id").cast("binary").alias("key")).repartition(7)
    assert hashing.build_bloom(df, 3000).to_bytes() == BloomFilter(3000).add(b"item:%d" % i for i in range(3000)).to_bytes()


def test_table_files_written_by_tasks(spark, tmp_path):
    rows = [(bytearray(b"k%04d" % i), bytearray(b"v" * (i % 50)), i + 1, 1, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "key binary, value binary, seq long, op byte, expires_at_ms long").repartition(5)
    sst.write_sst(df, f"file://{tmp_path}/sst", 3)
    files = sorted((tmp_path / "sst").iterdir())
    assert len(files) == 3 and all(f.suffix == ".sst" for f in files)
    spans = sorted((t.footer.min_key, t.footer.max_key) for t in (sst.Table(f.read_bytes()) for f in files))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(map(tuple, sst.read_sst(spark, f"file://{tmp_path}/sst").collect())) == sorted(map(tuple, df.collect()))
    got = sst.lookup_sst(spark, f"file://{tmp_path}/sst", [b"k0007", b"k2999", b"k", b"k0100"], 101).collect()
    assert sorted(r.seq for r in got) == [8, 101]
    with pytest.raises(Exception, match="sorted by key"):
        spark.dataSource.register(sst.SstDataSource)
        df.unionByName(df).coalesce(1).write.format("kvsst").mode("append").save(f"file://{tmp_path}/bad")
    assert not [f for f in (tmp_path / "bad").glob("*")] if (tmp_path / "bad").exists() else True


def test_names_of_large_numbers(spark, tmp_path):
    """The query equals its SQL beyond six digits and without a number; a file's name keeps every digit."""
    import duckdb

    from kvtide.plans import events_log as L

    ids = "VALUES (0L, 'view'), (999999L, 'signup'), (1000000L, 'purchase'), (1234567890123L, 'click'), (CAST(NULL AS BIGINT), 'error')"
    spark.sql(f"SELECT * FROM ({ids}) AS e(event_id, event_type)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in L.kv_names(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(c.sql(L.ORACLES["kv_names"]).fetchall(), key=str)
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/events.parquet").filter("event_id > 999999").orderBy("event_id").select(text.file_name(F.col("event_id"), "sst")).collect()] == ["1000000.sst", "1234567890123.sst"]

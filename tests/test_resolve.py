"""Reads over a log against a plain Python model."""

import random

import pytest

from kvtide.operators import compaction as C
from kvtide.operators import resolve as R
from kvtide.schema import DELETE, KV_SCHEMA, PUT

NOW = 1000


def rows(spark, data):
    """data: (key, value, seq, op, deadline)."""
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), s, op, e) for k, v, s, op, e in data], KV_SCHEMA)


def model(data, max_seq=None, now=NOW, lo=None, hi=None):
    out = {}
    for k, v, s, op, e in sorted(data, key=lambda r: r[2]):
        if (max_seq is None or s <= max_seq) and (lo is None or k >= lo) and (hi is None or k < hi):
            out[k] = (v, s, op, e)
    return {k: (v, s) for k, (v, s, op, e) in sorted(out.items()) if op == PUT and not (e and now >= e)}


def live(df):
    return {bytes(r.key): (bytes(r.value), r.seq) for r in df.collect()}


@pytest.fixture(scope="module")
def log():
    r = random.Random(5)
    keys = [bytes([a]) + b"k" * r.randrange(3) for a in (0x01, 0x61, 0x7F, 0x80, 0xFF) for _ in range(4)]
    return [(r.choice(keys), b"v%d" % i if r.random() > 0.1 else b"", i + 1, DELETE if r.random() < 0.2 else PUT, r.choice([0, 0, 0, 500, 1000, 1001, 5000])) for i in range(400)]


@pytest.mark.parametrize("max_seq", [None, 0, 37, 200])
@pytest.mark.parametrize("ends", [(None, None), (b"a", b"\x80"), (b"\x80", b"a"), (None, b"\x7f"), (b"\x7f", None)])
def test_scan_is_the_model(spark, log, max_seq, ends):
    got = R.scan(rows(spark, log), *ends, max_seq, NOW).collect()
    want = model(log, max_seq, NOW, *ends)
    assert [bytes(r.key) for r in got] == list(want)
    assert {bytes(r.key): (bytes(r.value), r.seq) for r in got} == want


def test_a_deadline_masks_and_never_resurrects(spark):
    data = [(b"k", b"old", 1, PUT, 0), (b"k", b"new", 2, PUT, 1000)]
    assert live(R.resolve(rows(spark, data), as_of_ms=999)) == {b"k": (b"new", 2)}
    assert live(R.resolve(rows(spark, data), as_of_ms=1000)) == {}
    assert live(R.resolve(rows(spark, data), max_seq=1, as_of_ms=1000)) == {b"k": (b"old", 1)}


def test_unsigned_key_order(spark):
    data = [(k, b"", i + 1, PUT, 0) for i, k in enumerate([b"\xff", b"\x80", b"\x7f\x00", b"\x7f"])]
    assert [bytes(r.key) for r in R.scan(rows(spark, data)).collect()] == [b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]


def test_empty_value_is_not_absent(spark):
    data = [(b"a", b"", 1, PUT, 0)]
    request = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"b")), (2, bytearray(b"a"))], "pos int, key binary")
    got = R.multi_get(rows(spark, data), request, as_of_ms=NOW).orderBy("pos").collect()
    assert [r.value for r in got] == [b"", None, b""]


def test_bounds_and_limit(spark):
    data = [(b"k%02d" % i, b"v", i + 1, PUT, 0) for i in range(10)]
    assert [bytes(r.key) for r in R.scan(rows(spark, data), b"k03", b"k07").collect()] == [b"k03", b"k04", b"k05", b"k06"]
    assert R.scan(rows(spark, data), limit=3).count() == 3
    assert [bytes(r.key) for r in R.scan_prefix(rows(spark, data), b"k0").collect()] == [k for k, *_ in data]


def test_merge_of_three_runs(spark):
    one = rows(spark, [(b"b", b"b_newest", 10, PUT, 0), (b"d", b"d", 11, PUT, 0)])
    two = rows(spark, [(b"a", b"a", 4, PUT, 0), (b"b", b"b", 5, PUT, 0), (b"c", b"", 6, DELETE, 0)])
    three = rows(spark, [(b"b", b"b0", 1, PUT, 0), (b"c", b"c", 2, PUT, 0)])
    assert live(R.merge_runs(three, one, two, as_of_ms=NOW)) == {b"a": (b"a", 4), b"b": (b"b_newest", 10), b"d": (b"d", 11)}
    assert R.merge_runs(one, two, three, drop_tombstones=False, as_of_ms=NOW).count() == 4


def test_entry_keeps_tombstones(spark):
    log = rows(spark, [(b"a", b"x", 1, PUT, 0), (b"a", b"", 2, DELETE, 0)])
    assert R.get(log, b"a", as_of_ms=NOW).count() == 0
    assert R.get_entry(log, b"a").first().seq == 2


@pytest.mark.parametrize("retain", [0, 37, 400])
@pytest.mark.parametrize("droppable", [False, True])
def test_compaction_keeps_every_read_that_it_must(spark, log, retain, droppable):
    kept = C.merged(rows(spark, log), retain, NOW, droppable)
    for s in (retain, 200, 400):
        if s >= retain:
            assert live(R.resolve(kept, s, NOW)) == model(log, s)


def test_as_of_join(spark):
    log = rows(spark, [(b"a", b"1", 2, PUT, 0), (b"a", b"", 5, DELETE, 0)])
    probes = spark.createDataFrame([(bytearray(b"a"), s) for s in (1, 2, 4, 5, 9)] + [(bytearray(b"z"), 3)], "key binary, at_seq long")
    assert sorted((bytes(r.key), r.at_seq, r.seq) for r in R.as_of(log, probes).collect()) == sorted([(b"a", 1, None), (b"a", 2, 2), (b"a", 4, 2), (b"a", 5, 5), (b"a", 9, 5), (b"z", 3, None)], key=lambda x: x[:2])


def test_range_filter_reaches_the_scan(spark, tmp_path):
    rows(spark, [(b"a", b"1", 1, PUT, 0)]).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = R.scan(spark.read.parquet(f"{tmp_path}/t"), b"a", b"b", 7, NOW)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(seq,7)" in plan

"""Tables: commits, reopening, snapshots, compaction, vacuum."""

import time

import pytest
from pyspark.sql import functions as F

from kvtide.operators import mutations as M
from kvtide.operators.compaction import FileMeta, Options, picked
from kvtide.operators.mutations import WriteBatch
from kvtide.sources.commitlog import CommitConflict
from kvtide.sources.table import KVTable


def table(spark, tmp_path, **o):
    return KVTable(spark, f"file://{tmp_path}/t", Options(**o))


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


def bulk(spark, n, value, first=0):
    df = spark.range(first, first + n).withColumn("k", F.format_string("key:%06d", "id"))
    return M.puts(df, F.col("k"), F.format_string(value, "id")).drop("k")


def test_crud_and_reopen(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(WriteBatch().put("user:1", "Alice").put("user:2", "Bob").put("user:3", "Charlie"))
    t.delete("user:2")
    t = table(spark, tmp_path)
    assert keys(t.scan("user:0", "user:9")) == ["user:1", "user:3"]
    assert t.get_string("user:1") == "Alice" and t.get("user:2") is None and t.get("user:4") is None
    assert t.get_entry("user:2").op == 2 and t.version().max_seq == 4
    assert t.multi_get(["user:3", "nobody", "user:3"]) == [b"Charlie", None, b"Charlie"]
    assert t.size() == 2


def test_bulk_append_numbers_in_order(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(bulk(spark, 10_000, "val:%06d"), "id")
    t.put("key:000500", "updated_val")
    t.delete("key:000501")
    assert t.get("key:000499") == b"val:000499" and t.get("key:000500") == b"updated_val" and t.get("key:000501") is None
    assert t.get_entry("key:000007").seq == 8
    seqs = t.rows().agg(F.count("*"), F.countDistinct("seq"), F.max("seq")).first()
    assert tuple(seqs) == (10_002, 10_002, 10_002)


def test_snapshots_survive_compaction(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=2)
    t.write(WriteBatch().put("key:1", "initial_v1").put("key:2", "initial_v1"))
    s = t.snapshot()
    t.write(WriteBatch().put("key:1", "updated_v2").delete("key:2").put("key:3", "new_key_v1"))
    before = t.scan(snapshot=s)
    assert t.compact() and not t.compact()
    assert t.compact(force=True)
    assert [t.get(f"key:{i}", s) for i in (1, 2, 3)] == [b"initial_v1", b"initial_v1", None]
    assert [t.get(f"key:{i}") for i in (1, 2, 3)] == [b"updated_v2", None, b"new_key_v1"]
    assert keys(before) == ["key:1", "key:2"]  # an open scan reads the files of its own version
    assert {f.level for f in t.version().files} == {2}


def test_deletes_hold_when_older_versions_are_elsewhere(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=1)
    t.put("k", "v1")
    t.compact()
    t.compact(force=True)  # v1 in level 2
    t.delete("k")
    t.compact(retain_seq=9)  # the tombstone in level 1 must stay
    assert t.get("k") is None and t.get_entry("k").op == 2
    t.compact(force=True, retain_seq=9)
    assert t.get("k") is None and t.get_entry("k") is None


def test_expiry_and_an_older_version(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=1)
    t.put("k", "v1")
    t.put("k", "v2", ttl_ms=1)
    time.sleep(0.01)
    assert t.get("k") is None
    t.compact(retain_seq=2)
    assert t.get("k") is None and t.get("k", 1) is None
    t.put("p", "x", ttl_ms=0)
    t.put("q", "x", ttl_ms=-5)
    assert t.get("p") == b"x" and t.get("q") == b"x"


def test_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    b = WriteBatch().put("a", "1").put("a", "2").delete("b").put("c", None)
    assert len(b) == 4 and b.approximate_bytes() == 34 + 34 + 33 + 33 and not b.is_empty()
    t.write(b)
    assert t.get("a") == b"2" and t.get("c") == b""
    n = t.version().number
    t.write(WriteBatch())
    t.write(None)
    assert t.version().number == n
    b.clear()
    assert b.is_empty()
    with pytest.raises(ValueError):
        b.put("", "x")
    with pytest.raises(ValueError):
        b.put("k", b"x" * ((100 << 20) + 1))


def test_commits_are_exclusive(spark, tmp_path):
    t = table(spark, tmp_path)
    base = t.version()
    t.put("a", "1")
    with pytest.raises(CommitConflict):
        t.log.publish(base, [], [], 0)
    other = KVTable(spark, t.path)
    other.put("b", "2")
    assert t.put("c", "3") == 3


def test_vacuum_removes_only_what_no_version_uses(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=2)
    t.put("a", "1")
    t.put("b", "2")
    t.compact()
    spark.range(1).coalesce(1).write.parquet(f"{t.path}/data/orphan")
    assert len(t.vacuum()) == 3
    assert keys(t.scan()) == ["a", "b"] and t.vacuum() == []


def test_metrics_and_levels(spark, tmp_path):
    t = table(spark, tmp_path)
    t.write(WriteBatch().put("a", "1").delete("b"))
    m = t.metrics()
    assert (m["writes"], m["deletes"], m["l0_files"], m["total_files"]) == (2, 1, 1, 1) and m["total_bytes"] > 0
    assert [(r.level, r.files, r.rows) for r in t.levels().collect()] == [(0, 1, 2)]


def test_choice_of_files():
    def f(name, level, lo, hi, size=1):
        return FileMeta(name, level, 1, size, lo, hi, 1, 1)

    files = [f("a", 0, "10", "20"), f("b", 0, "15", "30"), f("c", 1, "00", "09"), f("d", 1, "30", "40"), f("e", 2, "00", "50")]
    assert picked(files, Options()) is None
    level, got = picked(files, Options(l0_files=2))
    assert level == 1 and {x.path for x in got} == {"a", "b", "d"}
    level, got = picked(files[2:], Options(l1_bytes=2))
    assert level == 2 and {x.path for x in got} == {"c", "e"}
    assert files[0].overlaps("20", None) and not files[0].overlaps("21", None) and files[0].overlaps(None, "10")


def test_many_overwrites_then_compaction(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=3)
    for b in range(5):
        t.append(bulk(spark, 200, f"batch{b}_val%04d"), "id")
    assert t.compact()
    assert t.metrics()["l1_files"] > 0 and t.metrics()["l0_files"] == 0
    assert t.get("key:000007") == b"batch4_val0007" and t.size() == 200


def test_empty_keys_are_refused_in_bulk(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(Exception, match="a key is empty"):
        t.append(M.puts(spark.range(1), F.lit(""), F.lit("x")), "id")
    assert t.version().number == -1 and t.scan().count() == 0


def test_states_shorten_the_log(spark, tmp_path, monkeypatch):
    from kvtide.sources import commitlog

    monkeypatch.setattr(commitlog, "STATE_EVERY", 3)
    t = table(spark, tmp_path)
    for i in range(7):
        t.put(f"k{i}", str(i))
    assert t.log.numbers(".state") == [2, 5] and t.log.numbers() == list(range(7))
    t.log.delete(f"{t.log.folder}/{0:020d}.json")  # a new reader starts from the state
    again = table(spark, tmp_path)
    assert again.size() == 7 and again.version().max_seq == 7 and again.metrics()["writes"] == 7
    assert [len(table(spark, tmp_path).version(n).files) for n in (2, 4, 5, 6)] == [3, 5, 6, 7]


def test_a_half_written_commit_is_none(spark, tmp_path):
    t = table(spark, tmp_path)
    t.put("a", "1")
    (tmp_path / "t" / "_commits" / f"{1:020d}.json").write_text('{"add": [')
    again = table(spark, tmp_path)
    assert again.version().number == 0 and again.get("a") == b"1"
    with pytest.raises(CommitConflict):
        again.log.publish(again.version(), [], [], 1)
    assert again.log.repair() and not again.log.repair()
    assert again.put("b", "2") == 2


def test_compaction_beside_writers(spark, tmp_path, monkeypatch):
    """An append that lands while a compaction writes its files doesn't undo it; a compaction whose inputs are gone gives up."""
    t = table(spark, tmp_path, l0_files=2)
    t.put("a", "1")
    t.put("b", "2")
    other, real, taken = KVTable(spark, t.path, Options(l0_files=2)), KVTable._write, []

    def slow(self, rows, level):
        files = real(self, rows, level)
        if self is t and level == 1 and not taken:
            taken.append(other.put("c", "3"))
        return files

    monkeypatch.setattr(KVTable, "_write", slow)
    assert t.compact() and taken
    v = t.version()
    assert sorted(f.level for f in v.files) == [0, 1] and [t.get(k) for k in "abc"] == [b"1", b"2", b"3"] and v.max_seq == 3
    t.put("d", "4")

    def late(self, rows, level):
        files = real(self, rows, level)
        if self is t and level == 1 and len(taken) == 1:
            taken.append(other.compact())
        return files

    monkeypatch.setattr(KVTable, "_write", late)
    assert not t.compact() and taken[1] is True
    assert [t.get(k) for k in "abcd"] == [b"1", b"2", b"3", b"4"] and sum(f.rows for f in t.version().files) == 4
    t.vacuum()
    assert [t.get(k) for k in "abcd"] == [b"1", b"2", b"3", b"4"]


def test_a_writer_that_dies_leaves_no_half_commit(spark, tmp_path):
    """What is written aside doesn't count, and doesn't hold the next writer up."""
    t = table(spark, tmp_path)
    t.put("a", "1")
    (tmp_path / "t" / "_commits" / "_dead.tmp").write_text('{"add": [')
    assert table(spark, tmp_path).put("b", "2") == 2 and t.get("b") == b"2"
    assert [n for n in (tmp_path / "t" / "_commits").iterdir() if n.name.endswith(".tmp")] == [tmp_path / "t" / "_commits" / "_dead.tmp"]


def test_bulk_writers_wait_for_compaction(spark, tmp_path):
    t = table(spark, tmp_path, l0_files=2, l0_stop=3)
    for i in range(7):
        t.append(bulk(spark, 10, f"v{i}:%d").coalesce(1), "id")
    assert t.metrics()["l0_files"] <= 4 + 3 and t.metrics()["l1_files"] > 0 and t.get("key:000003") == b"v6:3"


def test_merging_without_sorting_versions(spark):
    from kvtide.operators.compaction import merged

    rows = spark.createDataFrame([("k", "v", i, 1, 0) for i in range(1, 9)] + [("d", None, 9, 2, 0)], "key string, value string, seq long, op byte, expires_at_ms long")
    plan = merged(rows, 6, 0, True)
    assert sorted(r.seq for r in plan.collect()) == [6, 7, 8, 9]
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_range_join_of_any_length(spark):
    """Short and very long intervals against plain comparison; no interval goes to more than two buckets."""
    import random

    from kvtide.operators.resolve import range_join

    r = random.Random(2)
    rows = [(i, a, a + r.choice([0, 1, 3, 8, 64, 513, 10**6, 10**12])) for i, a in ((i, r.randrange(-(10**6), 10**6)) for i in range(200))]
    points = [r.randrange(-(10**6), 2 * 10**6) for _ in range(300)]
    got = range_join(spark.createDataFrame([(p,) for p in points], "at long"), spark.createDataFrame(rows, "i int, lo long, hi long"), "at", "lo", "hi")
    assert sorted((x.at, x.i) for x in got.collect()) == sorted((p, i) for p in points for i, a, b in rows if a <= p < b)
    assert got.columns == ["at", "i", "lo", "hi"]


def test_overlap_join(spark, monkeypatch):
    import random

    from kvtide.operators import compaction as C

    monkeypatch.setattr(C, "CELLS", 5)
    r = random.Random(3)
    files = lambda: [(i, *sorted((f"{r.randrange(1000):03d}", f"{r.randrange(1000):03d}"))) for i in range(40)]
    a, b = files(), [*files(), (99, "x", "a")]
    got = C.overlap_join(*(spark.createDataFrame(x, "run int, min_key string, max_key string") for x in (a, b)))
    assert sorted((x.a_run, x.b_run) for x in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if y[1] <= y[2] and x[1] <= y[2] and x[2] >= y[1])
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_pruning_of_files_stays_with_the_executors(spark):
    """The predicate over a frame of files is that of one file, and no file's metadata goes to the driver."""
    from kvtide.operators import compaction as C
    from kvtide.plans import events_log as L

    sf = "/root/testdata/sf0.001"
    got = L.kv_file_prune(spark, sf)
    files = [FileMeta(str(r.run), 0, 1, 1, r.min_key, r.max_key, 1, 1) for r in L._runs(spark, sf).collect()]
    assert got.inputFiles() and {r.run for r in got.collect()} == {int(f.path) for f in files if f.overlaps(L.LO, L.HI)}
    df = spark.createDataFrame([(f.path, f.min_key, f.max_key) for f in files], "path string, lo string, hi string")
    for lo, hi in ((L.LO, None), (None, L.LO), (L.HI, L.LO), (L.HI, L.HI)):
        assert {r.path for r in df.filter(C.overlapping(F.col("lo"), F.col("hi"), lo, hi)).collect()} == {f.path for f in files if f.overlaps(lo, hi)}
    assert all(f.overlaps(None, None) for f in files)


def test_overlap_join_of_wide_files(spark, monkeypatch):
    """Files over most keys take a bounded number of rows in the join, and every pair comes once."""
    import random

    from kvtide.operators import compaction as C

    r = random.Random(4)
    wide = lambda n: [(i, f"{r.randrange(300):04d}", f"{r.randrange(700, 1000):04d}") for i in range(n)]
    narrow = lambda n: [(1000 + i, f"{x:04d}", f"{x + r.choice([0, 1, 5, 30]):04d}") for i, x in enumerate(r.randrange(1000) for _ in range(n))]
    a, b = [*wide(60), *narrow(200)], [*wide(50), *narrow(200)]
    frames = [spark.createDataFrame(x, "run int, min_key string, max_key string") for x in (a, b)]
    for cells in (1, 3, 4, 64, 256):
        monkeypatch.setattr(C, "CELLS", cells)
        got = C.overlap_join(*frames)
        assert sorted((x.a_run, x.b_run) for x in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])
    sides, kind = [], type(frames[0])
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, *x: sides.extend([self, other]) or join(self, other, *x))
    C.overlap_join(*(f.filter("run < 1000") for f in frames))
    assert [s.select(s.columns[0]).distinct().count() for s in sides] == [60, 50] and all(s.count() <= 25 * n for s, n in zip(sides, (60, 50), strict=True))


def test_overlap_join_carries_few_keys(spark, monkeypatch):
    """A file of one key takes three rows in the join, and rows carry only the keys that are still to be compared."""
    import random

    from kvtide.operators import compaction as C

    r = random.Random(5)
    one = lambda n: [(i, k, k) for i, k in enumerate(f"{r.randrange(2000):04d}" for _ in range(n))]
    some = lambda n: [(1000 + i, f"{k:04d}", f"{k + r.choice([9, 60, 150, 900]):04d}") for i, k in enumerate(r.randrange(1000) for _ in range(n))]
    a, b = [*one(300), *some(80)], [*one(300), *some(90)]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])
    for kind in ("string", "binary"):
        frames = [spark.createDataFrame(x, "run int, min_key string, max_key string").selectExpr("run", *(f"cast({k} as {kind}) as {k}" for k in ("min_key", "max_key"))) for x in (a, b)]
        got = C.overlap_join(*frames)
        assert got.columns == ["a_run", "a_min_key", "a_max_key", "b_run", "b_min_key", "b_max_key"]
        assert sorted((x.a_run, x.b_run) for x in got.collect()) == want
    sides, frame = [], type(frames[0])
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *x: sides.extend([self, other]) or join(self, other, *x))
    C.overlap_join(*frames)
    for p, s, n in zip("ab", sides, (80, 90), strict=True):
        assert s.filter(f"{p}_run < 1000").count() == 3 * 300 and s.filter(f"{p}_run >= 1000").count() <= 19 * n
        keys = s.filter(f"{p}_run >= 1000").agg({f"{p}_lo": "count", f"{p}_hi": "count"}).first()
        assert keys[f"count({p}_lo)"] <= 4 * n and keys[f"count({p}_hi)"] <= 2 * n

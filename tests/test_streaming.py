"""Streams into a table."""

from pyspark.sql import functions as F

from kvtide.operators import mutations as M
from kvtide.sources.table import KVTable
from kvtide.streaming import log_stream as L

SCHEMA = "n long, at timestamp, key binary, value binary, op byte, expires_at_ms long"


def slice_of(spark, lo, hi, value):
    df = spark.range(lo, hi).withColumnRenamed("id", "n").withColumn("at", F.timestamp_seconds(F.col("n") * 600))
    return M.puts(df, F.format_string("k%d", F.col("n") % 10), F.format_string(value, "n")).select("n", "at", "key", "value", "op", "expires_at_ms")


def test_restart_commits_each_batch_once(spark, tmp_path):
    t = KVTable(spark, f"file://{tmp_path}/t")
    slice_of(spark, 0, 50, "a%d").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for _ in range(2):
        L.stream_into(t, source, f"{tmp_path}/c", "n").awaitTermination()
    assert t.version().max_seq == 50 and t.get("k3") == b"a43"
    slice_of(spark, 50, 55, "b%d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    L.stream_into(t, source, f"{tmp_path}/c", "n").awaitTermination()
    assert t.version().max_seq == 55 and t.get("k3") == b"b53" and t.get("k7") == b"a47"
    assert t.append(slice_of(spark, 0, 5, "again%d"), "n", stream="log", batch=0) == 55  # sent again


def test_windows_and_sessions(spark, tmp_path):
    slice_of(spark, 0, 50, "a%d").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for name, df in (("w", L.activity(source, "at")), ("s", L.sessions(source, "at"))):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 50
    assert spark.table("s").filter("n <> 1").count() == 0


def test_late_rows_are_left_out(spark, tmp_path):
    """Rows older than the watermark don't count; rows that are late by less do."""

    def counted():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = L.activity(source, "at", late="30 minutes").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    slice_of(spark, 0, 12, "a%d").coalesce(1).write.parquet(f"{tmp_path}/in")  # two hours, six rows each
    counted()
    slice_of(spark, 10, 11, "late%d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # 10 minutes late: counts
    counted()
    slice_of(spark, 1, 3, "too late%d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counted()
    slice_of(spark, 60, 61, "end%d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counted()
    got = {r.start.hour: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 6, 1: 7}


def test_sessions_into_files(spark, tmp_path):
    """The whole result after each batch, in files and not in the driver, with the state outside the heap."""
    for lo, hi in ((0, 30), (30, 50)):
        slice_of(spark, lo, hi, "a%d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = L.into_files(L.sessions(source, "at", gap="2 hours"), f"{tmp_path}/out", f"{tmp_path}/c")
        q.awaitTermination()
        assert {(r.key, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(b"k%d" % i, hi // 10) for i in range(10)}
    assert any("rocksdb" in name for name in q.lastProgress["stateOperators"][0]["customMetrics"])
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_query_of_sessions_reads_files(spark, tmp_path):
    from kvtide.plans import events_log

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name, rows in (("some", e), ("none", e.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = events_log.kv_stream_sessions(spark, f"{tmp_path}/{name}")
        assert got.inputFiles() and got.agg(F.sum("n")).first()[0] == (rows.count() or None)


def test_query_of_sessions_keeps_users_apart(spark, tmp_path):
    """Users of more than six digits, whose keys are cut to the same six, have sessions of their own."""
    from kvtide.plans import events_log

    e = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, user_id FROM VALUES (1000001L), (1000002L), (1000002L) AS u(user_id)")
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.key, r.n) for r in events_log.kv_stream_sessions(spark, str(tmp_path)).collect()) == [("user:100000", 1), ("user:100000", 2)]

import pytest
from pyspark.sql import functions as F

from weftline.operators import state
from weftline.operators.state import last_batch, read_state, write_state
from weftline.streaming import drop_repeats, payload_stream, upsert_stream


def test_upserts_over_batches(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "state", "marks"))
    schema = "k string, n bigint"
    merged = lambda: {"n": F.coalesce("s.n", F.lit(0)) + F.coalesce("i.n", F.lit(0))}
    for batch in ([("a", 1), ("b", 2)], [("a", 5), ("c", 7)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), target, ["k"], marks, merged).awaitTermination()
    assert {r.k: r.n for r in read_state(spark, target).collect()} == {"a": 6, "b": 2, "c": 7}


def test_state_lives_as_long_as_it_is_kept_and_batches_merge_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "state", "marks"))
    schema = "k string, at bigint"
    merged = lambda: {"at": F.greatest("s.at", "i.at")}
    run = lambda m: upsert_stream(spark.readStream.schema(schema).parquet(source), target, ["k"], str(tmp_path / m), merged, lambda: F.col("at") >= 5).awaitTermination()
    spark.createDataFrame([("a", 1), ("b", 9)], schema).coalesce(1).write.mode("append").parquet(source)
    run("marks")
    assert {r.k for r in read_state(spark, target).collect()} == {"b"} and last_batch(spark, target) == 0
    # the same batch again, as after a lost checkpoint: its number is known
    run("other")
    assert {r.k: r.at for r in read_state(spark, target).collect()} == {"b": 9}


def test_a_failed_write_leaves_the_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    write_state(spark.createDataFrame([("a", 1)], "k string, n int"), path, ["k"], None, 1)
    monkeypatch.setattr(state, "_point", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write_state(spark.createDataFrame([("b", 2)], "k string, n int"), path, ["k"], None, 2)
    assert [tuple(r) for r in read_state(spark, path).collect()] == [("a", 1)] and last_batch(spark, path) == 1


def test_payloads_are_pulled_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"body": "x", "fetchedAt": "t"}\n')
    q = payload_stream(spark, str(tmp_path / "in"), "body string, fetchedAt string").writeStream.format("memory").queryName("pulled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.body for r in spark.sql("SELECT body FROM pulled").collect()] == ["x"]


def test_repeats_are_dropped_in_flight(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 00:02:00")], "k string, t string").selectExpr("k", "timestamp(t) t").coalesce(1).write.parquet(source)
    stream = drop_repeats(spark.readStream.schema("k string, t timestamp").parquet(source), ["k"], "t", "1 hour")
    q = stream.writeStream.format("memory").queryName("repeats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.sql("SELECT k FROM repeats").collect()) == ["a", "b"]

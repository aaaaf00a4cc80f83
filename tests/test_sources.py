import json
import os


from lodeweave.sources import events as ev
from lodeweave.streaming import state


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_event_log(spark, tmp_path):
    good = json.dumps({"ts": "2026-05-16T08:00:00Z", "type": "a", "data": {"v": 1}})
    write(tmp_path / "2026-05-16.jsonl", [good, "{broken", json.dumps({"ts": "x", "type": "a", "data": None})])
    write(tmp_path / "2026-05-15.jsonl", [good])
    (tmp_path / "2026-05-14.jsonl").write_text("")
    (tmp_path / "other.csv").write_text("x")
    assert ev.read_events(spark, str(tmp_path)).count() == 2
    assert ev.read_events(spark, str(tmp_path), "2026-05-16").count() == 1
    assert tuple(ev.log_size(spark, str(tmp_path)).first()) == (3, 2)


def test_write_events_cuts_long_lines(spark, tmp_path):
    df = spark.createDataFrame([("2026-05-16T08:00:00Z", "a", "1" * 5000), ("2026-05-17T08:00:00Z", "b", "{}")], "ts string, type string, data string")
    ev.write_events(df, str(tmp_path / "log"))
    rows = {r.type: r for r in ev.read_events(spark, str(tmp_path / "log")).collect()}
    assert rows["a"].data.toPython() == {"_truncated": True, "_originalType": "a"} and rows["b"].day == "2026-05-17"
    assert ev.read_events(spark, str(tmp_path / "log"), "2026-05-17").count() == 1
    assert tuple(ev.log_size(spark, str(tmp_path / "log")).first()) == (2, 2) and tuple(ev.log_size(spark, "x", False).first()) == (0, 0)
    ev.write_events(df, str(tmp_path / "off"), enabled=False)
    assert not (tmp_path / "off").exists()


def test_stats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, 1, 0, "2026-01-01T00:00:00Z"), ("x", 1, 1, 1, None)], "strategy_id string, wins bigint, zeros bigint, losses bigint, last_win string")
    ev.write_stats(df, str(tmp_path / "s"))
    assert [tuple(r) for r in ev.read_stats(spark, str(tmp_path / "s"), ["a", "b"]).collect()] == [("a", 3, 1, 0, "2026-01-01T00:00:00Z")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f.json").write_text('{"schema":1,"stats":{"a":{"wins":5.7,"zeros":-2},"b":{"wins":"no","zeros":1}}}')
    assert [tuple(r) for r in ev.read_stats(spark, str(tmp_path / "t"), ["a", "b"]).collect()] == [("a", 5, 0, 0, None)]


def test_cache(spark):
    shape = "ns string, key string, value string, stored_at timestamp, expires_at timestamp"
    rows = spark.sql("SELECT 's' ns, 'k' key, '1' value, timestamp'2026-01-01' stored_at, timestamp'2026-01-02' expires_at UNION ALL SELECT 's', 'n', '2', timestamp'2026-01-01', NULL")
    newer = spark.sql("SELECT 's' ns, 'k' key, '3' value, timestamp'2026-01-03' stored_at, timestamp'2026-01-04' expires_at")
    both = ev.put_entries(rows, newer)
    reads = spark.sql("SELECT 's' ns, 'k' key, timestamp'2026-01-04' at UNION ALL SELECT 's', 'k', timestamp'2026-01-05' UNION ALL SELECT 's', 'n', timestamp'2030-01-01' UNION ALL SELECT 's', 'q', timestamp'2026-01-01'")
    got = sorted((r.key, r.hit, r.value) for r in ev.get_entries(reads, both).collect())
    assert got == [("k", False, None), ("k", True, "3"), ("n", True, "2"), ("q", False, None)]
    assert ev.cache_size(ev.drop_entries(both, rows.where("key = 'n'").select("ns", "key"))).first().entries == 1
    assert ev.put_entries(spark.createDataFrame([], shape), newer).count() == 1


def test_tables_between_stages_are_deleted(spark, tmp_path):
    from lodeweave import storage

    with storage.scope():
        df = storage.stored(spark.range(3), "x")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def run(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql("SELECT * FROM out").collect()


def test_streamed_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"ts": f"2026-05-16T0{h}:00:00Z", "type": "a", "data": "{}"}) for h in (1, 1, 5)]
    write(tmp_path / "in" / "a.jsonl", [*lines, "{broken"])
    log = state.read_log(spark, str(tmp_path / "in"))
    rows = run(state.rolling_counts(log, "1 hour", "1 hour"), tmp_path, "complete")
    assert sorted((r.start.hour, r.events) for r in rows) == [(1, 2), (5, 1)]


def test_streamed_admission(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 100, 105])], "key bigint, at_us bigint, request_id bigint").coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema("key bigint, at_us bigint, request_id bigint").parquet(str(tmp_path / "in" / "p"))
    rows = run(state.admit(stream, 2, 100), tmp_path)
    assert {r.request_id: r.granted for r in rows} == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_running_outcomes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "win", 5), ("a", "win", 3), ("a", "zero", 9), ("b", "loss", 1)], "strategy_id string, kind string, ts bigint").write.parquet(str(tmp_path / "in" / "p"))
    got = {}
    stream = spark.readStream.schema("strategy_id string, kind string, ts bigint").parquet(str(tmp_path / "in" / "p"))
    q = state.running_outcomes(stream, lambda df: got.update({r.strategy_id: (r.wins, r.zeros, r.losses, r.last_win) for r in df.collect()}), str(tmp_path / "cp"), "1 second").start()
    q.processAllAvailable()
    q.stop()
    assert got == {"a": (2, 1, 0, 5), "b": (0, 0, 1, None)}

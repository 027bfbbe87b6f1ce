"""Session memory and streamed counters: batches against a plain loop, streams against batches."""

import datetime
import random

from pyspark.sql import functions as F

from lexgrove.operators import sessions
from lexgrove.streaming import live

KIND = "user long, ts timestamp, seq long, question string, answer string, refused boolean"
START = datetime.datetime(2024, 5, 1, 22, 0)


def turns(seed, n=400):
    rnd = random.Random(seed)
    at = lambda: START + datetime.timedelta(minutes=rnd.choice([0, 7, 29, 30, 31, 59, 61, 200]) + 10 * rnd.randrange(300))
    rows = [(rnd.choice([1, 1, 1, 2, 3]), at(), k, f"q{k}", rnd.choice(["a", "", None, "b"]), rnd.choice([False, False, True, None])) for k in range(n)]
    return [*rows, (None, START, n, "q", "a", False), (1, None, n + 1, "q", "a", False)]


def loop(rows, gap):
    out, state = {}, {}
    for user, ts, seq, question, answer, refused in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        last, began, kept = state.get(user, (None, None, None))
        if last is None or ts >= last + datetime.timedelta(minutes=gap):
            began, kept = ts, None
        out[seq] = (began, kept and kept[0], question + (f" {kept[1]}" if kept else ""))
        state[user] = (ts, began, (seq, question) if answer and not refused else kept)
    return out


def test_the_last_kept_turn_is_remembered(spark):
    for seed in range(3):
        rows = turns(seed)
        got = sessions.remembered(spark.createDataFrame(rows, KIND).repartition(4)).collect()
        want = loop(rows, 30)
        assert len(got) == len(rows)
        for r in got:
            assert (r.session, r.previous and r.previous.seq, r.query) == want.get(r.seq, (None, None, "q"))
    assert sessions.remembered(spark.createDataFrame([], KIND)).collect() == []


def test_a_stream_remembers_as_a_batch_does(spark, tmp_path):
    rows = sorted((r for r in turns(5) if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2]))
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sessions.remembered_stream(stream, late="3 days").writeStream.format("memory").queryName("turns").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: (r.session, r.previous_seq, r.query) for r in spark.table("turns").collect()}
    assert got == loop(rows, 30)


def test_streamed_counters_count_each_event_once(spark, tmp_path):
    kind, start = "event_id long, ts timestamp, event_type string, value double", datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=11 * k), "ab"[k % 2], float(k)) for k in range(120)]
    parts = [rows[:40], rows[40:80] + rows[30:40], rows[35:36] + rows[80:] + rows[:10]]  # repeats within the watermark, and far behind it
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.follow_counters(stream(), f"{tmp_path}/out", f"{tmp_path}/c", late="12 hours").awaitTermination()
    counters = lambda: sorted(tuple(r) for r in live.current_counters(spark, f"{tmp_path}/out").collect())
    want = sorted(tuple(r) for r in live.event_counters(spark.createDataFrame(rows, kind)).collect())
    assert counters() == want and len(live.committed(spark, f"{tmp_path}/out")) >= 3
    # a restart without the checkpoint gives every batch again: the log has their numbers, and nothing changes
    live.follow_counters(stream(), f"{tmp_path}/out", f"{tmp_path}/c2", late="12 hours").awaitTermination()
    assert counters() == want
    # a batch that was written but not logged doesn't count
    spark.createDataFrame([(start, "a", 99, 1.0, 77)], "start timestamp, event_type string, n long, total double, batch long").write.parquet(f"{tmp_path}/out/changes/77")
    assert counters() == want


def test_session_table(spark):
    got = sessions.sessions(spark.createDataFrame(turns(1), KIND).where("user is not null and ts is not null")).agg(F.sum("turns")).first()[0]
    assert got == 400

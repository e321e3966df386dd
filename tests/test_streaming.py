"""Streams in several batches, across restarts, with late rows."""

from pyspark.sql import functions as F

from tracelark.operators import spans
from tracelark.streaming.live import live_blocks, live_traffic


def drain(spark, plan, source, schema, state, mode, kept):
    """Runs the stream over what lies in the folder now, and adds what it puts out."""
    out = []
    sink = lambda batch, n: out.append(batch.collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    plan(stream).writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    kept += [r for batch in out for r in batch]
    return len(out)


def test_blocks_stay_open_across_batches_and_restarts(spark, tmp_path):
    rows, seq = [], {}
    for k in range(40):
        for t in (1, 2):
            seq[t] = seq.get(t, 0) + 1
            rows.append((t, seq[t], 10 * k + t, "E" if k < 20 else "L", f"f{min(k, 39 - k)}"))
    schema = "thread_id long, seq_no long, ts_ns long, phase string, name string"
    got: list = []
    for part in range(4):  # each part a run of its own, from the state that the last one left; two files a run
        for half in range(2):
            cut = rows[20 * part + 10 * half : 20 * part + 10 * half + 10]
            spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(spark, live_blocks, str(tmp_path / "in"), schema, str(tmp_path / "state"), "append", got)
    whole = spans.pair_blocks(spark.createDataFrame(rows, schema)).select("thread_id", "depth", "name", "start_ns", "finish_ns")
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole.collect())) and len(got) == 40


def test_traffic_windows_close_and_late_rows_are_left_out(spark, tmp_path):
    schema = "record int, ts_ns long, msg_length long"
    hour = 3_600_000_000_000
    batches = [[(4, 1 * hour, 10), (8, 2 * hour, 5), (58, 2 * hour, 99)], [(9, 30 * hour, 7)], [(4, 3 * hour, 1000), (5, 31 * hour, 1)], [(4, 80 * hour, 2)], [(4, 81 * hour, 3)]]
    got: list = []
    plan = lambda s: live_traffic(s).select((F.unix_micros("start") * 1000).alias("start_ns"), "bytes", "messages")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(spark, plan, str(tmp_path / "in"), schema, str(tmp_path / "state"), "append", got)
    assert sorted(map(tuple, got)) == [(0, 15, 2), (24 * hour, 8, 2)]

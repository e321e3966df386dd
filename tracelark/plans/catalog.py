"""The registered queries: each operator applied to traces derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.murmur import murmur3_words
from ..model import is_comm, is_recv, is_send
from ..operators import comm, grammar, order, spans, traverse
from ..scratch import Scratch
from ..sources import fixtures as fx
from ..sources.store import Trace, read_config
from . import program, program_sql
from .oracle import DAY_NS, EDGES, HI, LO, ORACLE, SLICES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _on(source: Callable[[SparkSession, str], DataFrame], *names: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function of one fixture under its own name (and further names)."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        for name in (f.__name__, *names):
            QUERIES[name] = lambda spark, sf_dir: f(source(spark, sf_dir))
        return f

    return add


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _blocks_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token stream with the day of each token as its block."""
    e = fx.trace_events(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("thread_id").orderBy("ts_ns", "event_id")).cast("long")
    return e.select("thread_id", pos.alias("pos"), F.col("name").alias("token"), "ts_ns", F.expr(f"ts_ns div {DAY_NS}").alias("block"))


events, span_table, enter_leave, tokens = fx.trace_events, fx.trace_spans, fx.trace_enter_leave, _blocks_of_tokens
BASIC = ["event_id", "archive_id", "thread_id", "ts_ns", "record"]


def _add(source: Query, **made: Callable[[DataFrame], DataFrame]) -> None:
    for name, f in made.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: f(source(spark, sf_dir))


_add(
    events,
    agg_comm_matrix=comm.comm_matrix,
    agg_comm_matrix_dense=lambda e: comm.comm_matrix_dense(e, 8),
    agg_comm_matrix_timed=lambda e: comm.comm_matrix_timed(e, LO, HI),
    agg_comm_matrix_timed_recv_only=lambda e: comm.comm_matrix_timed(e, LO, HI, "recv"),
    doc_comm_matrix_isend=comm.isend_matrix,
    agg_msg_size_hist=comm.message_sizes,
    agg_msg_size_hist_amount=lambda e: comm.message_sizes(e, amount=True),
    agg_msg_size_hist_weighted=lambda e: comm.message_sizes(e, by="occurrences"),
    agg_msg_size_hist_local=lambda e: comm.message_sizes(e.where("archive_id = 3")),
    agg_comm_over_time=lambda e: comm.traffic(e, EDGES),
    agg_comm_over_time_count=lambda e: comm.traffic(e, EDGES, messages=True),
    agg_comm_over_time_local=lambda e: comm.traffic(e.where("archive_id = 3"), EDGES),
    join_bins=lambda e: e.where(F.col("ts_ns").between(EDGES[0], EDGES[-1])).select("event_id", F.greatest(comm.bin_of(F.col("ts_ns"), EDGES), F.lit(0)).alias("i")),
    flt_record=lambda e: e.where("record = 8").select(*BASIC),
    flt_record_in=lambda e: e.where(F.col("record").isin(4, 58)).select(*BASIC),
    flt_mpi_class=lambda e: e.select("event_id", is_send(F.col("record")).alias("is_send"), is_recv(F.col("record")).alias("is_recv"), is_comm(F.col("record")).alias("is_comm")),
    flt_seek=lambda e: traverse.seek(e, [LO, HI]),
    src_thread_list=lambda e: e.select("archive_id", "thread_id").distinct(),
    src_archives=lambda e: e.groupBy("archive_id").agg(F.countDistinct("thread_id").alias("n_threads")),
    src_threads=lambda e: e.groupBy("thread_id").agg(F.count("*").alias("n")),
    src_time_bounds=lambda e: e.agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns")),
    trv_trace_events=lambda e: traverse.merged(e.select("ts_ns", "archive_id", "thread_id", "event_id")).select("global_pos", "thread_id", "ts_ns", "event_id"),
    trv_thread_events=lambda e: traverse.thread_events(e).select("thread_id", "event_id", "ts_ns", "pos", "occurrence_idx"),
    trv_event_count=lambda e: e.groupBy("thread_id").agg(F.count("*").alias("n")),
    agg_archive_summary=lambda e: e.groupBy("archive_id").agg(F.countDistinct("thread_id").alias("n_threads"), F.count("*").alias("n_events")),
    agg_event_info=lambda e: e.groupBy("thread_id", "record", "name").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")),
    proj_event_props=lambda e: e.groupBy("thread_id", "name", "record").agg(F.count("*").alias("nb_occurrences")),
    proj_thread_props=lambda e: e.groupBy("thread_id").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("finish_ns")),
    proj_ns2s=lambda e: e.select("event_id", tx.seconds(F.col("ts_ns")).alias("seconds")),
    join_send_recv=lambda e: comm.match_messages(e).select("sender", "receiver", "tag", "send_ts", "recv_ts"),
)


@_on(events)
def src_chunk_load(e: DataFrame) -> DataFrame:
    """Summaries of 1000 values of each name; indices come from positions in one order, so no name is one task's."""
    idx = order.with_position(e.select("name", "ts_ns", "event_id"), ["name", "ts_ns", "event_id"], "at")
    first = idx.groupBy("name").agg(F.min("at").alias("zero"))
    c = idx.join(first, "name").withColumn("chunk", F.expr("cast((at - zero) div 1000 as bigint)"))
    return c.groupBy("name", "chunk").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("n"))


@_query
def sink_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Trace.store(fx.trace_events(spark, sf_dir), f"{Scratch(spark).top}/trace", "none").recompress("gzip")
    return t.events.groupBy("record").agg(F.count("*").alias("n"), F.sum(F.expr("ts_ns % 1000003")).alias("check_sum"))


_add(
    span_table,
    agg_sequence_stats=lambda s: spans.sequence_stats(s).select("thread_id", "name", "min_ns", "mean_ns", "max_ns", "n"),
    agg_contention=spans.contention,
    agg_snapshot=lambda s: spans.snapshot(s, LO, HI),
    agg_snapshot_by_name=lambda s: spans.snapshot(s, LO, HI, ("name",)),
    agg_interval_profile=lambda s: spans.interval_profile(s, SLICES),
    join_interval_clip=lambda s: s.where((F.col("finish_ns") > LO) & (F.col("start_ns") < HI)).select("thread_id", "name", "start_ns", spans.clipped(F.col("start_ns"), F.col("finish_ns"), LO, HI).alias("clip_ns")),
    agg_duration_vectors=spans.name_stats,
    agg_range_sum=lambda s: spans.range_sum(s, 2, 7),
    quantize_durations=spans.quantised,
    agg_seq_durations=lambda s: _indexed(s).where("level = 1").select("thread_id", "name", "idx", "duration_ns"),
    agg_seq_timestamps=lambda s: _indexed(s).where("level = 1").select("thread_id", "name", "idx", "start_ns"),
    trv_occurrence=lambda s: _indexed(s).where("idx = 2").select("thread_id", "name", "start_ns", "duration_ns"),
    doc_function_table=lambda s: spans.name_stats(s).select("name", "min_ns", "mean_ns", "max_ns", "n"),
    doc_duration_hist=lambda s: s.groupBy("name", F.expr("cast(least(duration_ns div 600000000000, 20) as int)").alias("bin")).agg(F.count("*").alias("n")),
)


def _indexed(s: DataFrame) -> DataFrame:
    return s.withColumn("idx", order.occurrence(["thread_id", "name"], ["start_ns", "finish_ns", "event_id"]))


_add(
    enter_leave,
    trv_call_tree_depth=lambda e: spans.with_depth(e).where("phase = 'E'").select("thread_id", "seq_no", "depth"),
    join_enter_leave=lambda e: spans.pair_blocks(e).select("thread_id", "depth", "name", "start_ns", "finish_ns"),
    agg_snapshot_exact=lambda e: spans.snapshot_exact(e, LO, HI),
)


@_on(enter_leave)
def agg_check_durations(e: DataFrame) -> DataFrame:
    b = spans.with_exclusive(e)
    bad = F.col("finish_ns").isNull() | (F.col("name") != F.col("leave_name")) | (F.col("duration_ns") != F.col("finish_ns") - F.col("start_ns")) | (F.col("exclusive_ns") < 0)
    return b.agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("violations"))


_add(
    tokens,
    gram_event_dict=grammar.event_dictionary,
    gram_runs=grammar.runs,
    gram_full_induction=grammar.induce,
    trv_sequence_content=lambda t: t.select("thread_id", "block", order.occurrence(["thread_id", "block"], ["pos"]).alias("i"), "token"),
    agg_seq_content=lambda t: t.groupBy("thread_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens")),
    set_bag_arithmetic=lambda t: traverse.signed_counts(*[t.where(f"thread_id % 2 = {k}").groupBy("token").agg(F.count("*").alias("n")) for k in (0, 1)], ["token"]),
    fn_murmur3=lambda t: t.groupBy("thread_id", "block").agg(murmur3_words(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.length("token").cast("long").alias("w")))), lambda x: x["w"])).alias("hash")),
)


@_on(tokens)
def trv_loop_duration(t: DataFrame) -> DataFrame:
    a = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos"))
    b = F.row_number().over(Window.partitionBy("thread_id", "token").orderBy("pos"))
    g = t.withColumn("island", a - b).groupBy("thread_id", "token", "island").agg(F.min("pos").alias("start_pos"), (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"), F.count("*").alias("n"))
    return g.where("n >= 2").select("thread_id", "token", "start_pos", "duration_ns")


def _edges(t: DataFrame, times: bool) -> DataFrame:
    """A three-level grammar: users hold tokens, groups hold users, one root holds groups."""
    u, g = F.concat(F.lit("U"), (F.col("thread_id") % 20).cast("string")), F.concat(F.lit("G"), (F.col("thread_id") % 5).cast("string"))
    one = t.select(u.alias("parent"), F.col("token").alias("child"), F.lit(1).cast("long").alias("times"))
    two = t.select(g.alias("parent"), u.alias("child"), F.lit(2).cast("long").alias("times")).distinct()
    three = t.select(F.lit("R").alias("parent"), g.alias("child"), F.lit(3).cast("long").alias("times")).distinct()
    return one.unionByName(two).unionByName(three) if times else one.unionByName(two).unionByName(three).select("parent", "child").distinct()


_add(tokens, flt_contains=lambda t: traverse.closure(_edges(t, False)), trv_token_counts=lambda t: traverse.token_counts(_edges(t, True)))


@_on(tokens)
def gram_sync(t: DataFrame) -> DataFrame:
    """Shared ids of tokens, day sequences and whole threads, by content from the leaves up."""
    leaf = t.select("thread_id", F.concat(F.lit("E"), F.col("token")).alias("id"), F.col("token").alias("content")).distinct()
    day = F.concat(F.lit("S"), F.col("block").cast("string"))
    one = t.select("thread_id", day.alias("parent"), "pos", F.concat(F.lit("E"), F.col("token")).alias("child"))
    two = t.groupBy("thread_id", "block").agg(F.min("pos").alias("pos")).select("thread_id", F.lit("root").alias("parent"), "pos", day.alias("child"))
    return grammar.align(leaf, one.unionByName(two))


_add(
    fx.definitions,
    src_strings=lambda d: d.where("scope = 'global'").select("ref", "str"),
    join_string_unify=traverse.unified,
)


@_query
def src_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.definitions(spark, sf_dir).where("scope = 'global'")
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region_ref")).join(names, F.col("region_ref") == F.col("ref")).select("region_ref", F.col("str").alias("name"))


@_query
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.table(spark, sf_dir, "region").select(F.create_map(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")), F.col("r_name")).alias("metadata"))
    return r.select(F.explode("metadata").alias("key", "value"))


@_query
def src_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, places = fx.locations(spark, sf_dir)
    g = groups.select(F.col("id").alias("parent"), F.col("name").alias("group_name"))
    return places.join(g, "parent", "left").select("id", "name", "group_name", "parent")


@_query
def join_location_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, places = fx.locations(spark, sf_dir)
    return traverse.parents(groups.unionByName(places.withColumn("id", F.col("id") + 10000)))


@_query
def join_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.trace_events(spark, sf_dir).select("event_id", (F.col("event_id") % 3000).alias("ref"))
    return traverse.resolve(e, fx.definitions(spark, sf_dir)).select("event_id", "str")


@_query
def proj_region_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.trace_events(spark, sf_dir).select("event_id", (F.col("event_id") % 3000).alias("ref"))
    got = traverse.resolve(e, fx.definitions(spark, sf_dir).where("scope = 'global'"))
    return got.select("event_id", F.coalesce("str", F.lit("INVALID_REGION")).alias("region"))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")).alias("attributes"))


_add(
    _attributes,
    proj_attributes=lambda a: a.select("event_id", F.element_at("attributes", "k").cast("int").alias("k"), F.element_at("attributes", "type").alias("event_type")),
)


@_query
def src_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as read from a file over the defaults."""
    fx.ship_package(spark)
    return spark.createDataFrame(sorted(read_config("compression = zstd\nmaxLoopLength = 50 # bounded\n").items()), "key string, value string")


@_query
def stream_comm_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live traffic windows over a stored trace, run to its end."""
    from ..streaming.live import live_traffic

    got = _drained(spark, fx.trace_events(spark, sf_dir).select("record", "ts_ns", "msg_length"), live_traffic, "complete")
    return got.select((F.unix_micros("start") * 1000).alias("start_ns"), "bytes", "messages")


@_query
def stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as a live query closes them, over a stored trace, run to its end."""
    from ..streaming.live import live_blocks

    return _drained(spark, fx.trace_enter_leave(spark, sf_dir), live_blocks, "append")


def _drained(spark: SparkSession, rows: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    top = Scratch(spark).top
    rows.write.parquet(f"{top}/in")
    out: list[str] = []

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/{n}")
        out.append(f"{top}/out/{n}")

    q = plan(spark.readStream.schema(rows.schema).parquet(f"{top}/in")).writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.parquet(*(out[-1:] if mode == "complete" else out))


program.add_tokens(tokens)
QUERIES.update(program.QUERIES)

#: The same queries in DuckDB's SQL.
SQL: dict[str, str] = {**ORACLE, **program_sql.SQL}

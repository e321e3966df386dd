"""Registered queries over the program trace, its stored form and its dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import record_name
from ..operators import comm, grammar, order, spans, traverse
from ..scratch import Scratch
from ..sources import fixtures as fx
from ..sources import store as st
from ..sources.ingest import DEFINITIONS, call_of, dictionaries_from_calls, events_from_calls, with_times
from .oracle import HI, LO
from .program_sql import LONGEST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["thread_id", "seq_no"]


def _add(source: Query, **made: Callable[[DataFrame], DataFrame]) -> None:
    for name, f in made.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: f(source(spark, sf_dir))


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _detail(name: str, df: DataFrame) -> DataFrame:
    """A dictionary as (kind, scope, id, name, detail)."""
    more = {"attributes": "cast(type as string)", "groups": "array_join(transform(members, x -> cast(x as string)), ',')", "comms": "cast(group_id as string)", "location_groups": "cast(parent as string)", "locations": "cast(parent as string)"}
    return df.select(F.lit(name).alias("kind"), "scope", "id", "name", F.expr(more.get(name, "cast(null as string)")).alias("detail"))


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, df in fx.all_definitions(spark, sf_dir).items():
        d = _detail(name, df)
        out = d if out is None else out.unionByName(d)
    return out


def _stored(spark: SparkSession, sf_dir: str) -> st.Trace:
    """The whole trace of the fixtures, stored and opened."""
    path = f"{Scratch(spark).top}/trace"
    return st.Trace.store(fx.trace_events(spark, sf_dir), path, "zstd", {"name": "fixture"}, fx.all_definitions(spark, sf_dir), fx.trace_spans(spark, sf_dir))


def _events_only(spark: SparkSession, sf_dir: str) -> st.Trace:
    return st.Trace.store(fx.trace_events(spark, sf_dir), f"{Scratch(spark).top}/trace")


BASIC = ["event_id", "archive_id", "thread_id", "ts_ns", "record"]


def _from_store(**made: Callable[[st.Trace], DataFrame]) -> None:
    """Queries of a stored trace: what they filter by prunes folders and row groups."""
    for name, f in made.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: f(_events_only(spark, sf_dir)).select(*BASIC)


_from_store(src_archive=lambda t: t.archive(5), src_thread=lambda t: t.thread(11), flt_archive=lambda t: t.archive(3), flt_thread=lambda t: t.thread(7), flt_time_range=lambda t: t.between(LO, HI))


@_query
def src_open_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an opened trace holds: rows and bounds of each table."""
    t = st.Trace.open(spark, _stored(spark, sf_dir).path)
    count = lambda df, what, low, high: df.agg(F.count("*").alias("n"), F.min(low).cast("long").alias("low"), F.max(high).cast("long").alias("high")).select(F.lit(what).alias("what"), "n", "low", "high")
    out = count(t.events, "events", "ts_ns", "ts_ns").unionByName(count(t.table("spans"), "spans", "start_ns", "finish_ns"))
    for name in (x for x in t.tables if x != "spans"):
        out = out.unionByName(count(t.table(name), name, "id", "id"))
    for name, key in (("threads", "thread_id"), ("archives", "archive_id")):
        out = out.unionByName(count(t.threads().select(key).distinct(), name, key, key))
    return out


@_query
def sink_store_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored trace, read again: sums of its events and blocks by thread, and all definitions."""
    t = _stored(spark, sf_dir)
    part = lambda what, value: [F.lit(what).alias("what"), F.col("thread_id").alias("id"), value.cast("string").alias("content")]
    out = t.events.groupBy("thread_id").agg(F.sum("msg_length").alias("v")).select(*part("events", F.col("v")))
    out = out.unionByName(t.table("spans").groupBy("thread_id").agg(F.sum(F.col("duration_ns") + F.col("exclusive_ns")).alias("v")).select(*part("spans", F.col("v"))))
    for name in (x for x in t.tables if x != "spans"):
        d = _detail(name, t.table(name))
        out = out.unionByName(d.select(F.col("kind").alias("what"), "id", F.concat_ws(" ", "scope", "name", "detail").alias("content")))
    return out


_add(
    _definitions,
    agg_definitions=lambda d: d,
    sink_register_defs=lambda d: st.check_unique(d.unionByName(d.where("id < 5")), ["kind", "scope", "id"]),
)


@_query
def sink_definition_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionaries that a recorder's definition calls fill, some of them made twice and some that define nothing."""
    names = {v: k for k, v in DEFINITIONS.items()}
    d = _definitions(spark, sf_dir)
    call = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("kind"))
    calls = d.select(call.alias("call"), "scope", "id", "name")
    calls = calls.unionByName(calls.where("id % 2 = 0")).unionByName(calls.limit(3).withColumn("call", F.lit("WriteNothing")))
    out = None
    for name, df in dictionaries_from_calls(calls).items():
        df = df.select(F.lit(name).alias("dictionary"), "scope", "id", "name")
        out = df if out is None else out.unionByName(df)
    return out


@_query
def src_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks of a reader that has selected every second thread: one an event of these, one a global definition."""
    e = fx.program_trace(spark, sf_dir).where("thread_id % 2 = 0")
    d = _definitions(spark, sf_dir).where("scope = 'global'")
    both = e.select(F.concat(F.lit("event "), record_name(F.col("record"))).alias("callback")).unionByName(d.select(F.concat(F.lit("definition "), "kind").alias("callback")))
    return both.groupBy("callback").agg(F.count("*").alias("n"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program as recorder calls, among them some that record nothing."""
    e = tx.payload(fx.program_trace(spark, sf_dir)).withColumn("call", call_of(F.col("record")))
    calls = e.drop("record", "seq_no").withColumnRenamed("event_id", "call_no")
    return calls.unionByName(calls.where("call_no % 7 = 0").withColumns({"call": F.lit("Metric"), "call_no": F.col("call_no") + 1}))


_PAYLOAD = list(tx.PAYLOADS)
_add(
    _calls,
    sink_record=lambda c: events_from_calls(c).select(*KEY, "ts_ns", "record", *_PAYLOAD),
    sink_call_adapter=lambda c: events_from_calls(c).select("archive_id", *KEY, "ts_ns", "record", "peer", "request_id"),
    sink_call_print=lambda c: events_from_calls(c).select(*KEY, tx.event_text(region=F.coalesce("region", "name"), full=True).alias("text")),
)
_add(
    fx.trace_events,
    src_vector=lambda e: (
        e.withColumn("idx", order.occurrence(["thread_id", "name"], ["ts_ns", "event_id"])).groupBy("thread_id", "name", F.expr("idx div 1000").alias("chunk")).agg(F.array_sort(F.collect_list("ts_ns")).alias("timestamps"))
    ),
    sink_clock=lambda e: with_times(e.withColumn("ts_ns", F.when(F.col("k") % 10 != 0, F.col("ts_ns"))), "event_id").select("thread_id", "event_id", "ts_ns"),
    enc_masking=lambda e: _masked(e),
    proj_attribute_print=lambda e: e.withColumn("kind", F.element_at(F.array(*map(F.lit, tx.KINDS)), (F.col("event_id") % len(tx.KINDS) + 1).cast("int"))).select(
        "event_id", "kind", tx.attribute_value(F.col("kind"), F.col("event_id"), F.col("k") / 8.0, F.col("name")).alias("text")
    ),
)


def _masked(e: DataFrame) -> DataFrame:
    """Lengths in as few bytes as the archive's largest takes, and read again."""
    width = e.groupBy("archive_id").agg(tx.masking_width(F.max("msg_length")).alias("width"))
    m = e.join(width, "archive_id").withColumn("raw", tx.masked(F.col("msg_length"), F.col("width")))
    return m.select("event_id", "width", F.hex("raw").alias("masked"), tx.unmasked(F.col("raw")).alias("value"))


def _numbered(e: DataFrame) -> DataFrame:
    return grammar.event_ids(e)


def _written(df: DataFrame, kind: str) -> DataFrame:
    """df, written as CSV or text and read again."""
    path = f"{Scratch(df.sparkSession).top}/out"
    st.write_rows(df, path, kind)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path) if kind == "csv" else df.sparkSession.read.text(path).withColumnRenamed("value", "line")


_add(
    fx.program_trace,
    sink_print_events=st.event_lines,
    sink_text_dump=lambda e: _written(st.event_lines(e.where("thread_id % 3 = 0")).select("line"), "text"),
    sink_flamegraph=lambda e: spans.folded_stacks(spans.with_phase(e).withColumn("name", F.col("label"))),
    sink_structure=lambda e: st.structure_lines(e, _blocks(e)),
    sink_structure_loops=lambda e: st.structure_lines(e, _blocks(e), loops=False),
    proj_event_data=lambda e: tx.payload(e).select(*KEY, "record", *_PAYLOAD),
    proj_event_name=lambda e: e.select(*KEY, tx.event_text(region=F.coalesce("region", "name"), full=True).alias("text")),
    join_enclosing_enter=lambda e: spans.with_open(spans.with_phase(e).withColumn("name", F.col("label"))).where("phase is null").select(*KEY, F.col("open_seq").alias("enclosing_seq"), F.col("open_ns").alias("enclosing_ns")),
    join_request=lambda e: _requests(e),
    join_wait_asof=lambda e: comm.next_wait(e, comm.is_wait_leave()).where("record between 4 and 9").select("event_id", "ts_ns", "wait_end_ns"),
    agg_messages=comm.message_list,
    trv_flags=lambda e: grammar.unrolled(e, _blocks(e)),
    proj_token_string=lambda e: _token_strings(e, _blocks(e)),
    flt_valid=lambda e: _tokens(e, _blocks(e)),
    agg_thread_summary=lambda e: _threads(e, _blocks(e)),
)


def _blocks(e: DataFrame) -> DataFrame:
    return grammar.block_sequences(e, Scratch(e.sparkSession))


def _requests(e: DataFrame) -> DataFrame:
    out = None
    for kind, issue, done in (("send", 5, 6), ("receive", 7, 9)):
        m = comm.match_requests(e.where(F.col("record") == issue), e.where(F.col("record") == done))
        m = m.select(F.lit(kind).alias("kind"), "archive_id", "request_id", "issue_ts", "completion_ts")
        out = m if out is None else out.unionByName(m)
    return out


def _token_strings(e: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens at their places: events, blocks where they begin, and each loop where it first stands."""
    first = b.groupBy("thread_id", "parent_seq", "loop", "sequence_id").agg(F.count("*").alias("nb_iterations")).where("nb_iterations > 1")
    loops = grammar.block_loops(b).join(first, ["thread_id", "sequence_id", "nb_iterations"]).groupBy("thread_id", "loop_id").agg(F.min("loop").alias("seq_no"))
    own = _numbered(e).select(*KEY, tx.token_text(F.lit("E"), F.col("event_no"), F.col("record")).alias("token"))
    return own.unionByName(b.select("thread_id", F.col("enter_seq").alias("seq_no"), tx.token_text(F.lit("S"), F.col("sequence_id")).alias("token"))).unionByName(
        loops.select(*KEY, tx.token_text(F.lit("L"), F.col("loop_id")).alias("token"))
    )


def _tokens(e: DataFrame, b: DataFrame) -> DataFrame:
    """All tokens of a thread's dictionaries in their order (kind, id), with an invalid one."""
    kind = lambda df, k, i: df.select("thread_id", F.lit(k).alias("kind"), F.col(i).cast("long").alias("id")).distinct()
    none = e.select("thread_id").distinct().withColumn("zero", F.lit(0))
    t = kind(_numbered(e), "E", "event_no").unionByName(kind(b, "S", "sequence_id")).unionByName(kind(grammar.block_loops(b), "L", "loop_id")).unionByName(kind(none, "I", "zero"))
    rank = F.when(F.col("kind") == "I", 0).when(F.col("kind") == "E", 1).when(F.col("kind") == "S", 2).otherwise(3)
    place = order.occurrence(["thread_id"], ["rank", "id"]) + 1
    return t.withColumn("rank", rank).select("thread_id", "kind", "id", (F.col("kind") != "I").alias("is_valid"), F.col("kind").isin("S", "L").alias("is_iterable"), place.alias("place"))


def _threads(e: DataFrame, b: DataFrame) -> DataFrame:
    own = grammar.with_tokens(e).groupBy("archive_id", "thread_id").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("n_events"), F.countDistinct("token").alias("n_definitions"))
    seq = b.groupBy("thread_id").agg(F.countDistinct("sequence_id").alias("n_sequences"))
    loop = grammar.block_loops(b).groupBy("thread_id").agg(F.count("*").alias("n_loops"))
    return own.join(seq, "thread_id").join(loop, "thread_id", "left").select(
        "archive_id", "thread_id", F.concat(F.lit("thread "), F.col("thread_id").cast("string")).alias("name"), "first_ns", "last_ns", (F.col("last_ns") - F.col("first_ns")).alias("duration_ns"),
        "n_events", "n_definitions", "n_sequences", F.coalesce("n_loops", F.lit(0)).cast("long").alias("n_loops"),
    )


def _program_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(fx.program_trace(spark, sf_dir))


#: Blocks that a function's ENTER opens.
CALLS = "name not in ('MPI_COLLECTIVE_BEGIN', 'OMP_FORK')"


def _names(b: DataFrame, bulk: bool) -> DataFrame:
    """Names of sequences by what opens them; in bulk, the root is main, long ones are named after their loop or number."""
    s = grammar.sequence_table(b)
    number = F.concat(F.lit("Sequence_"), F.col("sequence_id").cast("string"))
    if not bulk:
        return s.select("thread_id", "sequence_id", F.when(F.expr(CALLS), F.col("name")).otherwise(number).alias("name"))
    loop = grammar.block_loops(b).groupBy("thread_id", "sequence_id").agg(F.min("loop_id").alias("loop_id"))
    name = F.when(F.col("sequence_id") == 0, "main").when((F.col("n_tokens") <= 4) & F.expr(CALLS), F.col("name")).otherwise(F.coalesce(F.concat(F.lit("Loop_"), F.col("loop_id").cast("string")), number))
    return s.join(loop, ["thread_id", "sequence_id"], "left").select("thread_id", "sequence_id", name.alias("name"))


def _seq_info(b: DataFrame) -> DataFrame:
    s = grammar.sequence_table(b)
    whole = b.groupBy("thread_id").agg((F.max("finish_ns") - F.min("start_ns")).alias("d"))
    delta = F.col("n") * (F.col("mean_ns") - F.col("min_ns"))
    score = F.when(delta > F.col("d"), -1.0).when(F.col("d") == 0, 0.0).otherwise(F.round(delta / F.col("d"), 6))
    return s.join(whole, "thread_id").withColumn("contention", score.cast("double")).drop("d")


_add(
    _program_blocks,
    proj_sequence_name=lambda b: _names(b, False),
    proj_sequence_names_bulk=lambda b: _names(b, True),
    proj_seq_props=lambda b: grammar.sequence_table(b).withColumn("type", F.when(F.expr(CALLS), "BLOCK").otherwise("OTHER")),
    proj_loop_props=lambda b: grammar.block_loops(b).select("thread_id", "loop_id", "sequence_id", "nb_iterations"),
    agg_loop_info=grammar.block_loops,
    agg_seq_info=_seq_info,
    join_grammar_align=grammar.shared_sequences,
    gram_sequence_dict=lambda b: grammar.sequence_table(b).select("thread_id", "sequence_id", "name", "n_tokens", F.col("n").alias("nb_occurrences")),
)
_add(
    fx.trace_enter_leave,
    trv_next_prev=lambda e: traverse.neighbours(e).drop("ts_ns", "phase", "name"),
    trv_checkpoint=lambda e: traverse.resume(e, traverse.bookmarks(e)).select(*KEY, "ts_ns", "phase", "name"),
    trv_callstack=lambda e: spans.callstack(e, [LO, HI]),
    gram_close=lambda e: spans.closed_at_end(e.where(F.col("ts_ns") < HI)),
    gram_durations=lambda e: spans.with_exclusive(e).select("thread_id", "depth", "name", "start_ns", "duration_ns", "exclusive_ns"),
    sink_csv=lambda e: _written(
        spans.self_segments(e).where("b > a").select(F.col("thread_id").alias("Thread"), F.col("name").alias("Function"), F.col("a").alias("Start"), F.col("b").alias("Finish"), (F.col("b") - F.col("a")).alias("Duration")), "csv"
    ),
)
_add(
    fx.trace_spans,
    sink_csv_bulk=lambda s: _written(st.bulk_rows(s), "csv"),
    agg_snapshot_fast=lambda s: spans.snapshot_fast(spans.chunk_table(s), LO, HI),
)


def add_tokens(tokens: Query) -> None:
    """Queries of the plain token stream, which the catalogue makes."""
    _add(
        tokens,
        gram_find_loop=lambda t: grammar.repeats(t, LONGEST),
        gram_loop_squash=grammar.loops,
        gram_find_sequence=lambda t: grammar.known_sequences(t, grammar.sequences(t), 5),
    )


@_query
def gram_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar of every thread's blocks under the three ways to look for loops."""
    e = fx.program_trace(spark, sf_dir)
    out = None
    for algorithm in grammar.ALGORITHMS:
        g = grammar.induce_blocks(e, algorithm)
        out = g if out is None else out.unionByName(g)
    return out

"""Communication: matrices, message-size histograms, traffic over time, message matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import WAIT_NAMES, is_comm, is_recv, is_send
from ..scratch import Scratch
from .order import next_value, with_position
from .spans import with_open, with_phase


def comm_matrix(events: DataFrame) -> DataFrame:
    """Bytes by (sender, receiver), from receive events."""
    return events.where(is_recv(F.col("record"))).groupBy(F.col("peer").alias("sender"), F.col("archive_id").alias("receiver")).agg(F.sum("msg_length").alias("bytes"))


def comm_matrix_dense(events: DataFrame, ranks: int) -> DataFrame:
    """All ranks * ranks cells, zeros included; the grid is generated, not joined from data."""
    n = events.sparkSession.range(ranks * ranks)
    grid = n.select((F.col("id") % ranks).cast("int").alias("sender"), F.expr(f"cast(id div {ranks} as int)").alias("receiver"))
    return grid.join(comm_matrix(events), ["sender", "receiver"], "left").select("sender", "receiver", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def comm_matrix_timed(events: DataFrame, start_ns: int, end_ns: int, side: str = "both") -> DataFrame:
    """Bytes of events with start <= ts <= end; `both` counts the sending and the receiving end of a message, `recv` one."""
    e = events.where(F.col("ts_ns").between(start_ns, end_ns) & (is_comm(F.col("record")) if side == "both" else is_recv(F.col("record"))))
    sends = is_send(F.col("record"))
    return e.groupBy(F.when(sends, F.col("archive_id")).otherwise(F.col("peer")).alias("sender"), F.when(sends, F.col("peer")).otherwise(F.col("archive_id")).alias("receiver")).agg(
        F.sum("msg_length").alias("bytes")
    )


def isend_matrix(events: DataFrame) -> DataFrame:
    """Sum of lengths of distinct non-blocking send definitions by sender and receiver."""
    d = message_definitions(events).where(F.col("record") == 5)
    return d.groupBy(F.col("archive_id").alias("sender"), F.col("peer").alias("receiver")).agg(F.sum("msg_length").alias("bytes"))


def message_definitions(events: DataFrame) -> DataFrame:
    """Distinct payloads of communication events in each thread; requests are part of non-blocking payloads only."""
    request = F.when(F.col("record").isin(5, 9), F.col("request_id"))
    return events.where(is_comm(F.col("record"))).select("archive_id", "thread_id", "record", "peer", "communicator", "tag", "msg_length", request.alias("request_id")).distinct()


def message_sizes(events: DataFrame, by: str = "definitions", amount: bool = False) -> DataFrame:
    """(msg_length, n): how many definitions (or occurrences) have a length, or how many bytes they carry."""
    rows = message_definitions(events) if by == "definitions" else events.where(is_comm(F.col("record")))
    value = F.sum("msg_length") if amount else F.count("*")
    return rows.groupBy("msg_length").agg(value.cast("long").alias("n"))


def traffic(events: DataFrame, edges: list[int], messages: bool = False) -> DataFrame:
    """(i, value) for each interval of sorted edges: [t0, t1], then (t1, t2], …; a tie belongs to the earlier interval.

    The interval is found by a binary search over the literal edges, so no join is needed and partial sums shuffle.
    """
    e = events.where(is_comm(F.col("record")) & F.col("ts_ns").between(edges[0], edges[-1]))
    i = F.greatest(bin_of(F.col("ts_ns"), edges), F.lit(0))
    got = e.groupBy(i.alias("i")).agg((F.count("*") if messages else F.sum("msg_length")).cast("long").alias("n"))
    bins = events.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("i"))
    return bins.join(F.broadcast(got), "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("long").alias("messages" if messages else "bytes"))


def bin_of(x: Column, edges: list[int]) -> Column:
    """Number of the interval (e_i, e_i+1] that holds x, as nested comparisons of logarithmic depth; -1 at the first edge."""

    def pick(lo: int, hi: int) -> Column:  # the count of edges below x, less one, is in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x > edges[mid], pick(mid, hi)).otherwise(pick(lo, mid - 1))

    return F.when(x > edges[0], pick(0, len(edges) - 2)).otherwise(F.lit(-1))


def match_messages(events: DataFrame) -> DataFrame:
    """First-in first-out pairs of each channel (sender, receiver, tag)."""
    channel = ["sender", "receiver", "tag"]
    w = Window.partitionBy(*channel).orderBy("ts_ns", "event_id")
    s = events.where(is_send(F.col("record"))).select(F.col("archive_id").alias("sender"), F.col("peer").alias("receiver"), "tag", "ts_ns", "event_id", "msg_length", "request_id", "record")
    r = events.where(is_recv(F.col("record"))).select(F.col("peer").alias("sender"), F.col("archive_id").alias("receiver"), "tag", "ts_ns", "event_id", "request_id", "record")
    s = s.withColumn("rn", F.row_number().over(w)).withColumnsRenamed({"ts_ns": "send_ts", "event_id": "send_id", "request_id": "send_request", "record": "send_record"})
    r = r.withColumn("rn", F.row_number().over(w)).withColumnsRenamed({"ts_ns": "recv_ts", "event_id": "recv_id", "request_id": "recv_request", "record": "recv_record"})
    return s.join(r, [*channel, "rn"])


def match_requests(issues: DataFrame, completions: DataFrame, order: str = "event_id") -> DataFrame:
    """Each completion of a request id, in its archive, belongs to the oldest issue that is outstanding.

    (archive_id, request_id, issue_ts, completion_ts, issue_id, completion_id). A completion with nothing outstanding is
    dropped: it takes the running balance of issues and completions to a new low below zero. The others pair by rank.
    """
    pick = lambda df, step: df.select("archive_id", "request_id", "ts_ns", F.col(order).alias("id"), F.lit(step).alias("step"))
    w = Window.partitionBy("archive_id", "request_id").orderBy("ts_ns", F.desc("step"), "id")
    both = pick(issues, 1).unionByName(pick(completions, -1))
    both = both.withColumn("balance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.coalesce(F.min("balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    kept = both.withColumn("low", low).where("step = 1 or balance >= low")
    rank = F.row_number().over(Window.partitionBy("archive_id", "request_id", "step").orderBy("ts_ns", "id"))
    of = lambda c, step: F.max(F.when(F.col("step") == step, F.col(c)))
    got = kept.withColumn("k", rank).groupBy("archive_id", "request_id", "k").agg(
        of("ts_ns", 1).alias("issue_ts"), of("ts_ns", -1).alias("completion_ts"), of("id", 1).alias("issue_id"), of("id", -1).alias("completion_id")
    )
    return got.where("issue_ts is not null and completion_ts is not null").drop("k")


def next_wait(events: DataFrame, waits: Column, order: tuple[str, ...] = ("ts_ns", "event_id")) -> DataFrame:
    """events with wait_end_ns: the time of the archive's next event for which `waits` holds, whichever thread it is of."""
    return next_value(events, ["archive_id"], list(order), F.when(waits, F.col("ts_ns")), "wait_end_ns")


def is_wait_leave() -> Column:
    """The end of a function that waits for messages."""
    return (F.col("record") == 3) & F.col("region").isin(*WAIT_NAMES)


MESSAGE = ["id", "sender", "receiver", "tag", "msg_length", "isend_ts", "start_swait_ts", "end_swait_ts", "irecv_ts", "start_rwait_ts", "end_rwait_ts"]


def message_list(events: DataFrame) -> DataFrame:
    """Completed point-to-point messages with the waits of both sides, in the columns MESSAGE.

    Sends and receives of a channel (sender, receiver, tag) pair in order of time. A blocking call waits from its event to
    the end of the archive's next waiting function; a non-blocking one from the start of the block in which its request
    completes to the completion, and counts as received at the completion. Sends whose request never completes, and
    receives without a request, end no message. Ids number all messages that were begun, in order of their first side.
    """
    scratch = Scratch(events.sparkSession)
    e = with_open(with_phase(events).withColumn("name", F.col("label"))).where(F.col("record").isin(4, 5, 6, 7, 8, 9) | is_wait_leave())
    e = e.select("event_id", "archive_id", "ts_ns", "record", "region", "peer", "tag", "msg_length", "request_id", "open_ns")
    e = scratch.table(next_wait(e, is_wait_leave()).where(F.col("record") != 3))
    only = lambda r: e.where(F.col("record") == r)
    sent = match_requests(only(5), only(6)).select(F.col("issue_id").alias("event_id"), F.col("completion_id").alias("done_id"), F.col("completion_ts").alias("done_ts"))
    done = only(6).select(F.col("event_id").alias("done_id"), F.col("open_ns").alias("done_open"))
    received = match_requests(only(7), only(9)).select(F.col("completion_id").alias("event_id"))
    begun = [F.col("event_id").alias("send_id"), F.col("archive_id").alias("sender"), F.col("peer").alias("receiver"), "tag", F.col("msg_length").alias("send_length"), F.col("ts_ns").alias("isend_ts")]
    sends = only(4).select(*begun, F.col("ts_ns").alias("start_swait_ts"), F.col("wait_end_ns").alias("end_swait_ts")).unionByName(
        only(5).join(sent, "event_id", "left").join(done, "done_id", "left").select(*begun, F.col("done_open").alias("start_swait_ts"), F.col("done_ts").alias("end_swait_ts"))
    )
    took = [F.col("event_id").alias("recv_id"), F.col("peer").alias("sender"), F.col("archive_id").alias("receiver"), "tag", F.col("msg_length").alias("recv_length"), F.col("ts_ns").alias("irecv_ts")]
    recvs = only(8).select(*took, F.col("ts_ns").alias("start_rwait_ts"), F.col("wait_end_ns").alias("end_rwait_ts")).unionByName(
        only(9).join(received, "event_id", "left_semi").select(*took, F.col("open_ns").alias("start_rwait_ts"), F.col("ts_ns").alias("end_rwait_ts"))
    )
    channel = ["sender", "receiver", "tag"]
    rank = lambda ts, i: F.row_number().over(Window.partitionBy(*channel).orderBy(ts, i))
    both = sends.withColumn("rn", rank("isend_ts", "send_id")).join(recvs.withColumn("rn", rank("irecv_ts", "recv_id")), [*channel, "rn"], "full")
    send_first = F.coalesce(F.col("isend_ts") <= F.col("irecv_ts"), F.col("isend_ts").isNotNull())
    both = both.withColumns({"first_ts": F.least("isend_ts", "irecv_ts"), "first_id": F.when(send_first, F.col("send_id")).otherwise(F.col("recv_id")), "msg_length": F.when(send_first, F.col("send_length")).otherwise(F.col("recv_length"))})
    ends = [c for c in MESSAGE if c.endswith("_ts")]
    return with_position(both.select("first_ts", "first_id", *channel, "msg_length", *ends), ["first_ts", "first_id"], "id", 1).dropna(subset=ends).select(*MESSAGE)

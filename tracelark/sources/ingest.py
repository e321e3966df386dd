"""Raw recorder calls as rows of the events schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EVENTS, RECORDS

#: Recorder call -> record; each call carries the arguments of its record.
CALLS = {
    "Enter": "ENTER", "Leave": "LEAVE", "MpiSend": "MPI_SEND", "MpiIsend": "MPI_ISEND", "MpiIsendComplete": "MPI_ISEND_COMPLETE",
    "MpiIrecvRequest": "MPI_IRECV_REQUEST", "MpiRecv": "MPI_RECV", "MpiIrecv": "MPI_IRECV", "MpiCollectiveBegin": "MPI_COLLECTIVE_BEGIN",
    "MpiCollectiveEnd": "MPI_COLLECTIVE_END", "OmpFork": "OMP_FORK", "OmpJoin": "OMP_JOIN", "OmpAcquireLock": "OMP_ACQUIRE_LOCK",
    "OmpReleaseLock": "OMP_RELEASE_LOCK", "OmpTaskCreate": "OMP_TASK_CREATE", "OmpTaskSwitch": "OMP_TASK_SWITCH", "OmpTaskComplete": "OMP_TASK_COMPLETE",
    "ThreadFork": "THREAD_FORK", "ThreadJoin": "THREAD_JOIN", "ThreadTeamBegin": "THREAD_TEAM_BEGIN", "ThreadTeamEnd": "THREAD_TEAM_END",
    "ThreadAcquireLock": "THREAD_ACQUIRE_LOCK", "ThreadReleaseLock": "THREAD_RELEASE_LOCK", "ThreadTaskCreate": "THREAD_TASK_CREATE",
    "ThreadTaskSwitch": "THREAD_TASK_SWITCH", "ThreadTaskComplete": "THREAD_TASK_COMPLETE", "ThreadBegin": "THREAD_BEGIN", "ThreadEnd": "THREAD_END",
    "Generic": "GENERIC",
}
#: Definition call -> dictionary table.
DEFINITIONS = {
    "WriteString": "strings", "WriteRegion": "regions", "WriteAttribute": "attributes", "WriteGroup": "groups", "WriteComm": "comms",
    "WriteLocationGroup": "location_groups", "WriteLocation": "locations",
}


def record_of(call: Column) -> Column:
    """The record code of a call's name; null for calls that record nothing."""
    return F.element_at(F.create_map(*[F.lit(x) for name, rec in CALLS.items() for x in (name, RECORDS[rec])]), call)


def events_from_calls(calls: DataFrame, tie: str = "call_no") -> DataFrame:
    """(archive_id, thread_id, ts_ns, call, tie, arguments …) in the events schema: unknown calls go, missing arguments are null.

    A missing time is that of the thread's event before it; order within a thread is by time, then by `tie`.
    """
    w = Window.partitionBy("archive_id", "thread_id").orderBy(tie)
    known = calls.withColumn("record", record_of(F.col("call"))).where("record is not null")
    known = known.withColumn("ts_ns", F.coalesce("ts_ns", F.last("ts_ns", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    seq = F.row_number().over(Window.partitionBy("archive_id", "thread_id").orderBy("ts_ns", tie)).cast("long")
    out = []
    for field in EVENTS.replace("map<string,string>", "MAP").split(", "):
        name, kind = field.strip().split(" ")
        kind = kind.replace("MAP", "map<string,string>")
        out.append((seq if name == "seq_no" else F.col(name) if name in known.columns else F.lit(None)).cast(kind).alias(name))
    return known.select(*out)


def dictionary_of(call: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DEFINITIONS.items() for x in kv]), call)


def call_of(record: Column) -> Column:
    """The recorder call that makes a record; null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for name, rec in CALLS.items() for x in (RECORDS[rec], name)]), record)


def dictionaries_from_calls(calls: DataFrame) -> dict[str, DataFrame]:
    """The dictionary tables (scope, id, name, parent, members) that definition calls fill; calls that define nothing go.

    A definition that repeats with the same content counts once.
    """
    known = calls.withColumn("dictionary", dictionary_of(F.col("call"))).where("dictionary is not null")
    fields = [c for c in ("scope", "id", "name", "parent", "members") if c in known.columns]
    return {d: known.where(F.col("dictionary") == d).select(*fields).distinct() for d in DEFINITIONS.values()}


def with_times(events: DataFrame, order: str) -> DataFrame:
    """events whose missing ts_ns is that of the thread's event before; what comes before any known time gets the first known one."""
    w = Window.partitionBy("thread_id").orderBy(order)
    before = F.last("ts_ns", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("ts_ns", F.coalesce(before, F.min("ts_ns").over(Window.partitionBy("thread_id"))))

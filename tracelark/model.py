"""Data model: records, their classes, and the tables that operators read and make."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Record codes.
RECORDS = {
    "INVALID": 0, "MEASUREMENT_ON_OFF": 1, "ENTER": 2, "LEAVE": 3, "MPI_SEND": 4, "MPI_ISEND": 5, "MPI_ISEND_COMPLETE": 6, "MPI_IRECV_REQUEST": 7,
    "MPI_RECV": 8, "MPI_IRECV": 9, "MPI_REQUEST_TEST": 10, "MPI_REQUEST_CANCELLED": 11, "MPI_COLLECTIVE_BEGIN": 12, "MPI_COLLECTIVE_END": 13,
    "OMP_FORK": 14, "OMP_JOIN": 15, "OMP_ACQUIRE_LOCK": 16, "OMP_RELEASE_LOCK": 17, "OMP_TASK_CREATE": 18, "OMP_TASK_SWITCH": 19, "OMP_TASK_COMPLETE": 20,
    "METRIC": 21, "PARAMETER_STRING": 22, "PARAMETER_INT": 23, "PARAMETER_UNSIGNED_INT": 24, "THREAD_FORK": 25, "THREAD_JOIN": 26,
    "THREAD_TEAM_BEGIN": 27, "THREAD_TEAM_END": 28, "THREAD_ACQUIRE_LOCK": 29, "THREAD_RELEASE_LOCK": 30, "THREAD_TASK_CREATE": 31,
    "THREAD_TASK_SWITCH": 32, "THREAD_TASK_COMPLETE": 33, "THREAD_CREATE": 34, "THREAD_BEGIN": 35, "THREAD_WAIT": 36, "THREAD_END": 37,
    "IO_CREATE_HANDLE": 38,
    "IO_DESTROY_HANDLE": 39, "IO_DUPLICATE_HANDLE": 40, "IO_SEEK": 41, "IO_CHANGE_STATUS_FLAGS": 42, "IO_DELETE_FILE": 43, "IO_OPERATION_BEGIN": 44,
    "IO_OPERATION_TEST": 45, "IO_OPERATION_ISSUED": 46, "IO_OPERATION_COMPLETE": 47, "IO_OPERATION_CANCELLED": 48, "IO_ACQUIRE_LOCK": 49,
    "IO_RELEASE_LOCK": 50, "IO_TRY_LOCK": 51, "PROGRAM_BEGIN": 52, "PROGRAM_END": 53, "NON_BLOCKING_COLLECTIVE_REQUEST": 54,
    "NON_BLOCKING_COLLECTIVE_COMPLETE": 55, "COMM_CREATE": 56, "COMM_DESTROY": 57, "GENERIC": 58, "BUFFER_FLUSH": 59,
}
NAMES = {v: k for k, v in RECORDS.items()}
SEND, RECV = (4, 5), (8, 9)
COMM = SEND + RECV
#: START record -> END record of blocks.
BLOCKS = {2: 3, 35: 37, 27: 28, 25: 26, 14: 15, 52: 53, 12: 13}
#: Functions whose LEAVE ends a wait; each exists in lower case with a trailing underscore as well.
WAITS = (
    "MPI_Send MPI_Recv MPI_Bsend MPI_Ssend MPI_Rsend MPI_Sendrecv MPI_Sendrecv_replace MPI_Test MPI_Wait MPI_Waitany MPI_Testany "
    "MPI_Waitsome MPI_Testsome MPI_Probe"
).split()
WAIT_NAMES = tuple(WAITS) + tuple(w.lower() + "_" for w in WAITS)

EVENTS = (
    "archive_id int, thread_id long, seq_no long, ts_ns long, record int, region string, name string, peer int, communicator int, tag int, "
    "msg_length long, request_id long, lock_id long, acquisition_order long, task_id long, n_threads int, coll_op int, coll_root int, "
    "size_sent long, size_received long, attributes map<string,string>"
)


def is_send(record: Column) -> Column:
    return record.isin(*SEND)


def is_recv(record: Column) -> Column:
    return record.isin(*RECV)


def is_comm(record: Column) -> Column:
    return record.isin(*COMM)


def record_name(record: Column) -> Column:
    """Name of a record code."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(NAMES.items()) for x in kv]), record)

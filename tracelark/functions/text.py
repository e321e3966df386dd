"""Text forms of events, tokens and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import record_name


def event_text(record: str = "record", region: Column | None = None, full: bool = False) -> Column:
    """Human-readable form of an event; columns are those of the events table (with `full`, all of them)."""
    r, f = F.col(record), F.format_string
    name = region if region is not None else F.col("name")
    to, back = "dest=%d, comm=%d, tag=%d, len=%d", "src=%d, comm=%d, tag=%d, len=%d"
    p2p = ("peer", "communicator", "tag", "msg_length")
    text = (
        F.when(r == 2, F.concat(F.lit("Enter ("), name, F.lit(")")))
        .when(r == 3, F.concat(F.lit("Leave ("), name, F.lit(")")))
        .when(r == 4, f(f"MPI_SEND({to})", *p2p))
        .when(r == 5, f(f"MPI_ISEND({to}, req=%d)", *p2p, "request_id"))
        .when(r == 6, f("MPI_ISEND_COMPLETE(req=%d)", "request_id"))
        .when(r == 7, f("MPI_IRECV_REQUEST(req=%d)", "request_id"))
        .when(r == 8, f(f"MPI_RECV({back})", *p2p))
        .when(r == 9, f(f"MPI_IRECV({back}, req=%d)", *p2p, "request_id"))
        .when(r == 58, name)
    )
    if full:
        kind = record_name(r)
        text = (
            text.when(r.isin(14, 25), F.concat(kind, f("(nThreads=%d)", "n_threads")))
            .when(r.isin(16, 17, 29, 30), F.concat(kind, f("(lockID=%d, order=%d)", "lock_id", "acquisition_order")))
            .when(r.isin(18, 19, 20), F.concat(kind, f("(taskID=%d)", "task_id")))
            .when(r == 13, F.concat(kind, f("(op=%d, comm=%d, root=%d, sent=%d, recv=%d)", "coll_op", "communicator", "coll_root", "size_sent", "size_received")))
        )
    return text.otherwise(F.concat(record_name(r), F.lit("()")))


#: Payload columns of each kind of record.
P2P = (4, 5, 8, 9)
PAYLOADS = {
    "peer": P2P, "communicator": (*P2P, 13), "tag": P2P, "msg_length": P2P, "request_id": (5, 6, 7, 9), "lock_id": (16, 17, 29, 30), "acquisition_order": (16, 17, 29, 30),
    "task_id": (18, 19, 20), "n_threads": (14, 25), "coll_op": (13,), "coll_root": (13,), "size_sent": (13,), "size_received": (13,),
    "region": (2, 3), "name": (58,),
}


def payload(events: DataFrame) -> DataFrame:
    """events whose payload columns hold values only for records that carry them."""
    return events.withColumns({c: F.when(F.col("record").isin(*records), F.col(c)) for c, records in PAYLOADS.items() if c in events.columns})


#: Kinds of attributes; those below the line are printed as references, by this word.
PLAIN = ("UINT8", "UINT16", "UINT32", "UINT64", "INT8", "INT16", "INT32", "INT64")
REFERENCES = {
    "ATTRIBUTE": "attribute", "LOCATION": "location", "REGION": "region", "GROUP": "group", "METRIC": "metric", "COMM": "comm", "PARAMETER": "parameter",
    "RMA_WIN": "rma_win", "SOURCE_CODE_LOCATION": "source_code_location", "CALLING_CONTEXT": "calling_context",
    "INTERRUPT_GENERATOR": "interrupt_generator", "IO_FILE": "io_file", "IO_HANDLE": "io_handle", "LOCATION_GROUP": "location_group",
}
KINDS = ("NONE", *PLAIN, "FLOAT", "DOUBLE", "STRING", *REFERENCES)


def attribute_value(kind: Column, number: Column, real: Column, text: Column) -> Column:
    """Text of a typed value: whole numbers, six decimals, a string in quotes with its reference, or a reference."""
    out = F.when(kind == "NONE", F.lit("NONE")).when(kind.isin(*PLAIN), number.cast("string")).when(kind.isin("FLOAT", "DOUBLE"), F.format_string("%.6f", real))
    out = out.when(kind == "STRING", F.concat(F.lit('string <'), number.cast("string"), F.lit('> "'), text, F.lit('"')))
    for k, word in REFERENCES.items():
        out = out.when(kind == k, F.concat(F.lit(f"{word} <"), number.cast("string"), F.lit(">")))
    return out


def token_text(kind: Column, number: Column, record: Column | None = None) -> Column:
    """E5E / E6L / E7S for events (enter, leave, single), S2 and L0 for sequences and loops; no suffix without a record."""
    suffix = F.lit("") if record is None else F.when(kind != "E", "").when(record.isin(2, 14, 25, 27, 35), "E").when(record.isin(3, 15, 26, 28, 37), "L").otherwise("S")
    return F.concat(kind, number.cast("string"), suffix)


def attribute_text(attributes: Column) -> Column:
    """{name: value, …} of a map, by name."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "), F.lit("}"))


def seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def exact_seconds(ns: Column) -> Column:
    """Seconds with nine digits, as text, without a detour through floating point."""
    return F.concat(F.floor(ns / F.lit(10**9).cast("decimal(19,0)")).cast("string"), F.lit("."), F.lpad((ns % 10**9).cast("string"), 9, "0"))


def masking_width(most: Column) -> Column:
    """Bytes that hold every value up to `most`: 1, 2, 4 or 8."""
    return F.when(most < 1 << 8, 1).when(most < 1 << 16, 2).when(most < 1 << 32, 4).otherwise(8)


def masked(value: Column, width: Column) -> Column:
    """A whole number in its lowest `width` bytes, the lowest first."""
    full = F.reverse(F.lpad(F.hex(value), 16, "0"))
    pairs = F.regexp_replace(full, "(.)(.)", "$2$1")  # reversing digits has swapped each byte's halves
    return F.unhex(F.substring(pairs, F.lit(1), width * 2))


def unmasked(raw: Column) -> Column:
    """The number again."""
    pairs = F.regexp_replace(F.reverse(F.hex(raw)), "(.)(.)", "$2$1")
    return F.conv(pairs, 16, 10).cast("long")

"""Traces derived from the star-schema tables, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and markers: one event a row of `events`."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    record = F.when(kind == "purchase", 4).when(kind == "signup", 5).when(kind == "click", 8).when(kind == "view", 9).otherwise(58)
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 8).cast("int").alias("archive_id"),
        F.col("user_id").alias("thread_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        record.cast("int").alias("record"),
        kind.alias("name"),
        (k % 8).cast("int").alias("peer"),
        (k % 4).cast("int").alias("tag"),
        F.round(F.col("value") * 100).cast("long").alias("msg_length"),
        F.col("event_id").alias("request_id"),
        F.lit(0).alias("communicator"),
        k.alias("k"),
    )


def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, day and leaf blocks of every thread with inclusive and exclusive durations; one scan, dealt once by thread."""
    e = trace_events(spark, sf_dir).select("thread_id", "event_id", "ts_ns", "name", "k").withColumn("day", F.expr(f"ts_ns div {DAY_US * 1000}"))
    by_day, by_thread = Window.partitionBy("thread_id", "day"), Window.partitionBy("thread_id")
    e = e.repartition("thread_id").withColumn("next", F.lead("ts_ns").over(by_day.orderBy("ts_ns", "event_id")))
    e = e.withColumn("finish", F.least(F.col("ts_ns") + F.col("k").cast("long") * 60_000_000_000, F.coalesce("next", "ts_ns")))
    e = e.withColumns({"a1": F.min("ts_ns").over(by_day), "b1": F.max("ts_ns").over(by_day), "inside": F.sum(F.col("finish") - F.col("ts_ns")).over(by_day), "a0": F.min("ts_ns").over(by_thread), "b0": F.max("ts_ns").over(by_thread)})
    none = F.lit(None).cast("long")

    def row(level: int, day: Column, event: Column, name: Column, start: str, finish: str, exclusive: Column) -> Column:
        dur = F.col(finish) - F.col(start)
        return F.struct(F.lit(level).alias("level"), day.alias("day"), event.alias("event_id"), name.alias("name"), F.col(start).alias("start_ns"), F.col(finish).alias("finish_ns"), dur.alias("duration_ns"), exclusive.cast("long").alias("exclusive_ns"))

    rows = F.array(
        row(2, F.col("day"), F.col("event_id"), F.col("name"), "ts_ns", "finish", F.col("finish") - F.col("ts_ns")),
        F.when(F.col("ts_ns") == F.col("a1"), row(1, F.col("day"), none, F.lit("day"), "a1", "b1", F.col("b1") - F.col("a1") - F.col("inside"))),
        F.when(F.col("ts_ns") == F.col("a0"), row(0, none, none, F.lit("main"), "a0", "b0", F.lit(0))),
    )
    return e.select("thread_id", F.explode(F.array_compact(rows)).alias("s")).select("thread_id", "s.*")


def trace_enter_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as ENTER and LEAVE events in each thread's order."""
    leave_key = F.when((F.col("level") == 2) & (F.col("duration_ns") > 0), 5).otherwise(20 - F.col("level"))
    enter = F.struct(F.col("start_ns").alias("ts_ns"), F.lit("E").alias("phase"), (10 + F.col("level")).alias("order_key"))
    leave = F.struct(F.col("finish_ns").alias("ts_ns"), F.lit("L").alias("phase"), leave_key.alias("order_key"))
    both = trace_spans(spark, sf_dir).select("thread_id", "name", F.explode(F.array(enter, leave)).alias("x")).select("thread_id", "name", "x.*")
    seq = F.row_number().over(Window.partitionBy("thread_id").orderBy("ts_ns", "order_key")).cast("long")
    return both.select("thread_id", seq.alias("seq_no"), "ts_ns", "phase", "name")


#: What an event of a shape stands for in a program: (offset in ns, record, region of ENTER and LEAVE, name of a generic event).
SHAPES: dict[int, list[tuple[int, int, str | None, str | None]]] = {
    0: [(0, 2, "MPI_Send", None), (10, 4, None, None), (20, 3, "MPI_Send", None)],
    1: [(0, 2, "MPI_Isend", None), (10, 5, None, None), (20, 3, "MPI_Isend", None), (30, 2, "MPI_Wait", None), (40, 6, None, None), (50, 3, "MPI_Wait", None)],
    2: [(0, 2, "MPI_Isend", None), (10, 5, None, None), (20, 3, "MPI_Isend", None), (30, 2, "MPI_Waitall", None), (40, 6, None, None), (50, 3, "MPI_Waitall", None)],
    3: [(0, 2, "MPI_Isend", None), (10, 5, None, None), (20, 3, "MPI_Isend", None)],
    4: [(0, 2, "mpi_recv_", None), (10, 8, None, None), (20, 3, "mpi_recv_", None)],
    5: [(0, 2, "MPI_Irecv", None), (10, 7, None, None), (20, 3, "MPI_Irecv", None), (30, 2, "MPI_Wait", None), (40, 9, None, None), (50, 3, "MPI_Wait", None)],
    6: [(0, 14, None, None), (10, 16, None, None), (20, 17, None, None), (30, 15, None, None)],
    7: [(0, 2, "MPI_Allreduce", None), (10, 12, None, None), (20, 13, None, None), (30, 3, "MPI_Allreduce", None)],
    8: [(0, 18, None, None), (10, 19, None, None), (20, 20, None, None)],
    9: [(0, 2, "compute", None), (10, 58, None, "marker"), (20, 3, "compute", None)],
    10: [(0, 2, "solve", None), (10, 2, "solve", None), (20, 58, None, "marker"), (30, 3, "solve", None), (40, 3, "solve", None)],
    11: [(0, 2, "solve", None), (10, 2, "solve", None), (20, 2, "solve", None), (30, 3, "solve", None), (40, 3, "solve", None), (50, 3, "solve", None)],
    12: [(0, 2, "solve", None), (10, 2, "helper", None), (20, 3, "helper", None), (30, 2, "solve", None), (40, 58, None, "marker"), (50, 3, "solve", None), (60, 3, "solve", None)],
    13: [(10 * k, *x) for k, x in enumerate([(2, "step", None), (58, None, "tick"), (3, "step", None)] * 3)],
}
#: Before and after these: the program's main, and one block a day.
EDGE_SHAPES = {"first": [(-100, 2, "main", None)], "dawn": [(-50, 2, "day", None)], "dusk": [(800, 3, "day", None)], "last": [(850, 3, "main", None)]}


def _steps(rows: list[tuple[int, int, str | None, str | None]]) -> str:
    say = lambda x: "cast(null as string)" if x is None else f"'{x}'"
    return "array(" + ", ".join(f"named_struct('off', {o}L, 'record', {r}, 'region', {say(g)}, 'name', {say(n)})" for o, r, g, n in rows) + ")"


def program_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's events in the events schema: calls of message functions with requests, waits, recursion, loops, parallel regions.

    Every row of `events` becomes the events of its shape, within its own microsecond. All payload columns hold a value;
    functions.text.payload() leaves those that a record carries. event_id is unique and rises with time.
    """
    e = trace_events(spark, sf_dir).withColumn("day", F.expr(f"ts_ns div {DAY_US * 1000}"))
    w = Window.partitionBy("thread_id").orderBy("ts_ns")
    before, after = F.lag("day").over(w), F.lead("day").over(w)
    e = e.withColumns({"first": before.isNull(), "dawn": before.isNull() | (before != F.col("day")), "dusk": after.isNull() | (after != F.col("day")), "last": after.isNull()})
    shape = "CASE name WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 + k % 3 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 6 + k % 8 END"
    body = f"CASE {shape} " + " ".join(f"WHEN {n} THEN {_steps(rows)}" for n, rows in SHAPES.items()) + " END"
    edges = [f"if({c}, {_steps(rows)}, array())" for c, rows in EDGE_SHAPES.items()]
    e = e.withColumn("x", F.explode(F.expr(f"concat({body}, {', '.join(edges)})"))).withColumns({"at": F.col("ts_ns") + F.col("x.off")})
    return e.select(
        (F.col("event_id") * 1000 + F.col("x.off")).alias("event_id"), "archive_id", "thread_id", F.row_number().over(Window.partitionBy("thread_id").orderBy("at")).cast("long").alias("seq_no"),
        F.col("at").alias("ts_ns"), F.col("x.record").alias("record"), F.col("x.region").alias("region"), F.col("x.name").alias("name"), "peer", "communicator", "tag", "msg_length",
        F.col("k").cast("long").alias("request_id"), (F.col("k") % 5).cast("long").alias("lock_id"), F.col("event_id").alias("acquisition_order"), (F.col("event_id") % 50).alias("task_id"),
        (F.col("k") % 16 + 1).alias("n_threads"), (F.col("k") % 3).alias("coll_op"), (F.col("k") % 8).alias("coll_root"), F.col("msg_length").alias("size_sent"), (F.col("msg_length") * 2).alias("size_received"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("attributes"),
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a global dictionary, and local ones that override every tenth: (scope, ref, str)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("global").alias("scope"), F.col("p_partkey").alias("ref"), F.col("p_name").alias("str")).unionByName(
        p.where("p_partkey % 10 = 0").select(F.lit("local").alias("scope"), F.col("p_partkey").alias("ref"), F.concat(F.lit("local "), "p_name").alias("str"))
    )


def locations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Location groups (processes, children of a machine by region) and locations (threads): (id, name, parent)."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    groups = region.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent")).unionByName(
        nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"))
    )
    return groups, supplier.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("parent"))


def all_definitions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every dictionary of a trace by its name: (scope, id, name) and what else it holds."""
    region, nation, part = (table(spark, sf_dir, t) for t in ("region", "nation", "part"))
    groups, places = locations(spark, sf_dir)
    at = [F.lit("global").alias("scope")]
    members = nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("long"))).alias("members"))  # a few nations
    return {
        "strings": definitions(spark, sf_dir).select("scope", F.col("ref").alias("id"), F.col("str").alias("name")),
        "regions": part.where("p_partkey % 3 = 0").select(*at, F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name")),
        "attributes": part.where("p_partkey < 20").select(*at, F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("attribute "), "p_name").alias("name"), (F.col("p_partkey") % 26).cast("int").alias("type")),
        "groups": region.select(*at, F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")).join(members, "id").select("scope", "id", "name", "members"),
        "comms": region.select(*at, (F.col("r_regionkey") + 100).cast("long").alias("id"), F.concat(F.lit("comm "), "r_name").alias("name"), F.col("r_regionkey").cast("long").alias("group_id")),
        "location_groups": groups.select(*at, "id", "name", "parent"),
        "locations": places.select(*at, "id", "name", "parent"),
    }

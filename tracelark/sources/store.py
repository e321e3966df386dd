"""Traces as folders of Parquet tables, and text sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attribute_text, event_text, exact_seconds, token_text
from ..operators.grammar import event_ids, unrolled
from ..operators.spans import with_depth

CODECS = {"none": "uncompressed", "zstd": "zstd", "gzip": "gzip", "snappy": "snappy", "lz4": "lz4_raw"}
#: Parameters and their defaults.
DEFAULTS = {"compression": "none", "encoding": "none", "zstdCompressionLevel": "3", "loopFinding": "truncated", "maxLoopLength": "100", "timestampStorage": "delta"}


DICTIONARIES = ("strings", "regions", "attributes", "groups", "comms", "location_groups", "locations")


@dataclass
class Trace:
    """A stored trace: lazy tables; archives and threads are found by partition and row-group pruning."""

    spark: SparkSession
    path: str
    metadata: dict[str, str] = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Trace:
        """Reads the metadata and the list of tables, a few entries each; the tables are read when they are asked for."""
        t = Trace(spark, path)
        rows = spark.read.parquet(f"{path}/metadata").collect()
        t.metadata = {r["key"]: r["value"] for r in rows if r["kind"] == "user"}
        t.tables = sorted(r["key"] for r in rows if r["kind"] == "table")
        return t

    @staticmethod
    def store(
        events: DataFrame,
        path: str,
        codec: str = "zstd",
        metadata: dict[str, str] | None = None,
        definitions: dict[str, DataFrame] | None = None,
        spans: DataFrame | None = None,
    ) -> Trace:
        """One folder an archive, its files cut by thread and time and sorted so, that statistics prune; a folder a dictionary; the blocks.

        Rows are dealt by ranges of archive, thread and time: an archive or thread of any size is many files.
        """
        spark = events.sparkSession
        unknown = set(definitions or {}) - set(DICTIONARIES)
        if unknown:
            raise ValueError(f"unknown dictionaries {sorted(unknown)}")
        order = ["archive_id", "thread_id", "ts_ns"]
        write = lambda df: df.write.mode("overwrite").option("compression", CODECS[codec])
        write(events.repartitionByRange(*order).sortWithinPartitions(*order)).partitionBy("archive_id").parquet(f"{path}/events")
        tables = dict(definitions or {})
        for name, df in tables.items():
            write(df).parquet(f"{path}/{name}")
        if spans is not None:
            tables["spans"] = spans
            write(spans.repartitionByRange("thread_id", "start_ns").sortWithinPartitions("thread_id", "start_ns")).parquet(f"{path}/spans")
        rows = [("user", k, str(v)) for k, v in sorted((metadata or {}).items())] + [("table", k, "") for k in tables]
        spark.createDataFrame(rows, "kind string, key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
        return Trace.open(spark, path)

    @property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")

    def table(self, name: str) -> DataFrame:
        """A dictionary, or the blocks (`spans`)."""
        if name not in self.tables:
            raise KeyError(f"the trace holds no {name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def archive(self, archive_id: int) -> DataFrame:
        return self.events.where(F.col("archive_id") == archive_id)

    def thread(self, thread_id: int) -> DataFrame:
        return self.events.where(F.col("thread_id") == thread_id)

    def between(self, start_ns: int, end_ns: int) -> DataFrame:
        return self.events.where(F.col("ts_ns").between(start_ns, end_ns))

    def threads(self) -> DataFrame:
        return self.events.select("archive_id", "thread_id").distinct()

    def recompress(self, codec: str) -> Trace:
        """A copy of all tables under another codec, beside this one."""
        got = {k: self.table(k) for k in self.tables}
        spans = got.pop("spans", None)
        return Trace.store(self.events, f"{self.path}_{codec}", codec, self.metadata, got, spans)


def read_config(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Parameters from lines `key = value` over the defaults, and from the environment over both; unknown keys are errors."""
    out = dict(DEFAULTS)
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, _, value = (p.strip() for p in line.partition("="))
            if key not in out:
                raise ValueError(f"unknown parameter {key}")
            out[key] = value.strip('"')
    for key in out:
        out[key] = (environment or {}).get(f"TRACELARK_{key.upper()}", out[key])
    return out


def check_unique(definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are registered more than once."""
    return definitions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def event_lines(events: DataFrame) -> DataFrame:
    """(thread_id, seq_no, line): the text listing of a program's events: seconds, thread, token, event, attributes."""
    e = event_ids(events)
    token = token_text(F.lit("E"), F.col("event_no"), F.col("record"))
    line = F.concat_ws("  ", exact_seconds(F.col("ts_ns")), F.concat(F.lit("T"), F.col("thread_id").cast("string")), token, event_text(region=F.col("label"), full=True), attribute_text(F.col("attributes")))
    return e.select("thread_id", "seq_no", line.alias("line"))


def bulk_rows(spans: DataFrame) -> DataFrame:
    """Thread, Function, Start, Finish, Duration of blocks below the root."""
    return spans.where("level > 0").select(
        F.col("thread_id").alias("Thread"), F.col("name").alias("Function"), F.col("start_ns").alias("Start"), F.col("finish_ns").alias("Finish"), F.col("duration_ns").alias("Duration")
    )


def write_rows(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or text of the single column."""
    (df.write.mode("overwrite").option("header", True).csv if kind == "csv" else df.write.mode("overwrite").text)(path)


def structure_lines(events: DataFrame, blocks: DataFrame, durations: bool = True, loops: bool = True) -> DataFrame:
    """(thread_id, seq_no, line): a program's threads as indented trees of blocks and events.

    Each block with its start and, if asked for, its duration; without `loops` a loop is one line with its number of
    iterations, and what its iterations hold is shown for the first only. blocks: grammar.block_sequences().
    """
    e = with_depth(event_ids(events)).where("phase is null or phase = 'E'")
    own = blocks.select("thread_id", F.col("enter_seq").alias("seq_no"), "duration_ns", "sequence_id", "iteration", "loop", "parent_seq")
    times = own.groupBy("thread_id", F.col("loop").alias("seq_no"), F.col("parent_seq").alias("of")).agg(F.count("*").alias("times")).where("times > 1").drop("of")
    e = e.join(own, ["thread_id", "seq_no"], "left").join(times, ["thread_id", "seq_no"], "left")
    if not loops:
        kept = unrolled(events, blocks).where("flag = 'SEQUENCES'").select("thread_id", "seq_no")
        e = e.join(kept, ["thread_id", "seq_no"], "left_semi")
    opened = F.col("phase") == "E"
    what = F.when(opened, F.concat(F.lit("S"), F.col("sequence_id").cast("string"), F.lit(" "), "label")).otherwise(
        F.concat(token_text(F.lit("E"), F.col("event_no"), F.col("record")), F.lit(" "), event_text(region=F.col("label"), full=True))
    )
    parts = [F.concat(F.repeat(F.lit("  "), F.col("depth")), what), exact_seconds(F.col("ts_ns"))]
    if durations:
        parts.append(F.when(opened, F.concat(F.lit("+"), exact_seconds(F.col("duration_ns")))))
    if not loops:
        parts.append(F.when(F.col("times") > 1, F.concat(F.lit("x"), F.col("times").cast("string"))))
    return e.select("thread_id", "seq_no", F.concat_ws("  ", *parts).alias("line"))

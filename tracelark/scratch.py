"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def is_local(master: str) -> bool:
    """True if driver and executors are one process and so share every folder."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that was set, or, in local runs only, a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return str(at)
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return str(got.get())
    if not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="tracelark-")
    return _LOCAL[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may already be closed; the folder is only scratch
        pass


_TOPS: dict[str, list[str]] = {}


def release(spark: SparkSession, app: str | None = None) -> None:
    """Deletes all tables that operators have written for this application; results that still read them must be stored before."""
    for top in _TOPS.pop(app or spark.sparkContext.applicationId, []):
        _delete(spark, top)


class Scratch:
    """Written tables outlive lost executors, unlike cached blocks. They go with release(), or when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_dir(spark).rstrip('/')}/tracelark-{uuid.uuid4().hex}"
        self.n = 0
        app = spark.sparkContext.applicationId
        if app not in _TOPS:
            atexit.register(release, spark, app)
        _TOPS.setdefault(app, []).append(self.top)

    def table(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again."""
        path = f"{self.top}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tracelark_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_tracelark_path", None):
            _delete(self.spark, path)

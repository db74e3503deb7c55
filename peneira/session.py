"""Session helpers: a tuned local session, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g", name: str = "peneira") -> SparkSession:
    """A session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make so few partitions that most cores would wait; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; choose a temporary one only where that is unset on a local master.

    Checkpoints must live where every executor can read them, so that a lost executor
    costs no more than the tasks it was running.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="peneira-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


#: The folders written below, by session, to be deleted when the program ends.
_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended before the program
            continue
    _written.clear()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, deleted when the program ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"
    _written[path] = spark
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared checkpoint folder and read it from there ever after.

    For results that several later jobs read: they are not computed twice, survive lost executors, and are read by
    column, with their size known to the planner. The table is deleted by `release`, or when the program ends.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def durable_in_order(df: DataFrame) -> DataFrame:
    """The same, but with the partitions of df and the order of their rows kept."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    found = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if found.isDefined():
        out.written_to = found.get()
        _written[out.written_to] = df.sparkSession
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that durable wrote. Nothing may read them, or what was derived from them, afterwards."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path and _written.pop(path, None) is not None:
            _delete(df.sparkSession, path)

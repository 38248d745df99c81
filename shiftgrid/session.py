"""Session settings, and ``cut``: the end of a lineage in a table of the shared folder.

Every operator has one plan, whatever the volume.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Most slices of an ordered group; 0 = take spark.sql.shuffle.partitions.
SLICES_KEY = "spark.shiftgrid.slices"
# Rows of a group that one task sorts.
ROWS_KEY = "spark.shiftgrid.rows"
# Rows that one task of a join or an aggregation takes where their number is known.
TASK_ROWS = 500_000


def get_session(app: str = "shiftgrid", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # recording the source line of every column expression costs several calls to the JVM each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if conf.get("spark__master", "").startswith("local"):
        # on one machine a handful of partitions is already right, and merging them would leave cores idle
        builder = builder.config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_private: dict[str, str] = {}
_marked: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local master may do without one: it then gets a folder of this machine, which is where all its tasks run.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _private:
            _private[app] = tempfile.mkdtemp(prefix="shiftgrid-")
        folder = _private[app]
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is removed when the application ends."""
    folder = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and go on from there.

    Used where several branches read one intermediate result, and where values must not change when a lost executor's work
    is done again. The table is columnar, so each branch reads its own columns, and the planner knows its size.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables this application cut. Call it when no DataFrame built from them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(spark: SparkSession) -> int:
    n = int(spark.conf.get(SLICES_KEY, "0"))
    return n or int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: those of the session, and more where each would get more than TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // TASK_ROWS))


def rows_per_slice(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_KEY, "1000000"))

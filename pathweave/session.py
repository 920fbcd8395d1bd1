"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: list[str] = []


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pathweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting: there the driver's own disk
    is the executors' disk too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="pathweave-")
    return _local_dirs[sc.applicationId]


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_tables(spark: SparkSession) -> None:
    """Deletes the tables that this session has written below the shared folder.

    For the owner of a session to call when no result is read any more.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def files_for(rows: int) -> int:
    """Files for a table of about so many short rows."""
    return 2 + rows // 500_000


def materialise(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read the same rows: the work is done once, the
    lineage is cut, a lost executor costs a re-read, and Catalyst sees the true
    size when it picks a join. ``files`` keeps a table that is known to be small in few files.
    """
    spark = df.sparkSession
    path = table_path(spark, label)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

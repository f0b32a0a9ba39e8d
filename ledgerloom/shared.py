"""Tables written to the cluster's shared folder, to cut lineage and to be read more than once.

The folder is the one the cluster names in ``spark.checkpoint.dir`` or the context's checkpoint directory; only where both are
unset and the master is local (tests) a folder of our own is made.  Written tables survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application.

    That is the one named in ``spark.checkpoint.dir``, else the context's checkpoint directory.  Without either a folder of
    this machine is made, but only where driver and executors are one process; on a cluster, where executors would
    each write to a disk of their own, a RuntimeError is raised instead.
    """
    context = spark.sparkContext
    base, app = spark.conf.get("spark.checkpoint.dir", None), context.applicationId
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not _one_process(context.master):
            raise RuntimeError(f"no shared folder for intermediate tables: set spark.checkpoint.dir or a checkpoint directory (master {context.master})")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="ledgerloom-")
            atexit.register(shutil.rmtree, _own[app], True)
        base = "file://" + _own[app]
    if app not in _known:
        _known.add(app)
        atexit.register(_at_exit, spark)
    return f"{base.rstrip('/')}/ledgerloom-{app}"


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a zstd Parquet table in the shared folder, a directory per value of its last column ``by``, and return a scan of it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that are not written yet can then no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    try:
        forget(spark)
    except Exception:  # the session may be gone
        return


def slots(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

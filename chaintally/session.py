"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_PROCESS = uuid.uuid4().hex[:12]
_local: list[str] = []

# AQE picks partition counts, splits skewed shuffle partitions and switches to broadcast
# joins by measured size; the library adds no join hints of its own except for inputs with
# a proven bound (one metadata row, one row per calendar day, one row per partition).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app="chaintally", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder below ``spark.checkpoint.dir`` that holds this process's intermediate tables.

    On a cluster the setting must name storage that all executors share. Only in local mode,
    with nothing set, a temporary folder of this machine is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="chaintally-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        shared = _local[0]
    return f"{shared.rstrip('/')}/chaintally-{_PROCESS}"


def stored(df, name="table", partition_by=()):
    """Write an intermediate result once as Parquet in the shared folder and read it from there.

    For results that several branches of a report need: the source is scanned once, columns
    and row groups can be skipped, and a lost executor costs a re-read of files instead of a
    recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


materialise = stored


def ordered(df):
    """``df``, sorted before, as a checkpoint in the shared folder, whose rows keep their order and partitions.

    A table read back from files has no order; a checkpoint has, so nothing needs to be sorted again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


def drop_stored(spark):
    """Remove every intermediate table of this process; frames that read them end here."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

"""Session defaults and the scratch folder shared by all executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "daywatch", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    A cluster sets master, memory and shuffle partitions through spark-submit;
    ``master`` is only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the Python call site of every column expression slows wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        # A task and its worker keep a batch several times over.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as a URI or path.

    The context's checkpoint folder if one is set, else ``spark.checkpoint.dir``. A
    purely local session without either gets a temporary folder, removed at its end;
    on a cluster that names none this raises, as a folder of one machine would lose rows.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="daywatch-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder.

    All paths of an application lie in one folder, which ``clear_scratch`` removes and
    which goes at the latest when the Python process ends.
    """
    root = _scratch_root(spark)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has stored; frames that read it are void from then on."""
    _remove(spark, _scratch_root(spark))


_ROOTS: set[str] = set()


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/daywatch-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, root: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

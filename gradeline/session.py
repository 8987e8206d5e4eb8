"""Session settings, shared scratch space and pinned tables."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def build_session(app: str = "gradeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can read, named by the cluster in spark.checkpoint.dir.

    Only a local master may go without one: there a temporary folder is made once and removed at
    exit. On a cluster a machine-local folder would lose data, so the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="gradeline-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/gradeline-{spark.conf.get('spark.app.id', 'local')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below this application's part of the shared scratch folder."""
    path = f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of files, on whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is pinned inside. Results that outlive the scope have to be written."""
    before = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get()
        _SCOPE.reset(before)
        for path in paths:
            delete(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application pinned. Call it when no result that reads a pin is needed."""
    delete(spark, _app_folder(spark))


def pin(df: DataFrame, name: str = "pin") -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts lineage in a way that survives lost executors, lets later branches read only the columns
    they need, and gives the optimiser the real size when it picks a join.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fix_splits(spark: SparkSession) -> None:
    """Make file scans cut their input alike from now on, however many executors are alive.

    Unless told otherwise Spark lets the number of live cores decide how small files are packed.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))

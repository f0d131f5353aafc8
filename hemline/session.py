"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "hemline") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder; a
    cluster gets an error, because a machine-local folder would be lost with
    its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="hemline-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_folder(spark)}/hemline/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    Later stages start from the files, so a lost executor costs a re-read and
    not a recomputation, and columnar pruning applies to every later scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_only(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` what ``build`` returns, and delete the tables it has written on the way."""
    path = scratch_path(spark)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scope whose tables are deleted at its end; results that outlive it are written inside it."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    try:
        yield
    finally:
        inside, written[before:] = written[before:], []
        _delete(spark, inside)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables this application wrote with ``materialize``."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

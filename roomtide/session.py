"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job assumes. They may be set on a session that
# somebody else created, so static settings (memory, master) are not here.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = 8, app: str = "roomtide", memory: str = "8g", scratch_dir: str | None = None
) -> SparkSession:
    """Session for tests and the benchmark on one machine; only here is a local folder right for written tables."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", scratch_dir or tempfile.mkdtemp(prefix="roomtide-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting that holds inside this block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. Unlike
    an RDD checkpoint the table is columnar and has statistics, so later passes
    read only the columns they need and the optimizer knows its size. Inside
    ``scratch`` the table is removed at the end of the block. What the write
    shuffled goes when it is written: no later job reads it.
    """
    path = fresh_path(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that ``durable`` wrote, once their successors are written; anything else is left alone."""
    for table in tables:
        path = getattr(table, "written_at", None)
        if path is not None:
            remove(table.sparkSession, path)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; inside ``scratch`` what is written there is removed at the end of the block."""
    path = f"{shared_folder(spark)}/roomtide/{uuid.uuid4().hex}"
    for owned in _owned.get():
        owned.append(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which all executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


# blocks that are open in this thread (or task), outermost first
_owned: ContextVar[tuple[list[str], ...]] = ContextVar("owned", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``durable`` writes inside this block when it ends.

    Results must be computed or written inside the block. Blocks of different
    threads do not touch each other's tables.
    """
    paths: list[str] = []
    token = _owned.set((*_owned.get(), paths))
    try:
        yield
    finally:
        _owned.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

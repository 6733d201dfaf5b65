"""Spark session factory and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
# bytes of a row group, which a task that writes holds in memory
ROW_GROUP = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app_name: str = "cohortflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here relies on; ``conf`` overrides them.

    Keyword names use ``__`` for the dots, as in ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): str(v) for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that every executor can reach.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session, where one
    machine is the whole cluster, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortflow-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


_owners: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the tables that are written to the shared folder inside, and remove them at the end.

    Results are lazy, so whatever is to outlive the block must be written or collected in it. Blocks may be nested; a
    table belongs to the innermost. Use it in the thread that drives the session.
    """
    own: list[str] = []
    _owners.append(own)
    try:
        yield
    finally:
        _owners.remove(own)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is there, not when the driver next collects garbage.

    Only for writes: a table that is collected twice would have to make its shuffles again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back. The shuffles behind them go.

    Later steps then start from files that outlive any executor, instead of running the whole
    lineage again for every use. Files stay until the folder is cleared, or the :func:`scratch` around them ends; a
    ``path`` that :func:`shared_dir` gave before a block began outlives that block.
    """
    path = path or shared_dir(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WHOLE_KEYS_CONF = "spark.sql.requireAllClusterKeysForCoPartition"
_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(cores: int | str = 8, app_name: str = "apidrift") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage that driver and executors share, as named in ``spark.checkpoint.dir``.

    A session inside one machine may leave it unset and gets a folder of its own; a cluster must name one.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="apidrift-", ignore_cleanup_errors=True)
    return _own_folders[context.applicationId].name


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier job has written to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins leave rows where they are that are dealt by a part of the keys, here the release or pair: rows
    of one of them are few next to a partition. The planner's default deals them anew, by all keys."""
    kept = spark.conf.get(WHOLE_KEYS_CONF, None)
    spark.conf.set(WHOLE_KEYS_CONF, "false")
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(WHOLE_KEYS_CONF)
        else:
            spark.conf.set(WHOLE_KEYS_CONF, kept)


def materialize(df: DataFrame, label: str, in_place: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a result feeds several branches or a loop. Unlike cached blocks the files
    survive the loss of executors, and their sizes give the planner real statistics.
    ``in_place`` plans the write under :func:`joins_in_place`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with joins_in_place(spark) if in_place else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

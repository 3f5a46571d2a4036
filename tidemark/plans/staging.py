"""Tables written once so that later steps read fixed rows.

A range exchange samples its input, so two runs of one plan may cut the ranges at
different rows.  Whatever depends on the cut must therefore read a written table,
which also survives the loss of executors and cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"

#: A look-up table with more rows than this is not sent to all tasks.
BROADCAST_ENTRIES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder which the session names; one of its own only where all tasks run in this process."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder which all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return shared_folder(spark)


#: Folders of the passing tables of a block of ``passing``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def new_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tidemark/{application}/{label}-{uuid.uuid4().hex}"
    if not lasting and (held := _PASSING.get()) is not None:
        held.append(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged in here are removed at the end, but for the ``lasting`` ones: what comes out must be one of these."""
    held: list[str] = []
    before = _PASSING.set(held)
    try:
        yield
    finally:
        _PASSING.reset(before)
        for path in held:
            _delete(spark, path)


def stage(df: DataFrame, label: str, by: Sequence[str] = (), lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (columnar, so later scans prune).

    ``by``: columns of few values which get folders of their own, so that a filter on them
    reads its part only.  ``lasting``: it outlives a block of ``passing``.
    """
    spark = df.sparkSession
    path = new_path(spark, label, lasting)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove all tables which this application has staged; none of them may be needed any more."""
    _delete(spark, f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}")


def sized(lookup: DataFrame) -> DataFrame:
    """Broadcast a look-up table if it is counted to be small; else leave it to a shuffle."""
    few = lookup.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    return F.broadcast(lookup) if few else lookup

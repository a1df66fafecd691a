"""Where intermediate tables live: the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.files import delete_path, shared_path

#: Paths made in the innermost open ``scratch``; each driver thread has its own.
_OPEN: ContextVar[list[str] | None] = ContextVar("_OPEN", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = shared_path(spark, name)
    if (made := _OPEN.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are made within, when all that needs them has been written elsewhere."""
    token = _OPEN.set(made := [])
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            delete_path(spark, path)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or to ``path``) and read it back, which cuts its lineage for all executors."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The size that the plan's statistics give for ``df``, 0 if they give none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 62 else 0


def width(df: DataFrame, mb: int = 64) -> int:
    """Partitions for a shuffle of ``df``: the session's setting, or more if the plan's size estimate asks for it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df) // (mb << 20))

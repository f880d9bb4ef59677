"""Tables in the folder that a cluster shares, for cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Tables that cut() wrote and drop() hasn't deleted, by the frame that reads them.
_written: dict[int, tuple[DataFrame, str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local one serves sessions on
    one machine (tests); on a cluster that is an error, as executors would not see each other's files."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="silvan-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again: cut from its lineage, and safe from lost executors.

    The table is deleted by drop(), or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/silvan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written[id(out)] = out, path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames that cut() returned. Nothing that is still to run may read them."""
    for df in frames:
        if df is not None and id(df) in _written:
            _, path = _written.pop(id(df))
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def drop_since(before: Iterable[int], *keep: DataFrame) -> None:
    """Deletes all tables that were written since `before`, which written() gave, but those of `keep`."""
    kept = {*before, *map(id, keep)}
    drop(*[df for key, (df, _) in list(_written.items()) if key not in kept])


def written() -> frozenset[int]:
    """What stands for the tables that are there now."""
    return frozenset(_written)


def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the session may be over, with its folder or without
        drop(*[df for df, _ in list(_written.values())])

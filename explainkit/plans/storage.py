"""Durable intermediate results.

Lineage is cut by writing a Parquet table into the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a recomputation, and the
columnar files are several times smaller than a row checkpoint.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as a full URI.

    A folder of our own is used where none is configured and driver and executors are one process (tests,
    local mode); anywhere else that would scatter tables over the machines' own disks, so it is refused.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return qualified(spark, named.rstrip("/"))
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="explainkit-")
        import atexit

        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark resolves it; readers and writers outside the JVM then reach the same place."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; concurrent runs never meet. :func:`clean_up` deletes it."""
    path = f"{shared_dir(spark)}/explainkit/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it reread, with its lineage cut."""
    return persist_path(df, name)[0]


def persist_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`persist_table`, and where the table is, for callers that drop it when it is done."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def clean_up(spark: SparkSession) -> int:
    """Delete all tables that this process wrote and that are still there; their number. Results read lazily
    from them must have been consumed or written elsewhere."""
    paths = list(_written)
    for path in paths:
        drop_path(spark, path)
    return len(paths)

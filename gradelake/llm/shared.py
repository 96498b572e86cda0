"""Tables written to the folder that all executors share.

Long plans are cut by writing a table and reading it again: the files survive a lost executor, and the
next plan starts from statistics rather than from a long lineage.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="gradelake-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gradelake-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gradelake_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    path = getattr(df, "_gradelake_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete all tables that this driver has staged, once the results that read them are written. Returns how many."""
    n = len(_made)
    for path in list(_made):
        _delete(spark, path)
    return n


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)

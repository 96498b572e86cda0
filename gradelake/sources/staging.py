"""Tables written to the folder that all executors share, where several plans read what one plan made."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

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
        _own["dir"] = tempfile.mkdtemp(prefix="gradelake-core-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: later plans neither repeat its work nor carry its lineage."""
    path = f"{shared_dir(df.sparkSession)}/gradelake-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write df once, and count while it is written: no second read for the numbers."""
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, {k: v or 0 for k, v in seen.get.items()}


def release(spark: SparkSession) -> int:
    """Delete all tables written so, once the results that read them are written. Returns how many."""
    n = len(_made)
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n

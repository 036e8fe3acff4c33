"""Intermediate tables in the shared folder of the cluster.

An intermediate result that is read more than once, whose size must be known
before a plan is chosen, or whose partition numbers become data, is written
once to the folder named by ``spark.checkpoint.dir``.  A lost executor then
costs a re-read, not a recomputation that could number its partitions
differently.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES_KEY = "haulframe.broadcast.bytes"
BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
_sections: list[list[str]] = []
_proven: set[tuple[str, str]] = set()


def _prove_shared(spark: SparkSession, folder: str) -> None:
    """Raise an error if the driver does not see what executors write to ``folder``.

    Only a folder of a local file system can fail this, once per session.
    """
    app = spark.sparkContext.applicationId
    if (app, folder) in _proven:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    if files.getUri().getScheme() == "file":
        path = f"{folder}/haulframe/{app}/probe-{uuid.uuid4().hex}"
        spark.range(0, 2, 1, 2).write.parquet(path)
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))
        if len(found or []) != 2:
            raise RuntimeError(f"executors and driver do not share {folder}")
    _proven.add((app, folder))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of this session; a temporary one on a single machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if not spark.sparkContext.master.startswith("local"):
            _prove_shared(spark, shared)
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach"
        )
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="haulframe-")
    return _local_dirs[app]


def new_path(spark: SparkSession) -> str:
    """A fresh folder name under the shared folder."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/haulframe/{app}/{uuid.uuid4().hex}"
    for paths in _sections:
        paths.append(path)
    return path


@contextmanager
def scratch_section() -> Iterator[list[str]]:
    """The folders that scratch tables get while the section is open, in order."""
    paths: list[str] = []
    _sections.append(paths)
    try:
        yield paths
    finally:
        _sections.remove(paths)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application, and nothing else."""
    jvm = spark.sparkContext._jvm
    app = spark.sparkContext.applicationId
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/haulframe/{app}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _element_bytes(kind: T.ArrayType) -> int:
    """Size of an array's element in memory, a short text where it is one."""
    inner = kind.elementType
    return 16 + 8 * len(inner.fields) if isinstance(inner, T.StructType) else 16


def row_bytes(schema: T.StructType) -> Column:
    """Size of a row in memory, counting the text it really holds."""
    widths = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        for f in schema.fields
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    widths += [
        F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)) * _element_bytes(f.dataType)
        for f in schema.fields
        if isinstance(f.dataType, T.ArrayType)
    ]
    fixed = F.lit(16 + 16 * len(schema.fields)).cast("long")
    return reduce(lambda a, b: a + b, widths, fixed)


def materialize_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` once; also return its size, observed during the write."""
    seen = Observation()
    size = F.sum(row_bytes(df.schema)).alias("bytes")
    table = materialize(df.observe(seen, size))
    return table, seen.get["bytes"] or 0


def broadcast_limit(spark: SparkSession) -> int:
    """Largest table, in bytes, that is copied to every executor."""
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(BROADCAST_BYTES)))

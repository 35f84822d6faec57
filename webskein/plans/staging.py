"""Tables written to the folder that all executors share.

An operator that reads an intermediate result more than once, or that cuts a long lineage, writes it as Parquet below
the folder named by ``spark.checkpoint.dir``. Such a table survives the loss of any executor, and a later plan knows
its size, so that the planner's own size check decides whether a join may broadcast it. The shuffle files of the job that
wrote a table go with that job, and an operator frees a table after its last reader, so that disk holds what is still needed.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of what is executed to write a table: shuffle files go at its end, and batches for Python are small, also where rows hold long texts or sets.
RUN = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode, where none is set, a temporary folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="webskein-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    _written.append((spark, base))
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/webskein/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """What is executed within gives its shuffle files back at its end and uses bounded batches; for plans that run once."""
    before = {k: spark.conf.get(k, None) for k in RUN}
    for k, v in RUN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with run_once(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def stage_by(df: DataFrame, column: str, values: Iterable, name: str) -> list[DataFrame]:
    """stage() of rows of several kinds at once: a scan for each value of ``column``, which can be freed by itself."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with run_once(spark):
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    schema, out = T.StructType([f for f in df.schema.fields if f.name != column]), []
    for v in values:
        own = f"{path}/{column}={v}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        out.append(spark.read.schema(schema).parquet(own) if there else spark.createDataFrame([], schema))
        if there:
            _path_of[out[-1]] = own
    return out


def free(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; other DataFrames are left alone."""
    for t in tables:
        if path := _path_of.pop(t, None):
            delete(t.sparkSession, path)


_shared: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """A staged table that all plans of a session use: made once for its key, which names what it was made of."""
    key = (spark.sparkContext.applicationId, name, *key)
    if key not in _shared:
        _shared[key] = stage(make(), name)
    return _shared[key]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_written):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass

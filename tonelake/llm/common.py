"""What the operators of this subpackage share: reading, cutting lineage, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tonelake.shipping import ship

#: Rows of one Arrow batch that a Python worker holds; texts are long, so the default of 10,000 is too many.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; the rest, whatever it is called, is never read."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[df[c] for c in columns]) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Readies a session for operators in Python: small Arrow batches, and this package on the workers."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a single machine a temporary one is set where the
    session names none; a cluster must name it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = context._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tonelake-"))
    return jsc.getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept on the executors' disks for the jobs to come. Its lineage stays, so
    what a lost executor held is computed again. The shuffle files behind it are let go."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


_paths: dict[int, str] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage, survives lost
    executors, and goes when the driver's JVM ends. The shuffle files behind it are let go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonelake-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    spark.sparkContext._jvm.System.gc()
    return out


def forget(table: DataFrame) -> None:
    """Delete a table from ``written`` that no later job reads."""
    fs, path = _filesystem(table.sparkSession, _paths.pop(id(table)))
    fs.delete(path, True)


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items whose sizes sum to ``most`` at most, or single items beyond it."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)

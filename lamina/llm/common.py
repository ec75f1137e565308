"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import checkpoint_folder


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/lamina-{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove_tree(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass

    atexit.register(clean)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: whoever reads the result later does not recompute ``df``,
    and a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes of them, that a task works on at once, one row at least.
SLIM_ROWS, SLIM_BYTES = 1024, 4 << 20


def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of few bytes, so that what is made of them is small too.

    At the end a task's unused memory goes back to the system: a worker outlives its task
    and would hold on to it while others run beside it.
    """
    try:
        for batch in batches:
            step = max(1, min(SLIM_ROWS, SLIM_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
            del batch  # before the next one is read
    finally:
        pa.default_memory_pool().release_unused()


def whole_text(col: str = "text") -> Column:
    """The text as a string, a null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))

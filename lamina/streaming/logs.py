"""Training logs as streams: JSON lines, appended to while a run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "epoch bigint, step bigint, loss double, mask_ratio double, lr double, elapsed_sec double"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, stream: bool = True) -> DataFrame:
    """Rows of all log files in a folder; as a stream, also of those to come."""
    reader = spark.readStream.option("maxFilesPerTrigger", 64) if stream else spark.read
    return reader.schema(schema).json(folder)


def running_means(log: DataFrame, metrics: tuple[str, ...] = ("loss", "mask_ratio"), by: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Mean of each metric so far, for each epoch; its state is one row an epoch."""
    return log.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"))


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows as JSON lines, keys in order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(folder)

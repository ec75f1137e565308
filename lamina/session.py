"""Session settings, and storage that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local master gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir") or (given.get() if given.isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamina-checkpoint-")
    if not given.isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and forget how it was made.

    One job, unlike an eager checkpoint, and compressed; survives lost executors.
    The table goes when it is released, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/lamina-cut-{uuid.uuid4().hex}"
    _TABLES[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("_lamina_path", None)
        if path is not None:
            _remove(_TABLES.pop(path), path)


#: Tables that still lie in the shared folder, each with its session.
_TABLES: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    while _TABLES:
        path, spark = _TABLES.popitem()
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass

"""Lists of files: what a store holds, and what of it is wanted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.ranking import ranks

#: Endings of chunked-array files.
ENDINGS = (".h5", ".hdf", ".hdf5")


def list_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of a folder tree's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def select_files(files: DataFrame, ends: str | None = None, starts: list[str] | None = None) -> DataFrame:
    """Paths with an ending and one of some beginnings."""
    if ends:
        files = files.where(F.endswith("path", F.lit(ends)))
    if starts:
        hit = F.lit(False)
        for s in starts:
            hit = hit | F.startswith("path", F.lit(s))
        files = files.where(hit)
    return files


def new_files(now: DataFrame, earlier: DataFrame) -> DataFrame:
    """Files that were not there before."""
    return now.join(earlier.select("path").distinct(), "path", "left_anti")


def pair_by_order(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """(raw, label): the n-th path of each list, lists of equal length.

    Places are counted by ranges and the lists joined on them.
    """
    counts = raw.count(), labels.count()
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} volumes and {counts[1]} labels")
    sides = [ranks(df.select(F.col("path").alias(name), F.lit(0).alias("__all")), ("__all",), (name,), "__n").drop("__all") for name, df in (("raw", raw), ("label", labels))]
    return sides[0].join(sides[1], "__n").select("raw", "label")


def volumes_in(spark: SparkSession, folder: str, first: str | None = None, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(path, size) of the volumes to be read from a folder.

    Files of the folder itself whose names match the pattern ``first``, or if there are none,
    files of its whole tree with one of the ``endings``, in either case.  Without any,
    an error.
    """
    files = list_folder(spark, folder).select("path", "size")
    name = F.substring_index("path", "/", -1)
    ending = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    if first is not None:
        depth = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/"))
        root = len([p for p in folder.split(":", 1)[-1].split("/") if p])
        named = files.where((depth == root + 1) & name.rlike("^" + _as_regex(first) + "$"))
        if not named.isEmpty():
            return named
    found = files.where(F.instr(name, ".") > 0).where(ending.isin(*endings))
    if found.isEmpty():
        raise FileNotFoundError(f"no volumes under {folder}")
    return found


def expand_paths(spark: SparkSession, paths: list[str], endings: tuple[str, ...] = ENDINGS) -> list[str]:
    """Paths as given, but a folder that holds volume files is replaced by them, in order.

    A folder without any stays one item, an image stack.
    """
    out = []
    for path in paths:
        inside = []
        if not path.lower().endswith(endings):
            try:
                inside = [r["path"] for r in volumes_in(spark, path, None, endings).orderBy("path").toLocalIterator()]
            except FileNotFoundError:
                pass
        out += inside or [path]
    return out


def _as_regex(pattern: str) -> str:
    """A pattern of file names with * and ? as a regular expression."""
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)


def write_manifest(files: DataFrame, folder: str) -> None:
    """One JSON object a file, in order of paths."""
    files.orderBy("path").write.mode("overwrite").json(folder)


def prefix_counts(names: DataFrame, name: str = "name", mark: str = ".") -> DataFrame:
    """(prefix, n): names by what stands before the first ``mark``."""
    return names.groupBy(F.substring_index(name, mark, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))

"""Result tables that keep their versions: written once, named by a manifest, read again as they were.

Each write goes to a new folder below the table's; only then a line of the
manifest names it. A write that fails leaves a folder that nothing names, and
what others read meanwhile stays as it is. So a table may be made anew from
itself.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, folder string, rows long, note string, written timestamp"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: a row for each version, of those that writers have given the same number only the one that counts."""
    try:
        lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], MANIFEST)
    first = lines.groupBy("version").agg(F.min_by(F.struct("folder", "rows", "note", "written"), F.struct("written", "folder")).alias("x"))
    return first.select("version", "x.*")


def write_version(df: DataFrame, path: str, note: str = "") -> int:
    """Add a version of the table at ``path``, which ``df`` may itself be read from; the version's number, from 1."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    version = (history(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    line = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(rows).cast("long").alias("rows"), F.lit(note).alias("note"), F.current_timestamp().alias("written"))
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None, schema=None) -> DataFrame:
    """A version of the table at ``path``, the last one where none is given."""
    known = history(spark, path)
    found = (known.where(F.col("version") == version) if version else known.orderBy(F.desc("version"))).first()
    if found is None:
        raise ValueError(f"{path} has no version {version or ''}".rstrip())
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{found['folder']}")

"""Places that the driver and all executors share, and tables written there."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that setting is absent, as in tests on one machine, a temporary
    folder is set as the session's checkpoint folder first.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-siftlode-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` below ``folder`` and read it back: a plan without lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, table: str, path: str) -> DataFrame:
    """Like :func:`stored`, but dealt by ``key`` into as many buckets as a shuffle
    has partitions, so that joins on ``key`` read the rows where they lie. The
    catalog names it ``table``, until :func:`unlisted`."""
    spark = df.sparkSession
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts(spark), key).saveAsTable(table)
    return spark.table(table)


def unlisted(spark: SparkSession, table: str, path: str) -> None:
    """Delete a table of :func:`bucketed` that no later step reads."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    dropped(spark, path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now: it does so when the driver collects its garbage, which a driver with memory to spare seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes that a table may take to be broadcast.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (numbers, texts, bytes, arrays of texts), to be broadcast if all its rows take ``most`` bytes at most, else as it is."""

    def taken(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.octet_length(name)
        if kind.startswith("array"):
            return F.octet_length(F.array_join(name, "")) + 24 * F.size(name)
        return F.lit(0)

    size = sum((F.coalesce(taken(c, kind), F.lit(0)) for c, kind in df.dtypes), F.lit(24 + 16 * len(df.columns)))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if most is None else most) else df


def parts(spark: SparkSession, least: int = 1) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def groups(docs: DataFrame, text: str = "text", size: int = 20_000_000) -> int:
    """Into how many groups documents are dealt, so that one has about ``size`` bytes of text at most; at least the partitions of a shuffle."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0
    return parts(docs.sparkSession, -(-total // size))


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package; on a
    cluster it is shipped with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in [root, *paths] if x)


def filesystem(uri: str):
    """Arrow's file system and path for a URI, made in driver or task alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)

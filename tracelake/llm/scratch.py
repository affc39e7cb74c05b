"""Intermediate tables in the folder that every executor and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """``df``; its session then sends texts to Python in batches of at most ``BATCH_ROWS`` rows.

    Whole texts may be long, so batches of the default 10,000 rows would take much memory twice over
    (in the JVM and in Python). A smaller setting of the session is kept.
    """
    conf = df.sparkSession.conf
    if int(conf.get(BATCH, "10000")) > BATCH_ROWS or int(conf.get(BATCH, "10000")) <= 0:
        conf.set(BATCH, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if folder.startswith("/"):  # Spark takes it in its default file system
        default = spark.conf.get("spark.hadoop.fs.defaultFS", None) or ("file://" if spark.sparkContext.master.split("[")[0] == "local" else "")
        if not default and hasattr(spark.sparkContext, "_jsc"):  # what Hadoop's own files say; the folder is shared, so this may be a mounted disk
            default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or ""
        folder = f"file://{folder}" if default.startswith("file:") else default.rstrip("/") + folder
    return folder.rstrip("/")


#: Schemes of Hadoop whose stores pyarrow knows by another name, and those that both call alike.
RENAMED = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "webhdfs": "hdfs"}
SHARED_NAMES = ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")


def store_address(uri: str) -> str:
    """``uri`` as pyarrow spells it. Addresses without a scheme, and schemes that pyarrow lacks, are refused: workers would read and write their own disks, or nothing."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri}: files outside tables need an address with a scheme (file:, hdfs:, s3a:, ...); give spark.checkpoint.dir one")
    scheme = RENAMED.get(scheme, scheme)
    if scheme not in SHARED_NAMES:
        raise ValueError(f"{uri}: pyarrow has no file system for {scheme}:; set spark.checkpoint.dir to one of {', '.join(SHARED_NAMES)}, s3a")
    return f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def store_of(uri: str):
    """(pyarrow file system, path in it) of an address with a scheme."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(store_address(uri))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, so that later uses don't compute it again.

    The table lives in shared storage: a lost executor costs no more than the tasks it ran. The
    folder may be cleared when the application has ended.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, n: int = 1) -> list[str]:
    """``n`` column names that ``df`` doesn't have (names are compared without case)."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_c{k}" not in taken:
            out.append(f"_c{k}")
        k += 1
    return out


def join_frequent(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with a table of distinct, non-null keys that says how many rows each key has.

    Keys of at least 1 / ``most`` of all rows (so at most ``most`` of them) are broadcast; only the rows of
    rarer keys are shuffled, so no task gets a large share of the rows.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * most >= total
    heavy, light = F.broadcast(table.where(often).drop(count)), table.where(~often).drop(count)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))

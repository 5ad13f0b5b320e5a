"""Session set-up and the few physical helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST_BYTES = 64 << 20


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "folioflow", **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, ANSI, AQE and Arrow."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the cluster's shared folder.

    ``spark.checkpoint.dir`` names it. Only a session on one machine (``local[...]``, as in tests) gets a temporary folder of its own where that
    setting is absent, and loses it when it ends; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="folioflow-checkpoint-"))
    if not shared:
        delete_at_end(spark, sc._jsc.sc().getCheckpointDir().get())


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path as the cluster's file systems know it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints of the session, for intermediate results; it is deleted when the session ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that several readers don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes; texts by what they hold."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16).cast("bigint"), lambda n, x: n + row_bytes(x, kind.elementType))
    if isinstance(kind, MapType):
        return row_bytes(F.map_entries(value), ArrayType(StructType().add("key", kind.keyType).add("value", kind.valueType)))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the side has at most ``max_rows`` rows and ``max_bytes`` bytes; else leave the join to AQE.

    The side is materialised before it is measured, so whatever it derives from is computed once.
    """
    side = cut(df)
    measured = side.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(side.columns)]).alias("row"))
    size = row_bytes(F.col("row"), measured.schema["row"].dataType)
    found = measured.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(side) if found.rows <= max_rows and found.bytes <= max_bytes else side


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys``, with as many partitions as the session shuffles into."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

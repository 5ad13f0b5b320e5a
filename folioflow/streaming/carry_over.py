"""Read state and fetch ledgers kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.state import FIELD_BYTES, VALIDATOR_LEDGER_SQL
from folioflow.session import shared_folder
from folioflow.streaming.state_table import StateTable


def read_state_table(spark: SparkSession, path: str) -> StateTable:
    """First mark per device and key."""
    return StateTable(spark, path, ["device", "item_key"], lambda: [F.min("read_at").alias("read_at")])


def validator_table(spark: SparkSession, path: str) -> StateTable:
    """Validators of the latest good answer per address; later ones win, whatever the order of arrival."""
    return StateTable(spark, path, ["url"], lambda: [F.max("saved").alias("saved")])


def good_answers(log: DataFrame) -> DataFrame:
    """(url, saved) of the answers that carry validators; 304 and failures change nothing."""
    field = lambda c: F.when(F.octet_length(c) <= FIELD_BYTES, F.nullif(F.col(c), F.lit("")))
    rows = log.select("url", "fetched_at", "fetch_id", "status", field("etag").alias("etag"), field("last_modified").alias("last_modified"))
    kept = rows.filter((F.col("status") == 200) & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()))
    return kept.select("url", F.struct("fetched_at", "fetch_id", "etag", "last_modified").alias("saved"))


def follow(stream: DataFrame, table: StateTable, checkpoint: str) -> None:
    """Everything the stream has now, merged batch by batch; a batch that is repeated after a failure does no harm."""
    query = stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _stream(spark: SparkSession, sf_dir: str, name: str, files: int) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def carry_over_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read state after all marks were streamed in."""
    folder = shared_folder(spark, "read-state")
    table = read_state_table(spark, f"{folder}/table")
    follow(_stream(spark, sf_dir, "read_state", 4).select("device", "item_key", "read_at"), table, f"{folder}/log")
    return table.read().drop("bucket")


CARRY_OVER_SQL = "select device, item_key, min(read_at) as read_at from read_state group by 1, 2"


def validator_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator ledger after all response heads were streamed in."""
    folder = shared_folder(spark, "validators")
    table = validator_table(spark, f"{folder}/table")
    follow(good_answers(_stream(spark, sf_dir, "http_heads", 4)), table, f"{folder}/log")
    return table.read().select("url", "saved.etag", "saved.last_modified", "saved.fetched_at")


def fresh_stream(items: DataFrame, days: int = 3) -> DataFrame:
    """The age filter on a stream: a dated story later than the watermark is out, an undated one always stays.

    ``items`` has item_key and published. Dated rows repeat at most once within the watermark.
    """
    dated = items.filter("published is not null").withColumn("at", F.col("published").cast("timestamp")).withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(["item_key"]).drop("at")
    return dated.unionByName(items.filter("published is null"))


QUERIES = {"carry_over_stream": (carry_over_stream, CARRY_OVER_SQL), "validator_stream": (validator_stream, VALIDATOR_LEDGER_SQL)}

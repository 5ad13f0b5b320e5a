"""Copies of a record that differ in formatting only, counted in an incremental ledger.

The ledger holds one row per canonical key: how many copies came so far, the smallest id and the earliest copy. A new
batch is aggregated by key first (combined before its shuffle, so a story with any number of copies costs one row per
task) and then full-outer-joined with the ledger's matching buckets. On disk the ledger is bucketed by key; a batch reads and
writes only the buckets in which it has keys, beside the ones they replace, and counts once its commit is written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import cut, file_system, shared_folder

LEDGER = "slot int, key binary, copies bigint, smallest_id bigint, earliest struct<at: timestamp_ntz, id: bigint>"
BUCKETS, SPLITS = 64, 4


def canonical(text: Column) -> Column:
    """The text without white space and punctuation, in one letter case; null stays null."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[\s\p{Z}\p{P}\u0085]+", "")


def canonical_title(title: Column) -> Column:
    """Canonical parts between ``|`` in one order; empty parts don't count."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(title, r"\|"), canonical), lambda p: p != "")), "|")


def canonical_link(link: Column) -> Column:
    """Canonical address, and canonical query parameters in one order."""
    query = F.regexp_extract(link, r"(?s)\?(.*)$", 1)
    params = F.array_join(F.array_sort(F.filter(F.transform(F.split(query, "[&;]"), canonical), lambda p: p != "")), "&")
    return F.concat(canonical(F.regexp_replace(link, r"(?s)\?.*$", "")), F.lit("?"), params)


def record_key(guid: Column, link: Column, title: Column) -> Column:
    """16 bytes that agree when all three agree; null and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (canonical(guid), canonical_link(link), canonical_title(title))]
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def keyed(items: DataFrame, slots: int = BUCKETS * SPLITS) -> DataFrame:
    """(slot, key, item_id, at) of items; a slot is a share of the keys that one task writes."""
    rows = items.select(record_key(F.col("guid"), F.col("link"), F.col("title")).alias("key"), "item_id", F.col("fetched_at").cast("timestamp_ntz").alias("at"))
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"), "key", "item_id", "at")


def batch_counts(rows: DataFrame) -> DataFrame:
    """A batch of keyed rows as a ledger of its own; a null time sorts behind every known one."""
    return rows.groupBy("slot", "key").agg(
        F.count("*").alias("copies"),
        F.min("item_id").alias("smallest_id"),
        F.min(F.struct(F.coalesce("at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("at"), F.col("item_id").alias("id"))).alias("earliest"),
    )


def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch of counts: counts add up, the smallest id and the earliest copy stay."""
    a, b = ledger.alias("a"), batch.alias("b")
    joined = a.join(b, ["slot", "key"], "full_outer")
    return joined.select(
        "slot",
        "key",
        (F.coalesce(F.col("a.copies"), F.lit(0)) + F.coalesce(F.col("b.copies"), F.lit(0))).alias("copies"),
        F.least("a.smallest_id", "b.smallest_id").alias("smallest_id"),
        F.least("a.earliest", "b.earliest").alias("earliest"),
    )


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Ledger:
    """A ledger on disk that counts every batch once.

    Each batch has an id. What it changes is written to a folder of its own, one Parquet partition per bucket, and becomes part of the ledger when
    a commit is renamed into place: a file with the ids of all batches counted so far and, per bucket, the folder that holds it now. A batch that was
    committed before is passed over; one that died on the way, between any two buckets, has left the ledger as it was and is
    written again in full. A commit that another writer made meanwhile is an error, and the batch can be added again. Replaced
    buckets stay until ``vacuum``, so readers of an older commit aren't disturbed.

    ``splits`` tasks share a bucket, and both sides of the join are shuffled once, by that share.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, splits: int = SPLITS):
        self.spark, self.path, self.buckets, self.splits = spark, path, buckets, splits

    def _commits(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []

    def state(self) -> tuple[int, list[str], dict[int, str]]:
        """(number, batch ids, folder by bucket) of the newest commit."""
        commits = self._commits()
        if not commits:
            return 0, [], {}
        told = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/commits/{commits[-1]}", wholetext=True).collect()))
        return commits[-1], told["batches"], {int(k): v for k, v in told["buckets"].items()}

    def _commit(self, number: int, batches: list[str], folders: dict[int, str]) -> None:
        fs, at = file_system(self.spark, f"{self.path}/commits/{number}")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"batches": batches, "buckets": folders}).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError(f"commit {number} of {self.path} was made by another writer")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={k}" for k, folder in sorted(folders.items())]  # at most ``buckets``
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def read(self) -> DataFrame:
        return self._rows(self.state()[2])

    def add(self, items: DataFrame, batch_id: str) -> bool:
        """Count a batch in; false if it was counted before. Only buckets with keys of the batch are read and written; an empty batch changes no bucket."""
        number, done, folders = self.state()
        if batch_id in done:
            return False
        slots = self.buckets * self.splits
        bucket = F.pmod(F.col("slot"), F.lit(self.buckets)).alias("bucket")
        batch = cut(batch_counts(keyed(items, slots)))
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            folder = f"{number + 1}-{re.sub('[^A-Za-z0-9]+', '-', batch_id)}-{uuid.uuid4().hex[:8]}"
            tasks = min(slots, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), len(touched)))
            kept = self._rows({k: v for k, v in folders.items() if k in set(touched)})
            # both sides come by slot, which is part of the join's key, so the join and the write need no other shuffle
            with _setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
                merged = merge(kept.repartition(tasks, "slot"), batch.repartition(tasks, "slot")).withColumn("bucket", bucket)
                merged.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            folders = folders | dict.fromkeys(touched, folder)
        self._commit(number + 1, [*done, batch_id], folders)
        return True

    def vacuum(self) -> None:
        """Delete the buckets that the newest commit doesn't name, what dead batches left, and older commits."""
        number, _, folders = self.state()
        fs, data = file_system(self.spark, f"{self.path}/data")
        held = {f"{v}/bucket={k}" for k, v in folders.items()}
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            for bucket in fs.listStatus(folder.getPath()):
                if f"{folder.getPath().getName()}/{bucket.getPath().getName()}" not in held:
                    fs.delete(bucket.getPath(), True)
        for old in self._commits():
            if old < number:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{old}"), False)


def ledger_of(items: DataFrame, batches: list[Column], path: str | None = None) -> Ledger:
    """A ledger on disk to which the rows of each condition were added as a batch, in this order."""
    spark = items.sparkSession
    ledger = Ledger(spark, path or shared_folder(spark, "ledger"))
    for k, condition in enumerate(batches):
        ledger.add(items.filter(condition), f"batch-{k}")
    return ledger


def copies(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """(item_id_a, item_id_b): each copy besides the one with the smallest id, with that one.

    The ledger's keys with several copies are joined back to the rows; a key with very many rows is split by the
    skew join, as the ledger side has one row per key. Rows with the same id and key count as copies but give no pair.
    """
    several = ledger.filter("copies > 1").select("key", "smallest_id")
    return keyed(items).select("key", "item_id").join(several, "key").filter("item_id <> smallest_id").select(F.col("smallest_id").alias("item_id_a"), F.col("item_id").alias("item_id_b")).distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/items.parquet").select("item_id", "guid", "link", "title", "fetched_at")


def _two_batches(items: DataFrame) -> list[Column]:
    """Everything up to a month before the newest fetch as the kept ledger, the rest as the new batch."""
    last = items.agg(F.max("fetched_at").cast("timestamp_ntz").alias("t")).first().t
    if last is None:
        return [F.lit(True)]
    new = F.coalesce(F.col("fetched_at").cast("timestamp_ntz") > F.lit(last) - F.expr("interval 30 days"), F.lit(False))
    return [~new, new]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return copies(items, ledger_of(items, _two_batches(items)).read())


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each story once: the smallest id, the earliest delivery and the number of copies."""
    items = _items(spark, sf_dir)
    return ledger_of(items, _two_batches(items)).read().select("smallest_id", F.col("earliest.id").alias("earliest_id"), "copies")


_KEYED = r"""
    select item_id, fetched_at, regexp_replace(replace(lower(upper(guid)), 'ß', 'ss'), '[\s\x0b\x85\p{Z}\p{P}]+', '', 'g') as g,
      array_to_string(list_sort(list_filter(list_transform(string_split(replace(lower(upper(title)), 'ß', 'ss'), '|'),
        lambda p: regexp_replace(p, '[\s\x0b\x85\p{Z}\p{P}]+', '', 'g')), lambda p: p <> '')), '|') as t,
      regexp_replace(lower(regexp_replace(link, '(?s)\?.*$', '')), '[\s\x0b\x85\p{Z}\p{P}]+', '', 'g') || '?' ||
      array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(regexp_extract(link, '(?s)\?(.*)$', 1)), '[&;]'),
        lambda p: regexp_replace(p, '[\s\x0b\x85\p{Z}\p{P}]+', '', 'g')), lambda p: p <> '')), '&') as l
    from items"""

P2_FOUND_SQL = f"""
with k as ({_KEYED}), m as (select *, min(item_id) over (partition by g, t, l) as a from k)
select distinct a as item_id_a, item_id as item_id_b from m where item_id <> a"""

P2_LEDGER_SQL = f"""
with k as ({_KEYED})
select min(item_id) as smallest_id, arg_min(item_id, (fetched_at, item_id)) as earliest_id, count(*) as copies from k group by g, t, l"""

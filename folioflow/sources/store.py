"""The edition store: stories and their pages as Parquet, one partition per edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import selection
from folioflow.operators.layout import paginated
from folioflow.session import cut, shared_folder, table


def write_edition(stories: DataFrame, path: str, edition_date: str) -> bool:
    """Write an edition's stories (with ``pages``) and replace that edition only; nothing is touched when there are no stories.

    The index (stories without pages) and the pages are two tables, so the index is read without any page.
    """
    ready = cut(stories)
    if ready.isEmpty():
        return False
    dated = ready.withColumn("edition_date", F.lit(edition_date))
    options = {"partitionOverwriteMode": "dynamic"}
    dated.drop("pages").repartition(1).write.mode("overwrite").options(**options).partitionBy("edition_date").parquet(f"{path}/stories")  # an edition has a bounded number of stories
    pages = dated.select("edition_date", "composed_pos", F.explode("pages").alias("p")).select("edition_date", "composed_pos", "p.page", "p.lines")
    pages.repartitionByRange("composed_pos").sortWithinPartitions("composed_pos", "page").write.mode("overwrite").options(**options).partitionBy("edition_date").parquet(f"{path}/pages")
    return True


def read_index(spark: SparkSession, path: str, edition_date: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stories").filter(F.col("edition_date") == edition_date)


def story_pages(spark: SparkSession, path: str, edition_date: str, composed_pos: int) -> DataFrame:
    """Pages of one story: the edition's partition, and of it the row groups that hold the story."""
    return spark.read.parquet(f"{path}/pages").filter((F.col("edition_date") == edition_date) & (F.col("composed_pos") == composed_pos))


def orphans(spark: SparkSession, path: str, edition_date: str) -> DataFrame:
    """Stories of the index whose number of pages in the store differs from what the index says."""
    held = spark.read.parquet(f"{path}/pages").filter(F.col("edition_date") == edition_date).groupBy("composed_pos").agg(F.count("*").alias("held"))
    return read_index(spark, path, edition_date).join(held, "composed_pos", "left").filter(F.coalesce("held", F.lit(0)) != F.col("page_count")).select("composed_pos", "page_count", "held")


def numbered(stories: DataFrame, first: Column | None = None) -> DataFrame:
    """``page_count`` and the running ``first_page`` of an edition's stories."""
    counted = stories.withColumn("page_count", F.size("pages"))
    before = Window.orderBy("composed_pos").rowsBetween(Window.unboundedPreceding, -1)  # the stories of one edition
    return counted.withColumn("first_page", (F.coalesce(F.sum("page_count").over(before), F.lit(0)) + (F.lit(0) if first is None else first)).cast("int"))


def edition_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition composed, laid out, stored and read back: its index with the lines that its pages hold."""
    picked = selection.edition(spark, sf_dir).select("composed_pos", "item_id")
    bodies = table(spark, sf_dir, "items").select("item_id", "title", "author", "section", "blocks", "truncation")
    stories = numbered(paginated(picked.join(bodies, "item_id"), F.col("author")).drop("blocks"))
    path = shared_folder(spark, "edition")
    write_edition(stories, path, "2026-10-01")
    lines = spark.read.parquet(f"{path}/pages").groupBy("composed_pos").agg(F.sum(F.size("lines")).alias("lines"))
    return read_index(spark, path, "2026-10-01").join(lines, "composed_pos", "left").select("composed_pos", "item_id", "section", "page_count", "first_page", "lines")


QUERIES = {"edition_store": (edition_store, None)}

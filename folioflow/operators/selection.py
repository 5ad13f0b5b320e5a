"""From all items to the stories of an edition: keys, dedup, staleness, order, budgets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import bounded_broadcast, cut, table

DAY = 86_400


def item_key(guid: Column, link: Column, title: Column, published: Column) -> Column:
    """The natural key of a story: guid, else link, else title and publication time; absent and empty are the same."""
    seconds = F.coalesce(F.unix_seconds(published.cast("timestamp")).cast("string"), F.lit(""))
    return F.when(guid != "", F.concat(F.lit("g:"), guid)).when(link != "", F.concat(F.lit("l:"), link)).otherwise(F.concat(F.lit("t:"), F.coalesce(title, F.lit("")), F.lit("|"), seconds))


def newest(items: DataFrame) -> Column:
    """The newest publication time of all items, as a scalar; null when none is dated."""
    return items.agg(F.max("published").alias("now")).scalar()


def fresh(items: DataFrame, now: Column, max_age_days: int) -> DataFrame:
    """Items not older than ``max_age_days``: undated ones stay, one exactly at the limit stays, without ``now`` all stay."""
    return items.filter(~is_stale(now, max_age_days))


def is_stale(now: Column, max_age_days: int) -> Column:
    return F.coalesce(F.col("published") < now - F.make_dt_interval(F.lit(max_age_days)), F.lit(False))


def unread(items: DataFrame, read_state: DataFrame) -> DataFrame:
    """Items whose key is in no row of ``read_state``; duplicates among the items stay (policy ``read``)."""
    return items.join(read_state.select("item_key").distinct(), "item_key", "left_anti")


def first_printed(items: DataFrame, *order: Column) -> DataFrame:
    """The first item of each key in the given order (policy ``printed``).

    Kept by an aggregation that is combined before its shuffle, so a key with any number of rows is one row per task.
    """
    by = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    return items.groupBy(F.col("item_key").alias("_key")).agg(F.min_by(F.struct(*items.columns), by).alias("_first")).select("_first.*")


def section_order(feeds: DataFrame) -> DataFrame:
    """(section, section_pos): sections by their first feed, from 1."""
    first = feeds.groupBy("section").agg(F.min("feed_pos").alias("_first"))
    return first.select("section", F.row_number().over(Window.orderBy("_first", "section")).alias("section_pos"))  # a row per section


def newest_first(*ties: str) -> list[Column]:
    return [F.col("published").desc_nulls_last(), *[F.col(c) for c in ties]]


def fair_budget(items: DataFrame, max_items: int, floor: int, *ties: str) -> DataFrame:
    """At most ``max_items`` stories: ``floor`` per section in section order first, then one per section in turn.

    ``items`` has section_pos. Adds ``r``, the story's rank in its section. No section can give more than the budget, so ranks
    beyond it are cut off before the shuffle (WindowGroupLimit). A budget of 0 is no limit.
    """
    ranks = items.withColumn("r", F.row_number().over(Window.partitionBy("section_pos").orderBy(*newest_first(*ties))))
    if max_items == 0:
        return ranks
    late = F.col("r") > floor
    in_turn = (F.when(late, 1).otherwise(0), F.when(late, F.col("r")).otherwise(F.col("section_pos")), F.when(late, F.col("section_pos")).otherwise(F.col("r")))
    return ranks.filter(F.col("r") <= max_items).orderBy(*in_turn).limit(max_items)


def page_budget(stories: DataFrame, max_pages: int, *order: str) -> DataFrame:
    """Stories in order as long as the pages before a story are fewer than ``max_pages``; adds ``first_page``.

    A story has at least one page, so only the first ``max_pages`` stories can be in: that many rows are kept before the running sum.
    """
    head = stories.orderBy(*order).limit(max_pages)
    before = F.coalesce(F.sum("page_count").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("first_page", before.cast("bigint")).filter(F.col("first_page") < max_pages)


def reading_order(stories: DataFrame) -> DataFrame:
    """Oldest first; an undated story stands with the last dated one before it in its section. ``stories`` has composed_pos, section."""
    before = Window.partitionBy("section").orderBy("composed_pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = stories.withColumn("effective", F.coalesce("published", F.last("published", ignorenulls=True).over(before)))
    return dated.withColumn("reading_pos", F.row_number().over(Window.orderBy(F.col("effective").asc_nulls_last(), "composed_pos")))


def home_summary(stories: DataFrame) -> DataFrame:
    """(section, unread, first_pos) of unread stories, sections by first appearance, with the total beside each."""
    per = stories.groupBy("section").agg(F.count("*").alias("unread"), F.min("composed_pos").alias("first_pos"))
    return per.withColumn("total", F.sum("unread").over(Window.partitionBy()))  # a row per section


# ---------------------------------------------------------------- queries


def _stories(spark, sf_dir: str) -> DataFrame:
    """Items with the section and its place from the feeds, read ones left out."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", "section")
    sections = bounded_broadcast(section_order(feeds))
    items = table(spark, sf_dir, "items").select("item_id", "feed_pos", "item_pos", "item_key", "published", "section")
    return unread(items, table(spark, sf_dir, "read_state")).join(sections, "section")


def edition(spark, sf_dir: str, max_age_days: int = 3, max_items: int = 40, floor: int = 2) -> DataFrame:
    now = newest(table(spark, sf_dir, "items"))
    picked = fair_budget(fresh(_stories(spark, sf_dir), now, max_age_days), max_items, floor, "feed_pos", "item_pos", "item_id")
    composed = Window.orderBy("section_pos", "r")  # at most ``max_items`` rows
    return picked.withColumn("composed_pos", F.row_number().over(composed))


def edition_select(spark, sf_dir: str) -> DataFrame:
    return edition(spark, sf_dir).select("composed_pos", "section", "section_pos", "r", "item_id", "published")


_EDITION_SQL = """
    s as (select section, row_number() over (order by min(feed_pos), section) as section_pos from feeds group by section),
    n as (select max(published) as now from items),
    u as (select i.* from items i where not exists (select 1 from read_state r where r.item_key = i.item_key)),
    k as (select u.item_id, u.section, u.published, u.item_key, s.section_pos,
            row_number() over (partition by s.section_pos order by published desc nulls last, feed_pos, item_pos, item_id) as r
          from u join s using (section), n where published is null or published >= now - interval 3 day),
    p as (select * from k order by (r > 2)::int, case when r > 2 then r else section_pos end, case when r > 2 then section_pos else r end limit 40),
    e as (select *, row_number() over (order by section_pos, r) as composed_pos from p)"""
EDITION_SELECT_SQL = f"with {_EDITION_SQL} select composed_pos, section, section_pos, r, item_id, published from e"


def stale_filter_stats(spark, sf_dir: str) -> DataFrame:
    """What the age filter does per section, in one pass."""
    items = table(spark, sf_dir, "items")
    stale = is_stale(newest(items), 30)
    return items.groupBy("section").agg(F.count("*").alias("items_in"), F.count_if(F.col("published").isNull()).alias("undated"), F.count_if(stale).alias("dropped_stale"), F.count_if(~stale).alias("kept"))


STALE_FILTER_STATS_SQL = """
with n as (select max(published) as now from items), x as (select section, published, coalesce(published < now - interval 30 day, false) as stale from items, n)
select section, count(*) as items_in, count(*) filter (where published is null) as undated, count(*) filter (where stale) as dropped_stale,
  count(*) filter (where not stale) as kept from x group by section"""


def newest_first_rank(spark, sf_dir: str) -> DataFrame:
    """Rank of every order within its priority, newest first, with midnight ties; no priority is sorted in one task."""
    from folioflow.operators.ordering import ranked

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"), F.col("o_orderdate").alias("published"), F.col("o_custkey").alias("source"))
    return ranked(orders, "section", F.col("published").desc_nulls_last(), F.col("source"), F.col("o_orderkey"), name="r").select("section", "r", "o_orderkey", "published")


NEWEST_FIRST_RANK_SQL = """
select o_orderpriority as section, row_number() over (partition by o_orderpriority order by o_orderdate desc nulls last, o_custkey, o_orderkey) as r,
  o_orderkey, o_orderdate as published from orders"""


def fair_budget_orders(spark, sf_dir: str) -> DataFrame:
    """The budget with many ties: 200 orders, at least 15 of each priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"), F.col("o_orderdate").alias("published"), "o_custkey")
    first = orders.groupBy("section").agg(F.min("o_orderkey").alias("feed_pos"))
    placed = orders.join(bounded_broadcast(section_order(first)), "section")
    return fair_budget(placed, 200, 15, "o_custkey", "o_orderkey").select("section_pos", "r", "section", "o_orderkey", "published")


FAIR_BUDGET_SQL = """
with s as (select o_orderpriority as section, row_number() over (order by min(o_orderkey)) as section_pos from orders group by 1),
k as (select section_pos, row_number() over (partition by section order by o_orderdate desc nulls last, o_custkey, o_orderkey) as r, section, o_orderkey,
  o_orderdate as published from orders join s on section = o_orderpriority)
select * from k order by (r > 15)::int, case when r > 15 then r else section_pos end, case when r > 15 then section_pos else r end limit 200"""


def page_budget_orders(spark, sf_dir: str) -> DataFrame:
    """Orders as stories, their line items as pages, 500 pages."""
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("page_count"))
    stories = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(pages, "o_orderkey")
    ordered = stories.withColumn("newest", -F.unix_date(F.col("o_orderdate").cast("date")))
    return page_budget(ordered, 500, "newest", "o_orderkey").select("o_orderkey", "page_count", "first_page")


PAGE_BUDGET_SQL = """
with p as (select l_orderkey as o_orderkey, count(*) as page_count from lineitem group by 1),
s as (select o_orderkey, page_count, coalesce(sum(page_count) over (order by o_orderdate::date desc, o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as first_page
  from orders join p using (o_orderkey))
select * from s where first_page < 500"""


def unread_home_summary(spark, sf_dir: str) -> DataFrame:
    """Unread stories per section over all items, with the section's first one."""
    return home_summary(_stories(spark, sf_dir).withColumn("composed_pos", F.struct("section_pos", "feed_pos", "item_pos", "item_id"))).select("section", "unread", F.col("first_pos.item_id").alias("first_item"), "total")


UNREAD_HOME_SUMMARY_SQL = """
with u as (select i.* from items i where exists (select 1 from feeds f where f.section = i.section) and not exists (select 1 from read_state r where r.item_key = i.item_key))
select section, count(*) as unread, arg_min(item_id, (feed_pos, item_pos, item_id)) as first_item, (sum(count(*)) over ())::bigint as total from u group by section"""


def reading_order_edition(spark, sf_dir: str) -> DataFrame:
    return reading_order(edition(spark, sf_dir)).select("reading_pos", "composed_pos", "item_id", "effective")


READING_ORDER_SQL = f"""
with {_EDITION_SQL}, d as (select *, coalesce(published, last_value(published ignore nulls) over (partition by section order by composed_pos rows between unbounded preceding and current row)) as effective from e)
select row_number() over (order by effective asc nulls last, composed_pos) as reading_pos, composed_pos, item_id, effective from d"""


def next_unread(spark, sf_dir: str) -> DataFrame:
    """For every device the first story of a larger edition, in its order, that the device has not read."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", "section")
    items = table(spark, sf_dir, "items").select("item_id", "feed_pos", "item_pos", "item_key", "published", "section").join(bounded_broadcast(section_order(feeds)), "section")
    stories = fair_budget(items, 200, 2, "feed_pos", "item_pos", "item_id").withColumn("pos", F.row_number().over(Window.orderBy("section_pos", "r")))
    stories = cut(stories.select("pos", "item_id", "item_key"))  # an edition has 200 stories
    state = table(spark, sf_dir, "read_state").select("device", "item_key")
    read = state.join(F.broadcast(stories.select("pos", "item_key")), "item_key", "left").groupBy("device").agg(F.collect_set("pos").alias("read"))  # at most 200 places
    first = read.select("device", F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(max(stories.count(), 1))), "read")).alias("pos"))
    return first.join(F.broadcast(stories.select("pos", "item_id")), "pos").select("device", "pos", "item_id")


NEXT_UNREAD_SQL = """
with s as (select section, row_number() over (order by min(feed_pos), section) as section_pos from feeds group by section),
k as (select item_id, item_key, section_pos, row_number() over (partition by section_pos order by published desc nulls last, feed_pos, item_pos, item_id) as r from items join s using (section)),
p as (select * from k order by (r > 2)::int, case when r > 2 then r else section_pos end, case when r > 2 then section_pos else r end limit 200),
e as (select *, row_number() over (order by section_pos, r) as pos from p),
d as (select distinct device from read_state)
select device, min(pos) as pos, arg_min(item_id, pos) as item_id from d, e
where not exists (select 1 from read_state r where r.device = d.device and r.item_key = e.item_key) group by device"""


def printed_dedup(spark, sf_dir: str) -> DataFrame:
    """Each story's first item that was not read before."""
    items = table(spark, sf_dir, "items").select("item_id", "feed_pos", "item_pos", "item_key", "published")
    return unread(first_printed(items, F.col("feed_pos"), F.col("item_pos"), F.col("item_id")), table(spark, sf_dir, "read_state"))


PRINTED_DEDUP_SQL = """
with k as (select item_id, feed_pos, item_pos, item_key, published, row_number() over (partition by item_key order by feed_pos, item_pos, item_id) as r from items)
select item_id, feed_pos, item_pos, item_key, published from k where r = 1 and not exists (select 1 from read_state s where s.item_key = k.item_key)"""


def mark_everything_read(spark, sf_dir: str) -> DataFrame:
    """Read state of one device after everything was marked: kept times for old keys, the newest fetch for new ones."""
    items = table(spark, sf_dir, "items")
    at = items.agg(F.max("fetched_at").alias("t")).scalar()
    mine = table(spark, sf_dir, "read_state").groupBy("item_key").agg(F.min("read_at").alias("read_at"))
    new = items.select("item_key").distinct().join(mine, "item_key", "left_anti").withColumn("read_at", at)
    return mine.unionByName(new)


MARK_EVERYTHING_READ_SQL = """
with m as (select item_key, min(read_at) as read_at from read_state group by 1)
select * from m union all
select distinct item_key, (select max(fetched_at) from items) as read_at from items where item_key not in (select item_key from m)"""


def compose_stats(spark, sf_dir: str) -> DataFrame:
    """Counters of the edition: as selected, and as published under a page budget of 30."""
    items = table(spark, sf_dir, "items")
    now = newest(items)
    seen = items.join(table(spark, sf_dir, "read_state").select("item_key").distinct().withColumn("seen", F.lit(True)), "item_key", "left").select("published", "seen", "section")
    counts = seen.agg(F.count("*").alias("items_in"), F.count("seen").alias("dropped_seen"), F.count_if(F.col("seen").isNull() & is_stale(now, 3)).alias("dropped_stale"))
    pages = table(spark, sf_dir, "items").select("item_id", "truncation", F.greatest(F.lit(1), F.ceil(F.coalesce("text_bytes", F.lit(0)) / 1000)).cast("int").alias("page_count"))
    picked = edition(spark, sf_dir).select("item_id", "composed_pos").join(pages, "item_id")
    selected = picked.agg(F.count("*").alias("selected"), F.count_if(F.col("truncation") != "none").alias("selected_truncated"))
    published = page_budget(picked, 30, "composed_pos").agg(F.count("*").alias("published"), F.count_if(F.col("truncation") != "none").alias("published_truncated"), F.sum("page_count").cast("bigint").alias("pages"))
    whole = lambda one: one.select(F.struct("*")).scalar()  # noqa: E731  one row each
    return spark.range(1).select(whole(counts).alias("c"), whole(selected).alias("s"), whole(published).alias("p")).select("c.*", "s.*", "p.*")


COMPOSE_STATS_SQL = f"""
with {_EDITION_SQL},
q as (select count(*) as items_in, count(*) filter (where seen) as dropped_seen, count(*) filter (where not seen and coalesce(published < now - interval 3 day, false)) as dropped_stale
  from (select published, exists (select 1 from read_state r where r.item_key = i.item_key) as seen from items i), n),
g as (select e.composed_pos, truncation, greatest(1, ceil(coalesce(text_bytes, 0) / 1000.0))::int as page_count from e join items using (item_id)),
b as (select *, coalesce(sum(page_count) over (order by composed_pos rows between unbounded preceding and 1 preceding), 0) as first_page from g)
select q.*, (select count(*) from g) as selected, (select count(*) filter (where truncation <> 'none') from g) as selected_truncated,
  (select count(*) from b where first_page < 30) as published, (select count(*) filter (where truncation <> 'none') from b where first_page < 30) as published_truncated,
  (select sum(page_count)::bigint from b where first_page < 30) as pages from q"""

QUERIES = {
    "edition_select": (edition_select, EDITION_SELECT_SQL),
    "stale_filter_stats": (stale_filter_stats, STALE_FILTER_STATS_SQL),
    "newest_first_rank": (newest_first_rank, NEWEST_FIRST_RANK_SQL),
    "fair_budget": (fair_budget_orders, FAIR_BUDGET_SQL),
    "page_budget": (page_budget_orders, PAGE_BUDGET_SQL),
    "unread_home_summary": (unread_home_summary, UNREAD_HOME_SUMMARY_SQL),
    "reading_order": (reading_order_edition, READING_ORDER_SQL),
    "next_unread": (next_unread, NEXT_UNREAD_SQL),
    "printed_dedup": (printed_dedup, PRINTED_DEDUP_SQL),
    "mark_everything_read": (mark_everything_read, MARK_EVERYTHING_READ_SQL),
    "compose_stats": (compose_stats, COMPOSE_STATS_SQL),
}

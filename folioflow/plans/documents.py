"""Queries that send whole tables through the document readers and compare what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.content import article_run, article_run_sql
from folioflow.session import table
from folioflow.sources.feeds import feed_items, opml_feeds
from folioflow.sources.html import NO_LIMITS, html_losses, html_to_blocks


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(spark, sf_dir: str) -> DataFrame:
    """Every document as a web page with navigation, script and footer around its lines."""
    body = F.replace(escaped(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>"))
    page = F.concat(F.lit("<html><head><title>x</title><script>if (a < b) {}</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><p>"), body, F.lit("</p></article><footer>&copy; 2026</footer></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("page"))


def html_blocks(spark, sf_dir: str) -> DataFrame:
    """All blocks of every page, whole: the navigation's list item, the lines, and the footer."""
    blocks = _pages(spark, sf_dir).select("doc_id", F.explode(html_to_blocks(F.col("page"), NO_LIMITS)).alias("b"))
    return blocks.select("doc_id", "b.pos", "b.type", "b.level", "b.text")


_PAGE_LINES = r"""
    l as (select doc_id, ['Home'] || list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') || ['© 2026'] as b from documents)"""
HTML_BLOCKS_SQL = f"""
with {_PAGE_LINES}, p as (select doc_id, unnest(range(0, len(b)))::int as pos, unnest(b) as t from l)
select doc_id, pos, case when pos = 0 then 'list-item' else 'paragraph' end as type, case when pos = 0 then 1 else 0 end as level, t as text from p"""


def html_limited(spark, sf_dir: str) -> DataFrame:
    """What is kept of every page, and cut, under the limits of a small reader: 600 blocks of 8,192 bytes."""
    return _pages(spark, sf_dir).select("doc_id", html_losses(F.col("page")).alias("x")).select("doc_id", "x.kept", F.col("x.blocks").alias("blocks_cut"), F.col("x.texts").alias("texts_cut"))


HTML_LIMITED_SQL = f"""
with {_PAGE_LINES} select doc_id, least(len(b), 600)::int as kept, greatest(len(b) - 600, 0)::int as blocks_cut, len(list_filter(b, lambda t: strlen(t) > 8192))::int as texts_cut from l"""


def page_article(spark, sf_dir: str) -> DataFrame:
    """The article run of every page, without its navigation and footer."""
    rows = _pages(spark, sf_dir).select("doc_id", html_to_blocks(F.col("page"), NO_LIMITS).alias("blocks"))
    return rows.select("doc_id", F.size("blocks").alias("n_blocks"), article_run(F.col("blocks")).alias("run")).filter("run is not null").select("doc_id", "n_blocks", "run.first", "run.last", "run.score")


_PAGE_BLOCKS = f"with {_PAGE_LINES} select doc_id, unnest(range(0, len(b))) as pos, case when unnest(range(0, len(b))) = 0 then 'list-item' else 'paragraph' end as type, strlen(unnest(b)) as n from l"
PAGE_ARTICLE_SQL = f"""
select r.doc_id, n_blocks, first, last, score from ({article_run_sql(_PAGE_BLOCKS, "doc_id")}) r join (with {_PAGE_LINES} select doc_id, len(b)::int as n_blocks from l) using (doc_id)"""


def _documents(spark, sf_dir: str) -> DataFrame:
    """Every item as a feed document of its own."""
    t = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped(F.coalesce(F.col(c), F.lit(""))), F.lit(f"</{name}>"))
    paragraphs = F.array_join(F.transform(F.coalesce("blocks", F.array()), lambda b: F.concat(F.lit("<p>"), escaped(escaped(F.coalesce(b.text, F.lit("")))).cast("string"), F.lit("</p>"))), "")
    body = F.concat(F.lit("<description>"), F.replace(F.replace(paragraphs, F.lit("<p>"), F.lit("&lt;p&gt;")), F.lit("</p>"), F.lit("&lt;/p&gt;")), F.lit("</description>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>"), escaped(F.coalesce("source_name", F.lit(""))), F.lit("</title><item>"), t("title", "title"), t("guid", "guid"), t("link", "link"), t("author", "author"), t("pubDate", "published_raw"), body, F.lit("</item></channel></rss>"))
    return table(spark, sf_dir, "items").select("item_id", "title", xml.alias("xml"))


def feed_parse(spark, sf_dir: str) -> DataFrame:
    """Items that were written as RSS and read again."""
    read = feed_items(_documents(spark, sf_dir), "xml").select("item_id", F.col("title").alias("raw"), "feed.format", F.get(F.col("feed.items"), 0).alias("i"))
    title = F.when(~F.coalesce(F.col("raw").rlike("[<&]"), F.lit(False)), F.col("i.title"))  # a title with markup is read as a page once more
    return read.select("item_id", "format", "i.guid", "i.link", title.alias("title"), "i.author", "i.published_raw", "i.content_source", "i.text_bytes", F.array_join("i.blocks.text", "\n").alias("body"))


FEED_PARSE_SQL = r"""
with b as (select *, list_filter(list_transform(list_transform(coalesce(blocks, []), lambda x: coalesce(x.text, '')), lambda x: regexp_replace(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') as t from items),
w as (select *, regexp_replace(regexp_replace(coalesce(author, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') as a, regexp_replace(regexp_extract(a, '\((.*)\)', 1), '^ +| +$', '', 'g') as inner_name from b),
c as (select *, regexp_replace(guid, '^\s+|\s+$', '', 'g') as g, regexp_replace(link, '^\s+|\s+$', '', 'g') as l, regexp_replace(published_raw, '^\s+|\s+$', '', 'g') as p from w),
d as (select *, len(t) = 0 and regexp_replace(coalesce(title, ''), '[ \t\n\r\f\x0B]+', '', 'g') = '' as gone from c)
select item_id, 'rss' as format, case when not gone then coalesce(g, '') end as guid, case when not gone then coalesce(l, '') end as link, case when not gone then nullif(p, '') end as published_raw,
  case when not gone and not regexp_matches(coalesce(title, ''), '[<&]') then regexp_replace(regexp_replace(coalesce(title, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') end as title,
  case when not gone then case when inner_name <> '' then inner_name when contains(a, '@') and not contains(a, ' ') then '' else a end end as author,
  case when not gone then array_to_string(t, chr(10)) end as body,
  case when not gone then case when len(t) > 0 then 'summary' else 'none' end end as content_source, case when not gone then coalesce(list_sum(list_transform(t, lambda x: strlen(x))), 0)::bigint end as text_bytes from d"""


def parse_report(spark, sf_dir: str) -> DataFrame:
    """Files, items and their kinds of body over all feed documents."""
    read = feed_items(_documents(spark, sf_dir), "xml").select("feed.format", "feed.items_seen", F.size("feed.items").alias("n"), F.get(F.col("feed.items"), 0).alias("i"))
    return read.groupBy("format").agg(F.count("*").alias("files"), F.sum("items_seen").alias("seen"), F.sum("n").alias("items"), F.count_if(F.col("i.content_source") == "summary").alias("summaries"))


PARSE_REPORT_SQL = f"""
with r as ({FEED_PARSE_SQL})
select format, count(*) as files, count(*) as seen, count(guid) as items, count(*) filter (where content_source = 'summary') as summaries from r group by format"""


def opml_merge(spark, sf_dir: str) -> DataFrame:
    """Subscription files, one per feed and one more that repeats every feed in another folder: the first of each address counts."""
    feeds = table(spark, sf_dir, "feeds")
    one = lambda folder: F.concat(F.lit("<opml><body><outline text='"), folder, F.lit("'><outline text='inner'><outline type='rss' text='"), escaped(F.col("source_name")), F.lit("' xmlUrl='"), F.col("url"), F.lit("'/></outline></outline></body></opml>"))
    files = feeds.select(F.col("feed_pos").alias("file"), one(F.col("section")).alias("xml")).unionByName(feeds.select((F.col("feed_pos") + 1000).alias("file"), one(F.lit("Unsorted")).alias("xml")))
    return opml_feeds(files, "xml", "file").select("url", "title", "section")


OPML_MERGE_SQL = "select url, source_name as title, section from feeds"

QUERIES = {
    "html_blocks": (html_blocks, HTML_BLOCKS_SQL),
    "html_limited": (html_limited, HTML_LIMITED_SQL),
    "page_article": (page_article, PAGE_ARTICLE_SQL),
    "feed_parse": (feed_parse, FEED_PARSE_SQL),
    "parse_report": (parse_report, PARSE_REPORT_SQL),
    "opml_merge": (opml_merge, OPML_MERGE_SQL),
}

"""Small operators of the reader: styles, charsets, cache paths, candidates for a fetch, logs as text, refresh costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.strings import url_parts
from folioflow.operators.state import refresh_policy
from folioflow.session import bounded_broadcast, table

# Characters with a stand-in of the same meaning, and what stands in for them.
STOOD_IN = "★☆■▣▪●⁃▸▶−‐‑    "
STAND_INS = "••••••–››–--    "
# Refresh costs in milliseconds.
REFRESH_MS = {"full": 1740, "partial": 460}


def shown_text(text: Column) -> Column:
    """Text in characters that a page can show: stand-ins, and decoration without one dropped."""
    return F.regexp_replace(F.translate(text, STOOD_IN, STAND_INS), r"[\x{2190}-\x{2bff}\x{2e00}-\x{2e7f}\x{e000}-\x{f8ff}\x{fe00}-\x{fe0f}\x{1f000}-\x{10ffff}]", "")


def style_at(runs: Column, offset: Column) -> Column:
    """Flags of the first run that covers a byte offset, 0 if none does."""
    return F.coalesce(F.try_element_at(F.filter(runs, lambda r: (r.start <= offset) & (offset < r.start + r.length)), F.lit(1)).flags.cast("int"), F.lit(0))


def cache_path(url: Column) -> Column:
    return F.concat(F.lit("/f"), F.substring(F.md5(url), 1, 16), F.lit(".xml"))


# ---------------------------------------------------------------- queries


def styled_bytes(spark, sf_dir: str) -> DataFrame:
    """Bytes per item in bold, italic, code and links, and the style of each block's first byte."""
    blocks = table(spark, sf_dir, "items").select("item_id", F.explode("blocks").alias("b"))
    length = lambda bit: F.aggregate(F.coalesce("b.runs", F.array()), F.lit(0), lambda n, r: n + F.when(r.flags.cast("int").bitwiseAND(bit) > 0, r.length).otherwise(0))
    per = blocks.select("item_id", *[length(bit).alias(c) for c, bit in (("bold", 1), ("italic", 2), ("code", 4), ("link", 8))], style_at(F.col("b.runs"), F.lit(0)).alias("first"))
    return per.groupBy("item_id").agg(*[F.sum(c).alias(c) for c in ("bold", "italic", "code", "link")], F.count_if(F.col("first") > 0).alias("styled_starts"))


STYLED_BYTES_SQL = """
with b as (select item_id, unnest(blocks) as b, unnest(range(0, len(blocks))) as k from items),
r as (select item_id, k, unnest(b.runs) as r from b),
s as (select item_id, sum(case when r.flags & 1 > 0 then r.length else 0 end)::bigint as bold, sum(case when r.flags & 2 > 0 then r.length else 0 end)::bigint as italic,
  sum(case when r.flags & 4 > 0 then r.length else 0 end)::bigint as code, sum(case when r.flags & 8 > 0 then r.length else 0 end)::bigint as link from r group by 1),
f as (select item_id, count(*) filter (where len(list_filter(b.runs, lambda x: x.start <= 0 and x.start + x.length > 0 and x.flags > 0)) > 0) as styled_starts from b group by 1)
select item_id, coalesce(bold, 0) as bold, coalesce(italic, 0) as italic, coalesce(code, 0) as code, coalesce(link, 0) as link, styled_starts from f left join s using (item_id)"""


def charset(spark, sf_dir: str) -> DataFrame:
    """Every character of the titles and how many titles have it."""
    titles = table(spark, sf_dir, "items").select(F.explode(F.array_distinct(F.split("title", ""))).alias("character")).filter(F.col("character") != "")
    return titles.groupBy("character").agg(F.count("*").alias("titles")).select(F.hex(F.encode("character", "UTF-8")).alias("character"), "titles")


CHARSET_SQL = """
with c as (select unnest(list_distinct(list_transform(range(1, length(title) + 1), lambda i: substring(title, i, 1)))) as ch from items where title is not null)
select hex(ch) as character, count(*) as titles from c group by 1"""


def fallback_text(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "items").filter("title is not null").select("item_id", shown_text(F.col("title")).alias("shown"))


FALLBACK_TEXT_SQL = rf"""
select item_id, regexp_replace(translate(title, '{STOOD_IN}', '{STAND_INS}'), '[\x{{2190}}-\x{{2bff}}\x{{2e00}}-\x{{2e7f}}\x{{e000}}-\x{{f8ff}}\x{{fe00}}-\x{{fe0f}}\x{{1f000}}-\x{{10ffff}}]', '', 'g') as shown
from items where title is not null"""


def article_candidates(spark, sf_dir: str) -> DataFrame:
    """Truncated items with an https link whose page is not among the crawled documents: what a fetcher should get."""
    items = table(spark, sf_dir, "items").filter((F.col("truncation") != "none") & (F.col("link") != "")).select("item_id", "link", url_parts(F.col("link")).alias("u"))
    crawled = table(spark, sf_dir, "documents").select(F.col("url").alias("link")).filter("link is not null").distinct()
    return items.filter("u.secure").join(crawled, "link", "left_anti").select("item_id", "u.host", cache_path(F.col("link")).alias("path"))


ARTICLE_CANDIDATES_SQL = r"""
select item_id, lower(regexp_extract(link, '(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?#].*)?$', 2)) as host, '/f' || left(md5(link), 16) || '.xml' as path
from items i where truncation <> 'none' and regexp_matches(link, '(?i)^https://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?#].*)?$') and not exists (select 1 from documents d where d.url = i.link)"""


def read_log_load(spark, sf_dir: str) -> DataFrame:
    """The read state as lines of key and epoch with a comment, read again: the last month's keys with their first time."""
    state = table(spark, sf_dir, "read_state")
    lines = state.select(F.concat(F.substring(F.md5("item_key"), 1, 16), F.lit(" "), F.unix_seconds(F.col("read_at").cast("timestamp")).cast("string")).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([("# read keys",), ("",), ("broken",)], "line string"))
    parts = F.split("line", " ")
    rows = lines.filter(~F.col("line").startswith("#")).select(parts[0].alias("key"), F.get(parts, 1).try_cast("bigint").alias("epoch")).dropna()
    now = rows.agg(F.max("epoch").alias("now")).scalar()
    return rows.filter(F.col("epoch") >= now - 30 * 86_400).groupBy("key").agg(F.min("epoch").alias("epoch"))


READ_LOG_LOAD_SQL = """
with r as (select left(md5(item_key), 16) as key, epoch(date_trunc('second', read_at))::bigint as epoch from read_state)
select key, min(epoch) as epoch from r where epoch >= (select max(epoch) from r) - 30 * 86400 group by 1"""


def refresh_cost(spark, sf_dir: str) -> DataFrame:
    """What the refreshes of each user cost."""
    costs = spark.createDataFrame(list(REFRESH_MS.items()), "refresh string, ms int")
    turns = refresh_policy(spark, sf_dir).join(bounded_broadcast(costs), "refresh")
    return turns.groupBy("user_id").agg(F.count("*").alias("refreshes"), F.count_if(F.col("refresh") == "full").alias("full"), F.sum("ms").alias("ms"))


def _refresh_cost_sql() -> str:
    from folioflow.operators.state import REFRESH_POLICY_SQL

    cost = f"case refresh when 'full' then {REFRESH_MS['full']} else {REFRESH_MS['partial']} end"
    return f"with p as ({REFRESH_POLICY_SQL}) select user_id, count(*) as refreshes, count(*) filter (where refresh = 'full') as full, sum({cost})::bigint as ms from p group by 1"


QUERIES = {
    "styled_bytes": (styled_bytes, STYLED_BYTES_SQL),
    "charset": (charset, CHARSET_SQL),
    "fallback_text": (fallback_text, FALLBACK_TEXT_SQL),
    "article_candidates": (article_candidates, ARTICLE_CANDIDATES_SQL),
    "read_log_load": (read_log_load, READ_LOG_LOAD_SQL),
    "refresh_cost": (refresh_cost, _refresh_cost_sql()),
}

"""Bodies of stories: blocks, byte counts, the truncation hint, and the article inside a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.datetimes import let
from folioflow.functions.strings import ascii_lower, byline, collapse_ws, grey3, icontains, resolve_url, seconds_until, tidy_author, trim_ws, url_parts
from folioflow.session import bounded_broadcast, table

SHORT_BYTES, SUMMARY_BYTES, SUMMARY_BLOCKS, TAIL_BYTES = 500, 1500, 3, 120
# Fixed values: phrases that link to the rest of a story.
MORE = ("read more", "continue reading", "read the rest", "read on", "[…]", "[...]")


def text_bytes(blocks: Column) -> Column:
    return F.aggregate(F.coalesce(blocks, F.array()), F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.octet_length(b.text), F.lit(0)))


def _tail_bytes(text: Column) -> Column:
    """The last 120 bytes in ASCII lower case; they may begin inside a character."""
    raw = F.encode(ascii_lower(text), "UTF-8")
    return F.when(F.octet_length(raw) > TAIL_BYTES, F.substring(raw, -TAIL_BYTES, TAIL_BYTES)).otherwise(raw)


def truncation(blocks: Column, content_source: Column, size: Column, link: Column) -> Column:
    """The classifier of the feed reader: summary-only, ellipsis-tail, read-more-link, very-short or none.

    The phrases of a link to the rest are looked for in the last 120 bytes.
    """
    count = F.coalesce(F.size(blocks), F.lit(0))
    last = F.try_element_at(F.filter(blocks, lambda b: b.text != ""), F.lit(-1)).text
    tail = _tail_bytes(last)
    more = F.lit(False)
    for phrase in MORE:
        more = more | F.coalesce(F.contains(tail, F.lit(phrase.encode())), F.lit(False))
    return (
        F.when(count <= 0, "summary-only")
        .when((content_source == "summary") & ((size < SUMMARY_BYTES) | (count < SUMMARY_BLOCKS)), "summary-only")
        .when(F.endswith(last, F.lit("…")) | F.endswith(last, F.lit("...")), "ellipsis-tail")
        .when(more, "read-more-link")
        .when((size < SHORT_BYTES) & (F.coalesce(link, F.lit("")) != ""), "very-short")
        .otherwise("none")
    )


def text_to_blocks(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n[ \t\r\f]*\n"), collapse_ws), lambda t: t != "")


def article_run(blocks: Column, prose_floor: int = 90, max_blocks: int = 400) -> Column:
    """The run of neighbouring blocks with the highest score: struct(first, last, score), null when there is no prose.

    Paragraphs and quotes score their bytes over the floor, list items half of that, headings a little less than nothing, anything else
    minus the floor. Latest start and earliest end win ties. The run is found in one fold over the blocks of a document, without
    a shuffle; it is cut to ``max_blocks`` and must hold a paragraph of at least the floor.
    """

    def score(b: Column) -> Column:
        n = F.coalesce(F.octet_length(b.text), F.lit(0))
        half = F.when(n >= prose_floor, F.floor((n - prose_floor) / 2)).otherwise(F.ceil((n - prose_floor) / 2)).cast("int")
        return F.when(b.type.isin("paragraph", "blockquote"), n - prose_floor).when(b.type == "heading", F.when(n > 0, -30).otherwise(-90)).when(b.type == "list-item", half).otherwise(-90)

    zero = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in {"at": 0, "sum": 0, "start": 0, "best": 0, "first": -1, "last": -1}.items()])

    def step(a: Column, x: Column) -> Column:
        fresh = a.sum <= 0
        total = F.when(fresh, x).otherwise(a.sum + x)
        start = F.when(fresh, a["at"]).otherwise(a.start)
        better = total > a.best
        return F.struct(
            (a["at"] + 1).alias("at"),
            total.cast("int").alias("sum"),
            start.alias("start"),
            F.when(better, total).otherwise(a.best).cast("int").alias("best"),
            F.when(better, start).otherwise(a["first"]).alias("first"),
            F.when(better, a["at"]).otherwise(a["last"]).alias("last"),
        )

    run = F.aggregate(F.transform(F.coalesce(blocks, F.array()), score), zero, step)

    def checked(r: Column) -> Column:
        last = F.least(r["last"], r["first"] + max_blocks - 1)
        prose = F.exists(F.slice(blocks, r["first"] + 1, F.greatest(last - r["first"] + 1, F.lit(0))), lambda b: (b.type == "paragraph") & (F.octet_length(b.text) >= prose_floor))
        return F.when((r["first"] >= 0) & prose, F.struct(r["first"].alias("first"), last.alias("last"), r.best.alias("score")))

    return let(run, checked)


# ---------------------------------------------------------------- queries


def truncation_reason(spark, sf_dir: str) -> DataFrame:
    """The reader's classifier over the stored blocks of every item."""
    size = text_bytes(F.col("blocks"))
    return table(spark, sf_dir, "items").select("item_id", size.alias("bytes"), truncation(F.col("blocks"), F.col("content_source"), size, F.col("link")).alias("reason"))


_REASON_SQL = """
    b as (select item_id, content_source, link, source_name, truncation, list_transform(coalesce(blocks, []), lambda x: x.text) as t, len(coalesce(blocks, [])) as n from items),
    c as (select *, coalesce(list_sum(list_transform(t, lambda x: strlen(coalesce(x, '')))), 0)::bigint as bytes, list_filter(t, lambda x: x <> '')[-1] as last from b),
    d as (select *, right(hex(translate(last, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 240) as tail from c),
    r as (select *, case when n = 0 then 'summary-only' when content_source = 'summary' and (bytes < 1500 or n < 3) then 'summary-only'
      when last like '%…' or last like '%...' then 'ellipsis-tail'
      when contains(tail, hex('read more')) or contains(tail, hex('continue reading')) or contains(tail, hex('read the rest')) or contains(tail, hex('read on')) or contains(tail, hex('[…]')) or contains(tail, hex('[...]')) then 'read-more-link'
      when bytes < 500 and coalesce(link, '') <> '' then 'very-short' else 'none' end as reason from d)"""
TRUNCATION_REASON_SQL = f"with {_REASON_SQL} select item_id, bytes, reason from r"


def truncation_report(spark, sf_dir: str) -> DataFrame:
    """Items, truncated items and their percentage per source, as delivered."""
    t = F.count_if(F.col("truncation") != "none")
    return table(spark, sf_dir, "items").groupBy("source_name").agg(F.count("*").alias("items"), t.alias("truncated"), F.round(100.0 * t / F.count("*"), 4).alias("percent"))


TRUNCATION_REPORT_SQL = """
select source_name, count(*) as items, count(*) filter (where truncation <> 'none') as truncated, round(100.0 * count(*) filter (where truncation <> 'none') / count(*), 4) as percent
from items group by source_name"""


def document_blocks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_to_blocks(F.col("text"))).alias("pos", "block"))


DOCUMENT_BLOCKS_SQL = r"""
with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r\f]*\n'),
  lambda x: regexp_replace(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') as b from documents)
select doc_id, unnest(range(0, len(b)))::int as pos, unnest(b) as block from p"""


def extract_article(spark, sf_dir: str) -> DataFrame:
    """The article run of every item's blocks."""
    run = article_run(F.col("blocks"))
    return table(spark, sf_dir, "items").select("item_id", run.alias("run")).filter(F.col("run").isNotNull()).select("item_id", "run.first", "run.last", "run.score")


def article_run_sql(blocks: str, key: str) -> str:
    """The article runs of ``blocks``, a query of (key, pos, type, n) with the bytes of each block."""
    return f"""
with s as (select {key}, pos, type, n, case when type in ('paragraph', 'blockquote') then n - 90 when type = 'heading' then case when n > 0 then -30 else -90 end
    when type = 'list-item' then (n - 90) // 2 else -90 end as score from ({blocks})),
t as (select *, sum(score) over w as total from s window w as (partition by {key} order by pos)),
m as (select *, min({{'v': total - score, 'p': -pos}}) over (partition by {key} order by pos) as low from t),
best as (select {key}, max({{'s': total - low.v, 'p': -pos}}) as best, arg_max(-low.p, {{'s': total - low.v, 'p': -pos}}) as first from m group by {key}),
r as (select {key}, first::int as first, least(-best.p, first + 399)::int as last, best.s::int as score from best where best.s > 0)
select r.* from r where exists (select 1 from s where s.{key} = r.{key} and s.pos between r.first and r.last and s.type = 'paragraph' and s.n >= 90)"""


EXTRACT_ARTICLE_SQL = article_run_sql("select item_id, pos, b.type as type, strlen(coalesce(b.text, '')) as n from (select item_id, unnest(blocks) as b, unnest(range(0, len(blocks))) as pos from items)", "item_id")


def _address(url: Column) -> Column:
    """The address without fragment, with scheme, host and port made equal; null for what is none."""
    parts = url_parts(trim_ws(F.regexp_replace(url, r"(?s)#.*$", "")))
    return F.when(parts.host.isNotNull(), F.concat_ws(" ", parts.secure.cast("string"), parts.host, parts.port.cast("string"), parts.path))


def enriched(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``items`` whose text was cut, with the latest crawled document of their link: ``doc_id``, ``crawled_at`` and ``paragraphs``.

    ``paragraphs`` are the document's, or the item's own block texts where no document of that address was crawled. Addresses are equal without
    their fragment and with default ports; an item without a link, or with one that is no address, keeps its own text. Both sides are joined by address, of which
    the documents' side has one row each.
    """
    wanted = items.filter(F.col("truncation") != "none").select("item_id", "blocks", _address(F.col("link")).alias("address"))
    found = documents.select(_address(F.col("url")).alias("address"), "doc_id", "crawled_at", "text").filter("address is not null")
    latest = found.groupBy("address").agg(F.max_by(F.struct("doc_id", "crawled_at", "text"), F.struct("crawled_at", "doc_id")).alias("d"))
    own = F.transform(F.filter(F.coalesce("blocks", F.array()), lambda b: F.coalesce(b.text, F.lit("")) != ""), lambda b: b.text)
    return wanted.join(latest, "address", "left").select("item_id", "d.doc_id", "d.crawled_at", F.coalesce(text_to_blocks(F.col("d.text")), own).alias("paragraphs"))


def article_enrich(spark, sf_dir: str) -> DataFrame:
    """Every truncated item with the latest document of its link, if one was crawled, and the text it then has."""
    done = enriched(table(spark, sf_dir, "items"), table(spark, sf_dir, "documents"))
    return done.select("item_id", "doc_id", "crawled_at", F.size("paragraphs").alias("paragraphs"), F.array_join("paragraphs", "\n").alias("text"))


_ADDRESS = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?].*)?$"
ARTICLE_ENRICH_SQL = rf"""
with a as (select doc_id, crawled_at, text, regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '{_ADDRESS}', ['s', 'h', 'p', 'r']) as x from documents where url is not null),
d as (select arg_max({{'doc_id': doc_id, 'crawled_at': crawled_at, 'text': text}}, (crawled_at, doc_id)) as d, lower(x.s) as s, lower(x.h) as h, coalesce(nullif(x.p, ''), case when lower(x.s) = 'https' then '443' else '80' end) as p, x.r as r
  from a where x.h <> '' group by all),
i as (select item_id, list_filter(list_transform(coalesce(blocks, []), lambda b: b.text), lambda t: t <> '') as own, regexp_extract(regexp_replace(trim(link), '(?s)#.*$', ''), '{_ADDRESS}', ['s', 'h', 'p', 'r']) as x from items where truncation <> 'none'),
j as (select item_id, d.doc_id as doc_id, d.crawled_at as crawled_at, coalesce(list_filter(list_transform(regexp_split_to_array(d.text, '
[ 	
]*
'),
  lambda x: regexp_replace(regexp_replace(x, '[ 	

]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), own) as t
  from i left join d on x.h <> '' and s = lower(x.s) and h = lower(x.h) and r = x.r and p = coalesce(nullif(x.p, ''), case when lower(x.s) = 'https' then '443' else '80' end))
select item_id, doc_id, crawled_at, len(t)::int as paragraphs, array_to_string(t, chr(10)) as text from j"""


def item_text(spark, sf_dir: str) -> DataFrame:
    """Author, byline and collapsed title of every item."""
    items = table(spark, sf_dir, "items")
    author = tidy_author(F.col("author"))
    return items.select("item_id", author.alias("author"), byline(author, F.col("source_name"), F.col("published")).alias("byline"), collapse_ws(F.col("title")).alias("title"), ascii_lower(F.col("section")).alias("section"))


ITEM_TEXT_SQL = r"""
with a as (select *, regexp_replace(regexp_replace(author, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') as p from items),
b as (select *, regexp_replace(regexp_extract(p, '\((.*)\)', 1), '^ | $', '', 'g') as i from a),
c as (select *, case when p is null then null when i <> '' then i when contains(p, '@') and not contains(p, ' ') then '' else p end as who from b)
select item_id, who as author, concat_ws('  ·  ', case when who <> '' then 'By ' || who end, nullif(source_name, ''), strftime(published, '%-d %b %Y')) as byline,
  regexp_replace(regexp_replace(title, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') as title,
  translate(section, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as section from c"""


def string_normalise(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    t = F.col("text")
    return documents.select("doc_id", F.octet_length(t).alias("bytes"), F.length(trim_ws(t)).alias("trimmed"), F.length(collapse_ws(t)).alias("collapsed"), icontains(t, "Read More").alias("more"), ascii_lower(t).alias("lowered"))


STRING_NORMALISE_SQL = r"""
select doc_id, strlen(text)::int as bytes, length(regexp_replace(text, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'))::int as trimmed,
  length(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g'))::int as collapsed,
  contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'read more') as more,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from documents"""


def url_split(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "items").select("item_id", url_parts(trim_ws(F.col("link"))).alias("u")).select("item_id", "u.*")


URL_SPLIT_SQL = r"""
with l as (select item_id, regexp_replace(link, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') as u from items),
p as (select *, regexp_extract(u, '(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?#].*)?$', ['s', 'h', 'p', 'r']) as x,
  regexp_matches(u, '(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?#].*)?$') and strlen(u) <= 2048 as ok from l)
select item_id, case when ok then lower(x.s) = 'https' end as secure, case when ok then lower(x.h) end as host,
  case when ok then coalesce(try_cast(x.p as int), case when lower(x.s) = 'https' then 443 else 80 end) end as port,
  case when ok then case when x.r = '' then '/' when x.r like '/%' then x.r else '/' || x.r end end as path from p"""


def url_resolve(spark, sf_dir: str) -> DataFrame:
    refs = F.array(F.lit("a/b.html"), F.lit("/top?x=1"), F.lit("//other.example/c"), F.lit("https://far.example/"))
    rows = table(spark, sf_dir, "documents").filter(F.col("url").isNotNull()).select("doc_id", "url", F.explode(refs).alias("ref"))
    return rows.select("doc_id", "ref", resolve_url(F.col("url"), F.col("ref")).alias("resolved"))


URL_RESOLVE_SQL = r"""
with r as (select doc_id, url, unnest(['a/b.html', '/top?x=1', '//other.example/c', 'https://far.example/']) as ref from documents where url is not null)
select doc_id, ref, case when ref like 'https://%' then ref when ref like '//%' then regexp_extract(url, '(?i)^(https?:)', 1) || ref
  when ref like '/%' then regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || ref
  else coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(?i)^(https?://[^/]+/(?:.*/)?)', 1), ''), regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/') || ref end as resolved from r"""


def date_formats(spark, sf_dir: str) -> DataFrame:
    """Masthead, short and clock forms of publication times, and the seconds to the next edition; empty for undated items."""
    p = F.col("published")
    return table(spark, sf_dir, "items").select(
        "item_id",
        F.coalesce(F.date_format(p, "EEEE, d MMMM yyyy"), F.lit("")).alias("masthead"),
        F.coalesce(F.date_format(p, "d MMM yyyy"), F.lit("")).alias("short"),
        F.coalesce(F.date_format(p, "HH:mm"), F.lit("")).alias("clock"),
        seconds_until("06:30", p).cast("int").alias("until"),
    )


DATE_FORMATS_SQL = """
select item_id, coalesce(strftime(published, '%A, %-d %B %Y'), '') as masthead, coalesce(strftime(published, '%-d %b %Y'), '') as short,
  coalesce(strftime(published, '%H:%M'), '') as clock,
  ((23400 - 1 - (hour(published) * 3600 + minute(published) * 60 + second(published)) + 86400) % 86400 + 1)::int as until from items"""


def grey3_quantise(spark, sf_dir: str) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("v"), grey3(F.col("id")).alias("grey"))


GREY3_SQL = "select v::int as v, ((((v * 7 + 127) // 255) * 255) // 7)::int as grey from range(256) t(v)"


def fixture_match(spark, sf_dir: str) -> DataFrame:
    """Feed addresses against source names: a host label in a name's letters, or the other way round, both of four or more letters; the first match by name."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", F.element_at(F.split(F.regexp_extract("url", "^https?://([^/]+)", 1), r"\."), 1).alias("label"))
    names = table(spark, sf_dir, "documents").select("source").filter(F.col("source").isNotNull()).distinct()
    tokens = names.select("source", F.explode(F.split(ascii_lower(F.col("source")), "[^a-z0-9]+")).alias("token")).filter(F.length("token") >= 4)
    # labels are cut into all their parts of four or more letters, so containment is an equality and no theta join
    parts = feeds.filter(F.length("label") >= 4).select("feed_pos", "label", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("label") - 3), lambda i: F.transform(F.sequence(F.lit(4), F.length("label") - i + 1), lambda n: F.substring(F.col("label"), i, n))))).alias("token"))
    inside = parts.select("feed_pos", "token").distinct().join(bounded_broadcast(tokens), "token")
    around = tokens.select("source", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("token") - 3), lambda i: F.transform(F.sequence(F.lit(4), F.length("token") - i + 1), lambda n: F.substring(F.col("token"), i, n))))).alias("label")).distinct()
    outside = feeds.join(around, "label").select("feed_pos", "source")
    return inside.select("feed_pos", "source").unionByName(outside).groupBy("feed_pos").agg(F.min("source").alias("source"))


FIXTURE_MATCH_SQL = """
with f as (select feed_pos, string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.')[1] as label from feeds),
t as (select distinct source, unnest(regexp_split_to_array(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) as token from documents where source is not null)
select feed_pos, min(source) as source from f, t where length(label) >= 4 and length(token) >= 4 and (contains(label, token) or contains(token, label)) group by feed_pos"""

QUERIES = {
    "truncation_reason": (truncation_reason, TRUNCATION_REASON_SQL),
    "truncation_report": (truncation_report, TRUNCATION_REPORT_SQL),
    "text_to_blocks": (document_blocks, DOCUMENT_BLOCKS_SQL),
    "extract_article": (extract_article, EXTRACT_ARTICLE_SQL),
    "article_enrich": (article_enrich, ARTICLE_ENRICH_SQL),
    "item_text": (item_text, ITEM_TEXT_SQL),
    "string_normalise": (string_normalise, STRING_NORMALISE_SQL),
    "url_parts": (url_split, URL_SPLIT_SQL),
    "url_resolve": (url_resolve, URL_RESOLVE_SQL),
    "date_formats": (date_formats, DATE_FORMATS_SQL),
    "grey3_quantise": (grey3_quantise, GREY3_SQL),
    "fixture_match": (fixture_match, FIXTURE_MATCH_SQL),
}

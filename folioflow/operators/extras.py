"""Smaller operators: bounded sources, client answers, pages and neighbours of stories, offsets, pixels and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import selection
from folioflow.session import bounded_broadcast, table

LEDGER_ENTRIES = 128  # what a small reader keeps; None keeps all


def read_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content, truncated) of every file below a path, each cut after ``most`` bytes if given.

    The length is known from the listing. Empty files have no row, as Spark's file sources pass over them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length", limited(F.col("content"), most)["content"].alias("content"), (F.col("length") > most if most is not None else F.lit(False)).alias("truncated"))


def limited(content: Column, most: int | None) -> Column:
    """struct(content, truncated): the first ``most`` bytes of a binary value, and whether there were more; null stays null."""
    if most is None:
        return F.struct(content.alias("content"), F.lit(False).alias("truncated"))
    return F.struct(F.substring(content, 1, most).alias("content"), (F.octet_length(content) > most).alias("truncated"))


def repaired_utf8(content: Column) -> Column:
    """struct(text, valid): bytes as text with U+FFFD for what is no UTF-8, and whether nothing had to be replaced."""
    text = content.cast("string")
    return F.struct(F.make_valid_utf8(text).alias("text"), F.is_valid_utf8(text).alias("valid"))


def conditional_answer(body: Column, sent_etag: Column, most: int | None = None) -> Column:
    """struct(status, etag, body, truncated): what a file-backed server answers. The tag is the body's digest; an equal one sent along gives 304 and no body, a null body 404."""
    etag = F.md5(body)
    answer = lambda status, body_, cut: F.struct(F.lit(status).alias("status"), F.when(F.lit(status) != 404, etag).alias("etag"), body_.alias("body"), cut.alias("truncated"))
    nothing = F.lit(None).cast("binary")
    kept = limited(body, most)
    return F.when(body.isNull(), answer(404, nothing, F.lit(False))).when(etag == sent_etag, answer(304, nothing, F.lit(False))).otherwise(answer(200, kept["content"], kept["truncated"]))


def kept_bodies(answers: DataFrame) -> DataFrame:
    """(url, etag, body, body_at, checked_at, problem): per address the body of the latest 200 that came before, as 304 confirms it.

    ``answers`` has url, fetched_at, seq, status, etag and body. A 200 keeps its body and validators together; a 304 reuses what is kept; anything else
    after the last good answer is the problem of the address, beside the body kept. One aggregation per address, combined before its shuffle.
    """
    order = F.struct("fetched_at", "seq")
    good = F.when(F.col("status") == 200, F.struct("fetched_at", "seq", "etag", "body"))
    fine = F.when(F.col("status").isin(200, 304), order)
    found = answers.groupBy("url").agg(F.max_by(good, F.when(F.col("status") == 200, order)).alias("b"), F.max(fine).alias("fine"), F.max_by("status", order).alias("last_status"), F.max(order).alias("last"))
    failed = F.coalesce(F.col("last") > F.col("fine"), F.lit(True)) | F.col("b").isNull()
    return found.select("url", "b.etag", "b.body", F.col("b.fetched_at").alias("body_at"), F.col("fine.fetched_at").alias("checked_at"), F.when(failed, F.concat(F.lit("status "), F.col("last_status").cast("string"))).alias("problem"))


def offset_minutes(text: Column) -> Column:
    """Whole minutes with a sign, at most a day either way; null for anything else."""
    minutes = F.when(text.rlike(r"^[+-]?\d{1,9}$"), text).try_cast("int")
    return F.when(F.abs(minutes) <= 1440, minutes)


def to_px(sixteenths: Column) -> Column:
    """Sixteenths of a pixel to pixels, halves up."""
    return F.floor((sixteenths + 8) / 16).cast("int")


def inside(x: Column, y: Column, box: Column) -> Column:
    """Whether a place lies in a struct(x, y, width, height); an empty box holds nothing."""
    return (box.width > 0) & (box.height > 0) & (x >= box.x) & (x < box.x + box.width) & (y >= box.y) & (y < box.y + box.height)


# ---------------------------------------------------------------- queries


def limited_source(spark, sf_dir: str) -> DataFrame:
    """Every document through a source of at most 1,000 bytes, and its text repaired where a character was cut."""
    cut = limited(F.encode("text", "UTF-8"), 1000)
    rows = table(spark, sf_dir, "documents").select("doc_id", cut.alias("c"))
    return rows.select("doc_id", F.octet_length("c.content").alias("bytes"), "c.truncated", repaired_utf8(F.col("c.content"))["valid"].alias("valid"))


LIMITED_SOURCE_SQL = """
select doc_id, least(strlen(text), 1000)::int as bytes, strlen(text) > 1000 as truncated,
  strlen(text) <= 1000 or substr(hex(encode(text)), 2001, 1) not in ('8', '9', 'A', 'B') as valid from documents"""


def conditional_fetch(spark, sf_dir: str) -> DataFrame:
    """Every crawled document asked for again with the tag of its oldest crawl: 304 where the text is that one, else 200 with at most 10,000 bytes."""
    documents = table(spark, sf_dir, "documents").filter(F.col("url").isNotNull()).select("url", "doc_id", "crawled_at", F.encode("text", "UTF-8").alias("body"))
    first = documents.groupBy("url").agg(F.min_by(F.md5("body"), F.struct("crawled_at", "doc_id")).alias("tag"), F.min(F.struct("crawled_at", "doc_id")).alias("f"))
    asked = documents.join(first, "url").withColumn("a", conditional_answer(F.col("body"), F.when(F.col("doc_id") != F.col("f.doc_id"), F.col("tag")), 10_000))
    return asked.select("doc_id", "a.status", "a.etag", F.octet_length("a.body").alias("bytes"), "a.truncated")


CONDITIONAL_FETCH_SQL = """
with d as (select url, doc_id, crawled_at, text, md5(text) as tag from documents where url is not null),
f as (select url, arg_min(tag, (crawled_at, doc_id)) as first_tag, arg_min(doc_id, (crawled_at, doc_id)) as first_id from d group by 1),
a as (select d.*, case when text is null then 404 when doc_id <> first_id and tag = first_tag then 304 else 200 end as status from d join f using (url))
select doc_id, status, case when status <> 404 then tag end as etag, case when status = 200 then least(strlen(text), 10000)::int end as bytes, status = 200 and strlen(text) > 10000 as truncated from a"""


def body_ledger(spark, sf_dir: str) -> DataFrame:
    """Addresses of the response log with the fetch whose body is kept, when it was last confirmed, and what is wrong since."""
    heads = table(spark, sf_dir, "http_heads").select("url", "fetched_at", F.col("fetch_id").alias("seq"), "status", "etag", F.col("fetch_id").alias("body"))
    return kept_bodies(heads).filter(F.col("url").isNotNull())


BODY_LEDGER_SQL = """
with g as (select url, arg_max({'etag': etag, 'body': fetch_id, 'at': fetched_at}, (fetched_at, fetch_id)) filter (where status = 200) as b, max({'f': fetched_at, 's': fetch_id}) filter (where status in (200, 304)) as fine,
  arg_max(status, (fetched_at, fetch_id)) as last_status, max({'f': fetched_at, 's': fetch_id}) as last from http_heads where url is not null group by 1)
select url, b.etag as etag, b.body as body, b.at as body_at, fine.f as checked_at, case when b is null or fine is null or last > fine then 'status ' || last_status::varchar end as problem from g"""


def known_problems(spark, sf_dir: str) -> DataFrame:
    """Addresses whose latest answer is bad, and whether the one before was bad with the same status, so that it is known already."""
    order = F.struct("fetched_at", "fetch_id", "status")
    heads = table(spark, sf_dir, "http_heads").filter(F.col("url").isNotNull() & F.col("status").isNotNull())
    two = heads.groupBy("url").agg(F.max(order).alias("last"), F.max_by("status", F.struct("fetched_at", "fetch_id")).alias("status"))
    before = heads.join(two.select("url", "last"), "url").filter(order < F.col("last")).groupBy("url").agg(F.max_by("status", F.struct("fetched_at", "fetch_id")).alias("earlier"))
    bad = two.filter(~F.col("status").isin(200, 304))
    return bad.join(before, "url", "left").select("url", "status", F.coalesce(F.col("earlier") == F.col("status"), F.lit(False)).alias("known"))


KNOWN_PROBLEMS_SQL = """
with r as (select url, status, row_number() over w as n, lead(status) over w as earlier from http_heads where url is not null and status is not null window w as (partition by url order by fetched_at desc, fetch_id desc))
select url, status, coalesce(earlier = status, false) as known from r where n = 1 and status not in (200, 304)"""


def opml_report(spark, sf_dir: str) -> DataFrame:
    """Per section the feeds of a subscription list, those with a language, and the repeated addresses of the list set twice."""
    feeds = table(spark, sf_dir, "feeds")
    twice = feeds.select("section", "url", "lang").unionByName(feeds.select("section", "url", "lang"))
    return twice.groupBy("section").agg(F.countDistinct("url").alias("added"), (F.count("*") - F.countDistinct("url")).alias("repeated"), F.countDistinct(F.when(F.col("lang") != "", F.col("url"))).alias("with_language"))


OPML_REPORT_SQL = """
select section, count(distinct url) as added, count(distinct url) as repeated, count(distinct url) filter (where lang <> '') as with_language from feeds group by 1"""


def story_neighbours(spark, sf_dir: str) -> DataFrame:
    """The edition's stories in reading order with the one before and after, whatever was read, and the page that each begins at of all pages."""
    order = selection.reading_order(selection.edition(spark, sf_dir)).select("reading_pos", "item_id")
    size = table(spark, sf_dir, "items").select("item_id", F.greatest(F.lit(1), F.ceil(F.coalesce("text_bytes", F.lit(0)) / 800)).cast("int").alias("pages"))
    rows = bounded_broadcast(order).join(size, "item_id")
    stories = F.array_sort(F.collect_list(F.struct("reading_pos", "item_id", "pages")))  # the stories of one edition
    listed = rows.agg(stories.alias("all"))
    total = F.aggregate("all", F.lit(0), lambda n, s: n + s.pages)
    each = listed.select("all", total.alias("of"), F.posexplode("all").alias("k", "s"))
    at = lambda k: F.get(F.col("all"), k)["item_id"]
    first = F.aggregate(F.slice("all", F.lit(1), F.col("k")), F.lit(1), lambda n, s: n + s.pages)
    return each.select("s.reading_pos", "s.item_id", F.when(F.col("k") > 0, at(F.col("k") - 1)).alias("previous"), at(F.col("k") + 1).alias("next"), first.cast("int").alias("page"), F.col("of").cast("int").alias("of"))


def page_folios(spark, sf_dir: str) -> DataFrame:
    """Every page of the edition as ``k / n`` of its story, and its number in the edition."""
    stories = story_neighbours(spark, sf_dir)
    size = table(spark, sf_dir, "items").select("item_id", F.greatest(F.lit(1), F.ceil(F.coalesce("text_bytes", F.lit(0)) / 800)).cast("int").alias("n"))
    pages = bounded_broadcast(stories).join(size, "item_id").select("item_id", "page", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return pages.select("item_id", "k", "n", F.concat(F.col("k").cast("string"), F.lit(" / "), F.col("n").cast("string")).alias("label"), (F.col("page") + F.col("k") - 1).alias("folio"))


def offset_parse(spark, sf_dir: str) -> DataFrame:
    """Written numbers of minutes, of all orders' keys and priorities, as offsets."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(""), F.lit("x")), (F.col("o_orderkey") % 4 + 1).cast("int")), (F.col("o_orderkey") % 2000).cast("string")).alias("raw"))
    return orders.select("o_orderkey", offset_minutes(F.col("raw")).alias("minutes"), to_px(F.col("o_orderkey") % 4096).alias("px"))


OFFSET_PARSE_SQL = """
with r as (select o_orderkey, ['+', '-', '', 'x'][(o_orderkey % 4 + 1)::int] as sign, (o_orderkey % 2000)::int as m from orders)
select o_orderkey, case when sign <> 'x' and m <= 1440 then case when sign = '-' then -m else m end end as minutes, ((o_orderkey % 4096 + 8) // 16)::int as px from r"""


def hit_test(spark, sf_dir: str) -> DataFrame:
    """Events as touches of a screen: which corner of it they hit, and how low a battery they report."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 758).cast("int").alias("x"), (F.col("event_id") * 61 % 1024).cast("int").alias("y"), (F.col("event_id") * 13 % 4200).cast("int").alias("mv"))
    box = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    corner = F.coalesce(*[F.when(inside(F.col("x"), F.col("y"), box(x, y)), name) for name, x, y in (("top-left", 0, 0), ("top-right", 658, 0), ("bottom-left", 0, 944), ("bottom-right", 658, 944))], F.lit("none"))
    return e.select("event_id", corner.alias("corner"), F.col("mv").between(1, 3499).alias("battery_low"))


HIT_TEST_SQL = """
with e as (select event_id, event_id * 37 % 758 as x, event_id * 61 % 1024 as y, event_id * 13 % 4200 as mv from events)
select event_id, case when x < 100 and y < 80 then 'top-left' when x >= 658 and y < 80 then 'top-right' when x < 100 and y >= 944 then 'bottom-left' when x >= 658 and y >= 944 then 'bottom-right' else 'none' end as corner, mv between 1 and 3499 as battery_low from e"""


def ledger_bounded(spark, sf_dir: str) -> DataFrame:
    """Validators of each device as a reader of 128 entries keeps them: the first addresses it saw, each with its latest save; ``latest_validators`` keeps all."""
    v = table(spark, sf_dir, "validators").filter(F.col("url").isNotNull())
    kept = v.groupBy("device", "url").agg(F.min(F.struct("saved_at", "validator_id")).alias("first"), F.max_by(F.struct("validator_id", "etag", "last_modified"), F.struct("saved_at", "validator_id")).alias("x"))
    # WindowGroupLimit keeps the first of each device before the shuffle
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("device").orderBy("first"))).filter(F.col("n") <= LEDGER_ENTRIES)
    return ranked.select("device", "url", "n", "x.validator_id")


LEDGER_BOUNDED_SQL = """
with k as (select device, url, min({'s': saved_at, 'v': validator_id}) as first, arg_max(validator_id, (saved_at, validator_id)) as validator_id from validators where url is not null group by 1, 2),
r as (select *, row_number() over (partition by device order by first) as n from k)
select device, url, n::int as n, validator_id from r where n <= 128"""

QUERIES = {
    "limited_source": (limited_source, LIMITED_SOURCE_SQL),
    "conditional_fetch": (conditional_fetch, CONDITIONAL_FETCH_SQL),
    "body_ledger": (body_ledger, BODY_LEDGER_SQL),
    "known_problems": (known_problems, KNOWN_PROBLEMS_SQL),
    "opml_report": (opml_report, OPML_REPORT_SQL),
    "story_neighbours": (story_neighbours, None),
    "page_folios": (page_folios, None),
    "offset_parse": (offset_parse, OFFSET_PARSE_SQL),
    "hit_test": (hit_test, HIT_TEST_SQL),
    "ledger_bounded": (ledger_bounded, LEDGER_BOUNDED_SQL),
}

"""Closed forms against plain sequential models, readers against cases, and the shape of the entry points."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import layout
from folioflow.operators.content import article_run, text_to_blocks, truncation
from folioflow.operators.ordering import ranked, running, sequenced, with_previous
from folioflow.operators.selection import fair_budget, first_printed, item_key, page_budget, reading_order, section_order
from folioflow.sources import feeds, html, http, markup
from folioflow.sources.store import read_index, story_pages, write_edition
from folioflow.streaming.gestures import gesture_stream, recognise
from folioflow.session import shared_folder
from folioflow.streaming.state_table import StateTable

BLOCKS = "array<struct<pos int, type string, level int, ordered boolean, list_index int, text string, runs array<struct<start int, length int, flags tinyint>>, src string>>"


def block(text, kind="paragraph", pos=0):
    return (pos, kind, 0, False, 0, text, [], None)


def test_entry_points():
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert "edition_select" in queries and set(oracle) <= set(queries)


def test_fair_budget_gives_four_each(spark):
    rows = [(s, k, datetime(2026, 1, 1) + timedelta(days=k)) for s, n in ((1, 20), (2, 6), (3, 6)) for k in range(n)]
    df = spark.createDataFrame(rows, "section_pos int, item_id int, published timestamp_ntz")
    got = fair_budget(df, 12, 2, "item_id").groupBy("section_pos").count().collect()
    assert {r.section_pos: r["count"] for r in got} == {1: 4, 2: 4, 3: 4}
    assert fair_budget(df, 0, 2, "item_id").count() == 32


@pytest.mark.parametrize("seed", range(5))
def test_fair_budget_against_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(0, 8) for _ in range(4)]
    most, floor = rng.randint(1, 20), rng.randint(0, 4)
    took = [0] * 4
    left = most
    for i in range(4):
        took[i] = min(floor, sizes[i], left)
        left -= took[i]
    while left and any(t < s for t, s in zip(took, sizes, strict=True)):
        for i in range(4):
            if left and took[i] < sizes[i]:
                took[i] += 1
                left -= 1
    df = spark.createDataFrame([(i, k) for i in range(4) for k in range(sizes[i])] or [(9, 0)], "section_pos int, item_id int").withColumn("published", F.lit(None).cast("timestamp_ntz")).filter("section_pos < 9")
    got = {r.section_pos: r["count"] for r in fair_budget(df, most, floor, "item_id").groupBy("section_pos").count().collect()}
    assert [got.get(i, 0) for i in range(4)] == took


def test_page_budget_overshoots_once(spark):
    df = spark.createDataFrame([(k, 3) for k in range(10)], "pos int, page_count int")
    assert [r.first_page for r in page_budget(df, 7, "pos").orderBy("pos").collect()] == [0, 3, 6]


def test_reading_order_and_sections(spark):
    df = spark.createDataFrame([(1, "a", datetime(2026, 1, 3)), (2, "a", None), (3, "b", datetime(2026, 1, 1)), (4, "b", None)], "composed_pos int, section string, published timestamp_ntz")
    assert [r.composed_pos for r in reading_order(df).orderBy("reading_pos").collect()] == [3, 4, 1, 2]
    order = section_order(spark.createDataFrame([(2, "x"), (1, "y"), (3, "y")], "feed_pos int, section string"))
    assert {r.section: r.section_pos for r in order.collect()} == {"y": 1, "x": 2}


def test_keys_and_first_printed(spark):
    df = spark.createDataFrame([("g", "l", "t", 1), ("", "l", "t", 2), (None, None, "t", 3), (None, "l", "t", 4)], "guid string, link string, title string, n int").withColumn("published", F.lit(None).cast("timestamp_ntz"))
    keyed = df.withColumn("item_key", item_key(F.col("guid"), F.col("link"), F.col("title"), F.col("published")))
    assert [r.item_key for r in keyed.orderBy("n").collect()] == ["g:g", "l:l", "t:t|", "l:l"]
    assert sorted(r.n for r in first_printed(keyed, F.col("n")).collect()) == [1, 2, 3]


def test_ordering_matches_windows(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice("aaaaab"), rng.randint(0, 50)) for i in range(500)], "id int, g string, v int")
    got = {r.id: r["rank"] for r in ranked(df, "g", F.col("v"), F.col("id")).collect()}
    want = {r.id: r.k for r in df.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert got == want
    rows = sequenced(df, F.col("g"), F.col("v"), F.col("id"))
    whole = Window.orderBy("g", "v", "id").rowsBetween(Window.unboundedPreceding, 0)
    for kind in ("sum", "max"):
        want = {r.id: r.x for r in df.withColumn("x", getattr(F, kind)("v").over(whole)).collect()}
        assert {r.id: r.x for r in running(rows, F.col("v"), "x", kind).collect()} == want
    want = {r.id: r.x for r in df.withColumn("x", F.lag("v").over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert {r.id: r.previous_v for r in with_previous(rows, "g", "v").collect()} == want
    assert ranked(df.filter("id < 0"), "g", F.col("v")).count() == 0


def test_truncation_cases(spark):
    def reason(blocks, source="full-content", link="x"):
        df = spark.createDataFrame([(blocks, source, link)], f"blocks {BLOCKS}, source string, link string")
        size = F.aggregate(F.coalesce("blocks", F.array()), F.lit(0), lambda n, b: n + F.octet_length(b.text))
        return df.select(truncation(F.col("blocks"), F.col("source"), size, F.col("link")).alias("r")).first().r

    long = "word " * 150
    assert reason([]) == reason(None) == reason([block("a")], "summary") == "summary-only"
    assert reason([block(long + "…")]) == reason([block(long + "..."), block("")]) == "ellipsis-tail"
    assert reason([block(long + "Read MORE")]) == reason([block("é" * 300 + " [...]. " + "é" * 20)]) == "read-more-link"
    assert reason([block("read on " + long)]) == "none" and reason([block(""), block("")]) == "very-short"
    assert reason([block("short")]) == "very-short" and reason([block("short")], link="") == "none"


def test_article_run(spark):
    nav, body = [block("Home", "list-item")] * 4, [block("x" * 200), block("Head", "heading"), block("y" * 300)]
    df = spark.createDataFrame([(1, nav + body + nav), (2, nav), (3, []), (4, None)], f"id int, blocks {BLOCKS}")
    got = {r.id: r.run for r in df.select("id", article_run(F.col("blocks")).alias("run")).collect()}
    assert (got[1].first, got[1].last, got[1].score) == (4, 6, 110 - 30 + 210)
    assert got[2] is got[3] is got[4] is None


def test_text_to_blocks(spark):
    got = spark.createDataFrame([("a\n b\n \t\nc\n\n\n",), ("",), (None,)], "t string").select(text_to_blocks(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [["a b", "c"], [], None]


@pytest.mark.parametrize(
    ("page", "shape"),
    [
        ("<h2>Title</h2><p>One.</p><p>Two.</p>", ["heading2:Title", "paragraph0:One.", "paragraph0:Two."]),
        ("<p>a<br>b  c</p>", ["paragraph0:a\nb c"]),
        ("<script>if (a<b) x</script>ok", ["paragraph0:ok"]),
        ("<ol><li>x<li>y</ol>", ["list-item1:x", "list-item1:y"]),
        ("<blockquote><p>q</p><blockquote>r</blockquote></blockquote>s", ["blockquote1:q", "blockquote2:r", "paragraph0:s"]),
        ("<pre>  a\n b </pre>", ["code0:a\n b"]),
        ("<img alt='x  y'><hr><img>", ["image0:x y", "rule0:"]),
        ("caf&eacute; &unknown; &#8217; &#150; a < b", ["paragraph0:café &unknown; ’ – a < b"]),
        ("<p>unclosed <b>bold", ["paragraph0:unclosed bold"]),
        ("<figcaption>c</figcaption><table><tr><td>d</td></tr></table>", ["caption0:c", "paragraph0:d"]),
        ("", []),
        (None, []),
    ],
)
def test_html_shapes(page, shape):
    assert [f"{b['type']}{b['level']}:{b['text']}" for b in html.html_blocks(page)] == shape


def test_html_runs_are_bytes_and_caps_hold():
    (b,) = html.html_blocks("<p>é <b>bold <i>both</i></b> x</p>")
    raw = b["text"].encode()
    assert [(raw[r["start"] : r["start"] + r["length"]].decode(), r["flags"]) for r in b["runs"]] == [("bold", 1), ("both", 3)]
    limits, lost = html.Limits(), Counter()
    assert len(html.html_blocks("<p>x" * 2000, limits, lost)) == limits.blocks and lost["blocks"] == 1400
    assert len(html.html_blocks("<p>" + "é" * 9000, limits, lost)[0]["text"].encode()) == limits.block_bytes and lost["texts"] == 1
    assert len(html.html_blocks("<p>x" * 700, html.NO_LIMITS)) == 700
    assert html.html_blocks("<p>" + "é" * 5000 + "<img alt=x>" * 700, html.NO_LIMITS)[0]["text"] == "é" * 5000


@pytest.mark.parametrize("page", ["<a b ", "<a '", "<a \"'", "<!", "<!-", "<![CDATA[", "<a", "<script>", "<p>&am", "</", "<a b=' <a c=\" >"])
def test_reading_takes_time_in_proportion(page):
    """Ten times the text takes about ten times as long, and not a hundred; a quadratic reader would take minutes."""
    start = time.process_time()
    list(markup.tokens(page * 30_000))
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    ("text", "read"),
    [
        ("<a b='x>y' c>t", [("start", "a", {"b": "x>y", "c": ""}, False), ("text", "t")]),
        ("<a b='x>y", [("text", "<"), ("text", "a b='x>y")]),
        ("1 < 2 <b/>", [("text", "1 "), ("text", "<"), ("text", " 2 "), ("start", "b", {}, True)]),
        ("<!doctype x><!-- a > b --></B >", [("end", "b")]),
        ("<![CDATA[<i>]]>&lt;", [("text", "<i>"), ("text", "<")]),
        ("<! x", [("text", "<"), ("text", "! x")]),
    ],
)
def test_tokens(text, read):
    assert list(markup.tokens(text)) == read


def test_whole_texts_come_back(spark, tmp_path):
    import __spark_entry__ as e

    texts = ["Short\n" + "Long line É & <tag>. " * 40 + "end", "x" + "é" * 9000, "A\n\n  b  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(k, n, line) for k, t in enumerate(texts) for n, line in enumerate(["Home", *filter(None, (" ".join(x.split()) for x in t.split("\n"))), "© 2026"])}
    assert {(r.doc_id, r.pos, r.text) for r in e.queries()["html_blocks"](spark, str(tmp_path)).collect()} == want
    assert {(r.doc_id, r.kept, r.blocks_cut, r.texts_cut) for r in e.queries()["html_limited"](spark, str(tmp_path)).collect()} == {(0, 4, 0, 0), (1, 3, 0, 1), (2, 4, 0, 0)}


def test_links_find_their_latest_document(spark):
    from folioflow.operators.content import enriched

    links = [(1, "HTTPS://A.example/x#top", "cut"), (2, "https://a.example/y", "cut"), (3, "none", "cut"), (4, " http://a.example/x", "cut"), (5, None, "cut"), (6, "https://a.example/x", "none")]
    items = spark.createDataFrame([(k, x, t, [block("own"), block("")]) for k, x, t in links], f"item_id bigint, link string, truncation string, blocks {BLOCKS}")
    pages = [(7, "https://a.example:443/x", datetime(2026, 2, 1), "old"), (8, "https://a.example/x", datetime(2026, 2, 2), "one\n\ntwo"), (9, "https://a.example/z", datetime(2026, 2, 3), "z"), (10, None, None, None)]
    documents = spark.createDataFrame(pages, "doc_id bigint, url string, crawled_at timestamp_ntz, text string")
    got = {r.item_id: (r.doc_id, r.paragraphs) for r in enriched(items, documents).collect()}
    assert got == {1: (8, ["one", "two"]), 2: (None, ["own"]), 3: (None, ["own"]), 4: (None, ["own"]), 5: (None, ["own"])}


RSS = """<?xml version="1.0"?><rss><channel><title>The &amp; Feed</title><image><title>no</title></image>
<item><title><![CDATA[A <b>bold</b> &#8217; title]]></title><description>&lt;p&gt;short&lt;/p&gt;</description><content:encoded><![CDATA[<p>long text</p>]]></content:encoded>
<media:title>no</media:title><author>ed@x.example (Ed B)</author><pubDate>Tue, 04 Nov 2025 11:00:00 GMT</pubDate><guid>g1</guid><link>https://x.example/1</link></item>
<item><title>Second</title><description>only this</description>"""


def test_feed_reading():
    feed = feeds.parse_feed(RSS)
    one, two = feed["items"]
    assert (feed["format"], feed["title"]) == ("rss", "The & Feed")
    assert (one["title"], one["author"], one["content_source"], one["blocks"][0]["text"], one["guid"]) == ("A bold ’ title", "Ed B", "full-content", "long text", "g1")
    assert one["summary_text"] == "short" and two["content_source"] == "summary" and two["title"] == "Second"
    assert feeds.parse_feed(RSS, 1)["stopped_early"] and feeds.parse_feed(RSS, 0)["items"] == []
    assert feeds.parse_feed("not xml at all")["items"] == feeds.parse_feed(None)["items"] == []


def test_atom_reading():
    text = "<feed><title>F</title><entry><title>T</title><link rel='self' href='no'/><link href='yes'/><author><name>N</name></author><updated>2026-01-01</updated><content type='xhtml'><div><p>x</p><img src='i'/></div></content></entry></feed>"
    (item,) = feeds.parse_feed(text)["items"]
    assert (item["link"], item["author"], item["published_raw"], [b["type"] for b in item["blocks"]]) == ("yes", "N", "2026-01-01", ["paragraph", "image"])


def test_bytes_entities_and_clip():
    assert markup.decode_bytes(b"\xef\xbb\xbfab") == "ab" and markup.decode_bytes(b"<?xml encoding='iso-8859-1'?>\x93\x81") == "<?xml encoding='iso-8859-1'?>“\x81"
    assert html.clip("word " * 200, 480).endswith("word…") and len(html.clip("é" * 500, 480).encode()) <= 483 and html.clip("a", 1) == "a"


def test_opml_and_config(spark):
    text = "<opml><body><outline text='Tech'><outline text='deep'><outline text='A' xmlUrl='u1'/></outline></outline><outline text='Unsorted'><outline text='B' xmlUrl='u2'/></outline><outline xmlUrl='u1' text='again'/></body></opml>"
    assert [(f["url"], f["section"]) for f in feeds.parse_opml(text)] == [("u1", "Tech"), ("u2", "News"), ("u1", "News")]
    merged = feeds.opml_feeds(spark.createDataFrame([(1, text), (2, text), (3, None)], "file int, xml string"), "xml", "file")
    assert {(r.url, r.section) for r in merged.collect()} == {("u1", "Tech"), ("u2", "News")}
    config = feeds.read_config(feeds.write_config([{"url": 'a"b', "section": "S"}, {"url": "c", "section": "T"}]))
    assert [(f["url"], f["section"], f["max_items"]) for f in config["feeds"]] == [('a"b', "S", 6), ("c", "T", 6)]
    for bad in ("", "[[feed]]\nsection='x'", "[[feed"):
        with pytest.raises(ValueError):
            feeds.read_config(bad)


def test_http_bodies():
    assert http.read_body(b"abcdef", 3, False) == (b"abc", True) and http.read_body(b"ab", 3, False) == (b"ab", False) and http.read_body(b"ab", None, False) == (b"ab", True)
    assert http.read_body(b"3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n", None, True) == (b"abcde", True)
    assert http.read_body(b"3\r\nab", None, True) == (b"ab", False) and http.read_body(b"zz\r\n", None, True) == (b"", False)


def test_hyphens_and_pages():
    h = layout.Hyphenator(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"], ["as-so-ciate", "present"])
    assert h.breaks("hyphenation") == [2, 6] and h.breaks("associate") == [2, 4] and h.breaks("present") == h.breaks("tiny") == h.breaks("naïvety") == []
    assert layout.read_patterns("% c\n\\patterns{ .ab1c % x\n 2de }") == [".ab1c", "2de"]
    text = "some words to be set in lines " * 80
    lines = layout.break_lines(text, 300, 36)
    assert " ".join(lines).split() == text.split() and all(layout.advance(x, 36) <= 300 for x in lines)
    flow = [{"role": "paragraph", "text": text}] * 6 + [{"role": "heading", "text": "Head", "keep": True}, {"role": "paragraph", "text": text}]
    pages = layout.paginate(flow, 2, layout.Hyphenator(layout.rule_patterns()))
    assert len(pages) > 2 and all(top + 36 <= layout.PAGE_HEIGHT for p in pages for _, top in p)
    assert layout.paginate([]) == []
    words = "to be set in"
    for align, first, last in (("left", 0, None), ("right", None, 300), ("justify", 0, 300)):
        placed = layout.place_words(words, 300, 36, align)
        assert [w for w, _ in placed] == words.split() and (first is None or placed[0][1] == first)
        assert last is None or abs(placed[-1][1] + layout.advance("in", 36) - last) <= 1
    assert layout.place_words(words, 300, 36, "justify", last=True) == layout.place_words(words, 300, 36)


def test_gestures(spark):
    def run(samples):
        """The gestures, the same whether the samples come at once or one by one."""
        frame = pd.DataFrame(samples, columns=["touching", "x", "y", "ts_ms"])
        whole, state, one_by_one = [g for _, _, g, _, _ in recognise("d", frame)[0]], (None, -(2**62)), []
        for k in range(len(frame)):
            found, *state = recognise("d", frame.iloc[k : k + 1], *state)
            one_by_one += [g for _, _, g, _, _ in found]
        assert one_by_one == whole
        return whole

    assert run([(True, 0, 0, 0), (False, 0, 0, 50)]) == ["tap"]
    assert run([(True, 0, 0, 0), (True, 0, 0, 700), (False, 0, 0, 800)]) == ["long-press"]
    assert run([(True, 0, 0, 0), (True, 60, 5, 100), (False, 0, 0, 110)]) == ["swipe-right"]
    assert run([(True, 0, 0, 0), (True, 60, 5, 950), (False, 0, 0, 1000)]) == []
    assert run([(True, 0, 0, 0), (False, 0, 0, 50), (True, 0, 0, 100), (False, 0, 0, 150)]) == ["tap"]
    assert run([(True, 0, 0, 0), (False, 0, 0, 50), (True, 0, 0, 160), (True, 0, 0, 175), (True, 0, -50, 200), (False, 0, 0, 210), (False, 0, 0, 300)]) == ["tap", "swipe-up"]
    assert run([(True, 0, 0, 0), (True, 20, 0, 100), (True, 0, 0, 700), (True, None, 0, 750), (False, 0, 0, 800)]) == ["tap"]
    assert run([]) == []
    folder = shared_folder(spark, "touches")
    schema = "device string, ts_ms bigint, touching boolean, x int, y int"
    for part in ([("d", 0, True, 0, 0), ("d", 100, True, 0, -60)], [("d", 120, False, 0, 0), ("e", 0, False, 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = gesture_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("gestures").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.gesture for r in spark.table("gestures").collect()] == ["swipe-up"]


def test_state_table_is_idempotent(spark):
    table = StateTable(spark, shared_folder(spark, "state") + "/t", ["k"], lambda: [F.min("v").alias("v")], 4)
    assert table.read() is None
    table.upsert(spark.createDataFrame([], "k string, v int"))
    for batch in ([("a", 3), ("b", 1)], [("a", 2), ("c", 9)], [("a", 2), ("c", 9)]):
        table.upsert(spark.createDataFrame(batch, "k string, v int"))
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", 2), ("b", 1), ("c", 9)}


def test_store_keeps_the_old_edition_when_nothing_is_new(spark):
    path = shared_folder(spark, "store")
    stories = spark.createDataFrame([(1, 2, [(0, ["a"]), (1, ["b"])]), (2, 1, [(0, ["c"])])], "composed_pos int, page_count int, pages array<struct<page int, lines array<string>>>")
    assert write_edition(stories, path, "d1") and not write_edition(stories.filter("composed_pos > 5"), path, "d1")
    assert read_index(spark, path, "d1").count() == 2 and [r.lines for r in story_pages(spark, path, "d1", 1).orderBy("page").collect()] == [["a"], ["b"]]


def test_reading_session():
    from folioflow.streaming.reader import Session

    s = Session([2, 0, 1])
    assert s.act("swipe-right") and (s.mode, s.at) == ("article", 0)
    assert s.act("swipe-down") and s.page == 1 and not s.act("swipe-down") and s.act("swipe-up") and not s.act("tap")
    assert s.act("swipe-right") and (s.at, s.read) == (2, {0, 2})  # the story without pages is passed over unmarked
    assert s.act("swipe-right") and (s.mode, s.at) == ("finished", 2) or s.at == 2
    s = Session([1, 1])
    assert s.act("tap") and s.armed and s.act("swipe-left") and not s.armed and not s.read
    assert s.act("tap") and s.act("tap") and s.read == {0, 1} and s.act("swipe-right") and s.mode == "finished"
    assert not s.act("swipe-left") and s.act("long-press") and s.mode == "home" and not s.act("long-press")
    assert not Session([]).act("swipe-up") and Session([]).act("swipe-right")


def test_bounded_sources_and_answers(spark, tmp_path):
    from folioflow.operators import extras

    (tmp_path / "a.txt").write_bytes("ééé".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    files = {r.path.rsplit("/", 1)[-1]: (bytes(r.content), r.length, r.truncated) for r in extras.read_files(spark, str(tmp_path), 3).collect()}
    assert files == {"a.txt": ("ééé".encode()[:3], 6, True)}
    df = spark.createDataFrame([(1, b"abc", None), (2, b"abc", "900150983cd24fb0d6963f7d28e17f72"), (3, None, None), (4, b"\xc3\xa9\xff", "x")], "k int, body binary, tag string")
    got = {r.k: r.a for r in df.select("k", extras.conditional_answer(F.col("body"), F.col("tag"), 2).alias("a")).collect()}
    assert [(got[k].status, got[k].truncated) for k in (1, 2, 3, 4)] == [(200, True), (304, False), (404, False), (200, True)] and bytes(got[1].body) == b"ab" and got[2].body is None
    text = {r.k: r.t for r in df.select("k", extras.repaired_utf8(F.col("body")).alias("t")).collect()}
    assert (text[1].text, text[1].valid, text[4].text, text[4].valid, text[3].text) == ("abc", True, "é�", False, None)


def test_bodies_are_kept_until_a_new_one_comes(spark):
    from folioflow.operators.extras import kept_bodies

    at = lambda d: datetime(2026, 1, d)
    rows = [("a", at(1), 1, 200, "e1", "one"), ("a", at(2), 2, 304, None, None), ("b", at(1), 3, 200, "e2", "two"), ("b", at(3), 4, 500, None, None), ("c", at(1), 5, 304, None, None), ("d", at(1), 6, 0, None, None), ("a", at(1), 7, 200, "e3", "new"), ("e", None, 8, 200, None, "x")]
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp_ntz, seq int, status int, etag string, body string")
    got = {r.url: (r.body, r.etag, r.checked_at, r.problem) for r in kept_bodies(df).collect()}
    assert got == {"a": ("new", "e3", at(2), None), "b": ("two", "e2", at(1), "status 500"), "c": (None, None, at(1), "status 304"), "d": (None, None, None, "status 0"), "e": ("x", None, None, None)}
    assert kept_bodies(df.filter("seq < 0")).count() == 0


def test_small_arithmetic(spark):
    from folioflow.operators import extras

    df = spark.createDataFrame([("+90",), ("-1440",), ("1441",), ("x",), ("",), (None,), ("9" * 40,)], "t string")
    assert [r.m for r in df.select(extras.offset_minutes(F.col("t")).alias("m")).collect()] == [90, -1440, None, None, None, None, None]
    assert [r.p for r in spark.createDataFrame([(7,), (8,), (24,), (-9,)], "v int").select(extras.to_px(F.col("v")).alias("p")).collect()] == [0, 1, 2, -1]
    box = F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(2).alias("width"), F.lit(0).alias("height"))
    assert spark.range(1).select(extras.inside(F.lit(1), F.lit(1), box)).first()[0] is False

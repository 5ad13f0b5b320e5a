"""Summaries and bodies that end before their author ended them.

A text whose last sentence has its mark is complete, unless the mark only belongs to an abbreviation. A sign of a cut (ellipsis, "read
more") makes a case by itself. Any other end without a mark is left open, and is a case only with evidence:

- ``word``: the trie of the corpus's words knows the last word as the beginning of other words, and not as a word;
- ``bytes``: more bytes were counted when the item was parsed than its blocks hold, or the delivered hint says that the body was cut;
- ``length``: it ends at a length at which texts of the field end again and again, and doesn't open like a caption;
- ``continuing``: its last word is one that hardly ever ends a sentence or a text of the corpus;
- ``sentence``: its author ended the sentences before with marks;
- ``opening``: texts of the corpus that begin with the same two words, or one where those are rare, end with a mark, all but a few.

So a caption, a headline or a signature without a mark is complete. The known words and their beginnings are a trie kept as a table, one row
per node; of its nodes only those are made at which an open text ends, whatever the length of the words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.datetimes import let
from folioflow.llm.boilerplate import repeated_blocks
from folioflow.llm.duplicates import record_key
from folioflow.session import bounded_broadcast, cut

RUNNING = ("paragraph", "blockquote")
EVIDENCES = ("sign", "word", "bytes", "length", "continuing", "sentence", "opening")
# Delivered hints that name a cut at the end of the body.
BODY_HINTS = ("ellipsis-tail", "read-more-link")
HEAD = 3  # letters by which wanted nodes are grouped

# Phrases of a link to the rest of a text.
_MORE = "read more|read on|read the rest|continue reading|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|читать далее|читать дальше"
_BLANKS = r"[\s\p{Z}\x{200b}\x{feff}]+$"
_TAIL = r"(?:\s+(?:https?://\S+|[\p{So}\x{fe0f}\x{200d}]+))+$"
_TURNED = "|".join(phrase[::-1] for phrase in _MORE.split("|"))
# what may stand at an end, read from the last character back: so a text without it is told by its first few characters
_SIGN = rf"(?iu)^(?:\](?:…|\.{{3}})\[|…|\.{{3}}|[^\p{{L}}]*(?:{_TURNED})[\[(]?)"
_LINK = rf"(?iu)^[^\p{{L}}]*(?:{_TURNED})[\[(]?\s+[.!?。．！？”»\"]"
# a short name after a dash, or after what a wrong encoding made of it, behind the last sentence
_SIGNED = r"^[^.!?]{1,40}(?:\s*[—–-]+|\s+[^\x{00}-\x{7f}\sЀ-ӿ]{3,9})\s+[\"”»“’)]*[.!?。．！？…]"
_ENDED = r"^(?:[\"'”»“’‘)\]）]*[.!?。．！？…]|[)\]）”»\"]|[^\x{00}-\x{7f}\s]{1,8}[.!?…])"
# a sentence that ends inside the text: a word, its mark, and a new sentence
_INNER = r"(?:\p{L}{4,}[\"”»“’)]*[.!?…][\"'”»“’)\]]*\s+[\"'„“”«»‘’¿¡(\[–—-]*\s?[\p{Lu}\p{N}]|[。！？].)"
_STOP = r"[.!?…。！？][\"'”»“’)\]]*$"
# what stands at an end is in the last 80 characters or nowhere, unless they hold such a run
_LONG_RUN = r"[^\p{L}]{20}"
NEAR = 80
# a letter and a plain mark, but not the last word of a phrase above
_PLAIN = rf"(?iu)\p{{L}}(?=[.!?]$)(?<!(?:{'|'.join(sorted({p.split()[-1] for p in _MORE.split('|')}))}))"


def _plain_word(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}€£$]+|[^\p{L}\p{N}]+$", "")


def _stripped(text: Column) -> Column:
    """The text without blanks, links and pictures at its end."""
    return F.regexp_replace(F.regexp_replace(text, _BLANKS, ""), _TAIL, "")


def stripped_end(text: Column) -> Column:
    """struct(end, off): a last part of the stripped text, on which every pattern tells the same as on the whole, and how much was stripped.

    Twice ``NEAR`` characters do where, after stripping, ``NEAR`` are left and a word begins among them; else the whole text is taken.
    """

    def of(part: Column) -> Column:
        return let(_stripped(part), lambda s: F.struct(s.alias("end"), (F.length(part) - F.length(s)).alias("off")))

    def checked(x: Column) -> Column:
        return F.when((F.length(x.end) >= NEAR) & x.end.rlike(r"\s\S+$") & ~x.end.rlike(_LONG_RUN), x).otherwise(of(text))

    return F.when(F.length(text) <= 2 * NEAR, of(text)).otherwise(let(of(F.right(text, F.lit(2 * NEAR))), checked))


def _ending(text: Column, pos: Column) -> Column:
    """What tells a cut: struct(pos, size, sign, ended, inner, word, one, two) with the last word and hashes of the first word and the first two.

    ``size`` counts the text without trailing links and pictures. Patterns are tried only where the text doesn't end in a letter and a plain mark, or
    could end in a link to the rest.
    """

    def as_told(end: Column, size: Column, sign: Column, ended: Column, inner: Column) -> Column:
        two = F.translate(F.substring_index(text, " ", 2), "123456789", "000000000")  # digits made equal
        one = F.xxhash64(F.substring_index(two, " ", 1))
        return F.struct(pos.alias("pos"), size.cast("int").alias("size"), sign.alias("sign"), ended.alias("ended"), inner.alias("inner"), F.substring_index(end, " ", -1).alias("word"), one.alias("one"), F.xxhash64(two).alias("two"))

    def told(x: Column) -> Column:
        link = lambda back: back.rlike(_LINK)
        marks = let(F.reverse(x.end), lambda back: F.struct((back.rlike(_SIGN) & ~link(back)).alias("sign"), (back.rlike(_ENDED) | back.rlike(_SIGNED) | link(back)).alias("ended")))
        return let(marks, lambda m: as_told(x.end, F.length(text) - x.off, m.sign, m.ended, F.when(m.sign | m.ended, F.lit(False)).otherwise(text.rlike(_INNER))))

    plain = F.right(text, F.lit(13)).rlike(_PLAIN)
    complete = as_told(F.when(F.endswith(text, F.lit(".")), text), F.length(text), F.lit(False), F.lit(True), F.lit(False))
    return F.when(plain, complete).otherwise(let(stripped_end(text), told))


def story_of(items: DataFrame) -> Column:
    """A number that the copies of a story share, by problem 2's key; a row without guid, link and title is a story of its own."""
    parts = [F.col(c) if c in items.columns else F.lit(None).cast("string") for c in ("guid", "link", "title")]
    return F.when(F.coalesce(*parts).isNull(), F.xxhash64("item_id")).otherwise(F.xxhash64(record_key(*parts)))


def values_with_ends(items: DataFrame, line_rows: int = 10, line_share: float = 0.002) -> DataFrame:
    """(item_id, source_name, field, size, sign, ended, inner, lost, word, one, two): summaries, and the last running block of bodies.

    Repeated lines of the source (in ``line_rows`` stories and ``line_share`` of them), headings, captions and lists don't count as running text; lines are counted by distinct stories, as a
    story that is delivered often repeats its own text. ``lost`` is true where ``text_bytes`` is more than the blocks hold or ``truncation`` names a cut of the body; ``items`` may lack these two columns.
    Texts are judged where they are read; only what was found of each is shuffled to meet the repeated lines.
    """
    rows = items.withColumn("source_name", F.coalesce("source_name", F.lit("")))
    texts = rows.withColumn("blocks", F.filter("blocks", lambda b: b.type.isin(*RUNNING)))  # no other block is ever judged
    gone = repeated_blocks(texts, line_rows, line_share, story_of(rows)).groupBy("item_id").agg(F.collect_set("pos").alias("gone"))  # at most the blocks of one item
    running = F.filter(F.coalesce("blocks", F.array()), lambda b: b.type.isin(*RUNNING) & F.coalesce(b.text.rlike(r"\S"), F.lit(False)))
    stored = F.aggregate(F.coalesce("blocks", F.array()), F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.octet_length(b.text), F.lit(0)))
    fewer = F.coalesce(F.col("text_bytes") > stored, F.lit(False)) if "text_bytes" in items.columns else F.lit(False)
    hinted = F.coalesce(F.col("truncation").isin(*BODY_HINTS), F.lit(False)) if "truncation" in items.columns else F.lit(False)
    found = rows.select(
        "item_id",
        "source_name",
        F.when(F.col("summary_text").rlike(r"\S"), _ending(F.col("summary_text"), F.lit(-1))).alias("summary"),
        F.transform(running, lambda b: _ending(b.text, b.pos)).alias("ends"),
        (fewer | hinted).alias("lost"),
    )
    left = F.filter("ends", lambda e: ~F.coalesce(F.array_contains(F.col("gone"), e.pos), F.lit(False)))
    body = found.join(gone, "item_id", "left").withColumn("body", F.try_element_at(left, F.lit(-1)))
    fields = F.array(
        F.struct(F.lit("summary").alias("field"), F.lit(False).alias("lost"), F.col("summary").alias("e")),
        F.struct(F.lit("body").alias("field"), F.col("lost"), F.col("body").alias("e")),
    )
    each = body.select("item_id", "source_name", F.inline(F.filter(fields, lambda f: f.e.isNotNull())))
    return each.select("item_id", "source_name", "field", "lost", "e.size", "e.sign", "e.ended", "e.inner", "e.word", "e.one", "e.two")


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n, last): how often each white-space separated word of a batch stands in a text, and at the end of one."""
    for batch in batches:
        inside: Counter = Counter()
        last: Counter = Counter()
        for text in batch["text"]:
            words = text.split()
            last.update(words[-1:])
            inside.update(words[:-1])
        words = list(inside | last)
        yield pd.DataFrame({"word": pd.Series(words, dtype=object), "n": [inside[w] for w in words], "last": [last[w] for w in words]})


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, ends, dotted, dotted_last): words without signs around them; how often each stands inside a text, ends a sentence or text, and has a full stop.

    ``n`` leaves out last words of texts, which may be cut; ``dotted`` counts a full stop inside texts, ``dotted_last`` at their end.
    """
    counted = texts.mapInPandas(count_words, "word string, n bigint, last bigint")
    stop, dot = F.col("word").rlike(_STOP), F.endswith("word", F.lit("."))
    plain = counted.select(_plain_word(F.col("word")).alias("word"), "n", "last", F.when(stop, F.col("n")).otherwise(0).alias("stopped"), F.when(dot, F.col("n")).otherwise(0).alias("dotted"), F.when(dot, F.col("last")).otherwise(0).alias("dotted_last"))
    return plain.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), (F.sum("stopped") + F.sum("last")).alias("ends"), F.sum("dotted").alias("dotted"), F.sum("dotted_last").alias("dotted_last"))


def trie(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words, here): of each ``node`` of ``wanted``, how many ``words`` (word, n) begin with it and how often it is a word itself.

    The nodes of the words' trie are made only at the lengths that wanted nodes with the same first letters have, so a word of any length
    makes no more nodes than that. Nodes that no word reaches have no row.
    """
    head = lambda word, k: F.substring(word, F.lit(1), F.lit(k))
    lengths = wanted.select(head(F.col("node"), HEAD).alias("head"), F.length("node").alias("length")).groupBy("head").agg(F.collect_set("length").alias("lengths"))
    heads = F.array_distinct(F.array(*[head(F.col("word"), k) for k in range(1, HEAD + 1)]))
    reached = words.select("word", "n", F.explode(heads).alias("head")).join(bounded_broadcast(lengths), "head")
    fits = F.filter("lengths", lambda k: k <= F.length("word"))
    nodes = reached.select("word", "n", F.explode(F.transform(fits, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("node"))
    whole = F.col("word") == F.col("node")
    # each node is one head's, as shorter heads are shorter nodes: nothing is counted twice
    return nodes.groupBy("node").agg(F.count_if(~whole).alias("words"), F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("here")).join(wanted.select("node").distinct(), "node", "left_semi")


def truncated(
    items: DataFrame,
    least_words: int = 2,
    pile_share: float = 0.01,
    pile_least: int = 8,
    ends_share: float = 0.02,
    ends_least: int = 20,
    opening_share: float = 0.1,
    caption_share: float = 0.7,
    evidences: tuple[str, ...] = EVIDENCES,
) -> DataFrame:
    """(item_id, source_name, field, evidence) of every summary and body that was cut; evidence is the first of ``EVIDENCES`` that tells so.

    A known word stands ``least_words`` times inside texts. A length is one at which a ``pile_share`` of the field's open or signed ends, and
    ``pile_least``, stand. A word is continuing when it was seen ``ends_least`` times and no more than ``ends_share`` of them at an end; so is an
    abbreviation, that is a word hardly ever without its full stop, which hardly ever ends a text. An opening tells where ``ends_least`` texts have it
    and at most ``opening_share`` of them stay open; where ``caption_share`` do, it is a caption's. ``evidences`` names those that may tell.

    Null, empty and blank texts are not cut, nor are bodies without running text, and texts that end in a signature, a
    link or a picture. Repeated item rows are judged each. Extra columns are ignored; a table without rows gives none.
    """
    ends = cut(values_with_ends(items))
    texts = items.select(F.explode(F.concat(F.array("summary_text"), F.coalesce(F.transform("blocks", lambda b: b.text), F.array()))).alias("text")).filter(F.col("text").isNotNull())
    words = cut(vocabulary(texts))
    seen = F.col("n") + F.col("ends")
    continuing = words.filter((seen >= ends_least) & (F.col("ends") <= ends_share * seen)).select("word", F.lit(True).alias("continuing"))
    short = (F.col("dotted") >= ends_least) & (F.col("n") - F.col("dotted") <= 0.05 * F.col("dotted")) & (F.col("dotted_last") <= ends_share * F.col("dotted"))
    abbreviations = words.filter(short).select("word", F.lit(True).alias("abbreviation"))
    open_ = ends.filter(~F.col("sign") & ~F.col("ended")).withColumn("word", _plain_word(F.col("word")))
    wanted = open_.filter("word <> ''").groupBy(F.col("word").alias("node")).agg(F.count("*").alias("uses"))
    nodes = trie(words.filter(F.col("n") >= least_words).select("word", "n"), cut(wanted)).filter("words > 0 and here = 0").select(F.col("node").alias("word"), F.lit(True).alias("begins"))
    # lengths at which a hundredth or more of a field's unfinished values end: at most a hundred per field
    stopped = ends.filter(F.col("sign") | ~F.col("ended")).groupBy("field", "size").agg(F.count("*").alias("n"))
    least = stopped.groupBy("field").agg(F.greatest(F.lit(float(pile_least)), pile_share * F.sum("n")).alias("least"))
    limits = stopped.join(F.broadcast(least), "field").filter("n >= least").select("field", "size", F.lit(True).alias("limit"))  # two fields
    openings = ends.select("sign", "ended", F.explode(F.array_distinct(F.array("one", "two"))).alias("opening")).groupBy("opening").agg(F.count("*").alias("n"), F.count_if(~F.col("sign") & ~F.col("ended")).alias("open"))
    habits = bounded_broadcast(openings.filter((F.col("n") >= ends_least) & (F.col("open") > 0)).select("opening", (F.col("open") / F.col("n")).alias("share")))
    judged = open_.join(nodes, "word", "left").join(F.broadcast(limits), ["field", "size"], "left").join(bounded_broadcast(continuing), "word", "left")
    for k in ("one", "two"):
        judged = judged.join(habits.select(F.col("opening").alias(k), F.col("share").alias(f"share_{k}")), k, "left")
    share = F.coalesce("share_two", "share_one")
    tells = {"word": F.col("begins"), "bytes": F.col("lost"), "length": F.col("limit") & (F.coalesce(share, F.lit(0.0)) < caption_share), "continuing": F.col("continuing"), "sentence": F.col("inner"), "opening": share <= opening_share}
    evidence = F.coalesce(*[F.when(F.coalesce(tells[e], F.lit(False)), e) for e in EVIDENCES if e in tells and e in evidences], F.lit(None).cast("string"))
    told = judged.select("item_id", "source_name", "field", evidence.alias("evidence")).filter(F.col("evidence").isNotNull())
    dotted = ends.filter(F.col("ended") & F.endswith("word", F.lit("."))).withColumn("word", _plain_word(F.col("word"))).join(bounded_broadcast(abbreviations), "word", "left_semi")
    parts = [told]
    if "continuing" in evidences:
        parts.append(dotted.select("item_id", "source_name", "field", F.lit("continuing").alias("evidence")))
    if "sign" in evidences:
        parts.append(ends.filter("sign").select("item_id", "source_name", "field", F.lit("sign").alias("evidence")))
    return reduce(DataFrame.unionByName, parts)


def _items(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/items.parquet").select("item_id", "source_name", "guid", "link", "title", "summary_text", "truncation", "text_bytes", "blocks")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return truncated(_items(spark, sf_dir)).select("item_id", "field").distinct()


def p5_shares(spark, sf_dir: str) -> DataFrame:
    """Per source how many items it delivered, how many of them were cut, and the share."""
    items = spark.read.parquet(f"{sf_dir}/items.parquet")
    cases = p5_found(spark, sf_dir).groupBy("item_id").agg(F.lit(1).alias("was_cut"))
    joined = items.select("item_id", "source_name").join(cases, "item_id", "left").groupBy("source_name").agg(F.count("*").alias("items"), F.count("was_cut").alias("cut"))
    return joined.withColumn("share", F.round(F.col("cut") / F.col("items"), 6))

"""Passages of evaluation texts inside a training corpus.

Every shard of the corpus (a stretch of whole documents of one task) gets a suffix array over its words, in the order of their first
``least`` words and then of the word before; every suffix of every test text is searched in it by bisection, and a hit is extended to the
longest match. Deeper order would tell nothing more, as all suffixes that share the first words are hits. Words that no test text
has can't be part of a match, so only suffixes whose first words are all test words are sorted: that drops no match. Hits
whose words before are equal too lie inside a longer match; the order lets them be skipped as a range, so texts that repeat
themselves cost no pairs. Documents are never shuffled. Test texts are a stated query set: they are sent to all shards, as many at once as
a bound allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.words import Chars, Words, slices

LEAST_WORDS = 12


class Tests:
    """Test texts as one sequence of word numbers (1 and up, 0 between texts), with all suffixes of at least ``least`` words."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        words = Words.of(Chars.of(texts))
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        counts = np.bincount(words.text, minlength=len(texts)) if len(words.text) else np.zeros(len(texts), np.int64)
        self.begin = np.cumsum(counts + 1) - counts - 1
        self.words = np.zeros(int(counts.sum()) + len(texts), np.int64)
        if len(words.text):
            self.words[np.arange(len(number)) + words.text] = number + 1
        self.ids, self.least = np.array(ids, np.int64), least
        place = np.concatenate([np.arange(b, b + c - least + 1) for b, c in zip(self.begin, counts, strict=True) if c >= least] or [np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys := _prefixes(self.words, place, least), kind="stable")
        self.place, self.keys = place[order], keys[order]
        self.before = _words_before(self.words, self.place)

    def number_of(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.vocabulary) == 0:
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)


def _prefixes(words: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix as bytes that compare like the words do."""
    window = words.astype(">u4")[place[:, None] + np.arange(depth)]
    return np.ascontiguousarray(window).view(f"S{4 * depth}").reshape(-1)


def _words_before(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The word before each place, 0 at the beginning of a text."""
    return np.where(place > 0, words[place - 1], 0)


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, place) of every place in the ranges."""
    size = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(size)), size), np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def shard_matches(texts: list[str | None], tests: Tests) -> tuple[np.ndarray, ...]:
    """(text number, test number, words, first word in the text, first word in the test) of the longest match of each text and test that share ``least`` words in a row.

    Of several longest matches it is the one that comes first in the text, then in the test.
    """
    words = Words.of(Chars.of(texts))
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    counts = np.bincount(words.text, minlength=len(texts)) if len(words.text) else np.zeros(len(texts), np.int64)
    sequence = np.zeros(int(counts.sum()) + len(texts) + tests.least, np.int64)
    sequence[np.arange(len(words.hash)) + words.text] = tests.number_of(words.hash)
    barrier = np.flatnonzero(sequence == 0)
    place = np.flatnonzero(sequence)
    run = barrier[np.searchsorted(barrier, place)] - place  # test words from here on
    place = place[run >= tests.least]
    if len(place) == 0 or len(tests.place) == 0:
        return none
    keys, number = np.unique(_prefixes(sequence, place, tests.least), return_inverse=True)
    at = np.minimum(np.searchsorted(keys, tests.keys), len(keys) - 1)
    known = np.flatnonzero(keys[at] == tests.keys)
    wide = len(tests.vocabulary) + 1
    code = number * wide + _words_before(sequence, place)
    suffixes = np.argsort(code, kind="stable")  # the shard's suffix array
    code, place = code[suffixes], place[suffixes]
    base, before = at[known] * wide, tests.before[known]
    low, high = np.searchsorted(code, base), np.searchsorted(code, base + wide)
    # a word before that is equal on both sides makes the hit part of a longer one
    same, after = np.searchsorted(code, base + before, "left"), np.searchsorted(code, base + before, "right")
    same, after = np.where(before > 0, same, high), np.where(before > 0, after, high)
    one, first_at = _expanded(low, same)
    two, second_at = _expanded(after, high)
    test_at = tests.place[known[np.concatenate((one, two))]]
    text_at = place[np.concatenate((first_at, second_at))]
    if len(test_at) == 0:
        return none
    length = np.full(len(test_at), tests.least)
    going = np.arange(len(test_at))
    while len(going):
        a, b = text_at[going] + length[going], test_at[going] + length[going]
        ok = (b < len(tests.words)) & (a < len(sequence))
        ok[ok] = (sequence[a[ok]] == tests.words[b[ok]]) & (sequence[a[ok]] > 0)
        going = going[ok]
        length[going] += 1
    ends = np.cumsum(counts + 1)
    text, test = np.searchsorted(ends, text_at, "right"), np.searchsorted(tests.begin, test_at, "right") - 1
    order = np.lexsort((test_at, text_at, -length, test, text))
    text, test, length, text_at, test_at = text[order], test[order], length[order], text_at[order], test_at[order]
    best = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (test[1:] != test[:-1]))))
    begin = ends - counts - 1
    return text[best], test[best], length[best], text_at[best] - begin[text[best]], test_at[best] - tests.begin[test[best]]


def leaks(documents: DataFrame, tests: DataFrame, least_words: int = LEAST_WORDS, block: int = 10_000) -> DataFrame:
    """(doc_id, eval_id, words, doc_word, eval_word): documents that hold ``least_words`` consecutive words of a test text.

    ``words`` is the length of the longest match, ``doc_word`` and ``eval_word`` are where it begins, in words from 0.
    ``documents`` has doc_id and text, ``tests`` eval_id and text. Null and empty texts hold nothing, shorter test texts can't leak;
    documents with the same id give a row each, as do tests. One reading of the corpus searches up to ``block`` test texts, which
    every task holds; more of them take as many readings as they have blocks.
    """
    schema = "doc_id bigint, eval_id bigint, words int, doc_word int, eval_word int"

    def search(ids: list[int], texts: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready = Tests(ids, texts, least_words)
            for batch in batches:
                docs, all_texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
                for a, b in slices(all_texts):
                    text, test, words, doc_word, eval_word = shard_matches(all_texts[a:b], ready)
                    at = {"words": words, "doc_word": doc_word, "eval_word": eval_word}
                    yield pd.DataFrame({"doc_id": docs[a:b][text], "eval_id": ready.ids[test]} | {k: v.astype(np.int32) for k, v in at.items()})

        return run

    parts, rows = [], iter(tests.filter(F.col("text").isNotNull()).select("eval_id", "text").orderBy("eval_id", "text").toLocalIterator())
    while (held := list(islice(rows, block))) or not parts:
        parts.append(documents.select("doc_id", "text").mapInPandas(search([r.eval_id for r in held], [r.text for r in held]), schema))
    return reduce(DataFrame.unionByName, parts)


def _leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p8_report(spark, sf_dir: str) -> DataFrame:
    """Per test text the number of documents it leaked into and the longest match."""
    return _leaks(spark, sf_dir).groupBy("eval_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def p8_locations(spark, sf_dir: str) -> DataFrame:
    """Every leak with the length of its longest match and where it begins in the document and in the test text."""
    return _leaks(spark, sf_dir)


def p8_clean(spark, sf_dir: str) -> DataFrame:
    """Documents without any leaked passage."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return documents.join(p8_found(spark, sf_dir), "doc_id", "left_anti")


_WORDS = r"list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w)"
_SHARED = f"""
with d as (select doc_id, {_WORDS} as w from documents), e as (select eval_id, {_WORDS} as w from eval_items),
  dw as (select doc_id, unnest(range(1, len(w) - 10)) as i, unnest(list_transform(range(1, len(w) - 10), lambda i: hash(array_to_string(w[i:i+11], ' ')))) as h from d),
  ew as (select eval_id, unnest(range(1, len(w) - 10)) as j, unnest(list_transform(range(1, len(w) - 10), lambda i: hash(array_to_string(w[i:i+11], ' ')))) as h from e),
  hits as (select distinct doc_id, eval_id, i, j from dw join ew using (h))"""
P8_FOUND_SQL = f"{_SHARED} select distinct doc_id, eval_id from hits"
P8_CLEAN_SQL = f"{_SHARED} select doc_id, lang, source, n_chars from documents where doc_id not in (select doc_id from hits)"
# neighbouring hits of one diagonal are one match of twelve words and one more for each further hit
P8_REPORT_SQL = f"""{_SHARED},
  runs as (select *, i - row_number() over (partition by doc_id, eval_id, i - j order by i) as run from hits),
  long as (select doc_id, eval_id, count(*) + 11 as words from runs group by doc_id, eval_id, i - j, run)
select eval_id, count(distinct doc_id) as documents, max(words)::int as longest from long group by eval_id"""
P8_LOCATIONS_SQL = f"""{_SHARED},
  runs as (select *, i - row_number() over (partition by doc_id, eval_id, i - j order by i) as run from hits),
  long as (select doc_id, eval_id, count(*) + 11 as words, min(i) - 1 as doc_word, min(j) - 1 as eval_word from runs group by doc_id, eval_id, i - j, run)
select doc_id, eval_id, words::int as words, doc_word::int as doc_word, eval_word::int as eval_word from long
qualify row_number() over (partition by doc_id, eval_id order by words desc, doc_word, eval_word) = 1"""

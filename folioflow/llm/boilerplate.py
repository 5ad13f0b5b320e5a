"""Lines that a source repeats over a large share of its documents.

The letters of every block are cut into chunks where a rolling hash of the last letters says so, not at fixed
places, so equal stretches give equal chunks wherever they stand. Per source and chunk the documents are counted. A line
that is repeated excessively consists of excessive chunks only, so blocks with any other chunk are out; for the blocks that
are left, whole lines are counted to be exact. Chunks are counted per document and batch before they
are shuffled, so a source with a third of all documents costs no more than its distinct chunks per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.session import bounded_broadcast, cut

WINDOW = 8  # letters that decide on a cut
MEAN_BITS = 5  # a cut every 32 letters in the mean


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mixed letters, first letter, size, line number) of the chunks of lines set one after the other."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    none = np.empty(0, np.int64)
    if n == 0:
        return codes, none, none, none
    mixed = _mixed(codes + np.uint64(0x9E3779B97F4A7C15))
    line = np.repeat(np.arange(len(lines)), sizes)
    starts = np.cumsum(sizes) - sizes
    within = np.arange(n) - starts[line]
    gear = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        gear[k:] += mixed[: n - k] << np.uint64(k * 7 % 61)
    cut = (_mixed(gear) >> np.uint64(64 - MEAN_BITS) == 0) & (within >= WINDOW - 1)
    ends = starts + sizes
    cut[ends[sizes > 0] - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate(([0], last[:-1] + 1))
    return mixed, first, last - first + 1, line[first]


def chunks_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of every chunk of every line. Cuts depend on the letters of the line alone; a line's ends are cuts."""
    mixed, first, size, line = _cuts(lines)
    if len(first) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    powers = np.cumprod(np.full(int(size.max()), np.uint64(0x2545F4914F6CDD1D), np.uint64))
    place = np.arange(len(mixed)) - np.repeat(first, size)
    sums = np.add.reduceat(mixed * powers[place], first)
    return line, _mixed(sums + (size - 1).astype(np.uint64)).view(np.int64)


def chunk_sizes(lines: list[str]) -> np.ndarray:
    """Letters of every chunk, in the order of :func:`chunks_of`."""
    return _cuts(lines)[2]


def lines_of(items: DataFrame, *keep: str) -> DataFrame:
    """(item_id, source_name, ``keep``, poses, lines) with the lower-case letters of each block; blocks without letters are left out."""
    pairs = F.transform("blocks", lambda b: F.struct(b.pos.cast("int").alias("pos"), F.regexp_replace(F.lower(b.text), r"[^\p{L}]+", "").alias("line")))
    kept = F.filter(pairs, lambda p: p.line != "")
    rows = items.filter(F.col("source_name").isNotNull()).select("item_id", "source_name", *keep, kept.alias("kept"))
    return rows.select("item_id", "source_name", *keep, F.col("kept.pos").alias("poses"), F.col("kept.line").alias("lines"))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """Row number and text of every line of a batch."""
    each = [() if x is None else x for x in batch["lines"]]
    return np.repeat(np.arange(len(batch)), [len(x) for x in each]), [t for x in each for t in x]


def count_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source_name, chunk, docs): in how many documents of the batch a chunk occurs."""
    for batch in batches:
        row, lines = _flat(batch)
        line, chunk = chunks_of(lines)
        codes, names = pd.factorize(batch["source_name"])
        once = pd.DataFrame({"row": row[line] if len(line) else [], "chunk": chunk}).drop_duplicates()
        once["source"] = codes[once["row"].to_numpy(dtype=int)]
        counted = once.groupby(["source", "chunk"], sort=False).size().reset_index(name="docs")
        yield pd.DataFrame({"source_name": names.to_numpy()[counted["source"].to_numpy(dtype=int)], "chunk": counted["chunk"].astype("int64"), "docs": counted["docs"].astype("int64")})


def block_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, source_name, pos, line, chunks) per block, and its ``story`` if rows have one; ``line`` is the digest of its letters."""
    for batch in batches:
        row, lines = _flat(batch)
        line, chunk = chunks_of(lines)
        bounds = np.searchsorted(line, np.arange(len(lines) + 1))
        yield pd.DataFrame(
            {
                "item_id": batch["item_id"].to_numpy()[row],
                "source_name": batch["source_name"].to_numpy()[row],
                "pos": np.array([p for x in batch["poses"] for p in (() if x is None else x)], np.int32),
                "line": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in lines],
                "chunks": [np.unique(chunk[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                **({"story": batch["story"].to_numpy()[row]} if "story" in batch else {}),
            }
        )


def repeated_blocks(items: DataFrame, least_rows: int = 10, least_share: float = 0.05, story: Column | None = None) -> DataFrame:
    """(source_name, item_id, pos): blocks whose line occurs in at least ``least_rows`` rows and ``least_share`` of the rows of its source.

    Lines are equal when their letters are, without regard to case. Rows without a source, null blocks and blocks without letters
    never count as cases, but rows without blocks count into the share. The same line twice in an item counts once, both
    blocks are cases. With ``story``, a bigint that copies of a story share, distinct stories are counted in place of rows. An
    empty table gives an empty result. Extra columns are ignored.
    """
    keep = () if story is None else ("story",)
    rows = items.select("item_id", "source_name", "blocks", *(() if story is None else (story.alias("story"),)))
    lines = lines_of(rows, *keep)
    named = rows.filter(F.col("source_name").isNotNull()).select("source_name", *keep)
    totals = bounded_broadcast((named.distinct() if keep else named).groupBy("source_name").agg(F.greatest(F.lit(float(least_rows)), least_share * F.count("*")).alias("least")))
    # documents are no fewer than stories, so what is excessive by stories is excessive here
    counted = lines.select("source_name", "lines").mapInPandas(count_chunks, "source_name string, chunk bigint, docs bigint").groupBy("source_name", "chunk").agg(F.sum("docs").alias("docs"))
    # each needs a share of its source's documents, so a source has at most (chunks per document / share) of them
    excessive = bounded_broadcast(counted.join(totals, "source_name").filter("docs >= least - 1e-9").select("source_name", F.col("chunk").alias("each")), 1_000_000)
    blocks = lines.mapInPandas(block_chunks, "item_id bigint, source_name string, pos int, line binary, chunks array<bigint>" + (", story bigint" if keep else ""))
    block = ("item_id", "source_name", "pos", "line", *keep)
    hits = blocks.select(*block, F.size("chunks").alias("of"), F.explode("chunks").alias("each")).join(excessive, ["source_name", "each"])
    candidates = cut(hits.groupBy(*block, "of").agg(F.count("*").alias("n")).filter("n = of").select(*block))
    seen = candidates.select("source_name", "line", *(keep or ("item_id",))).distinct().groupBy("source_name", "line").agg(F.count("*").alias("rows"))
    sure = seen.join(totals, "source_name").filter("rows >= least - 1e-9").select("source_name", "line")
    return candidates.join(bounded_broadcast(sure, 1_000_000), ["source_name", "line"], "left_semi").select("source_name", "item_id", "pos")


def without_blocks(items: DataFrame, cases: DataFrame) -> DataFrame:
    """``items`` with the blocks of ``cases`` (item_id, pos) taken out; items without a case are as they were."""
    gone = cases.groupBy("item_id").agg(F.collect_set("pos").alias("_gone"))  # at most the blocks of one item
    rows = items.drop("_gone").join(gone, "item_id", "left")
    return rows.withColumn("blocks", F.when(F.col("_gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains(F.col("_gone"), b.pos)))).drop("_gone")


def _letters(text: str) -> tuple[str, list[int]]:
    """The lower-case letters of a text and the place of each in it."""
    found = [(x, k) for k, c in enumerate(text) for x in c.lower() if x.isalpha()]
    return "".join(x for x, _ in found), [k for _, k in found]


def text_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, source_name, pos, chunk, start, stop): the chunks of each text with the stretch of it that they stand for; the stretches make up the text."""
    for batch in batches:
        texts = batch["text"].tolist()
        letters, places = zip(*map(_letters, texts), strict=True) if texts else ((), ())
        line, chunk = chunks_of(list(letters))
        first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else line
        # how many letters of its line stand before each chunk: its size is found by cutting the line again
        sizes = chunk_sizes(list(letters))
        before = np.cumsum(sizes) - sizes
        base = np.repeat(before[first], np.diff(np.append(first, len(line)))) if len(line) else before
        begin = before - base
        start = [0 if b == 0 else places[i][b] for i, b in zip(line.tolist(), begin.tolist(), strict=True)]
        stop = [len(texts[i]) if b + n == len(places[i]) else places[i][b + n] for i, b, n in zip(line.tolist(), begin.tolist(), sizes.tolist(), strict=True)]
        own = batch.iloc[line]
        yield pd.DataFrame({"item_id": own["item_id"].to_numpy(), "source_name": own["source_name"].to_numpy(), "pos": own["pos"].to_numpy(np.int32), "chunk": chunk, "start": np.array(start, np.int32), "stop": np.array(stop, np.int32)})


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the stretches; what is left is trimmed, and null where nothing is."""

    def cut_out(text: str, stretches) -> str | None:
        if stretches is None or text is None:
            return text
        left, at = [], 0
        for a, b in sorted((x["start"], x["stop"]) for x in stretches):
            left.append(text[at : max(a, at)])
            at = max(at, b)
        return "".join([*left, text[at:]]).strip() or None

    return pd.Series([cut_out(t, x) for t, x in zip(texts, spans, strict=True)], dtype=object)


def cut_chunks(items: DataFrame, least_rows: int = 10, least_share: float = 0.05) -> DataFrame:
    """(item_id, pos, text): every block of ``items``, without the chunks that its source repeats in ``least_rows`` rows and ``least_share`` of its rows.

    A repeated line inside a longer text goes but for the letters up to its first cut, and what stands around it stays. Blocks of which nothing is left have no row.
    Null texts, texts without letters and rows without a source are left as they are; an item id with several rows counts as one. Chunks are counted
    per source and document, combined before the shuffle; a hot source costs its distinct chunks.
    """
    block = F.posexplode("blocks").alias("_", "b")
    blocks = items.select("item_id", "source_name", block).select("item_id", "source_name", F.col("b.pos").cast("int").alias("pos"), F.col("b.text").alias("text"))
    chunks = blocks.filter(F.col("text").isNotNull() & F.col("source_name").isNotNull()).mapInPandas(text_chunks, "item_id bigint, source_name string, pos int, chunk bigint, start int, stop int")
    rows = items.filter(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.greatest(F.lit(float(least_rows)), least_share * F.count("*")).alias("least"))
    totals = bounded_broadcast(rows)
    counted = chunks.select("source_name", "chunk", "item_id").distinct().groupBy("source_name", "chunk").agg(F.count("*").alias("docs"))
    excessive = bounded_broadcast(counted.join(totals, "source_name").filter("docs >= least - 1e-9").select("source_name", "chunk"), 1_000_000)
    spans = chunks.join(excessive, ["source_name", "chunk"], "left_semi").groupBy("item_id", "pos").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most the chunks of one text
    joined = blocks.join(spans, ["item_id", "pos"], "left")
    done = joined.select("item_id", "pos", F.col("text").isNull().alias("empty"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(_without("text", "spans")).alias("text"))
    return done.filter(F.col("text").isNotNull() | F.col("empty")).drop("empty")


def _items(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/items.parquet").select("item_id", "source_name", "blocks")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return repeated_blocks(_items(spark, sf_dir)).distinct()


def p4_cut(spark, sf_dir: str) -> DataFrame:
    """Every block without the chunks that its source repeats excessively, wherever they stand in it."""
    return cut_chunks(_items(spark, sf_dir))


def p4_cleaned(spark, sf_dir: str) -> DataFrame:
    """Every item with the number and the joined text of the blocks that are left."""
    items = _items(spark, sf_dir)
    clean = without_blocks(items, repeated_blocks(items).select("item_id", "pos"))
    return clean.select("item_id", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("kept"), F.array_join("blocks.text", "\n").alias("text"))


_CASES_SQL = r"""
    b as (select item_id, source_name, unnest(blocks) as k from items where source_name is not null),
    l as (select item_id, source_name, k.pos as pos, regexp_replace(lower(k.text), '[^\p{L}]+', '', 'g') as line from b),
    t as (select source_name, count(*) as n from items where source_name is not null group by 1),
    e as (select source_name, line from l join t using (source_name) where line <> '' group by source_name, line, n
          having count(distinct item_id) >= 10 and count(distinct item_id) >= 0.05 * n),
    cases as (select distinct source_name, item_id, pos from l join e using (source_name, line))"""

P4_FOUND_SQL = f"with {_CASES_SQL} select source_name, item_id, pos from cases"
P4_CLEANED_SQL = f"""
with {_CASES_SQL}, g as (select item_id, list(pos) as gone from cases group by 1),
    c as (select items.item_id, list_filter(blocks, lambda b: not list_contains(coalesce(gone, []), b.pos)) as blocks from items left join g using (item_id))
select item_id, len(blocks)::int as kept, array_to_string(list_filter(list_transform(blocks, lambda b: b.text), lambda t: t is not null), chr(10)) as text from c"""

"""Statistics of document texts, how unusual they are, and what kind of text they tell.

Statistics are taken over whole texts, unrounded. Their empirical distributions are exact: values are sorted by range partitioning, numbered
inside their range, and a range's offset is what the ranges before it hold; rows with equal values may lie in several ranges, and share
their ranks all the same, so no language or value is ever in one task. The five statistics are ranked within the language, the shapes of lines,
which no language has to itself, over all documents. Lower and upper tail probabilities make a tail score for each, and the outlier
score of the document. Whether a document is prose is decided from the tail scores alone, by trees that are trained on a bounded number of
labelled documents; what else it is, list, table or junk, by trees on the shapes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.words import DIGIT, LETTER, OTHER, PUNCT, SPACE, Chars, Words, slices
from folioflow.session import bounded_broadcast, cut

COMMON_WORDS = 100
KINDS = ("prose", "list", "table", "junk")
STATISTICS = ("words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share")
SHAPES = (
    "digit_share", "other_share", "punct_share", "space_share", "distinct_share", "markup_share", "mixed_word_share", "one_letter_share", "longest_word", "line_length",
    "prose_line_chars", "numbered_line_chars", "bullet_line_chars", "digit_line_chars", "separated_line_chars", "digit_end_chars", "short_line_chars", "leader_line_chars", "deviation_word_length", "distinct_words",
)
FEATURES = STATISTICS + SHAPES
RANKED_SHAPES = (
    "digit_share", "markup_share", "distinct_share", "prose_line_chars", "numbered_line_chars", "bullet_line_chars", "digit_line_chars", "separated_line_chars", "short_line_chars", "leader_line_chars",
)
RANKED = STATISTICS + RANKED_SHAPES
ALL = "*"  # the group of what is ranked over all languages

# Signs that end a sentence or a line of it, bullets, column separators, and signs of markup and code.
_ENDS = np.array(sorted(map(ord, ".!?…:;\"'”»“’)«")), np.uint32)
_BULLETS = np.array(sorted(map(ord, "-*•·–‣▪◦○●→")), np.uint32)
_SEPARATORS = np.array(sorted(map(ord, "|;\t")), np.uint32)
_MARKUP = np.array(sorted(map(ord, "<>{}[]=/\\_#%&$^~`@+")), np.uint32)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def measure(texts: list[str | None], common: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All features of each text; ``common`` has the sorted hashes of the common words of each text's language."""
    n, chars = len(texts), Chars.of(texts)
    words = Words.of(chars)
    codes, kind = chars.codes, chars.kind
    of_char = np.repeat(np.arange(n), chars.sizes + 1)
    size = chars.sizes.astype(float)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_char[mask], minlength=n).astype(float)

    seen = size - per_text(kind == SPACE) + 1  # the newline after a text is a space too
    count = np.bincount(words.text, minlength=n).astype(float)
    length = words.size.astype(float)
    letters = np.bincount(words.text, length, n)
    out = {
        "words": count,
        "mean_word_length": _share(letters, count),
        "symbol_share": _share(per_text((kind == OTHER) | (kind == PUNCT)), size),
        "digit_share": _share(per_text(kind == DIGIT), seen),
        "other_share": _share(per_text(kind == OTHER), seen),
        "punct_share": _share(per_text(kind == PUNCT), seen),
        "space_share": _share(size - seen, size),
        "markup_share": _share(per_text(np.isin(codes, _MARKUP)), seen),
        "one_letter_share": _share(np.bincount(words.text[words.size == 1], minlength=n), count),
        "deviation_word_length": np.sqrt(np.maximum(_share(np.bincount(words.text, length**2, n), count) - _share(letters, count) ** 2, 0)),
    }
    bounds = np.searchsorted(words.text, np.arange(n + 1))
    distinct, known, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        mine = words.hash[bounds[i] : bounds[i + 1]]
        if len(mine):
            values, times = np.unique(mine, return_counts=True)
            distinct[i], longest[i] = len(values), words.size[bounds[i] : bounds[i + 1]].max()
            if len(common[i]):
                known[i] = times[np.isin(values, common[i])].sum()
    out |= {"distinct_share": _share(distinct, count), "distinct_words": distinct, "common_word_share": _share(known, count), "longest_word": longest}
    sums = np.concatenate(([0], np.cumsum(kind == DIGIT)))
    inside = sums[words.start + words.size] - sums[words.start]
    out["mixed_word_share"] = _share(np.bincount(words.text[(inside > 0) & (inside < words.size)], minlength=n), count)

    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    solid = np.flatnonzero(kind != SPACE)
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    starts, ends, a, b = starts[full], ends[full], a[full], b[full]
    line_text = of_char[starts]
    weight = (b - a).astype(float)
    lines = np.bincount(line_text, minlength=n).astype(float)
    out["line_length"] = _share(np.bincount(line_text, weight, n), lines)
    first, last = (solid[a], solid[b - 1]) if len(a) else (a, a)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[ends] - total[starts]

    def chars_in(mask: np.ndarray) -> np.ndarray:
        return _share(np.bincount(line_text[mask], weight[mask], n), np.bincount(line_text, weight, n))

    ended = np.isin(codes[last], _ENDS)
    other = np.flatnonzero(kind != DIGIT)
    after_digits = other[np.minimum(np.searchsorted(other, first), len(other) - 1)] if len(other) else first
    stop = lambda at: np.isin(codes[np.minimum(at, len(codes) - 1)], [46, 41])  # noqa: E731  full stop, bracket
    numbered = (kind[first] == DIGIT) & (after_digits - first <= 3) & stop(after_digits) | (kind[first] == LETTER) & stop(first + 1)
    blanks = np.zeros(len(codes), bool)
    blanks[1:] = (codes[1:] == 32) & (codes[:-1] == 32)
    dots = np.zeros(len(codes), bool)
    dots[2:] = (codes[2:] == 46) & (codes[1:-1] == 46) & (codes[:-2] == 46)
    digits = within(kind == DIGIT)
    out |= {
        "punctuated_line_share": _share(np.bincount(line_text[ended], minlength=n), lines),
        "prose_line_chars": chars_in(ended & (weight >= 40) & ~numbered & (digits < 0.15 * weight)),
        "numbered_line_chars": chars_in(numbered),
        "bullet_line_chars": chars_in(np.isin(codes[first], _BULLETS)),
        "digit_line_chars": chars_in(digits >= 0.2 * weight),
        "separated_line_chars": chars_in(within(np.isin(codes, _SEPARATORS)) + within(blanks) >= 2),
        "digit_end_chars": chars_in(kind[last] == DIGIT),
        "short_line_chars": chars_in((weight < 60) & ~ended),
        "leader_line_chars": chars_in(within(dots) >= 1),
    }
    return {k: out[k] for k in FEATURES}


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) summed per slice of a batch; ``word`` is a hash."""
    for batch in batches:
        codes, names = pd.factorize(batch["lang"])
        texts = batch["text"].tolist()
        for a, b in slices(texts):
            words = Words.of(Chars.of(texts[a:b]))
            counted = pd.DataFrame({"l": codes[a:b][words.text], "word": words.hash}).groupby(["l", "word"], sort=False).size().reset_index(name="n")
            yield pd.DataFrame({"lang": np.asarray(names)[counted["l"]], "word": counted["word"], "n": counted["n"]})


def common_words(documents: DataFrame, top: int = COMMON_WORDS) -> dict[str, np.ndarray]:
    """Sorted hashes of the ``top`` most frequent words per language; at most ``top`` per language come to the driver."""
    counted = documents.mapInPandas(count_words, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= top)
    found: dict[str, list[int]] = {}
    for r in ranked.select("lang", "word").collect():
        found.setdefault(r.lang, []).append(r.word)
    return {k: np.array(sorted(v), np.int64) for k, v in found.items()}


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, the statistics and shapes) of every document; texts that are null or empty have zeros, a null lang is ``und``."""
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    common = common_words(rows.select("lang", "text").filter(F.col("text").isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                part = batch.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang": part["lang"].to_numpy()} | measure(texts[a:b], [common.get(x, none) for x in part["lang"]]))

    return rows.mapInPandas(run, "doc_id bigint, lang string, " + ", ".join(f"{c} double" for c in FEATURES))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted range with ``below`` and ``upto``: how many rows of their group in this range have a smaller value, and one no larger.

    Rows that share a value are kept back until the value ends.
    """
    held: pd.DataFrame | None = None
    group, before = None, 0

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal group, before
        stat, names, value = rows["stat"].to_numpy(), rows["grp"].to_numpy(), rows["value"].to_numpy()
        n = len(rows)
        new_group = np.concatenate(([True], (stat[1:] != stat[:-1]) | (names[1:] != names[:-1])))
        new_value = new_group | np.concatenate(([True], value[1:] != value[:-1]))
        starts = np.flatnonzero(new_value)
        run = np.cumsum(new_value) - 1
        ends = np.append(starts[1:], n)
        opens = np.flatnonzero(new_group)
        first_of_group = opens[np.cumsum(new_group) - 1]
        carried = np.where(first_of_group == 0, before if group == (stat[0], names[0]) else 0, 0)
        below, upto = starts[run] - first_of_group + carried, ends[run] - first_of_group + carried
        group, before = (stat[-1], names[-1]), int(upto[-1])
        return rows.assign(below=below, upto=upto)

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        stat, names, value = rows["stat"].to_numpy(), rows["grp"].to_numpy(), rows["value"].to_numpy()
        other = np.flatnonzero((stat != stat[-1]) | (names != names[-1]) | (value != value[-1]))
        k = int(other[-1]) + 1 if len(other) else 0
        held = rows.iloc[k:]
        if k:
            yield told(rows.iloc[:k])
    if held is not None and len(held):
        yield told(held)


def exact_ranks(statistics: DataFrame, columns: tuple[str, ...] = RANKED) -> DataFrame:
    """(doc_id, row, lang, stat, value, below, upto, total): for each document and column how many of its group have a smaller value, and one no larger.

    The group is the language for ``STATISTICS`` and all documents for other columns; ``stat`` is the column's number and ``row`` tells rows with one id apart.
    Ties share their ranks. ``statistics`` has to be materialised, so that its rows keep their numbers.
    """
    each = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("stat"), (F.col("lang") if c in STATISTICS else F.lit(ALL)).alias("grp"), (F.col(c) + 0.0).alias("value")) for k, c in enumerate(columns)])
    long = statistics.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "lang", F.inline(each))
    # rows of one value are spread by their number
    order = ("stat", "grp", "value", "row")
    sorted_ = long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = cut(sorted_.mapInPandas(_placed, "doc_id bigint, row bigint, lang string, stat tinyint, grp string, value double, part int, below bigint, upto bigint"))
    ends = placed.groupBy("stat", "grp", "part").agg(
        F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"), F.min("upto").alias("first_n"), (F.max("upto") - F.max("below")).alias("last_n")
    )  # a row per group and range
    by_group = Window.partitionBy("stat", "grp")
    before = F.sum("n").over(by_group.orderBy("part")) - F.col("n")
    ends = ends.select("*", before.alias("before"), F.sum("n").over(by_group).alias("total"))
    # a value at the edge of ranges: what the ranges before and behind hold of it
    earlier = Window.partitionBy("stat", "grp", "value").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("stat", "grp", "value").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    edges = ends.select("stat", "grp", "part", F.inline(F.array_distinct(F.array(F.struct(F.col("first").alias("value"), F.col("first_n").alias("m")), F.struct(F.col("last").alias("value"), F.col("last_n").alias("m"))))))
    shared = edges.select("stat", "grp", "part", "value", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("equal_before"), F.coalesce(F.sum("m").over(later), F.lit(0)).alias("equal_behind"))
    offset = ends.select("stat", "grp", "part", "before", "total")
    whole = placed.join(bounded_broadcast(offset), ["stat", "grp", "part"]).join(bounded_broadcast(shared), ["stat", "grp", "part", "value"], "left")
    below = F.col("before") + F.col("below") - F.coalesce("equal_before", F.lit(0))
    upto = F.col("before") + F.col("upto") + F.coalesce("equal_behind", F.lit(0))
    return whole.select("doc_id", "row", "lang", "stat", "value", below.alias("below"), upto.alias("upto"), "total")


def tail_scores(statistics: DataFrame, columns: tuple[str, ...] = RANKED) -> DataFrame:
    """(doc_id, lang, the columns, ``tail_<c>``, ``score_<c>``, outlier) of every document.

    ``tail`` is the two-sided tail probability, ``score`` the log odds of the lower against the upper one, ``outlier`` the mean surprise of the tails
    of ``STATISTICS``.
    """
    ranks = exact_ranks(statistics, columns)
    low, high = F.col("upto") / F.col("total"), (F.col("total") - F.col("below")) / F.col("total")
    each = ranks.select("doc_id", "row", "lang", "stat", "value", F.least(F.lit(1.0), 2 * F.least(low, high)).alias("tail"), F.log(low / high).alias("score"))
    picked = [F.max(F.when(F.col("stat") == k, F.col(v))).alias(f"{v}_{c}") for k, c in enumerate(columns) for v in ("value", "tail", "score")]
    wide = each.groupBy("row", "doc_id", "lang").agg(*picked).drop("row")
    surprise = sum((-F.log(F.col(f"tail_{c}")) for c in columns if c in STATISTICS), F.lit(0.0)) / len(STATISTICS)
    return wide.withColumn("outlier", surprise).withColumnsRenamed({f"value_{c}": c for c in columns})


class Forest:
    """Classification trees on random rows and features, grown on binned values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: int, trees: int = 40, depth: int = 9, least: int = 4, bins: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.kinds, self.trees = kinds, []
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(self.edges, x.T, strict=True)], 1)
        for _ in range(trees):
            nodes: list[list] = []
            rows = rng.integers(0, len(y), len(y))
            stack = [(rows, 0, -1, 0)]
            while stack:
                own, level, parent, side = stack.pop()
                votes = np.bincount(y[own], minlength=kinds).astype(float)
                me = len(nodes)
                nodes.append([-1, 0, 0, 0, votes / votes.sum()])
                if parent >= 0:
                    nodes[parent][2 + side] = me
                if level == depth or len(own) < 2 * least or votes.max() == votes.sum():
                    continue
                best = (1e-9, -1, 0)
                base = len(own) - (votes**2).sum() / len(own)
                for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
                    k = len(self.edges[f]) + 1
                    table = np.bincount(binned[own, f] * kinds + y[own], minlength=k * kinds).reshape(k, kinds).cumsum(0)[:-1].astype(float)
                    left = table.sum(1)
                    right = len(own) - left
                    ok = (left >= least) & (right >= least)
                    if ok.any():
                        with np.errstate(divide="ignore", invalid="ignore"):
                            gain = base - (left - (table**2).sum(1) / left) - (right - ((votes - table) ** 2).sum(1) / right)
                        gain[~ok] = -1
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], f, at)
                if best[1] >= 0:
                    nodes[me][0], nodes[me][1] = int(best[1]), best[2]
                    goes = binned[own, best[1]] <= best[2]
                    stack += [(own[goes], level + 1, me, 0), (own[~goes], level + 1, me, 1)]
            self.trees.append((np.array([x[:4] for x in nodes], np.int64), np.stack([x[4] for x in nodes])))

    def chances(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(self.edges, x.T, strict=True)], 1)
        total = np.zeros((len(x), self.kinds))
        for nodes, votes in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                split = nodes[at, 0]
                going = np.flatnonzero(split >= 0)
                if len(going) == 0:
                    break
                n = nodes[at[going]]
                at[going] = np.where(binned[going, n[:, 0]] <= n[:, 1], n[:, 2], n[:, 3])
            total += votes[at]
        return total / len(self.trees)


PROSE_COLUMNS = (*[f"score_{c}" for c in RANKED], "outlier")


def known_kinds(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, kind) of at most ``most`` labelled documents, those with the smallest hash of their id."""
    return bounded_broadcast(labels.filter(F.col("kind").isin(*KINDS)).select("doc_id", "kind").orderBy(F.xxhash64("doc_id"), "doc_id", "kind").limit(most))


def train(rows: DataFrame, known: DataFrame, columns: tuple[str, ...], kinds: tuple[str, ...]) -> Forest | None:
    """Trees that tell the ``kinds`` of labelled documents from columns of ``rows``; null without any."""
    found = rows.join(known.filter(F.col("kind").isin(*kinds)), "doc_id").select(*columns, "kind").toPandas()  # bounded as the labels are
    if found.empty:
        return None
    found = found.sort_values(list(found.columns), ignore_index=True)  # the same trees whatever the order of arrival
    return Forest(found[list(columns)].fillna(0).to_numpy(float), found["kind"].map(kinds.index).to_numpy(), len(kinds))


def not_prose(scored: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id): documents that are not prose by their tail scores; none without labels."""
    binary = known.withColumn("kind", F.when(F.col("kind") == "prose", "prose").otherwise("other"))
    forest = train(scored, binary, PROSE_COLUMNS, ("prose", "other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            other = forest.chances(batch[list(PROSE_COLUMNS)].fillna(0).to_numpy(float))[:, 1] > 0.5 if forest else np.zeros(len(batch), bool)
            yield batch.loc[other, ["doc_id"]]

    return scored.select("doc_id", *PROSE_COLUMNS).mapInPandas(run, "doc_id bigint")


def kinds_of(statistics: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, kind): whether a document that isn't prose is a list, a table or junk, by its shapes; junk without labels."""
    names = KINDS[1:]
    forest = train(statistics, known, FEATURES, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = forest.chances(batch[list(FEATURES)].to_numpy(float)).argmax(1) if forest else np.full(len(batch), len(names) - 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "kind": np.array(names)[best]})

    return statistics.select("doc_id", *FEATURES).mapInPandas(run, "doc_id bigint, kind string")


def quality(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, kind) of every document that is not prose, learned from at most ``most`` labelled ones.

    Null and empty texts are documents without words. A repeated id is judged by each of its rows, and may have several kinds. Without labels nothing is found.
    """
    statistics = cut(text_statistics(documents))
    known = known_kinds(labels, most)
    other = not_prose(cut(tail_scores(statistics)), known).distinct()
    return kinds_of(statistics.join(other, "doc_id", "left_semi"), known)


def p9_statistics(spark, sf_dir: str) -> DataFrame:
    """The five statistics, their tail probabilities and the outlier score of every document."""
    scored = tail_scores(cut(text_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))), STATISTICS)
    return scored.select("doc_id", "lang", *STATISTICS, *[F.round(f"tail_{c}", 9).alias(f"tail_{c}") for c in STATISTICS], F.round("outlier", 6).alias("outlier"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/doc_labels.parquet")).distinct()

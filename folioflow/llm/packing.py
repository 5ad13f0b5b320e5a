"""Documents packed into sequences of fixed token capacity.

Texts are measured with a public tokenizer. A text longer than the capacity is cut into full sequences and a rest; nothing
else is split. Pieces are spread over shards of bounded size by a hash of their document, and each shard is packed on its own:
pieces in descending order go to the sequence with the lowest attention cost (linear plus quadratic in the length of its
documents) among those that have room, and to a new one if none has. With tens of thousands of pieces a shard fills its
sequences as well as the whole corpus would, and no task sees more than a shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_broadcast, cut

#: where the driver finds the vocabulary; executors get it from the driver
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CONTAINERS = 1_000  # a stated set of capacities: every document is packed once for each
PLACED = "container_id int, doc_id bigint, piece int, sequence bigint, offset int, tokens int"


def token_counter(path: str):
    """A function from a text to its number of tokens; the vocabulary is read once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    encoding = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with a text; null texts have no row, empty ones 0 tokens."""
    documents.sparkSession.sparkContext.addFile(path)
    name = Path(path).name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        count = token_counter(SparkFiles.get(name))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": np.fromiter(map(count, batch["text"]), np.int64, len(batch))})

    return documents.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint")


class Lightest:
    """Open sequences by room left; gives the one of lowest cost that has room for a size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.best = [float("inf")] * (2 * self.width)  # over heaps of each room left, and their minimum up the tree
        self.heaps: list[list] = [[] for _ in range(self.width)]

    def _lift(self, room: int) -> None:
        k = room + self.width
        self.best[k] = self.heaps[room][0][0] if self.heaps[room] else float("inf")
        while k > 1:
            k //= 2
            self.best[k] = min(self.best[2 * k], self.best[2 * k + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        from heapq import heappush

        heappush(self.heaps[room], (cost, sequence))
        self._lift(room)

    def take(self, size: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the lightest sequence with room for ``size``."""
        from heapq import heappop

        low, high, found, least = size + self.width, 2 * self.width, 0, float("inf")
        while low < high:
            if low & 1:
                if self.best[low] < least:
                    found, least = low, self.best[low]
                low += 1
            if high & 1:
                high -= 1
                if self.best[high] < least:
                    found, least = high, self.best[high]
            low, high = low // 2, high // 2
        if not found:
            return None
        while found < self.width:
            found = 2 * found if self.best[2 * found] == least else 2 * found + 1
        room = found - self.width
        cost, sequence = heappop(self.heaps[room])
        self._lift(room)
        return room, cost, sequence


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size; sizes are at most the capacity. Equal sizes are taken in the order given."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_, n = Lightest(capacity), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        room, cost, at = open_.take(size) or (capacity, 0.0, n)
        n += at == n
        sequence[i], offset[i] = at, capacity - room
        open_.put(room - size, cost + linear * size + quadratic * size * size, at)
    return sequence, offset


LINEAR, QUADRATIC = 1.0, 1 / 4096


def pack_documents(counts: DataFrame, containers: DataFrame, shard_pieces: int = 50_000) -> DataFrame:
    """(container_id, doc_id, piece, sequence, offset, tokens): where every document lies for every capacity.

    ``counts`` has doc_id and tokens, ``containers`` container_id and capacity_tokens; capacities that are null or below 1 hold
    nothing, more than ``MOST_CONTAINERS`` of them are an error. Offsets count tokens within the sequence. Pieces of a longer document are numbered from 0.
    Pieces that fill a sequence are one each, without packing; the others of a capacity are spread over as many shards as ``shard_pieces`` of them
    need, so no task has more to pack, however long documents are. Documents with the same id
    are packed each. The number of a sequence is unique for a container.
    """
    stated = containers.filter("capacity_tokens >= 1").select("container_id", F.col("capacity_tokens").cast("int").alias("capacity")).limit(MOST_CONTAINERS + 1).collect()
    if len(stated) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} containers")
    rest = lambda capacity: F.count_if((F.col("tokens") % capacity > 0) | (F.col("tokens") == 0))
    open_pieces = counts.agg(F.count("*"), *[rest(r.capacity) for r in stated]).first()[1:]
    each = F.array(*[F.struct(F.lit(r.container_id).cast("int").alias("container_id"), F.lit(r.capacity).alias("capacity"), F.lit(max(1, -(-n // shard_pieces))).alias("shards")) for r, n in zip(stated, open_pieces, strict=True)])
    if not stated:
        each = F.array().cast("array<struct<container_id int, capacity int, shards int>>")
    sized = cut(counts.select("doc_id", "tokens", F.monotonically_increasing_id().alias("row"))).select("doc_id", "tokens", "row", F.inline(each))
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    left = (F.col("tokens") - full * F.col("capacity")).cast("int")
    # a full piece is a sequence of its own: its number is that of its row and piece, below those of the shards
    whole = sized.filter(full > 0).select("container_id", "doc_id", "row", "capacity", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select("container_id", "doc_id", "piece", (-F.pmod(F.xxhash64("row", "piece"), F.lit(2**62)) - 1).alias("sequence"), F.lit(0).alias("offset"), F.col("capacity").alias("tokens"))
    parts = sized.filter((left > 0) | (F.col("tokens") == 0)).select("container_id", "capacity", "doc_id", "row", full.alias("piece"), left.alias("tokens"), F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "tokens"], ignore_index=True)
        sequence, offset = pack(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]), LINEAR, QUADRATIC)
        return pdf.assign(sequence=sequence + pdf["shard"].astype("int64") * 2**32, offset=offset)[["container_id", "doc_id", "piece", "sequence", "offset", "tokens"]]

    return parts.groupBy("container_id", "shard").applyInPandas(run, PLACED).unionByName(whole)


def _packed(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(cut(token_counts(documents)), spark.read.parquet(f"{sf_dir}/containers.parquet"))


def p7_packed(spark, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Per container size the sequences used, the tokens in them, the share of their room that is used, and how far the costliest sequence is above the mean."""
    containers = spark.read.parquet(f"{sf_dir}/containers.parquet")
    cost = F.sum(LINEAR * F.col("tokens") + QUADRATIC * F.col("tokens") * F.col("tokens"))
    each = _packed(spark, sf_dir).groupBy("container_id", "sequence").agg(F.sum("tokens").alias("tokens"), cost.alias("cost"))
    used = each.groupBy("container_id").agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), F.round(F.max("cost") / F.avg("cost"), 4).alias("cost_max_to_mean"))
    return used.join(bounded_broadcast(containers), "container_id").withColumn("fill", F.round(F.col("tokens") / (F.col("sequences") * F.col("capacity_tokens")), 6))

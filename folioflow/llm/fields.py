"""Text fields of items in long form: one row per title, author and block text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values_of(items: DataFrame, keep: tuple[str, ...] = ("item_id",), author: bool = False) -> DataFrame:
    """(``keep``, field, pos, text) of ``title``, optionally ``author``, and every block; null texts give no row."""

    def one(field: str) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), F.lit(-1).alias("pos"), F.col(field).alias("text")))

    blocks = F.transform(F.coalesce(F.col("blocks"), F.array()), lambda b: F.struct(F.lit("block").alias("field"), b.pos.cast("int").alias("pos"), b.text.alias("text")))
    parts = [one("title"), *([one("author")] if author else []), blocks]
    return items.select(*keep, F.inline(F.concat(*parts))).filter(F.col("text").isNotNull() & (F.col("text") != ""))


def with_texts(frame: pd.DataFrame, **columns: list[str]) -> pd.DataFrame:
    """The frame with columns of texts, which stay texts when there are no rows."""
    return frame.assign(**{c: pd.Series(v, index=frame.index, dtype=object) for c, v in columns.items()})

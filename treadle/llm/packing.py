"""Filling containers of fixed capacity.

First-fit decreasing, run on its own in each of many groups into which the items
are drawn by a hash; a group has about ``GROUP_ITEMS`` items, so that its last,
half-empty containers weigh little and its work fits one task. The first
container that an item fits in is found in a tournament tree of free room.

Items are the documents' lengths in tokens; a longer one than the capacity is
split into full pieces and a rest, and every token comes out once.

Defined results: null and empty texts give no item; equal rows are items of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treadle.llm.tokenizing import VOCABULARY, token_counts
from treadle.session import cut, table

CAPACITY = 2048
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item. ``sizes`` must not increase."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < size:
                i += 1
        out.append(i - leaves)
        room[i] -= size
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            room[i] = a if a > b else b
    return out


def pack(sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(item, piece, token_start, n_tokens, bin_id)`` of all pieces of ``sizes(item, size)``."""
    pieces = (
        sizes.where(F.col(size) > 0)
        .select(F.col(item).alias("item"), F.col(size).alias("size"))
        .select("item", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("long"))).alias("piece"))
        .select("item", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    )
    n = sizes.agg(F.sum(F.ceil(F.col(size) / capacity))).first()[0] or 0
    groups = max(1, -(-int(n) // GROUP_ITEMS))
    kind = next(f.dataType for f in pieces.schema if f.name == "item")
    schema = T.StructType([T.StructField("item", kind), *(T.StructField(c, T.LongType()) for c in ("piece", "token_start")), T.StructField("n_tokens", T.IntegerType()), T.StructField("bin_id", T.LongType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True])
        pdf["bin_id"] = [(group << 32) + b for b in first_fit_decreasing(pdf["n_tokens"].tolist(), capacity)]
        return pdf[["item", "piece", "token_start", "n_tokens", "bin_id"]]

    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("item", "piece", F.lit("bins")), F.lit(groups)))
    return grouped.groupBy("g").applyInPandas(fill, schema).withColumnRenamed("item", item)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(cut(token_counts(documents, vocabulary=vocabulary)), "doc_id", "n", capacity)


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their tokens, and the share of their room that is used."""
    return p9_bins(spark, d).agg(
        F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"),
        F.round(F.sum("n_tokens") / (F.count_distinct("bin_id") * CAPACITY), 6).alias("filled"),
    )


QUERIES = {"p9_bins": p9_bins, "p9_fill": p9_fill}
SQL: dict[str, str] = {}

"""Packing into length buckets.

Documents longer than the longest sequence are cut into consecutive pieces, so nothing is
lost. The histogram of piece lengths has one bin for each length and so a fixed size;
dynamic programming over it chooses the bucket bounds that need the least padding. Inside a
bucket, pieces are numbered without gaps and every ``budget // bound`` of them are a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import words_of, written


def best_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds with the least padding; ``counts[i]`` sequences have the length ``i``, from 1 on.

    ``cost[j]``: least padding of all lengths up to the j-th that occurs, with so many
    buckets. Of equal costs, the earlier split wins. Fewer lengths than buckets give a
    bucket each.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = counts[lengths].astype(np.float64)
    rows = np.concatenate([[0.0], np.cumsum(n)])
    tokens = np.concatenate([[0.0], np.cumsum(n * lengths)])
    m = len(lengths)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0
    splits = []
    for _ in range(min(buckets, m)):
        new, split = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            pads = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            split[j] = int(np.argmin(pads))
            new[j] = pads[split[j]]
        cost = new
        splits.append(split)
    bounds, j = [], m
    for split in reversed(splits):
        bounds.append(int(lengths[j - 1]))
        j = int(split[j])
    return bounds[::-1]


def pieces_of(docs: DataFrame, max_tokens: int, doc_id: str, text: str, tokens: Column | None) -> DataFrame:
    """(doc_id, piece, start, n_tokens): consecutive pieces that cover a document."""
    n = tokens if tokens is not None else F.size(words_of(F.col(text))) + 1
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long").alias("all")
    )
    last = F.expr(f"(all - 1) div {max_tokens}")
    return sized.select("doc_id", "all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * max_tokens).alias("start"),
        F.least(F.lit(max_tokens).cast("long"), F.col("all") - F.col("piece") * max_tokens).alias("n_tokens"),
    )


def pack(
    docs: DataFrame,
    max_tokens: int = 2048,
    buckets: int = 16,
    budget: int = 32_768,
    block_rows: int = 50_000,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, bound, batch, slot.

    Tokens are the words of the text and one end, or what the column ``tokens`` counts.
    ``bucket`` counts from 0 by length, ``bound`` is the padded length of its pieces,
    ``batch`` counts from 0 inside the bucket and ``slot`` inside the batch;
    ``bound * (slots of a batch) <= budget`` unless one piece alone is longer.

    Null and empty texts are one token, the end. Repeated rows and null ids are packed like
    others; pieces of equal place in the order are interchangeable. An empty table gives no
    rows. Other columns of ``docs`` are not looked at.
    """
    pieces = written(pieces_of(docs, max_tokens, doc_id, text, tokens), "pieces")
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in pieces.groupBy("n_tokens").count().collect():  # max_tokens rows at most
        counts[length] = n
    bounds = best_bounds(counts, buckets)
    total = int(counts.sum())
    blocks = max(1, -(-total // block_rows))
    # The first bound that is long enough; few bounds, so plain conditions.
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bound)
    rows = pieces.withColumns(
        {
            "bucket": bucket,
            "bound": bound,
            "__block": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"),
        }
    )
    spot = ["bucket", "__block"]
    before = Window.partitionBy("bucket").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*spot)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*spot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*spot).orderBy("doc_id", "piece", "n_tokens")
    place = F.col("__before") + F.col("__row") - 1
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bound"))
    return (
        rows.withColumn("__row", F.row_number().over(inside))
        .join(offsets, spot)
        .withColumns({"__place": place, "__each": each})
        .select(
            "doc_id",
            "piece",
            "start",
            "n_tokens",
            "bucket",
            "bound",
            F.expr("__place div __each").alias("batch"),
            F.expr("__place % __each").alias("slot"),
        )
    )

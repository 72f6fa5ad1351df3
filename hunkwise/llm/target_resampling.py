"""Importance resampling of documents towards a target collection.

Features are runs of one or two words, hashed into buckets. The gain of a bucket compares its
share in the target with its share in all documents; the weight of a document is the mean
gain of its features, and Gumbel noise drawn from its id turns the highest scores into
a sample without replacement.

Within a batch, n-grams are interned in an open-addressed table of numpy arrays: keys are
xxhash64, equal keys are verified byte by byte, and every slot stores the bucket and the
count of its n-gram. The checksum that gives the bucket is taken once for each slot; the
slot ids of the occurrences then gather counts or gains. The only thing that leaves
the cluster is one sum for each bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import texts, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
EMPTY = -1


@dataclass(frozen=True)
class Resampling:
    """``buckets`` of features; ``percent`` of the documents of ``least_words`` or more are drawn;
    ``seed`` names the noise. ``features`` are interned at a time."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    features: int = 400_000


class Table:
    """Interned n-grams of one batch: arrays by slot, and the slot of every occurrence."""

    def __init__(self, grams: list[bytes], buckets: int):
        n = len(grams)
        size = 1 << max(4, (2 * n - 1).bit_length())
        mask = np.int64(size - 1)
        self.keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n)
        gram = np.empty(n, object)
        gram[:] = grams
        owner = np.full(size, EMPTY, np.int64)  # the occurrence that took the slot
        self.ids = np.empty(n, np.int64)
        todo, slot = np.arange(n), (self.keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = owner[slot] == EMPTY
            owner[slot[free]] = todo[free]  # of several, the last one has it
            own = owner[slot]
            hit = self.keys[own] == self.keys[todo]
            hit[hit] = gram[own[hit]] == gram[todo[hit]]
            self.ids[todo[hit]] = slot[hit]
            todo, slot = todo[~hit], (slot[~hit] + 1) & mask
        self.slots = np.flatnonzero(owner != EMPTY)
        self.count = np.bincount(self.ids, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        crcs = map(zlib.crc32, gram[owner[self.slots]].tolist())
        self.bucket[self.slots] = np.fromiter(crcs, np.int64, len(self.slots)) % buckets


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return WORD.findall(text.lower())


def _pieces(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """N-grams in groups of bounded size: the grams, and (row, words, grams) of each stretch in order.

    A text longer than a group is cut into stretches; the pair across a cut goes with the later one.
    """
    grams: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    for row, text in enumerate(texts(batch.column(batch.num_columns - 1))):
        words = words_of(text)
        for start in range(0, max(len(words), 1), at_once):
            own = words[start : start + at_once]
            first = max(start - 1, 0)
            with_last = words[first : start + at_once]
            pairs = list(map(b" ".join, zip(with_last, with_last[1:])))  # noqa: B905
            grams += own
            grams += pairs
            parts.append((row, len(own), len(own) + len(pairs)))
            if len(grams) >= at_once:
                yield grams, parts
                grams, parts = [], []
    if parts:
        yield grams, parts


def _counting(setup: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(setup.buckets, np.int64)
        for batch in batches:
            for grams, _ in _pieces(batch, setup.features):
                table = Table(grams, setup.buckets)
                np.add.at(total, table.bucket[table.slots], table.count[table.slots])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "features": pa.array(total[held], pa.int64())})

    return run


def bucket_counts(docs: DataFrame, setup: Resampling = Resampling(), text: str = "text") -> np.ndarray:
    """Features in each bucket over all rows; one row for each task and bucket is shuffled."""
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counting(setup), "bucket bigint, features bigint")
    out = np.zeros(setup.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("features").alias("features")).collect():  # as many rows as buckets
        out[row["bucket"]] = row["features"]
    return out


def gains(source: np.ndarray, target: np.ndarray, setup: Resampling) -> np.ndarray:
    """1000 * log of the smoothed shares' ratio, floored, for each bucket."""
    n, s, t = setup.buckets, int(source.sum()), int(target.sum())
    of = lambda a, b: math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))))
    return np.array([of(a, b) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighing(gain: np.ndarray, setup: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for grams, parts in _pieces(batch, setup.features):
                table = Table(grams, setup.buckets)
                sums = np.concatenate([[0], np.cumsum(gain[table.bucket][table.ids])])
                at = 0
                for row, words, size in parts:
                    n_words[row] += words
                    n_features[row] += size
                    total[row] += sums[at + size] - sums[at]
                    at += size
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank by score, then doc_id: dealt by ranges of that order, numbered within, offsets added."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))  # a row for each partition
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, part == starts.part).select(*rows.columns, (F.col("before") + within + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, setup: Resampling = Resampling(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Drawn are the highest scores of the documents of enough words, ties to the smaller id,
    rows without an id last among equals, equal rows in any order. A null or empty text
    has no feature, weight 0, and is never drawn; its noise is that of its id, an absent id
    counting as empty text. Repeated rows are rows of their own. An empty target leaves
    gains of the source alone, an empty table gives no rows. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, setup, text), bucket_counts(target, setup), setup)
    weighed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _weighing(gain, setup), "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )
    name = F.concat(F.lit(f"{setup.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = written(
        weighed.withColumn("score", F.col("weight") + noise).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())),
        "scored",
    )
    able = F.col("n_words") >= setup.least_words
    drawn = setup.percent * scored.filter(able).count() // 100
    ranked = _ranked(scored.filter(able)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")

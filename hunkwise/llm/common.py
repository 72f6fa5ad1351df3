"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.session import shared_dir

# The blanks that separate words, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table below the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text, native; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def same(*pairs: tuple[Column, Column]) -> Column:
    """All pairs equal, null equal to null."""
    cond = None
    for a, b in pairs:
        cond = a.eqNullSafe(b) if cond is None else cond & a.eqNullSafe(b)
    return cond


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every text, nothing for null."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def fold_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased. Splitting bytes at blanks is splitting at [\\x20\\x09-\\x0D]."""
    return text.lower().split()

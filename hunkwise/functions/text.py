"""Text helpers with the semantics of the language the inputs come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that ends a line, and every character that
# counts as blank at the ends of a text.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAKS = f"\r\n|[{OTHER_BREAKS}]"
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def unify_breaks(text: Column) -> Column:
    """Write every kind of line break as a newline.

    Most texts have newlines only; looking for the others as plain bytes is far
    cheaper than running the pattern.
    """
    others = F.lit(False)
    for ch in OTHER_BREAKS:
        others = others | text.contains(ch)
    return F.when(others, F.regexp_replace(text, LINE_BREAKS, "\n")).otherwise(text)


def without_last_break(text: Column) -> Column:
    return F.when(
        text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)


def with_lines(df: DataFrame, text: str, keep: list[str], name: str = "lines") -> DataFrame:
    """``keep`` and the lines of a text: none for an empty text, no empty line after a last break.

    The unified text is a column of its own, so that it is made once however often
    the next step looks at it.
    """
    unified = df.select(*keep, unify_breaks(F.col(text)).alias("__text"))
    whole = F.col("__text")
    lines = F.when(F.octet_length(whole) == 0, F.array().cast("array<string>")).otherwise(
        F.split(without_last_break(whole), "\n")
    )
    return unified.select(*keep, lines.alias(name))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def truncate_utf8(text: Column, limit: int, marker: str) -> Column:
    """The first ``limit`` bytes of a longer text, then ``marker``.

    A character cut in two becomes one replacement character.
    """
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit(marker))).otherwise(text)


def replace_each(text: Column, pairs) -> Column:
    """Apply (pattern, replacement) pairs one after the other."""
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))

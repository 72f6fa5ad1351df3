"""Pattern scans over added lines, screens and redaction over texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions import rules as R
from hunkwise.functions.text import replace_each, strip
from hunkwise.model import (
    AGENT_FAMILY,
    CATEGORIES,
    CONFIDENCE_DEFAULT,
    CONFIDENCE_THRESHOLD,
    FINDING_COLUMNS,
    SEVERITIES,
    finding_seq,
)
from hunkwise.operators.diff import is_added


def _entries(look_ahead: bool) -> Column:
    """Lines of a hunk that are not deleted: place, line and the next added line that is not blank.

    Looking ahead needs the lines that are not added and the blank ones gone; a hunk without the word
    ``except`` is spared that, and its lines are told apart once they are rows.
    """
    kept = F.filter("lines", lambda l: ~l.startswith("-"))
    none = F.lit(None).cast("string").alias("following")
    alone = F.transform(kept, lambda l, i: F.struct(i.alias("at"), l.alias("line"), none))
    if not look_ahead:
        return alone
    solid = F.filter(alone, lambda p: is_added(p["line"]) & (strip(_content(p["line"])) != ""))
    paired = F.zip_with(
        solid,
        F.slice(solid, 2, 1 << 30),
        lambda p, n: F.struct(p["at"].alias("at"), p["line"].alias("line"), _content(n["line"]).alias("following")),
    )
    return F.when(F.exists("lines", lambda l: l.contains("except")), paired).otherwise(alone)


def _content(line: Column) -> Column:
    return F.substring(line, F.lit(2), F.length(line))


def scan_rules(hunks: DataFrame, families: Sequence[R.Family] = R.FAMILIES) -> DataFrame:
    """Findings of all ``families`` in one pass over the added lines, without a shuffle.

    ``hunks`` has diff_id, file_no, filename, hunk_no, new_start and lines.
    """
    look_ahead = any(f.looks_ahead for f in families)
    lines = hunks.select(
        F.col("diff_id").alias("review_id"),
        "file_no",
        F.col("filename").alias("file"),
        "hunk_no",
        "new_start",
        F.inline(_entries(look_ahead)),
    )
    # Most lines have none of the words and go at once. No filter asks for the matches: it would be moved before the
    # text of the line is made and make it, and every match, again. Spreading the findings drops lines without any.
    worded = reduce(or_, [F.col("line").contains(w) for w in sorted({w for f in families for w in f.words})])
    lines = lines.where(is_added(F.col("line")) & worded).withColumn("content", _content(F.col("line")))
    matches = {
        f"m{f.number}": f.first_match(F.col("file"), F.col("content"), F.col("following")) for f in families
    }
    hit = lines.withColumns(matches)
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"m{f.number}").isNotNull(),
                    F.struct(F.lit(f.number).alias("family_no"), *f.describe(F.col(f"m{f.number}"))),
                )
                for f in families
            ]
        )
    )
    return hit.select("*", F.explode(found).alias("f")).select(
        "review_id",
        "file_no",
        finding_seq(F.col("file_no"), F.col("f.family_no"), F.col("hunk_no"), F.col("at")).alias("finding_seq"),
        "file",
        (F.col("new_start") + F.col("at")).alias("line_start"),
        (F.col("new_start") + F.col("at")).alias("line_end"),
        "f.severity",
        "f.category",
        "f.explanation",
        "f.suggested_fix",
        F.lit("rule").alias("source"),
        F.lit(1.0).alias("confidence"),
        F.lit("").alias("reasoning_trace"),
    )


def scan_secrets(hunks: DataFrame) -> DataFrame:
    return scan_rules(hunks, [R.SECRETS])


def scan_sql_injection(hunks: DataFrame) -> DataFrame:
    return scan_rules(hunks, [R.SQL_INJECTION])


def scan_exceptions(hunks: DataFrame) -> DataFrame:
    return scan_rules(hunks, [R.EXCEPTIONS])


def run_rules(hunks: DataFrame) -> DataFrame:
    return scan_rules(hunks, R.FAMILIES)


def blocklist_screen(df: DataFrame, col: str, terms: Sequence[str] = R.BLOCKED_TERMS) -> DataFrame:
    """Add the first term, in list order, that the text contains, or null."""
    first = F.coalesce(*[F.when(F.col(col).contains(t), F.lit(t)) for t in terms])
    return df.withColumn("blocked_by", first)


def screen_injection(df: DataFrame, col: str) -> DataFrame:
    """Add ``hits``, how many patterns fired one after the other, and the ``clean`` text."""
    text = F.col(col)
    stage = df.withColumns({"__t0": text, "__hits": F.lit(0)})
    for i, pattern in enumerate(R.INJECTION_PATTERNS):
        now = F.col(f"__t{i}")
        stage = stage.withColumns(
            {
                "__hits": F.col("__hits") + F.coalesce(now.rlike(pattern).cast("int"), F.lit(0)),
                f"__t{i + 1}": F.regexp_replace(now, pattern, R.INJECTION_MARK),
            }
        )
    last = F.col(f"__t{len(R.INJECTION_PATTERNS)}")
    wrapped = F.concat(F.lit(R.UNTRUSTED_OPEN + "\n"), last, F.lit("\n" + R.UNTRUSTED_CLOSE))
    return stage.select(
        *df.columns,
        F.col("__hits").alias("hits"),
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(wrapped).alias("clean"),
    )


def redact(df: DataFrame, cols: Sequence[str], ruleset=R.REDACT_PLAIN) -> DataFrame:
    return df.withColumns({c: replace_each(F.col(c), ruleset) for c in cols})


_NUMERIC = "(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)"


#: A submitted item, decoded once. Fields whose kind decides stay variants; one that cannot be cast is null.
_ITEM = (
    "struct<confidence: variant, explanation: variant, suggested_fix: variant, file: variant, "
    "line_start: double, line_end: double, severity: string, category: string, reasoning_trace: string>"
)


def confidence_gate(submissions: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Findings of submitted JSON that are complete, valid and sure enough.

    ``submissions`` has review_id, file_no, file and payload, a JSON object with a
    list ``findings``. An item that is no object, misses a field, breaks an allowed-word
    list, or whose confidence is no number or whose texts are no strings is dropped
    alone; the others of its submission stay.
    """
    def kind(c: str) -> Column:
        return F.schema_of_variant(F.col(f"i.{c}"))

    def no_text(c: str) -> Column:
        return F.col(f"i.{c}").isNotNull() & (kind(c) != "STRING")

    def text(c: str) -> Column:
        return F.try_variant_get(F.col(f"i.{c}"), "$", "string")

    # Items are decoded as they are spread: a filter on a column of a projection would decode again for every test.
    listed = F.expr("try_variant_get(try_parse_json(payload), '$.findings', 'array<variant>')")
    items = submissions.select(
        "review_id",
        "file_no",
        "file",
        F.posexplode(F.transform(listed, lambda x: F.try_variant_get(x, "$", _ITEM))).alias("at", "i"),
    )
    no_number = F.col("i.confidence").isNotNull() & ~kind("confidence").rlike(f"^{_NUMERIC}$")
    sure = F.coalesce(F.try_variant_get(F.col("i.confidence"), "$", "double"), F.lit(CONFIDENCE_DEFAULT))
    # The plain tests come first: most items that go need no kind.
    items = (
        items.where(F.col("i").isNotNull() & F.col("i.severity").isin(*SEVERITIES) & F.col("i.category").isin(*CATEGORIES))
        .where(~no_number & ~no_text("explanation") & ~no_text("suggested_fix") & ~no_text("file"))
        .select(
            "review_id",
            "file_no",
            "at",
            F.col("file").alias("own_file"),
            text("file").alias("named_file"),
            sure.alias("confidence"),
            *[F.col(f"i.{c}").alias(c) for c in ("line_start", "line_end", "severity", "category")],
            *[F.coalesce(text(c), F.lit("")).alias(c) for c in ("explanation", "suggested_fix")],
            F.coalesce("i.reasoning_trace", F.lit("")).alias("reasoning_trace"),
        )
    )
    whole = [F.col(c) == F.floor(c) for c in ("line_start", "line_end")]
    kept = items.where(
        (F.col("confidence") >= threshold) & whole[0] & whole[1]
    ).select(
        "review_id",
        "file_no",
        finding_seq(F.col("file_no"), F.lit(AGENT_FAMILY), F.lit(0), F.col("at")).alias("finding_seq"),
        F.coalesce("named_file", "own_file").alias("file"),
        F.col("line_start").cast("long"),
        F.col("line_end").cast("long"),
        "severity",
        "category",
        "explanation",
        "suggested_fix",
        F.lit("agent").alias("source"),
        "confidence",
        "reasoning_trace",
    )
    return redact(kept, ["explanation", "suggested_fix"], R.REDACT_TYPED).select(*FINDING_COLUMNS)

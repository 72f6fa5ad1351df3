"""One text per changed file for a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.operators.diff import format_diff

# The sections of a case.
INTRO = "Review the following code diff from file `%s`.\n\n## Code Diff\n```diff\n%s\n```"
CONTEXT_TITLE = "\n\n## Retrieved Context (related code from the repository)\n"
RULES_TITLE = "\n\n## Issues Already Detected by Static Rules (do NOT duplicate)\n"
CLOSING = (
    "\n\nStart by planning what to investigate, then use tools to gather "
    "evidence. When you have enough confidence, call `submit_review`."
)


def assemble_case(files: DataFrame, context: DataFrame, findings: DataFrame) -> DataFrame:
    """Diff text, context and rule findings of each file; empty sections are left out.

    ``context`` has diff_id, file_no and context. Rule findings of one file are at
    most a few per line of it, so a file's list fits beside its diff.
    """
    key = ["diff_id", "file_no"]
    items = (
        findings.groupBy(F.col("review_id").alias("diff_id"), "file_no")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "finding_seq",
                        F.format_string("- Line %d: [%s] %s", "line_start", "severity", "explanation").alias("item"),
                    )
                )
            ).alias("__i")
        )
        .select(*key, F.array_join(F.transform("__i", lambda i: i["item"]), "\n").alias("items"))
    )
    diff = format_diff(files.select(*key, "filename", "hunks"))
    empty = F.lit("")

    def section(title: str, col: str):
        return F.when(F.coalesce(F.col(col), empty) != "", F.concat(F.lit(title), col)).otherwise("")

    return (
        diff.join(context.select(*key, "context").hint("merge"), key, "left")
        .join(items.hint("merge"), key, "left")
        .select(
            *key,
            "filename",
            F.concat(
                F.format_string(INTRO, "filename", "text"),
                section(CONTEXT_TITLE, "context"),
                section(RULES_TITLE, "items"),
                F.lit(CLOSING),
            ).alias("case_text"),
        )
    )

"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hunkwise.operators.diff import hunks_of, lines_as_added, parse_files
from hunkwise.operators.evaluate import eval_metrics, match_labels
from hunkwise.operators.findings import dedupe_findings, merge_findings
from hunkwise.operators.scan import confidence_gate, run_rules


def review_changes(
    diffs: DataFrame, submissions: DataFrame | None = None, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Diffs, and what an agent handed in, to (files, findings without duplicates).

    Counts and badges need no order; ``rank_findings`` adds it where a report does.
    """
    files = parse_files(diffs, cap)
    parts = [run_rules(hunks_of(files))]
    if submissions is not None:
        parts.append(confidence_gate(submissions))
    return files, dedupe_findings(merge_findings(*parts))


def evaluate_rules(files: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rules over whole files against labels: precision and recall per file.

    ``files`` has diff_id, file_no, file and source. As in a rules-only run nothing
    is deduplicated.
    """
    hunks = lines_as_added(files.withColumnRenamed("file", "filename"))
    outcomes = match_labels(run_rules(hunks), labels, keys)
    return eval_metrics(outcomes, files.withColumnRenamed("diff_id", "review_id"), keys)

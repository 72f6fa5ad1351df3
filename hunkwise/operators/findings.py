"""Union, deduplication, order and roll-ups of findings.

Texts that are spread inside a plan have no size that a planner can tell beforehand: it would
take them for a few bytes a row and send them whole through the driver. Joins with
such tables ask for a merge of both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.ordered import ranks
from hunkwise.model import (
    FINDING_COLUMNS,
    SEVERITIES,
    columns_besides,
    severity_name,
    severity_rank,
    source_rank,
)
from hunkwise.operators.diff import NUMBER_BLOCK, line_blocks, numbered


def merge_findings(*parts: DataFrame) -> DataFrame:
    """Bag union; finding_seq already carries the order of arrival."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per review, file, line range and category: best source, then first.

    Only the first of a key is asked for, so Spark drops the others before the
    shuffle and a key that fills a third of the table sends one row per task.
    """
    key = ["review_id", "file", "line_start", "line_end", "category"]
    best = Window.partitionBy(*key).orderBy(source_rank(), F.col("finding_seq"))
    return findings.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).drop("__n")


def rank_findings(findings: DataFrame) -> DataFrame:
    """Add ``rank`` within each review by severity, source and arrival."""
    ranked = findings.withColumns({"__sev": severity_rank(), "__src": source_rank()})
    return ranks(ranked, ["review_id"], ["__sev", "__src", "finding_seq"], "rank").drop("__sev", "__src")


def attach_findings(hunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Displayed lines, each with the findings that end on it; one row per pair.

    Deleted lines have no new number and never match. Lines without a finding
    stay with nulls; findings on lines that are not displayed drop out.
    """
    # Lines meet findings by block, with the findings of two stretches of line numbers, which is all that a
    # block can reach; a row for every line is made after the shuffle.
    note = F.struct(F.col("line_end").alias("line"), "finding_seq", "severity", "category", "explanation")
    reach = F.floor(F.col("line_end") / NUMBER_BLOCK)
    notes = (
        findings.select("review_id", "file", note.alias("note"), F.explode(F.array(reach - 1, reach)).alias("__stretch"))
        .groupBy(F.col("review_id").alias("__review"), F.col("file").alias("__file"), "__stretch")
        .agg(F.collect_list("note").alias("__notes"))
        .withColumnRenamed("__stretch", "__near")
    )
    blocks = line_blocks(hunks).withColumn("__first", F.floor((F.col("new_start") + F.col("__new")) / NUMBER_BLOCK))
    met = blocks.join(
        notes.hint("merge"),
        (F.col("diff_id") == F.col("__review")) & (F.col("filename") == F.col("__file")) & (F.col("__first") == F.col("__near")),
        "left",
    )
    keep = columns_besides(hunks, "lines")
    lines = numbered(met, [*keep, "__notes"])
    own = F.when(F.col("__notes").isNotNull(), F.filter("__notes", lambda n: n["line"] == F.col("new_line")))
    rows = lines.select(*columns_besides(lines, "__notes"), F.explode_outer(own).alias("n"))
    return rows.select(*columns_besides(rows, "n"), *[f"n.{c}" for c in ("finding_seq", "severity", "category", "explanation")])


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )


def severity_rollup(reviews: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """One summary per review, newest first, with zeros where nothing was found.

    ``files`` are the parsed files, so what the parser drops is not counted.
    Both sides are counted per review before the joins.
    """
    found = severity_counts(findings, "review_id").drop("findings")
    analyzed = files.groupBy(F.col("diff_id").alias("review_id")).agg(F.count(F.lit(1)).alias("files_analyzed"))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (*SEVERITIES, "files_analyzed")]
    return (
        reviews.join(found.hint("merge"), "review_id", "left")
        .join(analyzed.hint("merge"), "review_id", "left")
        .select(*reviews.columns, *counts)
        .orderBy(F.desc("created_at"), "review_id")
    )


def review_detail(reviews: DataFrame, ranked: DataFrame, review_id=None) -> DataFrame:
    """Reviews with their findings in order, one row per finding, or one review by id.

    A review without findings keeps one row. Rows stay flat, so a review of any
    size is spread over tasks; an id reaches the stored tables as a pushed filter.
    """
    if review_id is not None:
        reviews = reviews.where(F.col("review_id") == F.lit(review_id))
        ranked = ranked.where(F.col("review_id") == F.lit(review_id))
    return reviews.join(ranked.hint("merge"), "review_id", "left")


def file_badges(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file of a review: base name, number of findings and highest severity."""
    marks = findings.groupBy(F.col("review_id").alias("diff_id"), F.col("file").alias("filename")).agg(
        F.count(F.lit(1)).alias("findings"), F.min(severity_rank()).alias("__best")
    )
    keep = columns_besides(files, "hunks")
    return files.select(*keep).join(marks.hint("merge"), ["diff_id", "filename"], "left").select(
        *keep,
        F.substring_index("filename", "/", -1).alias("base_name"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        # an unknown severity shows as the lowest
        F.when(
            F.col("__best").isNotNull(), severity_name(F.least(F.col("__best"), F.lit(len(SEVERITIES) - 1)))
        ).alias("highest"),
    )


def report_comments(findings: DataFrame) -> DataFrame:
    """Comment rows for critical and high findings."""
    head = F.format_string(
        "**[%s] %s**: %s", F.upper("severity"), F.col("category"), F.col("explanation")
    )
    fix = F.when(
        F.coalesce("suggested_fix", F.lit("")) != "",
        F.concat(F.lit("\n\nSuggested fix: "), "suggested_fix"),
    ).otherwise("")
    return findings.where(F.col("severity").isin(*SEVERITIES[:2])).select(
        "review_id",
        "finding_seq",
        F.col("file").alias("path"),
        F.col("line_end").alias("line"),
        F.when(F.col("line_start") != F.col("line_end"), F.col("line_start")).alias("start_line"),
        F.concat(head, fix).alias("body"),
    )


def report_payload(ranked: DataFrame, page: int | None = None) -> DataFrame:
    """One JSON payload per review; its headline counts all findings.

    ``ranked`` comes from ``rank_findings``. With ``page``, the comments of a review
    are cut by rank into payloads of at most so many; nothing is left out.
    """
    totals = ranked.groupBy("review_id").agg(F.count(F.lit(1)).alias("__all"))
    comments = report_comments(ranked.withColumn("finding_seq", F.col("rank")))
    pages = comments.groupBy(
        "review_id", (F.floor((F.col("finding_seq") - 1) / page) if page else F.lit(0)).cast("long").alias("page_no")
    ).agg(
        F.sort_array(
            F.collect_list(F.struct("finding_seq", "path", "line", "start_line", "body"))
        ).alias("__c")
    )
    clean = F.transform(
        F.coalesce("__c", F.array().cast("array<struct<finding_seq:bigint,path:string,line:bigint,start_line:bigint,body:string>>")),
        lambda c: F.struct(*[c[n].alias(n) for n in ("path", "line", "body", "start_line")]),
    )
    return totals.join(pages.hint("merge"), "review_id", "left").select(
        "review_id",
        F.coalesce("page_no", F.lit(0).cast("long")).alias("page_no"),
        F.size(clean).alias("comments"),
        F.to_json(
            F.struct(
                F.lit("COMMENT").alias("event"),
                F.format_string("Code review: %d finding(s) across this PR.", F.col("__all")).alias("body"),
                clean.alias("comments"),
            )
        ).alias("payload"),
    )


FINDING_JSON = (
    "file string, line_start long, line_end long, severity string, category string, explanation string, "
    "suggested_fix string, source string, confidence double, reasoning_trace string"
)


def findings_to_json(findings: DataFrame) -> DataFrame:
    """Interchange form: one JSON object per finding."""
    names = [c for c in FINDING_COLUMNS if c not in ("review_id", "file_no", "finding_seq")]
    return findings.select("review_id", "file_no", "finding_seq", F.to_json(F.struct(*names)).alias("json"))


def findings_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(
        "review_id", "file_no", "finding_seq", F.from_json("json", FINDING_JSON).alias("f")
    ).select("review_id", "file_no", "finding_seq", "f.*")

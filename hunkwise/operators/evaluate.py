"""Label matching, precision and recall, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.ordered import islands
from hunkwise.model import LINE_TOLERANCE

_PAIR = (
    "array<struct<outcome:string,finding_seq:bigint,finding_line:bigint,label_seq:bigint,label_line:bigint>>"
)


def match_labels(
    findings: DataFrame,
    labels: DataFrame,
    keys: list[str] | None = None,
    tolerance: int = LINE_TOLERANCE,
) -> DataFrame:
    """Greedy one-to-one matching of findings to labels.

    In order of arrival each finding takes the first label, in label order, that is
    unused, of its category and within ``tolerance`` lines. Gives one row per pair
    (tp), per finding left over (fp) and per label left over (fn).

    A choice can only touch what lies within the tolerance, so every file is first
    cut where no finding or label lies within reach of the next one; the fold then
    sees one such stretch of one category of one file.
    """
    keys = keys or ["review_id", "file"]
    both = findings.select(
        *keys, "category", F.lit(0).alias("kind"), F.col("finding_seq").alias("seq"), F.col("line_start").cast("long").alias("line")
    ).unionByName(
        labels.select(
            *keys, "category", F.lit(1).alias("kind"), F.col("label_seq").cast("long").alias("seq"), F.col("line").cast("long")
        )
    )
    cut = islands(both, [*keys, "category"], "line", tolerance + 1)
    item = F.struct("seq", "line")
    grouped = cut.groupBy(*keys, "category", "island").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == 0, item))).alias("found"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == 1, item))).alias("expected"),
    )

    def pick(state: Column, f: Column) -> Column:
        fits = F.filter(
            state["left"], lambda l: F.abs(l["line"] - f["line"]) <= tolerance
        )
        # Bound as the element of an array, the label is looked up once for each finding.
        return F.get(F.transform(F.array(F.get(fits, 0)), lambda label: take(state, f, label)), 0)

    def take(state: Column, f: Column, label: Column) -> Column:
        row = F.struct(
            F.when(label.isNull(), "fp").otherwise("tp").alias("outcome"),
            f["seq"].alias("finding_seq"),
            f["line"].alias("finding_line"),
            label["seq"].alias("label_seq"),
            label["line"].alias("label_line"),
        )
        return F.struct(
            F.filter(state["left"], lambda l: ~l["seq"].eqNullSafe(label["seq"])).alias("left"),
            F.concat(state["rows"], F.array(row)).alias("rows"),
        )

    def finish(state: Column) -> Column:
        rest = F.transform(
            state["left"],
            lambda l: F.struct(
                F.lit("fn").alias("outcome"),
                F.lit(None).cast("long").alias("finding_seq"),
                F.lit(None).cast("long").alias("finding_line"),
                l["seq"].alias("label_seq"),
                l["line"].alias("label_line"),
            ),
        )
        return F.concat(state["rows"], rest)

    start = F.struct(F.col("expected").alias("left"), F.array().cast(_PAIR).alias("rows"))
    rows = F.aggregate("found", start, pick, finish)
    return grouped.select(*keys, "category", F.explode(rows).alias("r")).select(*keys, "category", "r.*")


def _scores(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return df.withColumns(
        {
            "precision_raw": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0),
            "recall_raw": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0),
        }
    ).withColumns(
        {
            "precision": F.bround("precision_raw", 3),
            "recall": F.bround("recall_raw", 3),
        }
    )


_COUNTS = ("true_positives", "false_positives", "false_negatives")


def eval_metrics(outcomes: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, precision and recall per file; a file without outcomes scores 1.0."""
    keys = keys or ["review_id", "file"]
    counts = outcomes.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == o).alias(c) for o, c in zip(("tp", "fp", "fn"), _COUNTS)]
    )
    return _scores(
        files.select(*keys).join(counts, keys, "left").select(
            *keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS]
        )
    )


def eval_total(details: DataFrame) -> DataFrame:
    """Micro-averaged totals over all files, with F1."""
    total = _scores(
        details.agg(
            F.count(F.lit(1)).alias("total_fixtures"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS],
        )
    )
    return _with_f1(total)


def eval_levels(outcomes: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """Counts, precision, recall and F1 of every file, of every prefix of ``keys``, and of all, from one aggregation.

    ``level`` is the number of keys that are summed over: 0 is a file, the highest the total row;
    keys that are summed over are null. Outcomes and files go through the same grouping sets
    and are added up before the shuffle, so the total row costs one row for each task.
    """
    seen = F.lit(None).cast("string")
    rows = outcomes.select(*keys, "outcome").unionByName(files.select(*keys, seen.alias("outcome")))
    sets = [list(keys[:i]) for i in range(len(keys), -1, -1)]
    counted = rows.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("__id"),
        F.count_if(F.col("outcome").isNull()).alias("files"),
        *[F.count_if(F.col("outcome") == o).alias(c) for o, c in zip(("tp", "fp", "fn"), _COUNTS, strict=True)],
    )
    level = F.bit_count("__id").cast("int")
    return _with_f1(_scores(counted.withColumn("level", level).drop("__id"))).select(
        *keys, "level", "files", *_COUNTS, "precision", "recall", "f1"
    )


def _with_f1(scores: DataFrame) -> DataFrame:
    p, r = F.col("precision_raw"), F.col("recall_raw")
    return scores.withColumn("f1_raw", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn(
        "f1", F.bround("f1_raw", 3)
    )


def last_resolutions(posted: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Each posted finding once, with the resolution that holds for it or null.

    Posting again resets a finding, so only a resolution at or after the last
    posting counts; if any does, the very last one does. Both sides shrink to one
    row per finding before they meet.
    """
    last_post = posted.groupBy("finding_id").agg(F.max("posted_at").alias("posted_at"))
    last = resolutions.groupBy("finding_id").agg(
        F.max(F.struct("ts", "seq", "resolved")).alias("__last")
    )
    holds = F.col("__last.ts") >= F.col("posted_at")
    return last_post.join(last, "finding_id", "left").select(
        "finding_id", "posted_at", F.when(holds, F.col("__last.resolved")).alias("resolved")
    )


def acceptance_rate(tracked: DataFrame, *keys: str) -> DataFrame:
    """Totals over tracked findings; unknown ones stay in the denominator."""
    known = F.col("resolved")
    return (
        tracked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_posted"),
            F.count_if(known).alias("resolved"),
            F.count_if(~known).alias("dismissed"),
            F.count_if(known.isNull()).alias("unknown"),
        )
        .withColumn(
            "acceptance_rate",
            F.when(F.col("total_posted") > 0, F.col("resolved") / F.col("total_posted")).otherwise(0.0),
        )
    )

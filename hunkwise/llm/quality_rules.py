"""Quality rules with cross-document line frequency, native.

Base counts are array functions inside the row. The method hashes normalised lines,
counts the documents of a host that hold each, takes lines above the host's limit out,
and rejects documents of which too little is left.

A group of copies shares all its lines without any of them being boilerplate; removing
copies is for a deduplication. So the documents that hold a line are told apart by a
fingerprint: the hash of the set of all their lines. Copies share it, and two documents that
differ in any line never do. The count that is held against the limit is that of the fingerprints:
copies count once, however many they are, and hide no other document. The limit's share is one of
a host's fingerprints, too, so copies do not raise it.

Near copies differ in some line and so count apart; with enough of them on a host, all they share is
above the limit. So that a text does not vanish with its copies, the first of the depleted documents
that hold a line keeps it, and stays if enough is left of it then; the others are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import BLANKS, same, words_of, written

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class LineLimits:
    """``least`` different documents of a host, or ``share`` of them where that is more, may hold a line.

    Copies count as one document. ``left``: the part of a document's characters that must remain.
    """

    least: int = 20
    share: float = 0.002
    left: float = 0.2


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line, F.lit(BLANKS))))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words, from ``words``.

    Window hashes are compared within one document only. Most documents repeat none,
    which a set tells; only others are sorted.
    """
    n = F.size("words")
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("hashes", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn(
        "ordered", F.when(some, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    at = lambda k: F.get(F.col("ordered"), k)["h"]
    df = df.withColumn(
        "again",
        F.array_sort(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False))
                    | F.coalesce(x["h"] == at(k + 1), F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.transform("again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("again"), k + 1) - p, F.lit(WINDOW))))
    return df.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    )


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document with its base counts and its lines as (key, chars)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), body.alias("body"))
    rows = rows.withColumns({"words": words_of(F.col("body")), "parts": F.split("body", "\n")})
    rows = rows.withColumn("lines", F.filter("parts", lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    rows = _with_repeats(rows)
    n = F.size("words").cast("long")
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("body").alias("text_hash"),
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        F.transform(
            "lines", lambda x: F.struct(line_key(x).alias("key"), F.length(F.trim(x, F.lit(BLANKS))).alias("chars"))
        ).alias("lines"),
    )


def apply_rules(
    docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: base counts, base_failed, kept, removed (keys of lines taken out).

    Null or empty texts have no words, fail the base rule and are not kept. A null host
    is a host of its own. Rows that repeat a document count as documents each; they have
    the same result. Lines are compared after trimming blanks and lower-casing; blank
    lines are never counted. A line at its limit stays, one above it goes. An empty
    table gives no rows; other columns of ``docs`` are not looked at.
    """
    facts = written(
        base_counts(docs, doc_id, text, host).withColumn("row", F.monotonically_increasing_id()), "rule-facts"
    )
    keys = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["key"])))
    each = facts.select("host", keys.alias("keys")).select("host", F.xxhash64("keys").alias("print"), F.explode("keys").alias("key"))
    hosts = facts.select("host", F.xxhash64(keys).alias("print")).distinct().groupBy("host").agg(
        F.greatest(F.lit(float(limits.least)), F.count(F.lit(1)) * limits.share).alias("most")
    )
    many = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limits.least)
    frequent = written(
        many.alias("m")
        .join(hosts.alias("h"), same((F.col("m.host"), F.col("h.host"))))
        .filter("n > most")
        .select("m.host", "key", "most"),
        "rule-frequent",
    )
    on = lambda a, b: same((F.col(f"{a}.host"), F.col(f"{b}.host"))) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    prints = (
        each.alias("e")
        .join(frequent.alias("f"), on("e", "f"))
        .groupBy("f.host", "f.key", "most")
        .agg(F.count_distinct("print").alias("prints"))
    )
    above = written(
        prints.filter("prints > most").select("host", "key"),
        "rule-lines",
    )
    doc = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("text_hash").alias("text"))
    lines = facts.select("row", "host", doc.alias("doc"), F.explode("lines").alias("line")).select(
        "row", "host", "doc", "line.key", "line.chars"
    )
    hits = written(lines.alias("l").join(above.alias("a"), on("l", "a")).select("l.*"), "rule-hits")
    gone = hits.groupBy("row").agg(F.sum("chars").alias("gone_chars"), F.collect_set("key").alias("removed"))
    all_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    sized = facts.withColumn("all_chars", all_chars).join(gone, "row", "left")
    poor = sized.filter(F.col("all_chars") - F.col("gone_chars") < F.col("all_chars") * limits.left).select("row")
    lost = hits.join(poor, "row")
    first = lost.groupBy("host", "key").agg(F.min("doc").alias("doc"))
    mine = on("l", "f") & (F.col("l.doc") == F.col("f.doc"))
    saved = (
        lost.alias("l")
        .join(first.alias("f"), mine)
        .groupBy("l.row")
        .agg(F.sum("chars").alias("saved_chars"), F.collect_set("l.key").alias("saved"))
    )
    chars = F.col("all_chars") - F.coalesce("gone_chars", F.lit(0)) + F.coalesce("saved_chars", F.lit(0))
    none = F.array().cast("array<bigint>")
    return (
        sized.join(saved, "row", "left")
        .withColumn("depleted", F.coalesce(chars < F.col("all_chars") * limits.left, F.lit(False)))
        .select(
            *[c for c in facts.columns if c not in ("row", "lines")],
            "depleted",
            (~F.col("base_failed") & ~F.col("depleted")).alias("kept"),
            F.array_except(
                F.coalesce("removed", none), F.when(F.col("depleted"), none).otherwise(F.coalesce("saved", none))
            ).alias("removed"),
        )
    )


def filter_documents(
    docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, and without the lines above their limits.

    Only documents that are rejected or lose lines are looked up; the rest stay as they are.
    """
    rules = apply_rules(docs, limits, doc_id, text, host)
    acts = rules.filter(~F.col("kept") | (F.size("removed") > 0)).groupBy("doc_id", "host", "text_hash").agg(
        F.bool_and("kept").alias("kept"), F.first("removed").alias("removed")
    )
    old = F.col(f"d.{text}")
    lines = F.filter(
        F.split(old, "\n"), lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~F.array_contains("a.removed", line_key(x))
    )
    body = F.when(F.size("a.removed") > 0, F.array_join(lines, "\n")).otherwise(old)
    return (
        docs.alias("d")
        .join(
            acts.alias("a"),
            same(
                (F.col(f"d.{doc_id}"), F.col("a.doc_id")),
                (F.col(f"d.{host}"), F.col("a.host")),
                (F.xxhash64(F.coalesce(old, F.lit(""))), F.col("a.text_hash")),
            ),
            "left",
        )
        .filter(F.coalesce("a.kept", F.lit(True)))
        .select(*[body.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
    )

"""Limits, running costs, alarms and budgets over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.functions.ordered import running_sums
from hunkwise.model import (
    ALARM_EMPTY_RATE,
    ALARM_MIN_REVIEWS,
    COST_CAP,
    COST_PER_TOKEN,
    MAX_ITERATIONS,
    REQUESTS_PER_WINDOW,
    TOKEN_BUDGET,
    WINDOW_SECONDS,
)
from hunkwise.session import stored

MICROS = 1_000_000


def block_of(position: str, width: int) -> Column:
    """Blocks of ``width`` along a long column, rising with it also below zero."""
    return F.expr(f"(`{position}` - pmod(`{position}`, {width}L)) div {width}L")


def accept_ticks(n: int, window: int, ends: bool):
    """Batches of (key, block, at, n, start) in order -> how many of each tick are let through.

    ``start`` holds the accepted times that a block begins with. Only accepted times still inside the
    window are kept, at most ``n`` of them, so a block of any length streams through. While the
    window is full the next tick that can pass is looked up, not walked to. With ``ends``
    the times that each block ends with are given out instead.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, live, done = None, [], []

        def given():
            keys, blocks, times = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(blocks, pa.int64()), pa.array(times, pa.list_(pa.int64()))], names=["key", "block", "end"]
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.column("at").to_numpy()
            many = batch.column("n").to_numpy()
            mark = batch.column("block").to_numpy()
            keys, starts = batch.column("key"), batch.column("start")
            kind = keys.type
            code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(mark) != 0)) + 1
            passed = np.zeros(len(at), dtype=np.int64)
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(at)]):
                here = (keys[int(lo)].as_py(), int(mark[lo]))
                if here != group:
                    if group is not None:
                        done.append((*group, live))
                    group, live = here, list(starts[int(lo)].as_py())
                i = int(lo)
                while i < hi:
                    now = int(at[i])
                    while live and live[0] <= now - window:
                        live.pop(0)
                    room = n - len(live)
                    if room > 0:
                        take = min(room, int(many[i]))
                        passed[i] = take
                        live.extend([now] * take)
                        i += 1
                    else:
                        i += int(np.searchsorted(at[i:hi], live[0] + window))
            if ends:
                if done:
                    yield given()
                    done = []
                continue
            some = np.flatnonzero(passed)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(some)), pa.array(at[some]), pa.array(passed[some])],
                names=["key", "at", "passed"],
            )
        if ends and group is not None:
            done.append((*group, live))
            yield given()

    return run


def _block_starts(ticks: DataFrame, n: int, window: int) -> DataFrame:
    """(key, block, start): the accepted times that every block of ``ticks`` begins with.

    All blocks are decided at once, as if nothing came before. Then each takes what the one before it
    ended with, and only those are decided again whose beginning has changed, until none has. Times are
    forgotten after a window, so a block soon remembers the same whatever it began with, and two
    or three rounds are usual; a key that never forgets takes a round for every block, and ends all the same.
    """
    kind = ticks.schema["key"].dataType
    end = T.StructType(
        [T.StructField("key", kind), T.StructField("block", T.LongType()), T.StructField("end", T.ArrayType(T.LongType()))]
    )
    none = F.array().cast("array<bigint>")

    def decided(rows: DataFrame) -> DataFrame:
        return _in_blocks(rows).mapInArrow(accept_ticks(n, window, True), end)

    blocks = ticks.groupBy("key", "block").agg(F.min("at").alias("first"))
    known = blocks.join(decided(ticks.withColumn("start", none)), ["key", "block"]).withColumn("start", none)
    along = Window.partitionBy("key").orderBy("block")
    while True:
        before = F.coalesce(F.lag("end").over(along), none)
        begun = F.filter(before, lambda t: t > F.col("first") - window)
        chained = stored(known.withColumn("next", begun), "limit-blocks")
        changed = chained.where(~F.col("start").eqNullSafe(F.col("next"))).select("key", "block", F.col("next").alias("start"))
        if changed.isEmpty():
            return chained.select("key", "block", "start")
        again = decided(ticks.join(changed, ["key", "block"])).withColumnRenamed("end", "new_end")
        known = chained.join(again, ["key", "block"], "left").select(
            "key", "block", "first", F.coalesce("new_end", "end").alias("end"), F.col("next").alias("start")
        )


def _in_blocks(ticks: DataFrame) -> DataFrame:
    return (
        ticks.select("key", "block", "at", "n", "start")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "at")
    )


def rate_limit(
    events: DataFrame,
    key: str,
    at: str,
    event_id: str,
    n: int = REQUESTS_PER_WINDOW,
    window_s: int = WINDOW_SECONDS,
    block_windows: int = 64,
) -> DataFrame:
    """Add ``allowed``: an event passes while fewer than ``n`` accepted ones are in its window.

    ``at`` is in microseconds; an entry exactly one window old has expired. Ties
    go by ``event_id``, which is unique. Events without a key are not let through.

    The decision depends on earlier decisions, so it is a fold, but only over times:
    events are counted per (key, time) first, and each key is cut into blocks of ``block_windows``
    windows. Blocks are decided side by side and stitched where the times that they remember
    meet, so a key that never rests, with a third of all events, still runs in many tasks; the
    events themselves are spread by time and id.
    """
    n = n or REQUESTS_PER_WINDOW
    window = window_s * MICROS
    spot = events.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(event_id).alias("id"))
    counted = spot.where("key is not null").groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    ticks = stored(counted.withColumn("block", block_of("at", block_windows * window)), "limit-ticks")
    schema = T.StructType(
        [
            T.StructField("key", spot.schema["key"].dataType),
            T.StructField("at", T.LongType()),
            T.StructField("passed", T.LongType()),
        ]
    )
    begun = ticks.join(_block_starts(ticks, n, window), ["key", "block"])
    passed = _in_blocks(begun).mapInArrow(accept_ticks(n, window, False), schema)
    order = Window.partitionBy("key", "at").orderBy("id")
    first = spot.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    accepted = (
        first.join(passed, ["key", "at"])
        .where(F.col("nth") <= F.col("passed"))
        .select(F.col("id").alias("__id"), F.lit(True).alias("__ok"))
    )
    return events.join(accepted, F.col(event_id) == F.col("__id"), "left").select(
        *events.columns, F.coalesce("__ok", F.lit(False)).alias("allowed")
    )


def quota_remaining(
    accepted: DataFrame,
    probes: DataFrame,
    key: str,
    at: str,
    n: int = REQUESTS_PER_WINDOW,
    window_s: int = WINDOW_SECONDS,
) -> DataFrame:
    """Add ``remaining`` to each probe (key, time): what is left of ``n`` in its window.

    Probes and accepted events meet on (key, window number); at most ``n`` accepted
    events share one, so a probe meets at most 2n.
    """
    window = window_s * MICROS
    asked = probes.withColumn("__probe", F.monotonically_increasing_id()) if "probe_id" not in probes.columns else probes.withColumn("__probe", F.col("probe_id"))
    slot = block_of(at, window)
    used = accepted.select(F.col(key).alias("__k"), F.col(at).alias("__t"), slot.alias("__slot"))
    near = asked.select(
        "__probe", F.col(key).alias("__k"), F.col(at).alias("__at"), F.explode(F.array(slot, slot - 1)).alias("__slot")
    )
    counted = (
        near.join(used, ["__k", "__slot"])
        .where((F.col("__t") > F.col("__at") - window) & (F.col("__t") <= F.col("__at")))
        .groupBy("__probe")
        .agg(F.count(F.lit(1)).alias("__used"))
    )
    return asked.join(counted, "__probe", "left").select(
        *probes.columns, F.greatest(F.lit(0), n - F.coalesce("__used", F.lit(0))).alias("remaining")
    )


def usage_ledger(usage: DataFrame, cap: float = COST_CAP) -> DataFrame:
    """Running tokens, calls and cost per review, and whether the cap still holds.

    ``usage`` has review_id, seq, at (microseconds), kind and tokens. A row of kind
    ``start`` resets its review; exactly the cap is still within it.
    """
    rate, per = COST_PER_TOKEN
    starts = F.col("kind") == "start"
    ledger = running_sums(
        usage,
        ["review_id"],
        ["at", "seq"],
        {
            "epoch": F.coalesce(starts, F.lit(False)).cast("long"),
            "total_tokens": F.when(~starts, F.col("tokens")).otherwise(0).cast("long"),
            "api_calls": F.coalesce(~starts, F.lit(False)).cast("long"),
        },
        reset=starts,
        since=("total_tokens", "api_calls"),
    )
    cost = F.col("total_tokens") * F.lit(rate) / F.lit(float(per))
    return ledger.withColumn("cost_usd", cost).withColumn("within_cap", ~(F.col("cost_usd") > cap))


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Final totals of each review since its last start, and how long that took."""
    last = ["epoch", "at", "seq", "total_tokens", "api_calls", "cost_usd"]
    per_epoch = ledger.groupBy("review_id", "epoch").agg(
        F.min("at").alias("__start"), F.max(F.struct(*last)).alias("__end")
    )
    final = per_epoch.groupBy("review_id").agg(F.max(F.struct("epoch", "__end", "__start")).alias("f"))
    return final.select(
        "review_id",
        "f.__end.total_tokens",
        "f.__end.api_calls",
        "f.__end.cost_usd",
        (F.col("f.__end.at") - F.col("f.__start")).alias("duration_us"),
    )


def outcome_flags() -> dict[str, Column]:
    nothing = (F.col("rule_count") == 0) & (F.col("agent_count") == 0)
    rules_only = (F.col("rule_count") > 0) & (F.col("agent_count") == 0) & ~F.col("had_errors")
    return {
        "total_reviews": F.lit(1).cast("long"),
        "empty_reviews": nothing.cast("long"),
        "agent_failures": F.col("had_errors").cast("long"),
        "rule_only_reviews": rules_only.cast("long"),
    }


def empty_rate_monitor(
    outcomes: DataFrame, min_total: int = ALARM_MIN_REVIEWS, threshold: float = ALARM_EMPTY_RATE
) -> DataFrame:
    """Running outcome counts per group, and the alarm for too many empty reviews.

    ``outcomes`` has group_key, at (microseconds), seq, rule_count, agent_count and had_errors.
    """
    run = running_sums(outcomes, ["group_key"], ["at", "seq"], outcome_flags())
    rate = F.col("empty_reviews") / F.col("total_reviews")
    return run.withColumn("alarm", (F.col("total_reviews") >= min_total) & (rate > threshold))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("group_key").agg(*[F.sum(v).alias(n) for n, v in outcome_flags().items()])


def turn_budget(
    calls: DataFrame, max_iter: int = MAX_ITERATIONS, budget: int = TOKEN_BUDGET
) -> DataFrame:
    """Add ``kept``: whether a logged model call would have been made.

    ``calls`` has conv_id, turn, tokens, is_submit and uses_tools. A call is made
    while fewer than ``max_iter`` and less than ``budget`` tokens went before, and
    no earlier call submitted or came back without tools. ``gives_findings`` marks
    the kept call that submits.
    """
    ends = F.col("is_submit") | ~F.col("uses_tools")
    run = running_sums(
        calls,
        ["conv_id"],
        ["turn"],
        {
            "calls_before": F.lit(1).cast("long"),
            "tokens_before": F.col("tokens").cast("long"),
            "__ends_before": ends.cast("long"),
        },
        inclusive=False,
    )
    kept = (
        (F.col("calls_before") < max_iter) & (F.col("tokens_before") < budget) & (F.col("__ends_before") == 0)
    )
    return run.withColumn("kept", kept).withColumn("gives_findings", kept & F.col("is_submit")).drop("__ends_before")

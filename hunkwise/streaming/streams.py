"""The streaming forms: the same column logic on ``readStream`` inputs."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from hunkwise.model import COST_CAP, COST_PER_TOKEN, REQUESTS_PER_WINDOW, WINDOW_SECONDS, columns_besides
from hunkwise.operators.chunks import upsert_chunks
from hunkwise.operators.diff import hunks_of, parse_files
from hunkwise.operators.ledger import MICROS, outcome_flags
from hunkwise.operators.scan import run_rules
from hunkwise.session import shared_dir
from hunkwise.sources.tables import pr_events


def stream_pr_events(received: DataFrame) -> DataFrame:
    """Review requests from a stream of payloads; stateless."""
    return pr_events(received)


def stream_rules(diffs: DataFrame, cap: int | None = None) -> DataFrame:
    """Rule findings of diffs as they arrive. A diff is one row, so no state is kept."""
    return run_rules(hunks_of(parse_files(diffs, cap)))


def decide_again(at: list[int], ids: list, allowed: list[bool], start: int, n: int, window: int) -> list[bool]:
    """Decisions of events in order, those before ``start`` as they stand."""
    live = [t for t, ok in zip(at[:start], allowed[:start], strict=True) if ok]
    out = list(allowed[:start])
    for now in at[start:]:
        live = [t for t in live if t > now - window]
        out.append(len(live) < n)
        if out[-1]:
            live.append(now)
    return out


def stream_rate_limit(
    events: DataFrame,
    key: str,
    at: str,
    event_id: str,
    n: int = REQUESTS_PER_WINDOW,
    window_s: int = WINDOW_SECONDS,
    delay_s: int = 86_400,
) -> DataFrame:
    """Decide each event on arrival, and again when an earlier one of its key turns up.

    Use it in update mode and keep the last row of each event. No row is lost: an event up to ``delay_s``
    behind the newest of its key takes its place, and what it changes is given out again; one
    that is farther behind is given out as ``late``, undecided. So with a delay that covers
    the disorder, the result is the batch form's in whatever order files come.

    The state of a key is its events of the last ``delay_s`` and window, so a key holds what it sends
    in that time and, at rest, its last ones: a watermark would let keys go, but drop late rows.
    A batch bounds the rest: size it with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    """
    window, reach = window_s * MICROS, delay_s * MICROS
    fields = {f.name: f.dataType for f in events.schema}
    out = T.StructType(
        [
            T.StructField(key, fields[key]),
            T.StructField(at, T.LongType()),
            T.StructField(event_id, fields[event_id]),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("late", T.BooleanType()),
        ]
    )
    memory = T.StructType(
        [
            T.StructField("at", T.ArrayType(T.LongType())),
            T.StructField("id", T.ArrayType(fields[event_id])),
            T.StructField("allowed", T.ArrayType(T.BooleanType())),
        ]
    )

    def decide(name, parts, state):
        import bisect

        import pandas as pd

        held = [list(x) for x in state.get] if state.exists else [[], [], []]
        rows = pd.concat(list(parts)).sort_values([at, event_id])
        new = list(zip(rows[at].tolist(), rows[event_id].tolist(), strict=True))
        behind = held[0][-1] - reach if held[0] else None
        late = [r for r in new if behind is not None and r[0] < behind]
        old = dict(zip(zip(held[0], held[1], strict=True), held[2], strict=True))
        fresh = [r for r in new[len(late) :] if r not in old]  # an event that comes again is known
        merged = sorted([*old, *fresh])
        start = bisect.bisect_left(merged, fresh[0]) if fresh else len(merged)
        times, ids = [r[0] for r in merged], [r[1] for r in merged]
        before = [old[r] for r in merged[:start]]
        allowed = decide_again(times, ids, before, start, n, window)
        first = bisect.bisect_right(times, times[-1] - reach - window) if times else 0
        state.update((times[first:], ids[first:], allowed[first:]))
        given = [(*r, ok, False) for r, ok in zip(merged[start:], allowed[start:], strict=True) if old.get(r) is not ok]
        given += [(*r, None, True) for r in late]
        if given:
            frame = pd.DataFrame(given, columns=[at, event_id, "allowed", "late"])
            frame.insert(0, key, name[0])
            yield frame

    return (
        events.select(key, at, event_id)
        .groupBy(key)
        .applyInPandasWithState(decide, out, memory, "update", GroupStateTimeout.NoTimeout)
    )


def roll_up(outcomes: DataFrame, length: str = "1 day") -> DataFrame:
    """Outcome counts per group and event-time window, batch or stream; counts of parts add up."""
    timed = outcomes if "event_time" in outcomes.columns else outcomes.withColumn("event_time", F.timestamp_micros("at"))
    return (
        timed.groupBy(F.window("event_time", length).alias("w"), "group_key")
        .agg(*[F.sum(v).alias(n) for n, v in outcome_flags().items()])
        .select(F.unix_micros("w.start").alias("window_start"), "group_key", *outcome_flags())
    )


def stream_rollup(outcomes: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``roll_up`` with a watermark: a window is given out when it is closed, and leaves the state.

    Rows later than the delay are not in it. Where none may be missed, add up the ``roll_up`` of every
    batch with ``drain_sums``, which keeps no state.
    """
    timed = outcomes.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
    return roll_up(timed, length)


def stream_upsert(path: str, keys: tuple[str, ...], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges chunks into the table at ``path``, as ``upsert_chunks`` does.

    The table is dealt into ``buckets`` by a hash of the keys; a batch rewrites the buckets that it has rows
    for and leaves the others. A bucket is replaced as a whole, and merging the same rows again changes
    nothing, so a batch that broke off is simply run again. At most ``buckets`` numbers reach the driver.
    """

    def write(held: DataFrame, new: DataFrame) -> None:
        merged = upsert_chunks(held, new, (*keys, "bucket")).hint("rebalance", "bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    def merge(rows: DataFrame, number: int) -> None:
        new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        try:
            held = rows.sparkSession.read.schema(new.schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            # Nothing is held yet, so it does not matter which buckets have rows, and the batch is passed over once.
            write(new.limit(0), new)
            return
        new = new.persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            if touched:
                write(held.where(F.col("bucket").isin(touched)), new)
        finally:
            new.unpersist()

    return merge


def stream_acceptance(
    posted: DataFrame, resolutions: DataFrame, horizon: str, delay: str = "1 hour"
) -> DataFrame:
    """Posted findings, each with every resolution up to ``horizon`` after it, or with nulls: an outer join of two streams.

    ``posted`` has finding_id and posted_at, ``resolutions`` finding_id, ts, seq and resolved; times are in
    microseconds. Both sides have a watermark of ``delay``. A posting stays in the state for the horizon, a
    resolution until no posting can match it, and a posting without resolution is
    given out when its horizon has passed. ``last_of_posted`` makes one row a finding of it.
    """
    p = posted.select("finding_id", "posted_at", F.timestamp_micros("posted_at").alias("posted_time")).withWatermark("posted_time", delay)
    r = resolutions.select(
        F.col("finding_id").alias("__id"), "ts", "seq", "resolved", F.timestamp_micros("ts").alias("solved_time")
    ).withWatermark("solved_time", delay)
    near = (F.col("finding_id") == F.col("__id")) & (F.col("solved_time") >= F.col("posted_time"))
    near &= F.col("solved_time") <= F.col("posted_time") + F.expr(f"interval {horizon}")
    return p.join(r, near, "leftOuter").select("finding_id", "posted_at", "ts", "seq", "resolved")


def last_of_posted(pairs: DataFrame) -> DataFrame:
    """(finding_id, posted_at, resolved): the last posting of each finding, with the last resolution after it."""
    best = F.max(F.struct("posted_at", "ts", "seq", "resolved")).alias("b")
    return pairs.groupBy("finding_id").agg(best).select("finding_id", "b.posted_at", "b.resolved")


def stream_usage(usage: DataFrame, delay: str = "1 hour", idle_s: int = 7 * 86_400, cap: float = COST_CAP) -> DataFrame:
    """The running ledger of ``usage_ledger`` on a stream: state by review, timers of event time.

    Rows wait in a list until the watermark has passed them, so that they are counted in order of
    time whatever batch they came in; then the running totals move on and the rows are given
    out. Totals of a review that rests for ``idle_s`` of event time leave the state. Rows later than ``delay``
    are dropped by the watermark: choose it to cover the disorder. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    fields = {f.name: f.dataType for f in usage.schema}
    rate, per = COST_PER_TOKEN
    row = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("start", T.BooleanType()), T.StructField("tokens", T.LongType())])
    sums = T.StructType([T.StructField(c, T.LongType()) for c in ("epoch", "total_tokens", "api_calls", "last")])
    out = T.StructType(
        [
            T.StructField("review_id", fields["review_id"]),
            *[T.StructField(c, T.LongType()) for c in ("seq", "at", "epoch", "total_tokens", "api_calls")],
        ]
    )

    class Ledger(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", row)
            self.totals = handle.getValueState("totals", sums)

        def handleInputRows(self, key, rows, timerValues):
            for part in rows:
                columns = [part["at"].tolist(), part["seq"].tolist(), (part["kind"] == "start").tolist(), part["tokens"].tolist()]
                self.waiting.appendList([tuple(x) for x in zip(*columns, strict=True)])
                # The earliest waiting row always has a timer; what is left when it fires gets the next one.
                if columns[0]:
                    self.handle.registerTimer((min(columns[0]) // MICROS + 1) * 1000)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
            due = [r for r in waiting if r[0] < passed]
            epoch, tokens, calls, last = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
            if not due:
                if not waiting and last and passed >= last + idle_s * MICROS:
                    self.totals.clear()
                return iter([])
            given = []
            for moment, seq, start, used in due:
                if last and moment > last + idle_s * MICROS:
                    epoch, tokens, calls = 0, 0, 0
                last = moment
                if start:
                    epoch, tokens, calls = epoch + 1, 0, 0
                else:
                    tokens, calls = tokens + used, calls + 1
                given.append((key[0], seq, moment, epoch, tokens, calls))
            if len(due) < len(waiting):
                self.waiting.put(waiting[len(due) :])
                self.handle.registerTimer((waiting[len(due)][0] // MICROS + 1) * 1000)
            else:
                self.waiting.clear()
            self.totals.update((epoch, tokens, calls, due[-1][0]))
            self.handle.registerTimer((due[-1][0] // MICROS + idle_s + 1) * 1000)
            return iter([pd.DataFrame(given, columns=out.names)])

        def close(self) -> None:
            pass

    timed = usage.select("review_id", "seq", "at", "kind", "tokens", F.timestamp_micros("at").alias("event_time"))
    ledger = (
        timed.withWatermark("event_time", delay)
        .groupBy("review_id")
        .transformWithStateInPandas(Ledger(), out, "Append", "EventTime")
    )
    cost = F.col("total_tokens") * F.lit(rate) / F.lit(float(per))
    return ledger.withColumn("cost_usd", cost).withColumn("within_cap", ~(F.col("cost_usd") > cap))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def drain(stream: DataFrame, purpose: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and read the result back.

    ``close`` may add rows that move the watermark beyond all others; the stream then goes on from its
    checkpoint, so that nothing stays open in the state.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if close is not None:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Closing:
    """A stream of marker rows that stays empty until it is told the time at which to close."""

    def __init__(self, spark: SparkSession, like: DataFrame, purpose: str):
        self.spark, self.schema, self.path = spark, like.schema, shared_dir(spark, purpose)
        spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.stream = spark.readStream.schema(self.schema).parquet(self.path)

    def add(self, **values) -> None:
        row = [values.get(f.name) for f in self.schema]
        self.spark.createDataFrame([tuple(row)], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema])).coalesce(
            1
        ).write.mode("append").parquet(self.path)


def drain_into(stream: DataFrame, purpose: str, merge: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now, each batch handed to ``merge``."""
    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{shared_dir(stream.sparkSession, purpose)}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_sums(stream: DataFrame, purpose: str, part: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Sums over a stream without state: ``part`` adds up each batch, and the parts add up when read.

    Rows count however late they come. Each batch replaces its own folder, so one that is run again
    adds nothing.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    empty = part(spark.createDataFrame([], stream.schema))
    empty.write.parquet(f"{base}/batch=-1")

    def keep(rows: DataFrame, number: int) -> None:
        part(rows).write.mode("overwrite").parquet(f"{base}/batch={number}")

    drain_into(stream, f"{purpose}-progress", keep)
    values = columns_besides(empty, *keys)
    return spark.read.parquet(base).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def drain_updates(stream: DataFrame, purpose: str, keys: list[str]) -> DataFrame:
    """Run an updating stream over what is there now: the last row of every key.

    Each batch replaces its own folder, so a batch that is run again adds nothing.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    values = columns_besides(stream, *keys)
    last = F.max_by(F.struct(*values), "batch").alias("last")
    return spark.read.parquet(f"{base}/out").groupBy(*keys).agg(last).select(*keys, "last.*")

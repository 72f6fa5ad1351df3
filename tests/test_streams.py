"""Streams over several batches: state is carried, expires, and late rows still count."""

import random
import time

from pyspark.sql import functions as F

from hunkwise.operators import chunks, evaluate, ledger
from hunkwise.session import shared_dir
from hunkwise.streaming import streams

S = 1_000_000
EVENTS = "user_id long, at long, event_id long"


def in_files(spark, folder, parts, schema):
    """One file for each part, read one a batch in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i + 1 < len(parts) else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rate_limit_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.randrange(4), rng.randrange(4_000) * S, i) for i in range(300))
    rows.sort(key=lambda r: r[1])
    stream = in_files(spark, tmp_path / "events", [rows[:90], rows[90:200], rows[200:]], EVENTS)
    decided = streams.stream_rate_limit(stream, "user_id", "at", "event_id", 3, 60, delay_s=60)
    got = {(r.event_id, r.allowed) for r in streams.drain_updates(decided, "limit", ["event_id"]).collect()}
    batch = ledger.rate_limit(spark.createDataFrame(rows, EVENTS), "user_id", "at", "event_id", 3, 60)
    assert got == {(r.event_id, r.allowed) for r in batch.collect()}


def test_rollup_gives_all_windows_and_late_rows(spark, tmp_path):
    schema = "group_key long, at long, rule_count long, agent_count long, had_errors boolean"
    hour = 3_600 * S
    first = [(1, 0, 0, 0, False), (1, 30 * hour, 1, 0, False)]
    second = [(1, 29 * hour + 1, 0, 1, False), (2, 49 * hour, 0, 0, True)]  # late by less than the delay
    stream = in_files(spark, tmp_path / "outcomes", [first, second], schema)
    rolled = streams.drain_updates(streams.stream_rollup(stream, delay="2 hours"), "rollup", ["window_start", "group_key"])
    got = {(r.window_start // (24 * hour), r.group_key): r.total_reviews for r in rolled.collect()}
    assert got == {(0, 1): 1, (1, 1): 2, (2, 2): 1}


def test_rate_limit_loses_no_row_in_reverse_order(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.randrange(3), rng.randrange(2_000) * S, i) for i in range(200)), key=lambda r: r[1])
    parts = [rows[140:], rows[60:140], rows[:60]]
    batch = ledger.rate_limit(spark.createDataFrame(rows, EVENTS), "user_id", "at", "event_id", 3, 60)
    want = {r.event_id: r.allowed for r in batch.collect()}
    for delay, late in ((2_000, 0), (10, 140)):
        stream = in_files(spark, tmp_path / f"events{delay}", parts, EVENTS)
        decided = streams.stream_rate_limit(stream, "user_id", "at", "event_id", 3, 60, delay_s=delay)
        got = {r.event_id: (r.allowed, r.late) for r in streams.drain_updates(decided, "reverse", ["event_id"]).collect()}
        assert set(got) == set(want) and sum(x[1] for x in got.values()) <= late
        if not late:
            assert {i: x[0] for i, x in got.items()} == want
        else:
            assert all((x[0] is None) == x[1] for x in got.values()) and any(x[1] for x in got.values())


def test_rollup_loses_no_row_in_reverse_order(spark, tmp_path):
    schema = "group_key long, at long, rule_count long, agent_count long, had_errors boolean"
    rows = [(i % 3, i * 3_600 * S, i % 2, 0, i % 5 == 0) for i in range(120)]
    stream = in_files(spark, tmp_path / "outcomes", [rows[80:], rows[40:80], rows[:40]], schema)
    got = streams.drain_sums(stream, "rollup", streams.roll_up, ["window_start", "group_key"])
    want = streams.roll_up(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 15


def test_upsert_over_batches_one_of_them_again(spark):
    """Five batches, the third repeated and the fourth broken off once, equal the batch form."""
    rng = random.Random(9)
    schema = "repo string, chunk_id string, content string, batch_no int, arrival long"
    parts = [[(rng.choice("ab"), f"c{rng.randrange(40)}", f"{n}-{i}", n, i) for i in range(60)] for n in range(5)]
    path = shared_dir(spark, "upsert")
    merge = streams.stream_upsert(path, ("repo", "chunk_id"), buckets=7)
    for n in (0, 1, 2, 2, 3, 4, 1):
        merge(spark.createDataFrame(parts[n], schema), n)
    merge(spark.createDataFrame([], schema), 5)
    got = spark.read.parquet(path).drop("bucket")
    first = spark.createDataFrame(parts[0], schema)
    want = chunks.upsert_chunks(first, spark.createDataFrame([r for p in parts[1:] for r in p], schema))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() == len({r[:2] for p in parts for r in p})


def test_upsert_leaves_other_buckets(spark):
    from pathlib import Path

    schema = "repo string, chunk_id string, content string, batch_no int, arrival long"
    path = shared_dir(spark, "upsert")
    merge = streams.stream_upsert(path, ("repo", "chunk_id"), buckets=5)
    merge(spark.createDataFrame([("a", f"c{i}", "x", 1, i) for i in range(50)], schema), 0)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    merge(spark.createDataFrame([("a", "c7", "y", 2, 0)], schema), 1)
    after = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert len({f.parent for f in set(before) - set(after)}) == 1
    assert spark.read.parquet(path).where("chunk_id = 'c7'").first().content == "y" and spark.read.parquet(path).count() == 50


def test_acceptance_of_two_streams(spark, tmp_path):
    rng = random.Random(3)
    posts = sorted([(f"{i % 4}-{rng.randrange(5)}", rng.randrange(1_000) * S) for i in range(40)], key=lambda r: r[1])
    solved = sorted(
        [(f"{i % 5}-{rng.randrange(5)}", rng.randrange(1_200) * S, i, rng.random() < 0.5) for i in range(50)], key=lambda r: r[1]
    )
    p_schema, r_schema = "finding_id string, posted_at long", "finding_id string, ts long, seq long, resolved boolean"
    p = in_files(spark, tmp_path / "p", [posts[:15], posts[15:]], p_schema)
    r = in_files(spark, tmp_path / "r", [solved[:20], solved[20:]], r_schema)
    ends = [streams.Closing(spark, x, "closing") for x in (p, r)]

    def close():
        ends[0].add(posted_at=10_000 * S)
        ends[1].add(ts=10_000 * S, finding_id="")  # a null id never reaches the join

    pairs = streams.stream_acceptance(p.unionByName(ends[0].stream), r.unionByName(ends[1].stream), "1300 seconds", "1300 seconds")
    tracked = streams.last_of_posted(streams.drain(pairs, "acceptance", close).where("finding_id is not null"))
    want = evaluate.last_resolutions(spark.createDataFrame(posts, p_schema), spark.createDataFrame(solved, r_schema))
    assert {tuple(x) for x in tracked.collect()} == {tuple(x) for x in want.collect()}
    assert any(x.resolved is None for x in want.collect()) and any(x.resolved for x in want.collect())


def test_usage_over_batches(spark, tmp_path):
    """Rows out of order across batches; a review that rests loses its totals."""
    rng = random.Random(7)
    schema = "review_id long, seq long, at long, kind string, tokens long"
    rows = [(rng.randrange(3), i, i * S + rng.randrange(20) * S, "start" if i % 17 == 0 else "usage", rng.randrange(9)) for i in range(150)]
    usage = in_files(spark, tmp_path / "usage", [rows[i::3] for i in range(3)], schema)
    end = streams.Closing(spark, usage, "closing")
    with streams.rocks_state(spark):
        ledger_rows = streams.stream_usage(usage.unionByName(end.stream), "200 seconds")
        got = streams.drain(ledger_rows, "usage", lambda: end.add(at=1_000 * S, seq=0, kind="start", tokens=0))
    got = got.where("review_id is not null").select("review_id", "seq", "epoch", "total_tokens", "api_calls", "cost_usd", "within_cap")
    want = ledger.usage_ledger(spark.createDataFrame(rows, schema)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    idle = [[(1, 1, 10 * S, "usage", 5)], [(2, 2, 500 * S, "usage", 1)], [(2, 3, 900 * S, "usage", 1)], [(1, 4, 1_000 * S, "usage", 7)]]
    stream = in_files(spark, tmp_path / "idle", idle, schema)
    end = streams.Closing(spark, stream, "closing")
    with streams.rocks_state(spark):
        rested = streams.stream_usage(stream.unionByName(end.stream), "10 seconds", idle_s=100)
        got = streams.drain(rested, "idle", lambda: end.add(at=9_000 * S, seq=0, kind="start", tokens=0))
    assert {r.seq: r.total_tokens for r in got.where(F.col("review_id") == 1).collect()} == {1: 5, 4: 7}

import json

import pytest
from pyspark.sql import functions as F

from hunkwise.operators import evaluate, findings
from hunkwise.plans.queries import diff_files
from hunkwise.plans.review import evaluate_rules, review_changes
from hunkwise.session import shared_dir
from hunkwise.sources import samples, tables
from hunkwise.streaming import streams

TINY = "/root/testdata/sf0.001"


def test_store_round_trip(spark):
    files, found = review_changes(samples.raw_diffs(spark, TINY))
    reviews = samples.reviews(spark, TINY)
    path = shared_dir(spark, "store")
    tables.write_reviews(reviews, found, files, path)
    back = tables.read_reviews(spark, path)
    assert back["reviews"].count() == reviews.count()
    assert back["findings"].drop("day").exceptAll(found.select(back["findings"].drop("day").columns)).count() == 0
    one = findings.review_detail(back["reviews"].drop("day"), findings.rank_findings(back["findings"].drop("day")), 1)
    assert one.count() > 0 and {r.review_id for r in one.select("review_id").collect()} == {1}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(review_id), EqualTo(review_id,1)]" in plan


def small_store(spark, ids, day="2024-05-01"):
    reviews = spark.createDataFrame([(i, day) for i in ids], "review_id long, day string").select(
        "review_id", F.to_timestamp("day").alias("created_at")
    )
    found = reviews.select("review_id", F.lit("bug").alias("category"))
    return reviews, found, reviews.select(F.col("review_id").alias("diff_id"), F.lit("a.py").alias("filename"))


def test_a_write_that_breaks_off_leaves_nothing_visible(spark, monkeypatch):
    path = shared_dir(spark, "store")
    with pytest.raises(FileNotFoundError):
        tables.read_reviews(spark, path)
    tables.write_reviews(*small_store(spark, [1, 2]), path)
    real = tables._commit
    monkeypatch.setattr(tables, "_commit", lambda *a: (_ for _ in ()).throw(OSError("broken")))
    with pytest.raises(OSError, match="broken"):
        tables.write_reviews(*small_store(spark, [2, 3]), path)
    reviews, found, _ = small_store(spark, [3])
    with pytest.raises(Exception, match="ABORTED|went wrong|USER_RAISED"):  # between the tables
        tables.write_reviews(reviews, found, reviews.select(F.raise_error(F.lit("went wrong")).cast("long").alias("diff_id")), path)
    assert {n: t.count() for n, t in tables.read_reviews(spark, path).items()} == {"reviews": 2, "findings": 2, "files": 2}
    monkeypatch.setattr(tables, "_commit", real)
    for _ in range(2):  # again, and again
        tables.write_reviews(*small_store(spark, [2, 3]), path)
    assert {n: t.count() for n, t in tables.read_reviews(spark, path).items()} == {"reviews": 3, "findings": 3, "files": 3}
    assert tables.read_reviews(spark, path, version=1)["findings"].count() == 2


def test_two_writers_do_not_overwrite_each_other(spark):
    path = shared_dir(spark, "store")
    tables.write_reviews(*small_store(spark, [1]), path)
    old = tables._manifest(spark, path)
    tables.write_reviews(*small_store(spark, [2]), path)
    with pytest.raises(RuntimeError, match="meanwhile"):
        tables._commit(spark, path, old)
    assert tables.read_reviews(spark, path)["reviews"].count() == 2


def test_ids_are_looked_up_in_the_days_written(spark, monkeypatch):
    path = shared_dir(spark, "store")
    for k, day in enumerate(("2024-05-01", "2024-05-02", "2024-06-01")):
        tables.write_reviews(*small_store(spark, [k], day), path)
    plans = []
    real = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    tables.write_reviews(*small_store(spark, [0, 9], "2024-05-01"), path)
    assert "day#" in plans[0].split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_reviews(spark, path)["reviews"].count() == 4


def test_pages_follow_each_other(spark):
    rows = [(i, f"2024-05-{1 + i % 9:02d}") for i in range(25)]
    reviews = spark.createDataFrame(rows, "review_id long, day string").select("review_id", F.to_timestamp("day").alias("created_at"), F.to_date("day").alias("day"))
    seen, after = [], None
    while page := tables.page_of_reviews(reviews, 10, after).collect():
        seen += [r.review_id for r in page]
        after = (page[-1].created_at, page[-1].review_id)
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (-int(r[1][-2:]), r[0]))]


def test_read_diffs_and_labels(spark, tmp_path):
    (tmp_path / "p.diff").write_text("diff --git a/a b/a\n@@ -1 +1 @@\n+x\n")
    (tmp_path / "m.expected.json").write_text(
        json.dumps([{"line": 4, "category": "bug", "severity": "low", "label": "l"}])
    )
    (tmp_path / "n.expected.json").write_text("[]")
    assert tables.read_diffs(spark, str(tmp_path / "*.diff")).first().raw.endswith("+x\n")
    labels = tables.read_labels(spark, str(tmp_path / "*.json"))
    assert tuple(labels.first()) == ("m.py", 0, 4, "bug", "low", "l") and labels.count() == 1


def test_scores_without_outcomes(spark):
    files = spark.createDataFrame([(1, 0, "a.py", "x = 1\n")], "diff_id long, file_no int, file string, source string")
    none = spark.createDataFrame([], "review_id long, file string, label_seq int, line long, category string")
    details = evaluate_rules(files, none)
    row = evaluate.eval_total(details).first()
    assert (row.precision, row.recall, row.f1, row.total_fixtures) == (1.0, 1.0, 1.0, 1)


def test_requests(spark):
    df = spark.createDataFrame([("o", "r", 1, "t"), ("", "r", 1, "t"), ("o", "r", 0, "t")], "owner string, repo string, pr_number int, github_token string")
    assert tables.valid_requests(df).columns == ["owner", "repo", "pr_number"] and tables.valid_requests(df).count() == 1


def test_streams_equal_batch(spark):
    batch = review_changes(samples.raw_diffs(spark, TINY))[1].count()
    stream = streams.drain(streams.stream_rules(samples.raw_diffs(spark, TINY, stream=True)), "test-rules")
    assert findings.dedupe_findings(stream).count() == batch


def test_parsing_does_not_shuffle(spark):
    raw = spark.createDataFrame([(1, "x")], "diff_id long, raw string")
    from hunkwise.operators import diff, scan

    plan = scan.run_rules(diff.hunks_of(diff.parse_files(raw)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_first_of_a_key_is_taken_before_the_shuffle(spark):
    _, found = review_changes(samples.raw_diffs(spark, TINY))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_badges_count_every_file(spark):
    files = diff_files(spark, TINY)
    none = review_changes(samples.raw_diffs(spark, TINY))[1].where(F.lit(False))
    assert findings.file_badges(files, none).where("findings = 0 and highest is null").count() == files.count()


def test_few_days_are_written_without_another_shuffle(spark, monkeypatch):
    hints, stores = [], []
    real = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda df, name, *a: hints.append(name) or real(df, name, *a))
    for most in (tables.FEW_FILES, 0):
        monkeypatch.setattr(tables, "FEW_FILES", most)
        path = shared_dir(spark, "store")
        files, found = review_changes(samples.raw_diffs(spark, TINY).where("diff_id < 40"))
        hints.clear()
        tables.write_reviews(samples.reviews(spark, TINY).where("review_id < 40"), found, files, path)
        assert hints.count("rebalance") == (0 if most else 3)
        stores.append({n: sorted(map(str, t.collect())) for n, t in tables.read_reviews(spark, path).items()})
    assert stores[0] == stores[1] and all(stores[0].values())


def test_a_listing_of_stored_diffs_reads_no_lines(spark):
    from hunkwise.plans import queries

    detail = queries.stored_detail(spark, TINY)
    assert "lines:array" not in detail._jdf.queryExecution().executedPlan().toString()
    assert detail.where("hunks > 1").count() > 0

"""Plans whose cost must keep in step with the input."""

import os

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hunkwise.functions import ordered
from hunkwise.llm import near_dedup
from hunkwise.operators import cases, diff, findings, scan, search
from hunkwise.plans import queries
from hunkwise.plans.review import review_changes
from hunkwise.sources import samples, tables
from hunkwise.streaming import streams

NOTE = "review_id long, file string, line_end long, finding_seq long, severity string, category string, explanation string"
HUNK = "diff_id long, file_no int, filename string, hunk_no int, old_start long, new_start long, lines array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_diffs(spark):
    raw = "diff --git a/a.py b/a.py\n@@ -1 +1,3 @@\n+try:\n+    pass\n+except:\n"
    return spark.createDataFrame([(1, "r", raw)], "diff_id long, repo string, raw string")


def test_orders_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(200).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(samples, "ROWS_OF_A_TASK", 2)
    dealt = samples.orders(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 100
    assert sorted(r.o_orderkey for r in dealt.collect()) == list(range(200))


def test_derived_tables_are_not_sent_through_the_driver(spark):
    files, found = review_changes(small_diffs(spark))
    context = files.select("diff_id", "file_no", F.col("filename").alias("context"))
    attached = findings.attach_findings(diff.hunks_of(files), found)
    for df in (findings.file_badges(files, found), cases.assemble_case(files, context, found), attached):
        assert "Broadcast" not in plan_of(df)
    assert [r.highest for r in findings.file_badges(files, found).collect()] == ["medium"]


def test_findings_meet_blocks_and_not_lines(spark):
    lines = ["-gone" if i % 9 == 4 else f"+line {i}" for i in range(900)]
    hunk = spark.createDataFrame([(1, 0, "a.py", 0, 1, 250, lines), (2, 0, "a.py", 0, 1, None, ["+x"])], HUNK)
    at = [249, 250, 255, 256, 511, 512, 513, 767, 768, 1_000, 5_000]
    notes = spark.createDataFrame([(1, "a.py", n, i, "low", "bug", "e") for i, n in enumerate([*at, 512, None])], NOTE)
    rows = findings.attach_findings(hunk, notes)
    assert "__first" in plan_of(rows)
    got = sorted((r.new_line, r.finding_seq) for r in rows.collect() if r.finding_seq is not None)
    last = 249 + sum(not x.startswith("-") for x in lines)
    assert got == sorted([(n, i) for i, n in enumerate(at) if 250 <= n <= last] + [(512, 11)])
    assert rows.count() == len(lines) + 1 + 1


def test_side_files_lie_in_folders_that_tasks_list(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i % 50}", i, f"text {i}") for i in range(200)], "name string, at int, text string")
    path = str(tmp_path / "side")
    tables.write_side_files(rows, "name", "text", path, ("at",), parts=8)
    assert all(d.startswith(("part=", "_", ".")) for d in os.listdir(path))
    back = {r.diff_id.split("/name=")[1].split("/")[0]: r.raw for r in tables.read_diffs(spark, path, deep=True).collect()}
    assert back == {f"n{k}": "".join(f"text {i}\n" for i in range(k, 200, 50)) for k in range(50)}


def test_few_stars_lose_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:-1], f"end{i}"]) for i in range(40)] + ["some other text of more than five words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for stars in (1, 4):
        rows = near_dedup.duplicate_groups(docs, near_dedup.Search(stars=stars)).collect()
        assert {r.doc_id: r.component_id for r in rows} == {**dict.fromkeys(range(40), 0), 40: 40}


def test_a_stream_of_two_loads_cuts_each_file_once(spark, tmp_path, monkeypatch):
    rows = spark.range(6).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate")
    )
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    seen = []
    monkeypatch.setattr(queries.streams, "drain_into", lambda stream, *_: seen.append(stream))
    monkeypatch.setattr(queries, "shared_dir", lambda *_: str(tmp_path / "orders.parquet"))
    try:
        queries.stream_upsert_chunks(spark, str(tmp_path))
    except AnalysisException:  # there is no table to read back
        pass
    assert seen[0]._jdf.queryExecution().analyzed().toString().count("StreamingRelation") == 1


def test_a_first_batch_is_written_without_being_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    merge = streams.stream_upsert(path, ("repo", "chunk_id"), buckets=3)
    kept = []
    whole = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: kept.append(1) or whole(df, *a))
    form = "repo string, chunk_id string, arrival long, batch_no int"
    merge(spark.createDataFrame([("r", f"c{i % 5}", i, 1) for i in range(20)] + [(None, "c1", 7, 1)], form), 0)
    assert kept == []
    merge(spark.createDataFrame([("r", "c2", 3, 2), ("s", "c2", 1, 2)], form), 1)
    got = sorted((r.repo or "", r.chunk_id, r.arrival, r.batch_no) for r in spark.read.parquet(path).collect())
    assert got == [("", "c1", 7, 1), ("r", "c0", 15, 1), ("r", "c1", 16, 1), ("r", "c2", 3, 2), ("r", "c3", 18, 1), ("r", "c4", 19, 1), ("s", "c2", 1, 2)]


def found_rows(spark):
    rows = [(k, i, s) for k, n in ((1, 9), (2, 2), (None, 4)) for i, s in zip(range(n), ["low", "critical", "high"] * 3)]
    return spark.createDataFrame(rows, "review_id long, finding_seq long, severity string").withColumn("source", F.lit("rule"))


def test_ordinary_reviews_are_ranked_in_one_shuffle(spark):
    plan = plan_of(findings.rank_findings(found_rows(spark)))
    assert "MapInArrow" not in plan and "rangepartitioning" not in plan and plan.count("Exchange") == 1


def test_large_reviews_are_ranked_in_parts(spark, monkeypatch):
    def ranked():
        return sorted(((r.review_id or 0, r.finding_seq, r.rank) for r in findings.rank_findings(found_rows(spark)).collect()))

    plain = ranked()
    monkeypatch.setattr(ordered, "LARGE", 3)
    monkeypatch.setattr(ordered, "ABOVE_MEAN", 1)
    assert "__s_rank" in plan_of(findings.rank_findings(found_rows(spark)))
    assert ranked() == plain
    assert [x[2] for x in plain if x[0] == 2] == [2, 1] and len(plain) == 15


def test_patterns_are_tried_once_for_a_line(spark):
    hunk = spark.createDataFrame([(1, 0, "a.py", 0, 0, 1, ["+try:", "+except:", '+q = "x"'])], HUNK)
    rows = scan.run_rules(hunk)
    assert plan_of(rows).count("AKIA[0-9A-Z]{16}") == 1
    assert [(r.line_start, r.category) for r in rows.collect()] == [(2, "bug")]


def test_side_files_are_written_and_read_by_tasks(spark, tmp_path):
    names = ["a/b", "c d", "x=1", None, "é"]
    rows = spark.createDataFrame([(n, i, None if i == 3 else f"{n} {i}") for i in range(4) for n in names], "name string, at int, text string")
    path = str(tmp_path / "side")
    tables.write_side_files(rows, "name", "text", f"file://{path}", ("at",), parts=3)
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)
    assert sorted(os.path.basename(f) for f in files) == sorted(
        ["name=a%2Fb", "name=c d", "name=x%3D1", "name=é", "name=__HIVE_DEFAULT_PARTITION__"]
    )
    for file in ("_SUCCESS", ".hidden"):
        (tmp_path / "side" / file).write_text("no")
    (tmp_path / "side" / "part=0" / "empty").write_text("")
    back = tables.read_diffs(spark, path, deep=True)
    assert "FileScan" not in plan_of(back)  # no list of files on the driver
    got = sorted(map(tuple, back.collect()))
    as_spark = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("_metadata.file_path", "value")
    assert got == sorted(map(tuple, as_spark.collect()))
    assert sorted(r[1] for r in got) == sorted(f"{n} 0\n{n} 1\n{n} 2\n\n" for n in names)


def test_contexts_are_found_in_one_shuffle(spark, monkeypatch):
    words = [f"w{i}" for i in range(30)]
    held = [(f"r{i % 3}", f"c{i:02d}", f"f{i}", " ".join(words[i % 7 : i % 7 + 1 + i % 5])) for i in range(40)]
    asks = [(f"q{i}", None if i == 9 else f"r{i % 4}", f"f{i}", " ".join(words[i % 5 : i % 5 + 3])) for i in range(12)]
    parts = search.vectorize_text(spark.createDataFrame(held, "repo string, chunk_id string, file string, content string"), "content")
    asked = search.vectorize_text(spark.createDataFrame(asks, "query_id string, repo string, file string, query string"), "query")
    idf = search.bucket_idf(parts, "vector")
    assert idf == search.bucket_idf(parts, "content")
    found = search.retrieve_context(asked, parts, by=["repo"], weights=idf)
    assert "Window" not in plan_of(found) and plan_of(found).count("Exchange ") == 1
    first = sorted(map(tuple, found.collect()))
    assert [r[0] for r in first] == sorted(f"q{i}" for i in range(12) if i % 4 != 3 and i != 9)
    sides = search.vectorize_text(asked, "query", idf), search.vectorize_text(parts, "content", idf)
    assert sorted(map(tuple, search.retrieve_context(*sides, by=["repo"]).collect())) == first
    twice = search.retrieve_context(asked.unionByName(asked.where("query_id = 'q1'")), parts, by=["repo"], weights=idf)
    assert "Window" in plan_of(twice) and twice.count() == len(first)
    for queries_of_tile, chunks_of_tile in ((2, 100), (2, 4)):
        monkeypatch.setattr(search, "QUERY_TILE", queries_of_tile)
        monkeypatch.setattr(search, "CHUNK_TILE", chunks_of_tile)
        tiled = search.retrieve_context(asked, parts, by=["repo"], weights=idf)
        assert ("Window" in plan_of(tiled)) == (chunks_of_tile < 13) and sorted(map(tuple, tiled.collect())) == first


def test_hunks_and_questions_are_made_once(spark):
    files = diff.parse_files(small_diffs(spark))
    assert "Filter (size(" not in plan_of(diff.hunks_of(files))
    assert plan_of(search.query_texts(files)).count("array_join(") == 1
    made = files.select("hunks").unionByName(files.select(F.slice("hunks", 1, 0).alias("hunks"))).unionByName(files.select(F.lit(None).cast(files.schema["hunks"].dataType).alias("hunks")))
    assert [r.hunk_no for r in diff.hunks_of(made).collect()] == [0]
    assert [r["query"] for r in search.query_texts(files).collect()] == ["try: pass except:"]

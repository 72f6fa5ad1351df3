"""Order-dependent operators against brute force, on groups where one key holds most rows."""

import random

from pyspark.sql import functions as F

from hunkwise.functions.ordered import islands, running_sums
from hunkwise.operators import evaluate, findings, ledger, search

S = 1_000_000


def skewed(n, seed, span):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(span) * S // 2, i) for i in range(n)]


def test_rate_limit(spark):
    rows = skewed(3000, 1, 2500) + [(None, 5, 9001), (None, 6, 9002)]
    want, live = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = [t for t in live.get(key, []) if t > at - 60 * S]
        want[i] = len(kept) < 10
        live[key] = kept + [at] * want[i]
    df = spark.createDataFrame([r for r in rows if r[0]], "key string, at long, id long")
    got = {r.id: r.allowed for r in ledger.rate_limit(df, "key", "at", "id").collect()}
    assert got == {i: w for i, w in want.items() if i < 9000}


def limited_by_hand(rows, n, window):
    want, live = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = [t for t in live.get(key, []) if t > at - window]
        want[i] = len(kept) < n
        live[key] = kept + [at] * want[i]
    return want


def test_a_key_that_never_rests_runs_in_blocks(spark):
    rng = random.Random(12)
    rows = [("hot", k * 7 * S + rng.randrange(3), 10 * k + j) for k in range(600) for j in range(rng.randrange(4))]
    # In step with the window, what a block began with is felt to the end: a round for every block.
    rows += [("beat", k * 20 * S, 100_000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, id long")
    got = {r.id: r.allowed for r in ledger.rate_limit(df, "key", "at", "id", 2, 60, block_windows=3).collect()}
    assert got == limited_by_hand(rows, 2, 60 * S)
    ticks = df.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("block", ledger.block_of("at", 180 * S))
    starts = ledger._block_starts(ticks, 2, 60 * S).where("key = 'hot'")
    assert starts.count() > 20 and starts.where(F.size("start") > 0).count() > 10


def test_quota(spark):
    df = spark.createDataFrame([("a", 100 * S, 1), ("a", 130 * S, 2), ("b", 100 * S, 3)], "key string, at long, id long")
    probes = spark.createDataFrame([("a", 160 * S), ("a", 159 * S), ("b", 90 * S), ("c", 1)], "key string, at long")
    got = {(r["key"], r["at"]): r.remaining for r in ledger.quota_remaining(df, probes, "key", "at").collect()}
    assert got == {("a", 160 * S): 9, ("a", 159 * S): 8, ("b", 90 * S): 10, ("c", 1): 10}


def test_running_sums(spark):
    rows = skewed(2000, 2, 5000)
    df = spark.createDataFrame(rows, "key string, at long, id long")
    out = running_sums(df, ["key"], ["at", "id"], {"total": F.col("id")}, inclusive=False)
    want, sums = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = sums.get(key, 0)
        sums[key] = want[i] + i
    assert {r.id: r.total for r in out.collect()} == want


def test_sums_that_start_again(spark):
    """A hot key over many partitions, with resets far apart and close together, null keys and doubles."""
    rng = random.Random(8)
    rows = [(None if i % 11 == 0 else k, at, i, rng.randrange(9), rng.random() < (0.002 if k == "hot" else 0.3)) for k, at, i in skewed(4000, 6, 3000)]
    df = spark.createDataFrame(rows, "key string, at long, id long, v long, again boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        out = running_sums(
            df, ["key"], ["at", "id"], {"whole": F.col("v"), "part": F.col("v"), "half": F.col("v") / 2}, reset=F.col("again"), since=("part",)
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, whole, part = {}, {}, {}
    for key, _, i, v, again in sorted(rows, key=lambda r: (r[1], r[2])):
        whole[key] = whole.get(key, 0) + v
        part[key] = (0 if again else part.get(key, 0)) + v
        want[i] = (whole[key], part[key], whole[key] / 2)
    assert {r.id: (r.whole, r.part, r.half) for r in out} == want


def test_inputs_are_evaluated_once(spark, tmp_path):
    """Every row of the input passes its source once, whatever is made of it."""
    seen = tmp_path / "seen"

    def tell(batches):
        import uuid

        for batch in batches:
            (seen / uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    def passed():
        n = sum(int(f.read_text()) for f in seen.iterdir())
        for f in seen.iterdir():
            f.write_text("0")
        return n

    seen.mkdir()
    df = spark.createDataFrame(skewed(500, 3, 400), "key string, at long, id long").mapInArrow(tell, "key string, at long, id long")
    running_sums(df, ["key"], ["at", "id"], {"total": F.col("id")}).collect()
    assert passed() == 500
    islands(df, ["key"], "at", 60 * S).collect()
    assert passed() == 500
    usage = df.select(
        F.col("key").alias("review_id"), F.col("id").alias("seq"), "at", F.when(F.col("id") % 50 == 0, "start").otherwise("use").alias("kind"), F.lit(3).alias("tokens")
    )
    ledger.usage_totals(ledger.usage_ledger(usage)).collect()
    assert passed() == 500
    found = df.select(
        F.col("key").alias("review_id"), F.lit("high").alias("severity"), F.lit("rule").alias("source"), F.col("id").alias("finding_seq"),
        F.lit("f").alias("file"), F.lit("bug").alias("category"), F.lit("x").alias("explanation"), F.lit("").alias("suggested_fix"),
        F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"),
    )
    findings.report_payload(findings.rank_findings(found)).collect()
    assert passed() == 500


def test_islands_also_below_zero(spark):
    df = spark.createDataFrame([("a", p) for p in (-9, -6, -1, 2, 5, 9, 20)], "key string, p long")
    got = {r.p: r.island for r in islands(df, ["key"], "p", 4).collect()}
    assert got == {-9: 1, -6: 1, -1: 2, 2: 2, 5: 2, 9: 3, 20: 4}


def test_match_labels(spark):
    rng = random.Random(3)
    found = [("f" if rng.random() < 0.7 else "g", rng.choice(["bug", "style"]), i, rng.randrange(150)) for i in range(120)]
    labels = [("f" if rng.random() < 0.7 else "g", rng.choice(["bug", "style"]), i, rng.randrange(150)) for i in range(90)]
    used, want = set(), []
    for file, cat, seq, line in found:
        fit = next((l for l in labels if l[2] not in used and l[:2] == (file, cat) and abs(l[3] - line) <= 3), None)
        if fit:
            used.add(fit[2])
        want.append((seq, fit[2] if fit else None))
    want += [(None, l[2]) for l in labels if l[2] not in used]
    pairs = evaluate.match_labels(
        spark.createDataFrame(found, "file string, category string, finding_seq long, line_start long"),
        spark.createDataFrame(labels, "file string, category string, label_seq int, line long"),
        ["file"],
    ).collect()
    assert sorted(map(repr, ((r.finding_seq, r.label_seq) for r in pairs))) == sorted(map(repr, want))
    by_outcome = {r.outcome for r in pairs if r.finding_seq is not None and r.label_seq is not None}
    assert by_outcome == {"tp"}


def test_rank_and_dedupe(spark):
    rng = random.Random(4)
    words = dict(severity=["critical", "high", "medium", "low"], source=["rule", "agent", "llm"])
    rows = [
        ("r", "f.py", rng.randrange(3), 0, rng.choice(words["severity"]), "bug", rng.choice(words["source"]), i << 22)
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "review_id string, file string, line_start int, line_end int, severity string, category string, source string, finding_seq long"
    )
    kept = sorted(findings.dedupe_findings(df).collect(), key=lambda r: r.line_start)
    for row in kept:
        best = min((r for r in rows if r[2] == row.line_start), key=lambda r: (words["source"].index(r[6]), r[7]))
        assert (row.source, row.finding_seq) == (best[6], best[7])
    order = sorted(rows, key=lambda r: (words["severity"].index(r[4]), words["source"].index(r[6]), r[7]))
    ranks = {r.finding_seq: r["rank"] for r in findings.rank_findings(df).collect()}
    assert ranks == {r[7]: i + 1 for i, r in enumerate(order)}


def test_acceptance(spark):
    posted = spark.createDataFrame([("a", 10), ("a", 50), ("b", 10), ("c", 10), ("d", 10)], "finding_id string, posted_at long")
    solved = spark.createDataFrame(
        [("a", 20, 1, True), ("b", 20, 2, True), ("b", 30, 3, False), ("c", 10, 4, True), ("x", 99, 5, True)],
        "finding_id string, ts long, seq long, resolved boolean",
    )
    row = evaluate.acceptance_rate(evaluate.last_resolutions(posted, solved)).first()
    assert tuple(row) == (4, 1, 1, 2, 0.25)


def test_tiles_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "QUERY_TILE", 7)
    monkeypatch.setattr(search, "CHUNK_TILE", 11)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6)).round(1)
    groups = ["hot" if i % 3 else f"g{i % 4}" for i in range(90)]
    rows = [(groups[i], i, v[i].tolist()) for i in range(90)]
    queries = spark.createDataFrame(rows[:40], "g string, query_id long, vector array<double>")
    chunks = spark.createDataFrame(rows, "g string, chunk_id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)

    def want(by):
        out = set()
        for q in range(40):
            near = sorted((-round(float(u[q] @ u[c]), 6), c) for c in range(90) if not by or groups[c] == groups[q])
            out |= {(q, i + 1, c) for i, (_, c) in enumerate(near[:3])}
        return out

    for by, sent in ((["g"], 0), (None, 0), (None, 1 << 20)):
        got = {(r.query_id, r["rank"], r.chunk_id) for r in search.top_k_similar(queries, chunks, 3, by, sent_bytes=sent).collect()}
        assert got == want(by)
    tied = chunks.withColumn("vector", F.array(F.lit(0.0), F.lit(1.0), *[F.lit(0.0)] * 4))
    for sent in (0, 1 << 20):
        got = {(r.query_id, r["rank"], r.chunk_id) for r in search.top_k_similar(queries, tied, 3, sent_bytes=sent).collect()}
        assert got == {(q, i + 1, i) for q in range(40) for i in range(3)}  # equal scores: the lowest ids
    assert search.top_k_similar(queries.limit(0), chunks).count() == 0


def recall(exact, found):
    want, got = ({(r.query_id, r.chunk_id) for r in df.collect()} for df in (exact, found))
    return len(want & got) / len(want)


def test_cells_find_nine_in_ten_of_all_rows(spark):
    """Ids divisible by 100 against every row of a whole table, and of clustered vectors with few probes."""
    from hunkwise.plans.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    exact, found = QUERIES["exact_neighbours"](spark, folder), QUERIES["approximate_neighbours"](spark, folder)
    assert recall(exact, found) >= 0.9
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    assert all(scores.get((r.query_id, r.chunk_id), r.score) == r.score for r in found.collect())

    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    v = middle[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    chunks = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "chunk_id long, vector array<double>")
    queries = chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    cells = search.fit_cells(chunks, sample=1000)
    assert cells.probes < len(cells.centres) / 3
    assert recall(search.top_k_similar(queries, chunks, 10), search.approximate_top_k(queries, chunks, cells, 10)) >= 0.9
    all_cells = search.Cells(cells.centres, len(cells.centres))
    assert recall(search.top_k_similar(queries, chunks, 10), search.approximate_top_k(queries, chunks, all_cells, 10)) == 1
    assert search._with_cells(chunks, cells, 1).count() == 3000
    assert search.fit_cells(chunks.limit(0)) == search.Cells([], 0)


def test_text_without_words(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id long, text string")
    idf = search.bucket_idf(texts, "text")
    lengths = {r.id: sum(x * x for x in r.vector) for r in search.vectorize_text(texts, "text", idf).collect()}
    assert lengths[1] == lengths[2] == 0 and abs(lengths[3] - 1) < 1e-9


def test_turn_budget(spark):
    calls = spark.createDataFrame(
        [(1, t, 10, t == 4, True) for t in range(7)]
        + [(2, t, 20_000, False, True) for t in range(4)]
        + [(3, 0, 1, False, False), (3, 1, 1, True, True)],
        "conv_id long, turn long, tokens long, is_submit boolean, uses_tools boolean",
    )
    kept = {(r.conv_id, r.turn) for r in ledger.turn_budget(calls).where("kept").collect()}
    assert kept == {(1, t) for t in range(5)} | {(2, 0), (2, 1)} | {(3, 0)}


def test_usage_ledger(spark):
    usage = spark.createDataFrame(
        [("r", 1, 0, "usage", 50_000), ("r", 2, S, "usage", 1), ("r", 3, 90 * S, "start", 0), ("r", 4, 100 * S, "usage", 7)],
        "review_id string, seq long, at long, kind string, tokens long",
    )
    rows = ledger.usage_ledger(usage).orderBy("seq").collect()
    assert [(r.total_tokens, r.within_cap) for r in rows] == [(50_000, True), (50_001, False), (0, True), (7, True)]
    total = ledger.usage_totals(ledger.usage_ledger(usage)).first()
    assert (total.total_tokens, total.api_calls, total.duration_us) == (7, 1, 10 * S)

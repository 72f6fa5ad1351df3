import collections
import itertools
import sys
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, documents, table  # noqa: E402

from checks.compare import TABLES, rows_of  # noqa: E402
from hunkwise.llm import line_dedup, near_dedup  # noqa: E402
from hunkwise.llm.queries import ORACLE, QUERIES  # noqa: E402


def same_as_sql(spark, name, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    res = con.execute(ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [c[0] for c in res.description], res.fetchall()
    )


def test_queries_are_their_sql(spark):
    for name in ("op2_minhash_near_dedup", "op6_line_dedup", "op8_chat_formatting"):
        same_as_sql(spark, name)


def groups_by_hand(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        if i is not None and w:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    low = {i: i for i, _ in rows if i is not None}
    linked = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


def test_groups_of_awkward_rows(spark):
    rows = near_dedup.duplicate_groups(documents(spark)).collect()
    assert len(rows) == len(AWKWARD)
    low = groups_by_hand(AWKWARD)
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else low[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert {r.n_shingles for r in rows if r.doc_id == 6} == {1}
    assert near_dedup.duplicate_groups(documents(spark).limit(0)).count() == 0


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    docs = documents(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 8, 10, 11, 12]
    assert kept.filter("doc_id is null").count() == 2


def test_texts_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{name}{k}" for k in range(60)) for name in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, ""), (9, a + " end"), (11, "so much text that nobody else has"), (11, None)]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.duplicate_groups(documents(spark, rows)).collect())
    assert got == {(3, 3, True): 1, (5, 3, False): 2, (7, 3, False): 1, (9, 3, False): 2, (11, 11, True): 2}
    # A second text without a near duplicate is not dropped.
    rows = [(3, a), (3, b), (4, a + " more")]
    assert {(r.doc_id, r.text) for r in near_dedup.keep_one(documents(spark, rows)).collect()} == {(3, a), (3, b)}


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"word{x}" for x in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"other{rng.integers(1e9)}"
        rows.append((i, " ".join(w)))
    search = near_dedup.Search(rounds=1, block=40, fan=30)
    got = near_dedup.duplicate_groups(documents(spark, rows), search).collect()
    low = groups_by_hand(rows)
    assert {r.doc_id: r.component_id for r in got} == low


def test_min_and_max_estimate_without_bias():
    a = np.arange(0, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.arange(180, 1080, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = near_dedup.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 720 / 1080) < 0.08
    keys = near_dedup.bands(sig)
    assert keys.shape == (2, near_dedup.BANDS) and len(set(keys[0])) == near_dedup.BANDS


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    roots = {}
    for r in near_dedup.components(edges).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, roots.values())) == [list(range(41)), [100, 101]]


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append((i is not None, i or 0))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [
            len(holders.get(key(x), [])) >= min_docs and max(holders[key(x)]) != (i is not None, i or 0) for x in lines
        ]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def test_lines_of_awkward_rows(spark):
    docs = documents(spark)
    for bits in (1 << 10, 1 << 12, 1 << 20):  # slices of a filter, and one that is sent, find the same
        got = line_dedup.drop_repeated_lines(docs, bits=bits)
        assert set(got.columns) == {*docs.columns, "n_dropped"}
        rows = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted(rows, key=order) == sorted(lines_by_hand(AWKWARD), key=order)
    assert line_dedup.drop_repeated_lines(docs.limit(0), bits=1 << 12).count() == 0
    assert got.filter("doc_id = 3").first().text is None


def test_line_edges(spark):
    short, long_ = "nineteen characters", "exactly twenty chars"
    rows = [(i, f"{long_}\n{short}\n{i}") for i in range(3)] + [(9, "ä" * 20), (10, "Ä" * 20), (11, "ä" * 20)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(documents(spark, rows), bits=1 << 12).collect()}
    assert got == {i: t for i, _, _, t in lines_by_hand(rows)}
    assert got[0] == f"{short}\n0" and got[2] == rows[2][1] and got[9] == "ä" * 20


def test_lines_of_hot_keys_and_of_rows_without_id(spark):
    """A line that all hold, ids that repeat or lack, rows that are equal: both ways are plain Python."""
    rows = [(None if i % 3 == 0 else i // 2, f"a line that every document holds\nown line number {i % 40} of some\n{i}") for i in range(300)]
    rows += rows[:50]
    want = sorted(map(repr, lines_by_hand(rows)))
    for bits in (1 << 11, 1 << 20):
        got = line_dedup.drop_repeated_lines(documents(spark, rows).repartition(7), bits=bits).collect()
        assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in got) == want


def test_filters_grow_with_the_lines(spark, monkeypatch):
    sent, sliced = [], []
    plain, dealt = line_dedup.twice_filter, line_dedup._sliced_suspects
    monkeypatch.setattr(line_dedup, "twice_filter", lambda d, t, bits, m: sent.append(bits) or plain(d, t, bits, m))
    monkeypatch.setattr(line_dedup, "_sliced_suspects", lambda r, n, *a: sliced.append(n) or dealt(r, n, *a))
    docs = documents(spark, [(i, "\n".join(f"a line of fair length {i} {k}" for k in range(100))) for i in range(100)])
    assert line_dedup.lines_to_drop(docs).count() == 0
    assert line_dedup.lines_to_drop(docs, bits=1 << 14).count() == 0
    assert sent == [1 << 17] and sliced == [8]


def test_classes_of_the_sample(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = QUERIES["op2_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.component_id for r in got} == groups_by_hand(docs)


def test_open_buckets_move_rows_in_proportion(spark):
    """Every pair of different components meets in one task, at about m + o * m / block rows."""
    search = near_dedup.Search(block=20)
    for outer, most in ((10, 400 + 10 * 20 + 10), (1, 400 + 20), (230, 400 + 170 * 12 + 230 * 12)):
        comp = {i: 0 if i < 400 - outer else i for i in range(400)}
        buckets = spark.createDataFrame([(5, i) for i in comp] + [(6, i) for i in range(30)], "key long, node long")
        comps = spark.createDataFrame(list(comp.items()), "node long, comp long")
        rows = near_dedup._block_rows(buckets, comps, search).collect()
        assert {r.key for r in rows} == {5} and len(rows) <= most
        tasks = collections.defaultdict(list)
        for r in rows:
            tasks[r.first, r.second].append(r)
        met = collections.Counter()
        for group in tasks.values():
            across = any(r.side for r in group)
            for x, y in itertools.combinations(group, 2):
                if x.comp != y.comp and (x.side != y.side or not across):
                    met[min(x.node, y.node), max(x.node, y.node)] += 1
        assert met == {(a, b): 1 for a, b in itertools.combinations(range(400), 2) if comp[a] != comp[b]}

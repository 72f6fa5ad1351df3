"""Which files a change reaches, and scores of all levels at once."""

import random

from pyspark.sql import functions as F

from hunkwise.operators import evaluate, imports

FILES = "repo string, file string, source string"


def links_of(spark, rows):
    files = spark.createDataFrame(rows, FILES)
    return imports.resolve_imports(imports.import_edges(files), files, "repo")


def test_modules_are_resolved_to_files(spark):
    rows = [
        ("r", "app/__init__.py", ""),
        ("r", "app/main.py", "from . import util, gone\nfrom .sub import deep as d\nfrom .. import top\nimport os, app.sub.leaf\n"),
        ("r", "app/util.py", "from app import main\n"),
        ("r", "app/sub/__init__.py", "from ..util import *\n"),
        ("r", "app/sub/deep.py", "from app.sub.leaf import thing\n"),
        ("r", "app/sub/leaf.py", "import top\n"),
        ("r", "top.py", ""),
        ("r", "app/util.js", ""),
        ("q", "main.py", "import top\nfrom app import util\n"),  # another repository has none of these
    ]
    got = {(r.file, r.target) for r in links_of(spark, rows).collect()}
    assert got == {
        ("app/main.py", "app/__init__.py"),
        ("app/main.py", "app/util.py"),
        ("app/main.py", "app/sub/__init__.py"),
        ("app/main.py", "app/sub/deep.py"),
        ("app/main.py", "app/sub/leaf.py"),
        ("app/main.py", "top.py"),
        ("app/util.py", "app/__init__.py"),
        ("app/util.py", "app/main.py"),
        ("app/sub/__init__.py", "app/util.py"),
        ("app/sub/deep.py", "app/sub/leaf.py"),
        ("app/sub/leaf.py", "top.py"),
    }


def reach(spark, edges, changed, depth=None):
    links = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, file string, target string")
    start = spark.createDataFrame([("r", c) for c in changed], "repo string, file string")
    return {r.file: r.distance for r in imports.change_reach(links, start, "repo", depth=depth).collect()}


def test_a_chain_of_fifty_and_a_cycle(spark):
    chain = [(f"f{i + 1}", f"f{i}") for i in range(50)]
    assert reach(spark, chain, ["f0"]) == {f"f{i}": i for i in range(51)}
    assert reach(spark, chain, ["f0"], depth=3) == {f"f{i}": i for i in range(4)}
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("d", "a")]
    assert reach(spark, cycle, ["a"]) == {"a": 0, "c": 1, "d": 1, "b": 2}
    assert reach(spark, cycle, ["gone"]) == {"gone": 0} and reach(spark, cycle, []) == {}


def test_a_graph_with_one_hot_module(spark):
    rng = random.Random(4)
    edges = [(f"m{rng.randrange(60)}", f"m{rng.randrange(60)}") for _ in range(90)] + [(f"m{i}", "hot") for i in range(0, 60, 2)]
    want, front, step = {"hot": 0, "m1": 0}, {"hot", "m1"}, 0
    while front:
        step += 1
        front = {a for a, b in edges if b in front} - set(want)
        want |= dict.fromkeys(front, step)
    assert reach(spark, edges, ["hot", "m1"]) == want


def test_levels_are_those_of_separate_sums(spark):
    rng = random.Random(2)
    files = [(f"r{i % 3}", f"f{i}") for i in range(20)]
    pairs = [(*rng.choice(files[:15]), rng.choice(["tp", "fp", "fn"])) for _ in range(200)]
    levels = evaluate.eval_levels(
        spark.createDataFrame(pairs, "repo string, file string, outcome string"), spark.createDataFrame(files, "repo string, file string")
    ).collect()
    assert sorted({r.level for r in levels}) == [0, 1, 2] and len(levels) == 20 + 3 + 1
    for r in levels:
        mine = [o for a, b, o in pairs if r.repo in (None, a) and r.file in (None, b)]
        assert (r.true_positives, r.false_positives, r.false_negatives) == tuple(mine.count(o) for o in ("tp", "fp", "fn"))
        assert r.files == sum(r.repo in (None, a) and r.file in (None, b) for a, b in files)
    total = next(r for r in levels if r.level == 2)
    details = spark.createDataFrame([r for r in levels if r.level == 0])
    assert abs(total.f1 - evaluate.eval_total(details.withColumn("n", F.lit(1))).first().f1) < 1e-9

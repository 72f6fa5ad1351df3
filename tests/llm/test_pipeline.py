import collections
import itertools
import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, documents, table, write  # noqa: E402

import corpus_pipeline  # noqa: E402
from hunkwise.llm import chat, decontaminate, packing  # noqa: E402
from hunkwise.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- decontamination ---


def tiles_by_hand(item, doc, width):
    """Greedy string tiling by trying everything."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (width - 1, 0, 0)
        for i, d in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if n > best[0]:
                best = (n, i, d)
        n, i, d = best
        if n < width:
            return sorted(out)
        for k in range(n):
            free_i[i + k] = free_d[d + k] = False
        out.append((d, i, n))


def test_tiles_are_those_of_the_plain_method():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item = rng.integers(0, 3, rng.integers(1, 14)).astype(np.uint64)
        doc = rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64)
        width = int(rng.integers(1, 4))
        assert decontaminate.tile(item, doc, width) == tiles_by_hand(item.tolist(), doc.tolist(), width)


def test_tiles_of_repeated_words():
    """Runs found at hits and everywhere agree, and a text of one word is tiled at once."""
    rng = np.random.default_rng(6)
    for _ in range(100):
        item, doc = (rng.integers(0, 2, rng.integers(1, n)).astype(np.uint64) for n in (16, 40))
        width = int(rng.integers(1, 4))
        known = decontaminate.running_hashes(item, width)
        window, order = decontaminate.running_hashes(doc, width), np.argsort(known, kind="stable")
        low = np.searchsorted(known[order], window, "left")
        count = np.searchsorted(known[order], window, "right") - low
        few = decontaminate._runs_at(item, doc, width, np.arange(len(window)), order, low, count)
        many = decontaminate._runs_everywhere(item, doc, width)
        assert sorted(zip(*few, strict=True)) == sorted(zip(*many, strict=True))
    start = time.time()
    assert decontaminate.tile(np.ones(100, np.uint64), np.ones(100_000, np.uint64), 5) == [(0, 0, 100)]
    assert time.time() - start < 5


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank, where nobody ever goes at night"),
    (2, "three little words"),
    (3, None),
    (4, "..."),
    (None, "an item without any number is found all the same, as it should be"),
]


def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")


def leaks():
    passage = ITEMS[0][1]
    words = passage.split()
    moved = " ".join(words[10:] + ["and", "then"] + words[:10])
    return [
        *AWKWARD,
        (50, f"before {passage} after"),
        (51, f"before {passage.upper()}!! after"),
        (52, f"filler {moved} filler"),
        (53, " ".join(words[:6]) + " and nothing else of it"),
        (54, "Three, little: WORDS"),
        (55, "three little other words"),
        (56, "xx " + ITEMS[4][1]),
    ]


@pytest.mark.parametrize("limit", [32_000_000, 0])
def test_leaks_are_found_both_ways(spark, limit):
    limits = decontaminate.Limits(max_broadcast_chars=limit)
    docs = documents(spark, leaks())
    found = decontaminate.find_contamination(docs, bench(spark), limits).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in found) == [(50, 1), (51, 1), (52, 1), (54, 2), (56, 0)]
    moved = next(r for r in found if r.doc_id == 52)
    assert moved.covered == moved.n_tokens and len(moved.tiles) == 2
    clean = decontaminate.remove_contaminated(docs, bench(spark), limits)
    assert clean.columns == docs.columns
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(
        [*(i for i, _ in AWKWARD), 53, 55]
    )
    assert decontaminate.find_contamination(docs.limit(0), bench(spark), limits).count() == 0
    assert decontaminate.find_contamination(docs, bench(spark).limit(0), limits).count() == 0
    assert decontaminate.remove_contaminated(docs, bench(spark).limit(0), limits).count() == len(leaks())


def test_decontamination_query(spark):
    tok = lambda t: decontaminate.tokens((t or "").encode()).tolist()
    items = {r.item_id: tok(r.text) for r in table(spark, "benchmark").collect()}
    want = set()
    for r in table(spark, "documents").collect():
        doc = tok(r.text)
        seeds = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for i, item in items.items():
            if any(tuple(item[k : k + 5]) in seeds for k in range(len(item) - 4)):
                covered = sum(x[2] for x in decontaminate.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 5))
                if covered >= 0.5 * len(item):
                    want.add((r.doc_id, i, covered))
    got = QUERIES["op3_benchmark_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in got} == want and want


# --- packing ---


def padding(counts, bounds):
    return sum(n * (next(b for b in bounds if b >= i) - i) for i, n in enumerate(counts) if n)


def test_bounds_are_the_best_of_all():
    rng = random.Random(4)
    for _ in range(60):
        counts = [0] + [rng.choice([0, 0, 1, 2, 9]) for _ in range(9)]
        lengths = [i for i, n in enumerate(counts) if n]
        k = rng.randint(1, 4)
        bounds = packing.best_bounds(np.array(counts), k)
        if not lengths:
            assert bounds == []
            continue
        every = [
            [*c, lengths[-1]] for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m)
        ]
        assert len(bounds) <= k
        assert padding(counts, bounds) == min(padding(counts, b) for b in every)


def checked_pack(rows, docs, max_tokens, budget):
    size = collections.Counter()
    for r in rows:
        assert r.n_tokens <= r.bound <= max_tokens and r.start == r.piece * max_tokens
        size[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for i, t in docs:
        want[i] += len((t or "").encode().split()) + 1
    assert size == want
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r)
    last = collections.defaultdict(int)
    for (bucket, batch), own in batches.items():
        last[bucket] = max(last[bucket], batch)
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bound <= budget
    for (bucket, batch), own in batches.items():
        assert batch == last[bucket] or len(own) == max(1, budget // own[0].bound)


def test_packs(spark):
    rows = packing.pack(documents(spark), max_tokens=64, buckets=3, budget=200, block_rows=100).collect()
    checked_pack(rows, AWKWARD, 64, 200)
    assert packing.pack(documents(spark).limit(0)).count() == 0
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    checked_pack(QUERIES["op7_packing"](spark, SF).collect(), docs, 2048, 32_768)


# --- chat ---


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_texts_come_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nx", "\\", "<\\|im_end|>", "a\\nb\n", "", None, "<|", "\\\\<|\\"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(nasty)]
    rows += [(None, None, None, "no id"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 5, "assistant", "x" * 3_000_000)]
    pieces = chat.format_conversations(turns(spark, rows))
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    from hashlib import sha256

    for conv in (1, 2, 3, None):
        own = sorted(
            ((t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: r[0]
        )
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns(spark, []))).count() == 0


def render(template, messages=()):
    return "".join(t for t, _ in chat.compile_template(template)(iter(messages)))


def test_template_language():
    assert render("{{ 'a' + 1 + none }}{{ 1 + 2 }}") == "a13"
    assert render("{% if 1 == 2 or not false %}y{% else %}n{% endif %}{% if 'a' != 'a' %}1{% elif true and 'x' %}2{% endif %}") == "y2"
    assert render("{{ ' x\\n' | trim | upper }}") == "X"
    people = [{"role": "a", "text": "1"}, {"role": "b", "text": "2"}]
    loop = "{% for m in messages %}{% if not loop.first %},{% endif %}{{ loop.index }}{{ m.role }}{{ m.none_such }}{% endfor %}"
    assert render(loop, people) == "1a,2b"
    inside = list(chat.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(iter(())))
    assert [x for x in inside if x[0]] == [("a", False), ("b", True), ("c", False)]


def test_constants_are_folded():
    assert chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}") == [("text", "abcd")]
    assert chat.parse("{{ x | upper }}")[0][0] == "out"


@pytest.mark.parametrize(
    "bad", ["{{ }}", "{{ a b }}", "{{ a.b() }}", "{{ a['b'] }}", "{{ a | none_such }}", "{% for x in y %}", "{% endif %}", "{% do x %}", "{{ (a }}", "{{ a.__class__.x }}"]
)
def test_bad_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


# --- pipeline ---


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(40))
    item = ITEMS[0][1]
    shared = "a passage of some length that stands in several documents"
    rows = [(i, f"{own(i)}\n{shared}") for i in range(4)]
    rows += [(10, own(10)), (11, own(10)), (12, own(10) + " more"), (13, f"{own(13)} {item}"), (14, "too short"), *AWKWARD]
    docs = documents(spark, rows)
    d = write(tmp_path, benchmark=bench(spark).select("item_id", "text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == documents(spark).columns, name
        docs.write.parquet(f"{tmp_path}/out-{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}.parquet")
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert set(left) == {0, 1, 2, 3, 8, 10}
    assert 11 not in left and 12 not in left and 13 not in left and 14 not in left and 4 not in left
    assert sum(shared in t for t in left.values()) == 1 and shared in left[3]
    assert all(r.n_chars == len(r.text) for r in docs.filter("text is not null").collect())


def test_stages_of_empty_tables(spark, tmp_path):
    d = write(tmp_path, benchmark=bench(spark).select("item_id", "text").limit(0), documents=documents(spark).limit(0))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_run_is_the_brute_force_result(spark):
    """Each stage is tested on its own against brute force; here its effect on the sample."""
    ids = {r.doc_id for r in table(spark, "documents").collect()}
    rules = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, SF).collect() if r.kept}
    leaked = {r.doc_id for r in QUERIES["op3_benchmark_decontamination"](spark, SF).collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert packed and packed <= rules <= ids
    assert not packed & leaked


def lines_by_rule(rows):
    """{id: text} of (id, host, text) after the quality rules, in plain Python."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    prints, holders = collections.defaultdict(set), collections.defaultdict(set)
    for _, host, text in rows:
        own = frozenset(key(x) for x in (text or "").split("\n") if key(x))
        prints[host].add(own)
        for k in own:
            holders[host, k].add(own)
    gone = {k for k, v in holders.items() if len(v) > max(20, 0.002 * len(prints[k[0]]))}

    def left(host, text, but=()):
        lines = text.split("\n")
        stay = [x for x in lines if (host, key(x)) not in gone or (host, key(x)) in but]
        return "\n".join(stay), sum(len(key(x)) for x in stay) >= 0.2 * sum(len(key(x)) for x in lines)

    first = {}
    for i, host, text in sorted(rows, key=lambda r: r[0]):
        if not left(host, text or "")[1]:
            for x in (text or "").split("\n"):
                first.setdefault((host, key(x)), i)
    out = {}
    for i, host, text in rows:
        mine = () if left(host, text or "")[1] else [k for k, keeper in first.items() if keeper == i]
        body, enough = left(host, text or "", mine)
        if len((text or "").split()) >= 10 and enough:
            out[i] = body
    return out


def pipeline_by_hand(rows, item):
    """The (id, piece, tokens) of the whole pipeline; ids differ and no text repeats its own words."""
    texts = lines_by_rule(rows)
    keys = {i: {k for x in t.split("\n") if len(k := x.strip().lower()) >= 20} for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, own in keys.items():
        for k in own:
            holders[k].append(i)
    lost = lambda i, k: len(holders[k]) >= 3 and max(holders[k]) != i
    texts = {i: "\n".join(x for x in t.split("\n") if not lost(i, x.strip().lower())) for i, t in texts.items()}
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    tok = lambda t: decontaminate.tokens(t.encode())
    out = set()
    for i in (i for i in texts if group[i] == i):
        covered = sum(n for _, _, n in tiles_by_hand(tok(item).tolist(), tok(texts[i]).tolist(), 5))
        if 2 * covered < len(tok(item)):
            n = len(words[i]) + 1
            out |= {(i, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))}
    return out


def test_pipeline_on_hot_hosts_and_copies_is_plain_python(spark, tmp_path):
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    menu, foot, item = [words(f"menu{m}", 60) for m in range(3)], words("foot", 12), ITEMS[0][1]
    page = "\n".join([words("page", 30), words("more", 30), foot])
    rows = [(i, "\n".join([*menu, words(f"own{i}", 20)])) for i in range(100, 125)]
    rows += [(i, f"{words(f'own{i}', 40)}\n{foot}") for i in range(200, 222)] + [(i, page) for i in range(300, 370)]
    rows += [(400, words("near", 60)), (401, words("near", 60) + " end"), (402, f"{words('leak', 20)} {item}"), (403, "short"), (404, None)]
    rows += [(405, words("long", 2500))] + [(i, f"{words(f'own{i}', 30)}\n{foot}") for i in range(500, 515)]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") >= 500, "cold").otherwise("hot"))
    d = write(tmp_path, documents=docs, benchmark=bench(spark).select("item_id", "text").filter("item_id = 1"))
    want = pipeline_by_hand([(i, "cold" if i >= 500 else "hot", t) for i, t in rows], item)
    ids = {i for i, _, _ in want}
    assert ids >= {100, *range(200, 222), 369, 400, 405, *range(500, 515)} and not ids & {*range(101, 125), 401, 402, 403, 404}
    got = [(r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want

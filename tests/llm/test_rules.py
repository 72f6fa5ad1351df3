import collections
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, documents, table  # noqa: E402

from hunkwise.llm import pii, quality_rules, sharding  # noqa: E402
from hunkwise.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def base_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall("[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(again),
        len(w) < 10 or 100 * len(again) > 20 * len(w),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    rows = QUERIES["op9_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base_by_hand(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rules_on_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (20, "a b c d e " * 3), (21, "x y z v w " * 400), (22, "\v | \v x\r\nx\r\n")])
    rows = quality_rules.apply_rules(docs).collect()
    got = collections.Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in rows)
    want = collections.Counter(
        (i, *base_by_hand(t)) for i, t in [(r.doc_id, r.text) for r in docs.collect()]
    )
    assert got == want
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 8, 9]


def frequent_rows():
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(15))
    menu = "home | about | contact | privacy | imprint | terms | cookies and much more of a menu"
    rows = [(i, f"{own(i)}\n{menu}") for i in range(40, 48)]
    rows += [(i, f"{menu}\nx{i}") for i in range(48, 52)]  # little is left
    rows += [(i, own(99) + "\n" + own(98)) for i in range(60, 72)]  # copies share lines, but are no boilerplate
    return rows, menu


def test_line_frequency(spark):
    rows, menu = frequent_rows()
    docs = documents(spark, rows)
    limits = quality_rules.LineLimits(least=5)
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, limits).collect()}
    assert all(len(got[i].removed) == 1 and got[i].kept for i in range(40, 48))
    assert all(got[i].depleted and not got[i].kept for i in range(49, 52))
    assert got[48].kept and not got[48].removed  # the first of the depleted holders keeps the line
    assert all(got[i].kept and not got[i].removed for i in range(60, 72))
    kept = {r.doc_id: r.text for r in quality_rules.filter_documents(docs, limits).collect()}
    assert sorted(kept) == [*range(40, 49), *range(60, 72)]
    assert all((menu in t) == (i == 48) for i, t in kept.items()) and kept[60] == rows[-1][1]
    # At its limit a line stays.
    at = {r.doc_id: r for r in quality_rules.apply_rules(docs, quality_rules.LineLimits(least=12)).collect()}
    assert not any(at[i].removed for i in range(40, 52))


def words(name, n):
    return " ".join(f"{name}x{k}" for k in range(n))


def test_long_shared_lines_do_not_shield_each_other(spark):
    shared = [words(f"menu{m}", 60) for m in range(3)]
    rows = [(i, "\n".join([*shared, words(f"own{i}", 20)])) for i in range(20, 80)]
    rows += [(i, "\n".join(shared[: i % 3 + 1]) + "\n" + words(f"own{i}", 400)) for i in range(100, 130)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    assert all(len(got[i].removed) == 3 and got[i].depleted and not got[i].kept for i in range(21, 80))
    assert got[20].kept and not got[20].removed
    assert all(len(got[i].removed) == i % 3 + 1 and got[i].kept for i in range(100, 130))


def test_copies_do_not_shield_the_other_holders(spark):
    footer = words("foot", 12)
    page = "\n".join([words("page", 30), words("more", 30), footer])
    rows = [(i, page) for i in range(100, 300)] + [(i, f"{words(f'own{i}', 40)}\n{footer}") for i in range(300, 340)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    assert all(len(got[i].removed) == 1 and got[i].kept for i in range(100, 340))
    # The copies are one document more: 21 are above the limit, 20 are at it.
    for others, gone in ((20, 1), (19, 0)):
        part = documents(spark, rows[: 200 + others])
        assert {len(r.removed) for r in quality_rules.apply_rules(part).collect()} == {gone}


def test_copies_do_not_raise_the_limit(spark):
    """Many copies of one page, a footer on all: the share is one of different documents."""
    foot = words("foot", 12)
    page = f"{words('page', 30)}\n{foot}"
    rows = [(i, page) for i in range(1000, 4000)] + [(i, f"{words(f'own{i}', 40)}\n{foot}") for i in range(7, 47)]
    limits = quality_rules.LineLimits(least=2, share=0.5)  # 41 different documents: 20.5 may hold a line
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows), limits).collect()}
    assert all(len(r.removed) == 1 and r.kept for r in got.values())


def test_one_of_many_near_copies_remains(spark):
    body = "\n".join(words(f"part{k}", 30) for k in range(8))
    rows = [(i, f"{body}\n{words(f'end{i}', 6)}") for i in range(10, 60)] + [(10, f"{body}\n{words('end10', 6)}")]
    rows += [(i, words(f"own{i}", 40)) for i in range(60, 70)]
    kept = quality_rules.filter_documents(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [10, 10, *range(60, 70)] and {r.text for r in kept if r.doc_id == 10} == {rows[0][1]}


def checked_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, f"text {i // 3}") for i in range(300)] + [(i, "hot") for i in range(300, 420)]
    placed = sharding.shard_documents(documents(spark, rows), 6, block_rows=20).collect()
    checked_shards(placed, 6)
    texts = dict(rows)
    spread = collections.defaultdict(set)
    for r in placed:
        assert r.size == len(texts[r.doc_id]) + 8
        spread[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for t, v in spread.items() if t != "hot") <= 20  # of 100
    hot = collections.Counter(r.shard for r in placed if texts[r.doc_id] == "hot")
    assert hot.most_common(1)[0][1] >= 40  # 20 at first


def test_shards_of_awkward_rows(spark):
    placed = sharding.shard_documents(documents(spark), 4).collect()
    checked_shards(placed, 4)
    assert collections.Counter(r.doc_id for r in placed) == collections.Counter(i for i, _ in AWKWARD)
    assert {(r.size, r.text_crc32) for r in placed if r.doc_id in (3, 4)} == {(8, 0)}
    assert sharding.shard_documents(documents(spark).limit(0), 4).count() == 0
    checked_shards(QUERIES["op10_sharding"](spark, SF).collect(), 24)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, body):
    digits = re.sub("[^0-9]", "", body)
    if kind == "ip":
        return all(int(x) <= 255 for x in body.split("."))
    if kind == "card":
        figures = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(figures) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans_by_hand(text):
    kinds = list(PLAIN)
    found = [
        (m.start(), kinds.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())
    ]
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]


ODD_TEXTS = [
    "a@b.c_d@e.f a@b..c @x.y a@b %+@q.r-s.t",
    "\U0001f600\U0001f600 é x.y@z.example.com,ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111112 0000000000000000",
    "call +1 (555) 010-9999. or +1-2 or ++49 30 1234567) +123456789012345678",
    "1" * 3000 + " " + "a" * 3000 + "@" + "b." * 300 + "c",
    "4111 1111 1111 1111" * 300,
    "me [at] site [dot] org or (555) 123-4567 token = sk-abcdefghij0123456789abcdef",
]


def test_base_spans(spark):
    docs = documents(spark, [*AWKWARD, *enumerate(ODD_TEXTS, 100)])
    found = pii.find_personal_data(docs).select("doc_id", F.filter("spans", lambda s: s["base"]).alias("b"), "spans").collect()
    got = collections.Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.b)) for r in found)
    assert got == collections.Counter((r.doc_id, ",".join(spans_by_hand(r.text))) for r in docs.collect())
    last = next(r for r in found if r.doc_id == 106)
    assert {"email", "phone", "secret"} <= {s.kind for s in last.spans}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_added_spans_leave_base_spans_alone(spark):
    for r in pii.find_personal_data(table(spark, "documents")).collect():
        base = [(s.start, s.end) for s in r.spans if s.base]
        for s in r.spans:
            assert s.base or all(s.end <= a or s.start >= b for a, b in base)


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op4_pii"](spark, SF).collect():
        want = spans_by_hand(texts[r.doc_id])
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(x.startswith("email") for x in want)
        assert r.base_sha256 == __import__("hashlib").sha256(",".join(want).encode()).hexdigest()


def test_reliabilities_are_found():
    # Four labelers that agree, one that contradicts them at random: it is not believed.
    counts = [("card", (1, 1, 1, 1, 1), 50), ("card", (1, 1, 1, 1, -1), 50)]
    counts += [("card", (-1, -1, -1, -1, 1), 50), ("card", (-1, -1, -1, -1, -1), 50)]
    post = pii.estimate(counts)
    assert min(post[:2]) > 0.95 and max(post[2:]) < 0.05
    weights = pii.train(counts)
    assert weights[len(pii.KINDS) + 1] > 0.5 > abs(weights[-1])
    assert pii.train([]) == [0.0] * len(weights)


def test_redaction(spark):
    docs = documents(spark, [(1, "x a@b.de y \U0001f600 1.2.3.4"), (2, None)])
    found = pii.find_personal_data(docs).withColumnRenamed("doc_id", "i")
    rows = docs.join(found, F.col("doc_id") == F.col("i")).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in rows.collect()} == {1: "x [email] y \U0001f600 [ip]", 2: None}

import collections
import math
import sys
from binascii import crc32
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, documents, table  # noqa: E402

from hunkwise.llm import lm_scoring, quality_classifier  # noqa: E402
from hunkwise.llm.queries import QUERIES  # noqa: E402


def words(text):
    return (text or "").encode().lower().split() + [b" end"]


def by_hand(rows, learned, order, mu, discount):
    """Score every text with counts in dictionaries."""
    counts = collections.Counter()
    for (_, text), ok in zip(rows, learned, strict=True):
        seq = [b" start", *words(text)]
        if ok:
            for n in range(1, order + 1):
                for i in range(len(seq) - n + 1):
                    counts[tuple(seq[i : i + n])] += 1
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != b" start"}
    total, known = sum(uni.values()), len(uni)

    def p(w, h):
        if not h:
            if not known:
                return 1.0
            return (uni[w] - discount) / total if w in uni else discount * known / total
        below = p(w, h[1:])
        n = counts[h]
        return (counts[(*h, w)] + mu * below) / (n + mu) if n else below

    out = []
    for _, text in rows:
        seq = [b" start", *words(text)]
        score = sum(math.log10(p(seq[i], tuple(seq[max(0, i - order + 1) : i]))) for i in range(1, len(seq)))
        base = sum(math.log10((uni.get(w, 0) + 1) / (total + known + 1)) for w in seq[1:])
        out.append((len(seq) - 1, sum(w in uni for w in seq[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_plain_counts(spark, order):
    docs = documents(spark)
    model = lm_scoring.Model(order=order, mu=3.0, block_bytes=50_000, bucket_bytes=20_000)
    learn = F.coalesce(F.col("doc_id") != 9, F.lit(False))
    got = sorted(
        lm_scoring.score_documents(docs, learn, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    )
    rows = sorted(AWKWARD, key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1]))))
    want = by_hand(rows, [i is not None and i != 9 for i, _ in rows], order, 3.0, 0.5)
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_lm_without_rows_or_lessons(spark):
    docs = documents(spark)
    assert lm_scoring.score_documents(docs.limit(0), F.lit(True)).count() == 0
    rows = lm_scoring.score_documents(docs, F.lit(False)).collect()
    assert {(r.score, r.base_score, r.n_known) for r in rows} == {(0.0, 0.0, 0)}


def test_a_state_sums_to_one():
    body = [b"a b a b c", b"a a b", b"z"]
    import numpy as np

    learned = np.array([True, True, False])
    levels, _, _ = lm_scoring.block_levels(body, learned, 2)
    model = lm_scoring.Model(mu=2.0)
    totals = [x.counts for x in levels]
    n = int(totals[0][1:].sum())
    known = int((totals[0][1:] > 0).sum())
    automaton = lm_scoring.Automaton(levels, totals, n, model)
    for history in ([], [2], [3], [4]):
        before, _ = automaton.walk(history)
        mass = 0.0
        for w in range(1, automaton.width):
            weight, unknown = automaton.walk([*history, w])
            assert unknown == (not automaton.seen[w])
            unk = math.log10(model.discount * known / n) if unknown else 0.0
            mass += 10 ** (weight - before + unk)
        assert math.isclose(mass, 1.0, rel_tol=1e-9)  # one unknown word stands for all


def test_lm_query_beats_its_base_on_held_out_texts(spark):
    rows = QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, "labels", d).collect()}
    rows = QUERIES["op5_quality_classifier"](spark, d).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == 1000 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_of_awkward_rows(spark):
    docs, labels = documents(spark), table(spark, "labels").select("doc_id", "quality")
    small = quality_classifier.Network(per_label=20, epochs=2)
    rows = quality_classifier.score_quality(docs, labels, F.lit(True), small).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(empty) == 1
    none = quality_classifier.score_quality(docs, labels.limit(0), F.lit(True), small).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), labels, F.lit(True), small).count() == 0


def test_gradient_is_that_of_the_loss():
    import numpy as np

    net = quality_classifier.Network(filters=3, embedding=2, chunk=6, overlap=2)
    w = quality_classifier.Weights(net)
    texts = [b"some words here and there, to be sure of several chunks" * 4, b"!! ** !!"]
    coded, y = [quality_classifier.symbols(t, net.width) for t in texts], np.array([1.0, 0.0])

    def loss():
        z = [w.logit(w.pooled(s, w.tables())) for s in coded]
        return float(np.mean([np.log1p(np.exp(-a)) if b else np.log1p(np.exp(a)) for a, b in zip(z, y, strict=True)]))

    grads = quality_classifier._gradient(w, coded, y)
    for name, at in (("out", (1,)), ("bias", (0,)), ("shift", (0,)), ("conv", (3, 1, 2)), ("embed", (ord("e"), 0))):
        old = w.p[name][at]
        w.p[name][at] = old + 1e-3
        up = loss()
        w.p[name][at] = old - 1e-3
        down = loss()
        w.p[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name


def test_whole_text_counts():
    net = quality_classifier.Network()
    w = quality_classifier.Weights(net)
    w.p["out"][net.filters :] = 1.0
    tables = w.tables()
    text = b"plain words " * 400_000
    assert w.score(text, tables) != w.score(text + b"###%%%&&&", tables) or w.p["out"][0] == 0

"""Phrase mining, resampling and token counts against plain Python and the library."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, documents, table, write  # noqa: E402

from hunkwise.llm import phrases, target_resampling, token_counts  # noqa: E402
from hunkwise.llm.queries import QUERIES  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- phrases ---


def mined_by_hand(rows, setup):
    """rows: (lang, text)."""
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, setup.longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= setup.least}
    longest: dict = {}
    for (lang, q), b in found.items():
        for size in range(2, len(q)):
            for i in range(len(q) - size + 1):
                longest[lang, q[i : i + size]] = max(b, longest.get((lang, q[i : i + size]), 0))
    kept = collections.defaultdict(list)
    for (lang, p), a in found.items():
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if not 100 * longest.get((lang, p), -1) >= setup.inside * a:
            kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, items in kept.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(items)[: setup.top], 1)
    )


def mined(df, setup):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, setup).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def mixed_rows(seed=5):
    """A common pair, a common word, rare words, ends of pieces and several languages."""
    rng = random.Random(seed)
    words = ["of", "the", "Of", "naïve", "x", "y", "z", "word\x0bend", "w\tv", "9", "😀"]
    rows = []
    for _ in range(300):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice(["of the", *words, f"r{rng.randint(0, 500)}"]) + rng.choice([" ", " ", " ", ", ", ".\n", "  "])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), (None, ""), ("fr", "? . !")]


@pytest.mark.parametrize("longest", [2, 3, 4])
@pytest.mark.parametrize("batch", [60, 10_000])
def test_phrases_are_those_of_plain_counts(spark, longest, batch):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    setup = phrases.Mining(longest=longest, least=4, top=25, batch=batch, route=500, common=40)
    want = mined_by_hand(rows, setup)
    assert mined(df, setup) == want and len(want) > 20


def test_common_words_and_pairs_are_split(spark):
    rows = [("en", f"of the w{i % 90} of the. v{i % 7} of u{i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "lang string, text string")
    setup = phrases.Mining(least=3, route=300, common=100)
    counted = df.mapInArrow(phrases._counting(setup.batch), phrases.COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    routes = phrases._routes(counted, setup)
    assert len(routes.words) and len(routes.pairs) and routes.number > 10
    assert mined(df, setup) == mined_by_hand(rows, setup)


@pytest.mark.parametrize("depths", [2, 3])
def test_quicksort_counts_prefixes(depths):
    rng = np.random.default_rng(3)
    rows = rng.zipf(1.4, (4000, depths)).clip(max=60) - 1
    for k in range(1, depths):
        rows[rows[:, k - 1] == 0, k] = 0
    rows = rows[rows[:, 0] > 0]
    weight = rng.integers(1, 4, len(rows))
    got = {}
    for depth, pointer, mass in phrases.frequent(rows.T, weight, 12):
        got |= {tuple(rows[p, :depth].tolist()): m for p, m in zip(pointer.tolist(), mass.tolist(), strict=True)}
    want = collections.Counter()
    for row, w in zip(rows.tolist(), weight.tolist(), strict=True):
        for depth in range(1, depths + 1):
            if row[depth - 1]:
                want[tuple(row[:depth])] += w
    assert got == {k: w for k, w in want.items() if w >= 12}
    assert phrases.frequent(np.zeros((3, 0), int), np.zeros(0, int), 1) == []


def test_counts_beyond_64_bits_are_exact(spark):
    big = 1_500_000_000
    counts = spark.createDataFrame(
        [("en", 0, "", 4 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], phrases.COUNTS
    )
    original, phrases.phrase_counts = phrases.phrase_counts, lambda docs, setup: counts
    try:
        row = phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).first()
    finally:
        phrases.phrase_counts = original
    assert (row.score, row.l, row.r) == (1000000 * big * big // ((big + 7) * (big + 1)), big + 7, big + 1)


def test_phrases_of_awkward_rows(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") > 7, "en"))
    setup = phrases.Mining(least=2)
    rows = [("en" if i is not None and i > 7 else None, t) for i, t in AWKWARD]
    assert mined(docs, setup) == mined_by_hand(rows, setup)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


# --- resampling ---


def resampled_by_hand(rows, target, setup=target_resampling.Resampling()):
    def words(text):
        return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]

    def features(text):
        w = words(text)
        return [zlib.crc32(f) % setup.buckets for f in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]  # noqa: B905

    s, t = (collections.Counter(b for x in texts for b in features(x)) for texts in ([r[1] for r in rows], target))
    big_s, big_t, n = sum(s.values()), sum(t.values()), setup.buckets
    out = []
    for doc, text in rows:
        f = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"{setup.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, len(words(text)) >= setup.least_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: setup.percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("at_once", [7, 400_000])
def test_resampling_is_that_of_plain_python(spark, at_once):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "Cd9", "éé", "x-y", "zz", f"q{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    target = ["ab cd9 ab", "zz zz q1 q2", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_resampling.resample(docs, goal, target_resampling.Resampling(features=at_once))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == resampled_by_hand(
        rows, target
    )


def test_resampling_of_awkward_rows(spark):
    goal = spark.createDataFrame([("alpha beta w1x1",)], "text string")
    setup = target_resampling.Resampling(least_words=5, percent=60)
    got = target_resampling.resample(documents(spark), goal, setup).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled_by_hand(AWKWARD, ["alpha beta w1x1"], setup)
    assert target_resampling.resample(documents(spark).limit(0), goal.limit(0)).count() == 0


def test_equal_keys_are_verified(monkeypatch):
    """With one key for all, bytes alone tell n-grams apart."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: 5)
    grams = [b"a", b"b", b"a", b"c", b"b", b"a"]
    held = target_resampling.Table(grams, 97)
    assert [held.count[i] for i in held.ids] == [3, 2, 3, 1, 2, 3] and len(held.slots) == 3
    assert [held.bucket[i] for i in held.ids] == [zlib.crc32(g) % 97 for g in grams]


def test_ranks_hold_over_many_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("score"), F.xxhash64("id").alias("tie"))
    got = [r.doc_id for r in target_resampling._ranked(rows).orderBy("rank").collect()]
    assert got == sorted(range(3000), key=lambda i: (-(i % 5), i))


# --- tokens ---


def by_library(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in rows]


def odd_texts():
    rng = random.Random(11)
    kinds = ["ab", "aaab ", "the in er on ", " \n\t  x'sdll've1", "éèß日本語한글😀՘\U00010940 12", "<|endoftext|> a", "\x00\x1c\x85  "]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(800)]
    plain = ["", "a" * 9000, "ab" * 5000, "=" * 7000, " " * 6000, "".join(rng.choice("etaoinshrdlu") for _ in range(12_000))]
    special = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>"]
    return texts + plain + special


@pytest.mark.parametrize("long", [3, 4096])
def test_tokens_are_those_of_the_library(long):
    counter = token_counts.Counter(token_counts.read_merges(PATH), token_counts.Limits(long=long))
    texts = odd_texts()
    assert counter.counts(texts) == by_library(texts)


def test_settled_code_points_are_cut_alike():
    counter = token_counts.Counter(token_counts.read_merges(PATH), token_counts.Limits())
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}  b" for c in range(token_counts.SETTLED)]
    assert not any(counter.other.search(t) for t in texts) and counter.counts(texts) == by_library(texts)
    assert counter.other.search(chr(token_counts.SETTLED))


def test_token_counts_of_awkward_rows(spark):
    got = token_counts.count_tokens(documents(spark), PATH, 20).collect()
    want = by_library([t for _, t in AWKWARD])
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [
        (i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(AWKWARD, want, strict=True)
    ]
    assert token_counts.count_tokens(documents(spark).limit(0), PATH).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert token_counts.count_tokens(documents(spark).limit(0), PATH).count() == 0
    small = token_counts.count_tokens(documents(spark), PATH, limits=token_counts.Limits(chars=50, known=10)).collect()
    assert [r.n_tokens for r in small] == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.read_merges(public_tokenizers.path("word_bpe_49k.json"))


def test_token_query_is_whole(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in QUERIES["op13_token_counts"](spark, folder).collect()}
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert got == dict(zip([i for i, _ in rows], by_library([t for _, t in rows]), strict=True))


def test_queries_are_those_of_plain_python(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").limit(60).collect()]
    docs = table(spark, "documents").filter(F.col("doc_id").isin([i for i, _ in rows]))
    goal = table(spark, "benchmark")
    folder = write(tmp_path, documents=docs, benchmark=goal)
    got = QUERIES["op12_target_resampling"](spark, folder).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == resampled_by_hand(rows, [r.text for r in goal.collect()])
    langs = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = QUERIES["op11_phrase_mining"](spark, folder).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == mined_by_hand(langs, phrases.Mining())

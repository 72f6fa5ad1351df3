"""Phrases that occur more often than their parts explain, mined from suffix pointers.

One pass counts words. A second pass deals every window of words, by a hash of its leading word,
to a route; windows whose leading word is common go by two words, those of a common
pair by three, so that no route holds more than a small part of a frequent word. Windows
are counted within a batch first, and travel as arrays of ids beside the words they use.

A route sorts its suffix pointers by multikey three-way quicksort: every open partition
takes a pivot at its depth and splits into smaller, equal and greater pointers, all
partitions in the same pass. The weight of an equal partition is the count of its phrase and
goes on to the next word, down to the greatest depth; partitions below the least count are
abandoned at once. Scores and containment are joins between the frequent phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import written

# Blanks, ends of pieces, and the mark that stands for such an end (never part of a word).
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b","
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + MARK * len(ENDS))
NO_LANG = "und"


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words found ``least`` times or more; ``inside``: percent of a phrase that a
    longer one must cover to replace it. ``batch`` words are counted at a time, ``route`` windows
    meet in a task; leading words above ``common`` windows, or 1 in 1,024 when that is less, are split."""

    longest: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000
    batch: int = 1_000_000
    route: int = 1_000_000
    common: int = 500_000


@dataclass(frozen=True)
class Routes:
    """How windows are dealt: hashes of common words and pairs, sorted, at most 2^20 of each."""

    number: int
    words: np.ndarray
    pairs: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b" "
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def pieces(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and a mark after every piece."""
    return text.translate(FOLD).replace(MARK, b" , ").split() + [MARK]


class Held:
    """Words of one language that wait to be counted: ids in order, 0 for the end of a piece."""

    def __init__(self) -> None:
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[MARK]  # noqa: B018
        self.ids: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        tokens = pieces(text)
        self.ids.append(np.fromiter(map(self.vocab.__getitem__, tokens), np.int64, len(tokens)))
        return len(tokens)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, vocabulary, ids) of about ``size`` words of all languages together. A text is never cut."""
    held: defaultdict[str, Held] = defaultdict(Held)
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            total += held[NO_LANG if name is None else name].add((text.as_py() or "").encode())
            if total >= size:
                yield from ((k, list(h.vocab), np.concatenate(h.ids)) for k, h in held.items())
                held.clear()
                total = 0
    yield from ((k, list(h.vocab), np.concatenate(h.ids)) for k, h in held.items())


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _counting(size: int):
    """Rows (lang, words, phrase, f): 0 words is their total, 1 a word, 2 a pair common in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocab, ids in _batches(batches, size):
            count = np.bincount(ids, minlength=len(vocab))[1:]
            two = ids[:-1] << 32 | ids[1:]
            pair, often = np.unique(two[(ids[:-1] > 0) & (ids[1:] > 0)], return_counts=True)
            pair, often = pair[2048 * often >= len(ids)], often[2048 * often >= len(ids)]
            joined = [vocab[p >> 32] + b" " + vocab[p & 0xFFFFFFFF] for p in pair.tolist()]
            kinds = [0] + [1] * len(count) + [2] * len(pair)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(kinds), pa.string()),
                    "words": pa.array(kinds, pa.int32()),
                    "phrase": _strings([b"", *vocab[1:], *joined]),
                    "f": pa.array(np.concatenate([[count.sum()], count, often]), pa.int64()),
                }
            )

    return run


def _windows(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows (n, longest) of two words or more, ended by zeros, and their counts."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    rows = np.stack([padded[k : k + len(ids)] for k in range(longest)], axis=1)
    for k in range(1, longest):
        rows[rows[:, k - 1] == 0, k] = 0
    rows = rows[rows[:, 1] > 0]
    if longest == 3 and ids.max(initial=0) < 1 << 21:  # three ids fit one number
        key, count = np.unique(rows[:, 0] << 42 | rows[:, 1] << 21 | rows[:, 2], return_counts=True)
        return np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], axis=1), count
    return np.unique(rows, axis=0, return_counts=True)


ROUTED = "route bigint, deep boolean, lang string, n int, sizes binary, words binary, ids binary, counts binary"


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    offsets = np.concatenate([[0], ends]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _letters(lang: str, vocab: list[bytes], rows: np.ndarray, count: np.ndarray, route: np.ndarray, deep: bool) -> pa.RecordBatch:
    """One row for each route: its windows, and the words that they use."""
    order = np.argsort(route, kind="stable")
    rows, count, route = rows[order], count[order].astype(np.uint32), route[order]
    starts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
    sizes = np.diff(np.append(starts, len(route)))
    group = np.repeat(np.arange(len(starts)), sizes)
    used, local = np.unique(group[:, None] * len(vocab) + rows, return_inverse=True)
    owner, word = used // len(vocab), used % len(vocab)
    first = np.searchsorted(owner, np.arange(len(starts)))
    local = local.reshape(rows.shape) - first[group][:, None]
    texts = pa.array([vocab[w] for w in word.tolist()], pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(word) + 1]
    ends = np.append(first[1:], len(word))
    joined = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets[np.append(0, ends)].copy()), texts.buffers()[2]]
    )
    narrow = np.uint16 if local.max(initial=0) < 1 << 16 else np.uint32
    width = rows.shape[1]
    return pa.RecordBatch.from_pydict(
        {
            "route": pa.array(route[starts].astype(np.int64)),
            "deep": pa.array([deep] * len(starts), pa.bool_()),
            "lang": pa.array([lang] * len(starts), pa.string()),
            "n": pa.array(sizes, pa.int32()),
            "sizes": _slices(np.diff(offsets).astype(np.uint32), ends).cast(pa.binary()),
            "words": joined.cast(pa.binary()),
            "ids": _slices(np.ascontiguousarray(local.astype(narrow)).reshape(-1), np.cumsum(sizes) * width).cast(pa.binary()),
            "counts": _slices(count, np.cumsum(sizes)).cast(pa.binary()),
        }
    )


def _dealing(routes: Routes, setup: Mining):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocab, ids in _batches(batches, setup.batch):
            rows, count = _windows(ids, setup.longest)
            if not len(rows):
                continue
            h = _hashes(lang, vocab)
            one, two = h[rows[:, 0]], _then(h[rows[:, 0]], h[rows[:, 1]])
            split = _among(two, routes.pairs)
            by = np.where(_among(one, routes.words) | split, two, one)
            if split.any():
                # A common pair: its count goes by two words, what follows it by three.
                key, at = np.unique(rows[split, 0] << 32 | rows[split, 1], return_inverse=True)
                whole = np.zeros((len(key), setup.longest), np.int64)
                whole[:, 0], whole[:, 1] = key >> 32, key & 0xFFFFFFFF
                total = np.bincount(at, weights=count[split]).astype(np.int64)
                further = split & (rows[:, 2] > 0) if setup.longest > 2 else np.zeros(len(rows), bool)
                if further.any():
                    three = _then(two[further], h[rows[further, 2]])
                    yield _letters(lang, vocab, rows[further], count[further], three % np.uint64(routes.number), True)
                rows = np.concatenate([rows[~split], whole])
                count = np.concatenate([count[~split], total])
                by = np.concatenate([by[~split], _then(h[whole[:, 0]], h[whole[:, 1]])])
            yield _letters(lang, vocab, rows, count, by % np.uint64(routes.number), False)

    return run


def frequent(columns: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, one pointer, weight) of all prefixes of weight ``least`` or more.

    ``columns``: (depths, pointers) symbols, 0 ends a suffix. Multikey three-way quicksort, all
    open partitions of a pass together; a partition keeps its pointers side by side.
    """
    depths, n = columns.shape
    flat = np.ascontiguousarray(columns).reshape(-1)
    found = []
    ptr = np.arange(n)
    size, depth = np.array([n], np.int64), np.zeros(1, np.int64)
    while len(ptr):
        start = np.cumsum(size) - size
        sym = flat[np.repeat(depth * n, size) + ptr]
        three = np.sort(np.stack([sym[start], sym[start + size // 2], sym[start + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        less, equal = sym < pivot, sym == pivot
        mass = weight[ptr]
        less_before, equal_before = (np.concatenate([[0], np.cumsum(x)]) for x in (less, equal))
        n_less = less_before[start + size] - less_before[start]
        n_equal = equal_before[start + size] - equal_before[start]
        sizes = np.stack([n_less, n_equal, size - n_less - n_equal], axis=1)
        # Where each pointer goes: its part's start, then its place among those of its part.
        index = np.arange(len(ptr))
        low, same = np.repeat(start + 0, size), np.repeat(start + n_less, size)
        rank_less = less_before[:-1] - np.repeat(less_before[start], size)
        rank_equal = equal_before[:-1] - np.repeat(equal_before[start], size)
        high = np.repeat(start + n_less + n_equal, size) + (index - low) - rank_less - rank_equal
        to = np.where(less, low + rank_less, np.where(equal, same + rank_equal, high))
        ptr2, mass2 = np.empty_like(ptr), np.empty_like(mass)
        ptr2[to], mass2[to] = ptr, mass
        sizes = sizes.reshape(-1)
        begins = np.cumsum(sizes) - sizes
        summed = np.concatenate([[0], np.cumsum(mass2)])
        masses = summed[begins + sizes] - summed[begins]
        deeper = np.repeat(depth, 3)
        middle = np.arange(len(sizes)) % 3 == 1
        deeper[middle] += 1
        ended = middle & (np.repeat(three[1], 3) == 0)
        keep = (masses >= least) & (sizes > 0) & ~ended
        report = keep & middle
        for d in np.unique(deeper[report]).tolist():
            here = report & (deeper == d)
            found.append((d, ptr2[begins[here]], masses[here]))
        keep &= deeper < depths
        ptr = ptr2[np.repeat(keep, sizes)]
        size, depth = sizes[keep], deeper[keep]
    return found


def _sorting(setup: Mining):
    """Rows of ROUTED, sorted by (route, deep, lang) -> (lang, words, phrase, a)."""
    width = setup.longest

    def mined(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, deep, lang = key
        n = np.array([r[0] for r in rows])
        sizes = [np.frombuffer(r[1], np.uint32) for r in rows]
        lens = np.concatenate(sizes).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(r[2] for r in rows))]
        )
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = np.asarray(coded.indices).astype(np.int32) + 1
        if MARK in names:
            number[number == names.index(MARK) + 1] = 0
        local = []
        at = 0
        for (m, _, _, ids, _), own in zip(rows, sizes, strict=True):
            kind = np.uint16 if len(ids) == 2 * m * width else np.uint32
            local.append(number[at + np.frombuffer(ids, kind).astype(np.int64)].reshape(m, width))
            at += len(own)
        columns = np.concatenate(local).T
        weight = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).astype(np.int64)
        assert len(weight) == n.sum()
        for depth, pointer, mass in frequent(columns, weight, setup.least):
            if depth < (3 if deep else 2):
                continue
            phrases = [b" ".join(names[s - 1] for s in p) for p in columns[:depth, pointer].T.tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(phrases), pa.string()),
                    "words": pa.array([depth] * len(phrases), pa.int32()),
                    "phrase": _strings(phrases),
                    "f": pa.array(mass, pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for route, deep, lang, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (route, deep, lang) != key:
                    if rows:
                        yield from mined(key, rows)
                    key, rows = (route, deep, lang), []
                rows.append(tuple(rest))
        if rows:
            yield from mined(key, rows)

    return run


COUNTS = "lang string, words int, phrase string, f bigint"


def _routes(counted: DataFrame, setup: Mining) -> Routes:
    """Dealing that fits the counts; only words and pairs above a 2^20th of all words come to the driver."""
    total = counted.filter("words = 0").agg(F.sum("f")).first()[0] or 0
    limit = max(total >> 20, min(setup.common, total >> 10))
    held: dict[int, list[np.uint64]] = {1: [], 2: []}
    for row in counted.filter(F.col("words").isin(1, 2) & (F.col("f") > limit)).collect():
        h = _hashes(row["lang"], row["phrase"].encode().split(b" "))
        held[row["words"]].append(h[0] if len(h) == 1 else _then(h[:1], h[1:])[0])
    words, pairs = (np.sort(np.array(held[k], np.uint64)) for k in (1, 2))
    return Routes(max(1, -(-total // setup.route)), words, pairs)


def phrase_counts(docs: DataFrame, setup: Mining = Mining()) -> DataFrame:
    """(lang, words, phrase, f): all words' total per language (0 words), words and phrases of ``least`` or more.

    ``docs`` has columns lang and text.
    """
    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    summed = texts.mapInArrow(_counting(setup.batch), COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    counted = written(summed.filter(f"f >= {setup.least} or words = 0"), "phrase-words")
    routes = _routes(counted, setup)
    key = ["route", "deep", "lang"]
    dealt = texts.mapInArrow(_dealing(routes, setup), ROUTED).repartition(max(routes.number, _partitions(docs)), "route")
    longer = dealt.sortWithinPartitions(*key).mapInArrow(_sorting(setup), COUNTS)
    return written(counted.filter("words < 2").unionByName(longer), "phrase-counts")


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mine_phrases(docs: DataFrame, setup: Mining = Mining(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ends of pieces, pieces into words at blanks; a is the count of the phrase, l and r those of
    the two parts of its weakest cut, n all words of the language, score floor(1000000 a a / (l r)).
    A phrase goes if a longer one that holds it has ``inside`` percent of its count. Ranks are by
    score, count, then phrase in byte order, so ties are settled. A null language is ``und``, a null
    or empty text has no words, repeated rows count each time, an empty table gives no rows; other
    columns are not looked at.
    """
    counts = phrase_counts(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), setup)
    part = counts.filter("words > 0").select("lang", "phrase", "f")
    found = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(word, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    left = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # 15 digits each: products stay within 38, and the division is exact.
    big = {c: f"cast({c} as decimal(15,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({big['a']} * {big['a']})) div ({big['l']} * {big['r']})")
    weakest = (
        scored.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    spans = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.struct(m.alias("m"), (F.col("words") - m + 1).alias("last")))
    shorter = F.flatten(
        F.transform(spans, lambda s: F.transform(F.sequence(F.lit(1), s["last"]), lambda i: F.array_join(F.slice(word, i, s["m"]), " ")))
    )
    covered = (
        found.filter("words > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = weakest.join(covered, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < setup.inside * F.col("a"))
    )
    # The best of each of 64 parts first, so that a language ends in one task with few rows.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= setup.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = few.withColumn("rank", rank).filter(F.col("rank") <= setup.top)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

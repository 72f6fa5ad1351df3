"""Benchmark decontamination by greedy string tiling.

Documents that share a seed, a run of ``min_match`` tokens, with a benchmark item are
candidates. Each candidate pair is tiled: the longest common runs of unmarked tokens are
marked, again and again, with running Karp-Rabin hashes to find them. What part of the item is covered
decides, wherever its pieces stand, so passages in another order are found too.

The seeds of a benchmark of bounded size go to every task and documents are not moved.
A larger benchmark is joined by shuffling seeds; both ways give the same pairs.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import same, texts, written

NO_PUNCTUATION = string.punctuation.encode()
BASE = 0x9E3779B97F4A7C15
PAIRS = "item_id bigint, n_tokens bigint, covered bigint, tiles array<struct<doc_start:int,item_start:int,length:int>>"
TILE = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))


@dataclass(frozen=True)
class Limits:
    """``coverage``: part of an item's tokens in tiles that makes a document contaminated.
    ``max_broadcast_chars``: size of a benchmark whose seeds may be sent to every task."""

    min_match: int = 5
    coverage: float = 0.5
    max_broadcast_chars: int = 32_000_000


def tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, ASCII punctuation left out."""
    words = text.lower().translate(None, NO_PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def running_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window, modulo 2^64: each window's from running sums."""
    if len(tokens) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(tokens) - width + 1, np.uint64)
    power, step = np.uint64(1), np.uint64(BASE)
    with np.errstate(over="ignore"):
        for k in range(width - 1, -1, -1):
            out += tokens[k : len(tokens) - width + 1 + k] * power
            power = power * step
    return out


def seed_width(n_tokens: int, min_match: int) -> int:
    """An item shorter than a seed is one seed."""
    return min(n_tokens, min_match)


def _runs_at(item: np.ndarray, doc: np.ndarray, width: int, starts: np.ndarray, order: np.ndarray, low: np.ndarray, count: np.ndarray):
    """Maximal runs (length, item start, doc start) of few hits, walked along their diagonals."""
    runs, covered = [], {}
    for d, a, c in zip(starts.tolist(), low.tolist(), count.tolist(), strict=True):
        for i in order[a : a + c].tolist():
            if d + width <= covered.get(d - i, -1):
                continue  # inside a run on this diagonal
            m = min(len(doc) - d, len(item) - i)
            unlike = np.flatnonzero(doc[d : d + m] != item[i : i + m])
            n = int(unlike[0]) if len(unlike) else m
            covered[d - i] = d + n
            if n >= width:  # equal hashes of other words are no run
                runs.append((n, i, d))
    return [np.array(x, np.int64) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 3


def _runs_everywhere(item: np.ndarray, doc: np.ndarray, width: int):
    """The same for many hits: lengths for all places of the document, one word of the item at a time."""
    found = []
    after = np.zeros(len(doc) + 1, np.int64)  # run lengths from (i + 1, d)
    for i in range(len(item) - 1, -1, -1):
        here = np.where(doc == item[i], after[1:] + 1, 0)
        begins = here >= width
        if i:
            begins[1:] &= doc[:-1] != item[i - 1]
        d = np.flatnonzero(begins)
        if len(d):
            found.append((here[d], np.full(len(d), i), d))
        after = np.append(here, 0)
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def tile(item: np.ndarray, doc: np.ndarray, width: int, near: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length) of tiles of ``width`` or more.

    ``near``: starts of windows of the document that may match; others cannot begin a tile.
    Ties in length go to the earliest place in the item, then in the document. Maximal runs wait
    in order of their length; one that a tile has cut goes back with what is left of it, so texts of a few
    words over and over cost what their runs cost, not what their pairs of places do.
    """
    hashes, window = running_hashes(item, width), running_hashes(doc, width)
    order = np.argsort(hashes, kind="stable")
    known = hashes[order]
    starts = np.arange(len(window)) if near is None else near
    low = np.searchsorted(known, window[starts], "left")
    count = np.searchsorted(known, window[starts], "right") - low
    if count.sum() <= 4 * len(starts) + len(item):
        size, at_item, at_doc = _runs_at(item, doc, width, starts, order, low, count)
    else:
        size, at_item, at_doc = _runs_everywhere(item, doc, width)
    first = np.lexsort((at_doc, at_item, -size))
    size, at_item, at_doc = size[first], at_item[first], at_doc[first]
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    cut: list[tuple[int, int, int]] = []  # what is left of runs, longest first
    next_, left = 0, len(item)
    while left >= width and (cut or next_ < len(size)):
        whole = (-int(size[next_]), int(at_item[next_]), int(at_doc[next_])) if next_ < len(size) else None
        if whole is not None and (not cut or whole <= cut[0]):
            n, i, d = whole
            next_ += 1
        else:
            n, i, d = heapq.heappop(cut)
        n = -n
        free = free_doc[d : d + n] & free_item[i : i + n]
        if free.all():
            free_doc[d : d + n] = False
            free_item[i : i + n] = False
            tiles.append((d, i, n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(cut, (a - b, i + a, d + a))
    return sorted(tiles)


class Benchmark:
    """Items with their seeds in one sorted array."""

    def __init__(self, rows: list[tuple[int, bytes]], limits: Limits):
        self.limits = limits
        self.items: list[tuple[int, np.ndarray]] = [(i, t) for i, t in ((i, tokens(x)) for i, x in rows) if len(t)]
        pairs: dict[int, list[tuple[int, int]]] = {}
        for width in range(1, limits.min_match + 1):
            found = [
                (h, n)
                for n, (_, t) in enumerate(self.items)
                if seed_width(len(t), limits.min_match) == width
                for h in running_hashes(t, width).tolist()
            ]
            pairs[width] = sorted(set(found))
        self.seeds = {
            w: (np.array([h for h, _ in p], np.uint64), np.array([n for _, n in p], np.int64)) for w, p in pairs.items() if p
        }

    def pairs(self, text: bytes) -> Iterator[tuple[int, int, int, list]]:
        """(item_id, tokens of the item, covered tokens, tiles) where the coverage is reached."""
        doc = tokens(text)
        for width, (seeds, owners) in self.seeds.items():
            window = running_hashes(doc, width)
            low = np.searchsorted(seeds, window, "left")
            hit = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == window))
            if not len(hit):
                continue
            high = np.searchsorted(seeds, window[hit], "right")
            by_item: dict[int, list[int]] = {}
            for d, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for n in owners[a:b].tolist():
                    by_item.setdefault(n, []).append(d)
            for n, near in by_item.items():
                number, item = self.items[n]
                found = tile(item, doc, width, np.array(near))
                covered = sum(x[2] for x in found)
                if covered >= self.limits.coverage * len(item):
                    yield number, len(item), covered, found


def _bounded(benchmark: DataFrame, limits: Limits, item_id: str, text: str) -> list[tuple[int, bytes]] | None:
    """The items, if they are known to be small; else nothing is collected."""
    chars = benchmark.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    if chars > limits.max_broadcast_chars:
        return None
    rows = benchmark.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).collect()
    return [(r[0], r[1].encode("utf-8", "replace")) for r in rows]


def _matches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            rows = [
                (doc, *pair)
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)
                for pair in bench.pairs(text)
            ]
            yield _pair_batch(rows)

    return run


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    tiles = [[{"doc_start": d, "item_start": i, "length": n} for d, i, n in r[4]] for r in rows]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "item_id": pa.array([r[1] for r in rows], pa.int64()),
            "n_tokens": pa.array([r[2] for r in rows], pa.int64()),
            "covered": pa.array([r[3] for r in rows], pa.int64()),
            "tiles": pa.array(tiles, TILE),
        }
    )


def _seeds(widths: list[int]):
    """(id, text) -> distinct (id, width, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                t = tokens(text)
                for width in widths:
                    found = np.unique(running_hashes(t, width))
                    if len(found):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "id": pa.array([number] * len(found), pa.int64()),
                                "width": pa.array([width] * len(found), pa.int32()),
                                "seed": pa.array(found.view(np.int64)),
                            }
                        )

    return run


def _item_seeds(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {
                (number, width, h)
                for number, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)
                if len(t := tokens(text))
                for width in (seed_width(len(t), min_match),)
                for h in running_hashes(t, width).view(np.int64).tolist()
            }
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array([r[0] for r in rows], pa.int64()),
                    "width": pa.array([r[1] for r in rows], pa.int32()),
                    "seed": pa.array([r[2] for r in rows], pa.int64()),
                }
            )

    return run


def _tile_rows(limits: Limits):
    """(doc_id, text, item_id, item text) -> pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, items = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, number, body in zip(ids, texts(batch.column(1)), items, texts(batch.column(3)), strict=True):
                rows += [(doc, *pair) for pair in Benchmark([(number, body)], limits).pairs(text)]
            yield _pair_batch(rows)

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, limits: Limits, item_id: str, item_text: str) -> DataFrame:
    """Pairs of a benchmark of any size. ``docs``: (doc_id, text, text_hash)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("body"))
    # A row is named by its place in a written table, so ids may be null or repeat.
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    rows = written(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    widths = list(range(1, limits.min_match + 1))
    wanted = items.select("row", "body").mapInArrow(_item_seeds(limits.min_match), "item bigint, width int, seed bigint")
    candidates = (
        rows.select("row", "text")
        .mapInArrow(_seeds(widths), "id bigint, width int, seed bigint")
        .join(wanted, ["width", "seed"])
        .select("id", F.col("item").alias("irow"))
        .distinct()
    )
    return (
        candidates.join(rows, candidates.id == rows.row)
        .drop("row")
        .join(items, F.col("irow") == items.row)
        .select("doc_id", "text", "item", "body")
        .mapInArrow(_tile_rows(limits), f"doc_id bigint, {PAIRS}")
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_tokens, covered, tiles.

    Tokens are words, A-Z lower-cased, without ASCII punctuation. Null and empty texts, on
    either side, match nothing. An item of fewer tokens than ``min_match`` is found
    where it stands whole. A pair exactly at the coverage counts. Rows that repeat a
    document or an item give a row each; null ids stay null. Empty tables give no rows;
    other columns are not looked at.
    """
    small = _bounded(benchmark, limits, item_id, item_text)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if small is None:
        return _joined(own, benchmark, limits, item_id, item_text)
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(small, limits))
    return own.mapInArrow(_matches(shared), f"doc_id bigint, {PAIRS}")


def _clean(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            yield batch.filter(pa.array([next(bench.pairs(t), None) is None for t in texts(batch.column(text_at))], pa.bool_()))

    return run


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are; null and empty texts stay."""
    small = _bounded(benchmark, limits, "item_id", "text")
    if small is None:
        marks: list[Column] = [F.col(doc_id).cast("long"), F.xxhash64(F.col(text))]
        keyed = docs.select(F.xxhash64(*marks).alias("doc_id"), F.col(text).alias("text"))
        bad = _joined(keyed, benchmark, limits, "item_id", "text").select(F.col("doc_id").alias("__bad")).distinct()
        return docs.alias("d").join(bad.alias("b"), same((F.xxhash64(*marks), F.col("b.__bad"))), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(small, limits))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(_clean(shared, names.index(text)), plain.schema).toDF(*names)

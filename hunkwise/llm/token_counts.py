"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

A batch of texts is cut into pre-tokens; those not met before are laid end to end in one
ragged array of symbols. In each round every sequence finds the lowest rank among its own
pairs, all sequences merge at once wherever that rank stands, and sequences without a
ranked pair leave with their count of symbols. Counts of pre-tokens are remembered within
a task, up to a bound, so a word costs its merges once and a look-up after that.

The vocabulary file is read once, on the driver: its merges are two arrays of fixed size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published pattern that cuts texts before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Editions of Unicode agree on the classes of all code points below; texts with others are cut by the library.
SETTLED = 0x530
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Limits:
    """``long``: symbols from which a pre-token is merged by itself; ``chars`` of text are
    handled at a time; ``known``: pre-tokens whose counts a task remembers."""

    long: int = 4096
    chars: int = 4_000_000
    known: int = 400_000


@dataclass(frozen=True)
class Merges:
    """Ranked pairs as arrays; ``keys`` are sorted, left symbol << 32 | right symbol."""

    first: np.ndarray  # symbol of each byte
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray  # symbol that the merge of each rank makes
    special: tuple[str, ...]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def read_merges(path: str) -> Merges:
    """The merges of a tokenizer file in JSON; only byte-level BPE without a normaliser is known."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = [k for k in ("unk_token", "dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or not plain or spec.get("normalizer") or odd:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"{path}: added token {token['content']!r} takes text beside it")
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    keys = left << 32 | right
    order = np.argsort(keys)
    return Merges(
        first=np.array([vocab[x] for x in byte_letters()], np.int32),
        keys=keys[order],
        ranks=order.astype(np.int32),
        made=np.array([vocab[a + b] for a, b in pairs], np.int32),
        special=tuple(t["content"] for t in spec["added_tokens"]),
    )


def merged_counts(words: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols left of each word (none may be empty), all words merged together."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    sym = merges.first[np.frombuffer(b"".join(words), np.uint8)]
    seq = np.repeat(np.arange(len(words)), sizes)
    inside = seq[:-1] == seq[1:]
    rank = np.full(len(sym), NONE, np.int32)  # of the pair that starts here
    rank[:-1][inside] = merges.rank(sym[:-1][inside], sym[1:][inside])
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        lows = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        low = np.repeat(lows, sizes)
        if (lows == NONE).any():
            done = lows == NONE
            out[seq[starts[done]]] = sizes[done]
            keep = low != NONE
            sym, seq, rank, low = sym[keep], seq[keep], rank[keep], low[keep]
            if not len(sym):
                break
        at = np.flatnonzero(rank == low)
        # Hits side by side are one symbol again and again: every second one counts, from the left.
        begins = np.concatenate([[True], (np.diff(at) > 1) | (seq[at[1:]] != seq[at[:-1]])])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym[at] = merges.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1  # where the merged symbols stand afterwards
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        touched = np.concatenate([new, new[new > 0] - 1])
        follow = np.minimum(touched + 1, len(sym) - 1)
        paired = (follow > touched) & (seq[follow] == seq[touched])
        rank[touched] = np.where(paired, merges.rank(sym[touched], sym[follow]), NONE)
    return out


def long_count(word: bytes, merges: Merges) -> int:
    """The same for one long word: places wait in a queue by rank, so a round costs what it merges."""
    sym = merges.first[np.frombuffer(word, np.uint8)]
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, NONE, np.int32)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] != NONE]
        if not len(places):
            return
        order = np.argsort(rank[places], kind="stable")
        ranks, at = np.unique(rank[places][order], return_index=True)
        for r, group in zip(ranks.tolist(), np.split(places[order], at[1:]), strict=True):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(queue, r)
            waiting[r].append(group)

    rank[:-1] = merges.rank(sym[:-1], sym[1:])
    if n > 1:
        wait(np.arange(n - 1))
    left = n
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        sym[at] = merges.made[r]
        rank[gone] = NONE
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        left -= len(at)
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        follow = np.minimum(after[touched], n - 1)
        rank[touched] = np.where(after[touched] < n, merges.rank(sym[touched], sym[follow]), NONE)
        wait(touched)
    return left


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, merges: Merges, limits: Limits):
        self.merges, self.limits = merges, limits
        self.known: dict[str, int] = {}
        self.cut = regex.compile(PATTERN)
        self.other = regex.compile(f"[^\\x00-\\u{SETTLED - 1:04x}]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self.library = None

    def pre_tokens(self, text: str) -> list[str]:
        if not self.other.search(text):
            return self.cut.findall(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def counts(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text)
            extra.append(len(parts) - 1)
            cut.append([w for part in parts for w in self.pre_tokens(part)] if len(parts) > 1 else self.pre_tokens(text))
        if len(self.known) > self.limits.known:
            self.known = {}
        known = self.known
        new = [w for w in set().union(*cut) if w not in known]
        coded = [w.encode() for w in new]
        short = [i for i, w in enumerate(coded) if len(w) < self.limits.long]
        if short:
            known.update(zip([new[i] for i in short], merged_counts([coded[i] for i in short], self.merges).tolist(), strict=True))
        for i, w in enumerate(coded):
            if len(w) >= self.limits.long:
                known[new[i]] = long_count(w, self.merges)
        return [sum(map(known.__getitem__, words)) + more for words, more in zip(cut, extra, strict=True)]


def _counting(merges: Merges, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges, limits)
        for batch in batches:
            n_bytes, n_tokens, held, size = [], [], [], 0
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                held.append(text)
                size += len(text)
                if size > limits.chars:
                    n_tokens += counter.counts(held)
                    held, size = [], 0
            n_tokens += counter.counts(held)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame, path: str, limit: int | None = None, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and, with a ``limit``, over_limit.

    Tokens are those of the vocabulary file at ``path``, without begin, end or added special
    tokens; a special string inside a text is one token, as the library's default has it.
    A null text is an empty one: no bytes, no tokens. Null and repeated ids are rows like any
    other; an empty table gives no rows; other columns are not looked at. A long text is
    counted whole; one pre-token of megabytes costs n log n. Nothing is shuffled.
    """
    merges = read_merges(path)
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema.fields[0].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text")).mapInArrow(
        _counting(merges, limits), f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    over: list[Column] = [] if limit is None else [(F.col("n_tokens") > limit).alias("over_limit")]
    return out.select("doc_id", "n_bytes", "n_tokens", *over)

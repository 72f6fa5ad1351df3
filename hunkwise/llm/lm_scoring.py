"""Language-model scoring with a weighted backoff automaton.

Counts stay in the cluster. Documents are dealt into blocks of a few megabytes. A block
sends its distinct n-grams, with their counts in training texts, to buckets by hash; a bucket
adds up what all blocks sent and answers each block for the n-grams it asked for. From the
answers a block builds the part of the automaton that its texts can reach: seen
contexts are states, seen n-grams are arcs, and every state has a failure arc to its
suffix. Each text is one walk from left to right that carries the state and adds log10
weights. No table of n-grams is broadcast, pruned or brought to the driver.

Smoothing: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), h' being h without its first
word; p(w) = (c(w) - discount) / N, and the mass that the discounts free belongs to
the unknown word. Outcomes of a state sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import fold_words, texts, written

START, END = b" start", b" end"  # no word holds a blank
START_ID, END_ID = 0, 1


@dataclass(frozen=True)
class Model:
    """``order`` words at most decide; ``mu`` is the weight of the shorter context, ``discount``
    what a known word gives to the unknown one. A block or bucket holds about so many bytes of text."""

    order: int = 2
    mu: float = 16.0
    discount: float = 0.5
    block_bytes: int = 6_000_000
    bucket_bytes: int = 8_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Level:
    """Distinct n-grams of one length in a block."""

    keys: np.ndarray  # 64-bit digests
    counts: np.ndarray  # in the block's training texts
    context: np.ndarray  # the (n-1)-gram before the last word
    suffix: np.ndarray  # the (n-1)-gram without the first word
    word: np.ndarray


def block_levels(bodies: list[bytes], train: np.ndarray, order: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """(levels, word ids of all texts one after the other, where each text starts).

    Every text is a start, its words and an end. The same texts in the same order give
    the same numbering, so answers can be matched by place.
    """
    numbers: dict[bytes, int] = {START: START_ID, END: END_ID}
    ids: list[int] = []
    starts = [0]
    for body in bodies:
        ids.append(START_ID)
        ids += [numbers.setdefault(w, len(numbers)) for w in fold_words(body)]
        ids.append(END_ID)
        starts.append(len(ids))
    word = np.array(ids, np.int64)
    at = np.array(starts)
    learned = np.repeat(train, np.diff(at))
    place = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    none = np.zeros(0, np.int64)
    levels = [Level(keys, np.bincount(word[learned], minlength=len(numbers)), none, none, none)]
    gram = word
    for n in range(2, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        codes, first, inverse = np.unique(gram[ends - 1] * len(numbers) + word[ends], return_index=True, return_inverse=True)
        context, last = codes // len(numbers), codes % len(numbers)
        below = levels[-1].keys[context]
        levels.append(
            Level(
                _mix(below * np.uint64(0x9E3779B97F4A7C15) + keys[last] + np.uint64(n)),
                np.bincount(inverse[learned[ends]], minlength=len(codes)),
                context,
                gram[ends[first]],
                last,
            )
        )
        new = np.full(len(word), -1, np.int64)
        new[ends] = inverse
        gram = new
    return levels, word, at


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys) % np.uint64(buckets)).astype(np.int64)


def _pack(keys: np.ndarray, level: int) -> bytes:
    """Digests of a bucket: 64 bits of a word, 56 of a longer n-gram besides those that chose the bucket."""
    return keys.tobytes() if level == 1 else keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(body: bytes, level: int) -> np.ndarray:
    if level == 1:
        return np.frombuffer(body, np.uint64)
    wide = np.zeros((len(body) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(body, np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


def _split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys): questions and answers use the same order."""
    bucket = _buckets_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _ask(order: int, buckets: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(rows(key[0].as_py(), table)), QUESTION)

    def rows(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        levels, _, _ = _levels_of(table, order)
        for n, level in enumerate(levels, 1):
            for bucket, part in _split(level.keys, buckets):
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([bucket], pa.int64()),
                        "block": pa.array([block], pa.int64()),
                        "level": pa.array([n], pa.int32()),
                        "keys": pa.array([_pack(level.keys[part], n)], pa.binary()),
                        "counts": pa.array([_narrow(level.counts[part])], pa.binary()),
                    },
                    QUESTION,
                )

    return ask


QUESTION = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
)
ASKED = "bucket bigint, block bigint, level int, keys binary, counts binary"
ANSWERED = "block bigint, bucket bigint, level int, totals binary, words bigint"
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, words bigint"
)


def _levels_of(table: pa.Table, order: int):
    """Rows of a block in a fixed order, so that it is the same whenever it is built."""
    table = table.sort_by([("text", "ascending"), ("train", "ascending"), ("doc_id", "ascending")])
    column = table.column("text").combine_chunks()
    return block_levels(list(texts(column)), np.array(table.column("train").to_pylist(), bool), order)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and level: totals of a bucket, for every block that asked."""
    start = xxhash.xxh3_64_intdigest(START)
    spot, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        parts = [_unpack(k, spot[1]) for _, k, _ in held]
        keys = np.concatenate(parts)
        counts = np.concatenate([_widen(c) for _, _, c in held])
        known, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
        # How many words are known at all is told once, to the first block.
        words = int(((totals > 0) & (known != np.uint64(start))).sum()) if spot[1] == 1 else 0
        sums, at = totals[inverse].astype(np.uint64), 0
        for i, (block, _, _) in enumerate(held):
            n = len(parts[i])
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "bucket": pa.array([spot[0]], pa.int64()),
                    "level": pa.array([spot[1]], pa.int32()),
                    "totals": pa.array([_narrow(sums[at : at + n])], pa.binary()),
                    "words": pa.array([words if i == 0 else 0], pa.int64()),
                }
            )
            at += n

    for batch in batches:
        for bucket, block, level, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, level) != spot:
                yield from answers()
                spot, held = (bucket, level), []
            held.append((block, keys, counts))
    yield from answers()


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the width comes first."""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if not len(values) or values.max() <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()
    raise ValueError


def _widen(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"u{body[0]}", offset=1).astype(np.int64)


class Automaton:
    """The part of the model that a block can reach. State 0 is the empty context."""

    def __init__(self, levels: list[Level], totals: list[np.ndarray], n_train: int, model: Model):
        self.width = len(levels[0].keys)
        seen = totals[0] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            prob = np.where(seen, (totals[0] - model.discount) / max(n_train, 1), 0.0)
            prob[START_ID] = 0.0
            self.root = np.log10(prob, where=prob > 0, out=np.zeros_like(prob)).tolist()
        self.seen = seen.tolist()
        # States of a level follow those of the one below.
        first, states = 1, [np.where(seen & (np.arange(self.width) != END_ID), np.arange(self.width) + 1, 0)]
        fails = [np.zeros(1 + self.width)]
        fails[0][1:] = np.log10(model.mu / (totals[0] + model.mu))
        lower = [np.zeros(1 + self.width, np.int64)]
        self.arcs: dict[int, int] = {}
        weights, targets = [], []
        first += self.width
        for n, (level, total) in enumerate(zip(levels[1:], totals[1:], strict=True), 2):
            prob = (total + model.mu * prob[level.suffix]) / (totals[n - 2][level.context] + model.mu)
            found = np.flatnonzero(total > 0)
            if n < len(levels):
                state = np.where((total > 0) & (level.word != END_ID), np.arange(len(total)) + first, states[-1][level.suffix])
                fails.append(np.log10(model.mu / (total + model.mu)))
                lower.append(states[-1][level.suffix])
                first += len(total)
            else:
                state = states[-1][level.suffix]
            codes = states[-1][level.context[found]] * self.width + level.word[found]
            self.arcs.update(zip(codes.tolist(), range(len(weights), len(weights) + len(found)), strict=True))
            weights += np.log10(prob[found]).tolist()
            targets += state[found].tolist()
            states.append(state)
        self.weights, self.targets = weights, targets
        self.fail = np.concatenate(fails).tolist()
        self.lower = np.concatenate(lower).tolist()
        self.first = states[0].tolist()

    def walk(self, words: list[int]) -> tuple[float, int]:
        """(log10 weight of all known words and failure arcs, number of unknown words)."""
        arcs, weights, targets, fail, lower = self.arcs, self.weights, self.targets, self.fail, self.lower
        root, first, seen, width = self.root, self.first, self.seen, self.width
        total, unknown, state = 0.0, 0, first[START_ID]
        for w in words:
            while state:
                arc = arcs.get(state * width + w)
                if arc is not None:
                    total += weights[arc]
                    state = targets[arc]
                    break
                total += fail[state]
                state = lower[state]
            else:
                total += root[w]
                unknown += not seen[w]
                state = first[w]
        return total, unknown


def _score(model: Model, buckets: int, n_train: int):
    def score(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        levels, word, at = _levels_of(block, model.order)
        found = {
            (b, n): _widen(t)
            for b, n, t in zip(*(answers.column(c).to_pylist() for c in ("bucket", "level", "totals")), strict=True)
        }
        totals = []
        for n, level in enumerate(levels, 1):
            total = np.zeros(len(level.keys), np.int64)
            for bucket, part in _split(level.keys, buckets):
                total[part] = found[bucket, n]
            totals.append(total)
        automaton = Automaton(levels, totals, n_train, model)
        base = np.log10(totals[0] + 1.0)
        rows = {c: [] for c in ("n_tokens", "n_known", "base", "score")}
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = word[a + 1 : b]
            weight, unknown = automaton.walk(own.tolist())
            rows["n_tokens"].append(len(own))
            rows["n_known"].append(len(own) - unknown)
            rows["base"].append(float(base[own].sum()))
            rows["score"].append(weight)
        block = block.sort_by([("text", "ascending"), ("train", "ascending"), ("doc_id", "ascending")])
        held = [not t for t in block.column("train").to_pylist()]
        known = [sum(answers.column("words").to_pylist())] + [0] * (len(held) - 1)
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
                "n_known": pa.array(rows["n_known"], pa.int64()),
                "base": pa.array(rows["base"], pa.float64()),
                "score": pa.array(rows["score"], pa.float64()),
                "words": pa.array(known, pa.int64()),
            }
        )

    return score


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = n = 0
        for text, train in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            size += len(text)
            n += (len(text.split()) + 1) * train
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([size], pa.int64()), "tokens": pa.array([n], pa.int64())})


def score_documents(
    docs: DataFrame, train: Column, model: Model = Model(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``train`` is true; null counts as false.
    Words are runs of non-blanks, A-Z lower-cased, told apart by 64-bit digests; every text
    has one end, a token like others. A null or empty text is an end alone.
    Rows that repeat are texts each, also in training. A null id is kept. With nothing to
    learn from, every score is 0. An empty table gives no rows; other columns of ``docs`` are
    not looked at.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sums = rows.select("text", "train").mapInArrow(_sizes, "bytes bigint, tokens bigint")
    size, n_train = (x or 0 for x in sums.agg(F.sum("bytes"), F.sum("tokens")).first())
    blocks = max(1, -(-size // model.block_bytes))
    buckets = max(1, -(-size // model.bucket_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")
    asked = dealt.groupBy("block").applyInArrow(_ask(model.order, buckets), ASKED)
    answered = (
        asked.repartition("bucket").sortWithinPartitions("bucket", "level").mapInArrow(_add_up, ANSWERED)
    )
    scored = written(
        dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(model, buckets, n_train), SCORED),
        "scores",
    )
    known = scored.agg(F.sum("words")).first()[0] or 0
    unknown = math.log10(model.discount * known / n_train) if known else 0.0
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n_train + known + 1)).alias("base_score"),
        (F.col("score") + (F.col("n_tokens") - F.col("n_known")) * unknown).alias("score"),
    )

"""Line deduplication with two Bloom filters.

First pass: every task keeps two filters over the hashes of line keys, "in a document" and
"in a second document", and gives them out in slices; slices meet and merge. A key
that two tasks have seen once each sets its bits of the second filter in the merge.
Second pass: only keys that the second filter knows are shuffled, one row for each key
and batch, to be counted exactly and to choose the document that keeps them.

Filters grow with the lines there are. One of up to ``FILTER_BITS`` is sent to all tasks. Beyond
twice that, keys are dealt into slices by hash instead: a slice has filters of that size of its own,
and the digests of lines, not the lines, travel to it. Both ways give the same result, because a
filter only chooses what is counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import same, texts, written

FILTER_BITS = 1 << 26  # 8 MB as bits; all that is ever broadcast
LEAST_BITS = 1 << 12
BITS_A_LINE = 8
SLICES = 32
SALTS = 16  # parts of a key that many documents hold
PROBES = 2
NO_ID = -(1 << 63)


def line_keys(text: bytes, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """(line, key) of every line; the key is None where it is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
            out.append((line, None))
        else:
            out.append((line, key))
    return out


def _digests(text: bytes, min_chars: int) -> list[bytes]:
    """128-bit digests of the different keys of a document."""
    return [xxhash.xxh3_128_digest(k) for k in {k for _, k in line_keys(text, min_chars) if k is not None}]


def _hashes(digests: list[bytes]) -> np.ndarray:
    """The half of each digest that filters and slices go by."""
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit numbers."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _fold(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """Note the keys of some documents; a key is listed once for each document."""
    if not len(hashes):
        return
    keys, counts = np.unique(hashes, return_counts=True)
    spots = _spots(keys, len(once))
    again = (counts > 1) | once[spots].all(axis=0)
    twice[spots[:, again]] = True
    once[spots] = True


def _filters(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            _fold(once, twice, _hashes([d for text in texts(batch.column(0)) for d in _digests(text, min_chars)]))
        width = bits // SLICES
        for s in range(SLICES):
            part = slice(s * width, (s + 1) * width)
            if once[part].any():
                packed = [zlib.compress(np.packbits(x[part]).tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([s], pa.int32()), "once": [packed[0]], "twice": [packed[1]]}
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sorted slices one by one; two slices are in memory at a time."""
    number, once, twice = None, None, None

    def give() -> Iterator[pa.RecordBatch]:
        if number is not None:
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([number], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]}
            )

    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
            if row["slice"] != number:
                yield from give()
                number, once, twice = row["slice"], a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    yield from give()


def twice_filter(docs: DataFrame, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The merged second filter as packed bits: ``bits / 8`` bytes whatever the input."""
    parts = docs.select(text).mapInArrow(_filters(bits, min_chars), "slice int, once binary, twice binary")
    merged = (
        parts.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, twice binary")
    )
    packed = np.zeros(bits // 8, np.uint8)
    width = len(packed) // SLICES
    for row in merged.collect():
        packed[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return packed


def _known(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spots = _spots(hashes, len(packed) * 8)
    return ((packed[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1).all(axis=0)


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(slices)).astype(np.int32)


HOLDERS = "key binary, salt int, docs array<bigint>, rows array<bigint>"
SLICED = "slice int, twice binary, " + HOLDERS


def _holders(batch: pa.RecordBatch, min_chars: int, keep) -> tuple[list[bytes], list]:
    """Keys of (doc, row, text) that ``keep`` chooses by their hashes, and the other columns of HOLDERS.

    A key of many batches gets salts by the batch, here by its first document.
    """
    found: dict[bytes, tuple[list[int], list[int]]] = {}
    ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for doc, row, text in zip(ids, marks, texts(batch.column(2)), strict=True):
        digests = _digests(text, min_chars)
        if digests:
            for i in np.flatnonzero(keep(_hashes(digests))):
                docs, rows = found.setdefault(digests[i], ([], []))
                docs.append(doc)
                rows.append(row)
    salt = zlib.crc32(repr(marks[:1]).encode()) % SALTS
    return list(found), [
        pa.array(list(found), pa.binary()),
        pa.array([salt] * len(found), pa.int32()),
        pa.array([d for d, _ in found.values()], pa.list_(pa.int64())),
        pa.array([r for _, r in found.values()], pa.list_(pa.int64())),
    ]


def _suspects(packed, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, columns = _holders(batch, min_chars, lambda h: _known(packed.value, h))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "salt", "docs", "rows"])

    return run


def _dealt_hashes(slices: int, min_chars: int):
    """(slice, hashes): those of a batch, a key in several of its documents twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _hashes([d for text in texts(batch.column(0)) for d in _digests(text, min_chars)])
            keys, counts = np.unique(every, return_counts=True)
            keys = np.repeat(keys, np.minimum(counts, 2))
            of = _slice_of(keys, slices)
            order = np.argsort(of, kind="stable")
            numbers, starts = np.unique(of[order], return_index=True)
            parts = np.split(keys[order], starts[1:]) if len(numbers) else []
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(numbers, pa.int32()), "hashes": pa.array([p.tobytes() for p in parts], pa.binary())}
            )

    return run


def _slice_filters(bits: int):
    """Rows sorted by slice to the second filter of each slice; one slice is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, once, twice = None, None, None

        def give() -> Iterator[pa.RecordBatch]:
            if number is not None:
                packed = zlib.compress(np.packbits(twice).tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "twice": [packed]})

        for batch in batches:
            for s, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != number:
                    yield from give()
                    number, once, twice = s, np.zeros(bits, bool), np.zeros(bits, bool)
                _fold(once, twice, np.frombuffer(hashes, np.uint64))
        yield from give()

    return run


def _dealt_holders(slices: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns = _holders(batch, min_chars, lambda h: np.ones(len(h), bool))
            of = _slice_of(_hashes(keys), slices) if keys else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int32()), pa.nulls(len(keys), pa.binary()), *columns],
                names=["slice", "twice", "key", "salt", "docs", "rows"],
            )

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (slice, salt), the filter first: holders of the keys that it knows."""
    known = None
    for batch in batches:
        filters = batch.column(1)
        at = 0
        for end in [*np.flatnonzero(filters.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(batch)]:
            part = batch.slice(at, end - at)
            if len(part):
                hit = _known(known, _hashes(part.column(2).to_pylist()))
                yield part.select(["key", "salt", "docs", "rows"]).filter(pa.array(hit))
            if end < len(batch):
                known = np.frombuffer(zlib.decompress(filters[end].as_py()), np.uint8)
            at = end + 1


def _sliced_suspects(rows: DataFrame, slices: int, bits: int, min_chars: int) -> DataFrame:
    """Holders of suspects where the filter is too large to send: both passes meet by slice."""
    filters = written(
        rows.select("text")
        .mapInArrow(_dealt_hashes(slices, min_chars), "slice int, hashes binary")
        .repartition(slices, "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_slice_filters(bits), "slice int, twice binary"),
        "line-filters",
    )
    salted = filters.select("slice", "twice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = rows.mapInArrow(_dealt_holders(slices, min_chars), SLICED)
    return (
        asked.unionByName(salted, allowMissingColumns=True)
        .repartition(slices, "slice", "salt")
        .sortWithinPartitions("slice", "salt", F.col("twice").isNull())
        .mapInArrow(_sift, HOLDERS)
    )


def row_mark(doc_id: str, text: str) -> Column:
    """What tells rows apart besides the id, so that a row's keys are never more than its text has."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def lines_to_drop(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int = FILTER_BITS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, row, drop): for every row that loses lines, the 128-bit digests of their keys."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), row_mark(doc_id, text).alias("row"), F.col(text).alias("text")
    )
    # No text has more keys than lines, nor than its bytes hold.
    size, newlines = F.octet_length("text"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = rows.agg(F.sum(F.least(newlines + 1, F.floor(size / max(min_chars, 1))))).first()[0] or 0
    need = max(LEAST_BITS, 1 << (BITS_A_LINE * lines - 1).bit_length() if lines else 0)
    if need <= 2 * bits:
        known = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text, min(need, bits), min_chars))
        found = rows.mapInArrow(_suspects(known, min_chars), HOLDERS)
    else:
        found = _sliced_suspects(rows, -(-need // bits), bits, min_chars)
    found = written(found, "line-suspects")
    # A key that very many documents hold is counted, and meets its keeper, in SALTS parts.
    parts = found.groupBy("key", "salt").agg(F.sum(F.size("docs")).alias("n"), F.max(F.array_max("docs")).alias("keeper"))
    repeated = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).filter(F.col("n") >= min_docs)
    keepers = parts.select("key", "salt").join(repeated, "key").select("key", "salt", "keeper")
    holders = found.join(keepers, ["key", "salt"]).select(
        "key", "keeper", F.explode(F.arrays_zip("docs", "rows")).alias("of")
    )
    losers = holders.filter(F.col("of.docs") != F.col("keeper"))
    return losers.groupBy(F.col("of.docs").alias("doc"), F.col("of.rows").alias("row")).agg(F.collect_set("key").alias("drop"))


def _rewrite(text_at: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, n_lines, n_dropped = [], [], []
            column = batch.column(text_at)
            drops = batch.column(batch.num_columns - 1).to_pylist()
            for i, (text, drop) in enumerate(zip(texts(column), drops, strict=True)):
                if not drop:
                    new.append(column[i].as_py())
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone, lines = set(drop), line_keys(text, min_chars)
                kept = [ln for ln, k in lines if k is None or xxhash.xxh3_128_digest(k) not in gone]
                new.append(b"\n".join(kept).decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[f"c{i}" for i in range(len(columns) + 2)],
            )

    return run


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    bits: int = FILTER_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
    report: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two counts.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of
    ``min_chars`` code points or more in ``min_docs`` documents or more loses all its lines
    except in the document with the largest id; a document that keeps a key keeps
    each of its lines. All other lines stay as they are.

    Null and empty texts are one empty line and stay as they are; a text whose lines all
    go becomes empty. A null id counts as the smallest; rows that repeat an id are
    documents each, and all rows with the largest id keep the line. An empty table gives no
    rows. ``bits`` is the largest filter that is sent to all tasks. All other columns pass; those named as in ``report`` are replaced.
    """
    passing = [c for c in docs.columns if c not in report]
    drops = lines_to_drop(docs, min_chars, min_docs, bits, doc_id, text)
    doc = F.coalesce(F.col(f"d.`{doc_id}`").cast("long"), F.lit(NO_ID))
    met = same((doc, F.col("x.doc")), (row_mark(f"d.`{doc_id}`", f"d.`{text}`"), F.col("x.row")))
    joined = docs.alias("d").join(drops.alias("x"), met, "left").select(
        *[F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(passing)], F.col("x.drop").alias("drop")
    )
    kinds = [docs.schema[c].dataType.simpleString() for c in passing]
    out = joined.mapInArrow(
        _rewrite(passing.index(text), min_chars),
        ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), f"c{len(kinds)} bigint", f"c{len(kinds) + 1} bigint"]),
    )
    return out.toDF(*passing, *report)

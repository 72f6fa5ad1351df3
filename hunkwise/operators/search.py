"""Text vectors, term weights and nearest chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.model import TOP_K, columns_besides
from hunkwise.operators.diff import is_added
from hunkwise.functions.text import strip
from hunkwise.session import stored

DIMENSIONS = 256
WORD = r"[\p{L}\p{N}_]+"
QUERY_LINES = 10
QUERY_MIN_CHARS = 10

# Sizes of one unit of comparison: at most this many queries meet this many chunks
# at a time, so the scores of a unit are 64 MB.
QUERY_TILE = 1_024
CHUNK_TILE = 8_192
SCORE_DIGITS = 6
#: Vectors of queries up to this size are sent to every task.
SENT_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def term_weights(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, term, tf, df, weight): weight = tf * (ln((1 + N) / (1 + df)) + 1)."""
    terms = docs.select(doc_id, F.explode(words(F.col(text))).alias("term"))
    tf = terms.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("docs")).scalar()
    known = df.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return tf.join(known, "term").select(
        doc_id, "term", "tf", "df", F.round(F.col("tf") * F.col("idf"), SCORE_DIGITS).alias("weight")
    )


def top_terms(weights: DataFrame, doc_id: str, k: int = 5) -> DataFrame:
    best = Window.partitionBy(doc_id).orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bucket_of(term: Column, dimensions: int = DIMENSIONS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int")


def bucket_list(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """``bucket_of`` every word of a text; a word that repeats in a batch is dealt once."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def deal(found: pa.Array) -> pa.Array:
        from hashlib import md5

        import numpy as np

        ends = np.r_[0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
        flat = found.flatten().dictionary_encode()
        known = [int.from_bytes(md5(w.encode()).digest()[:4], "big") % dimensions for w in flat.dictionary.to_pylist()]
        return pa.ListArray.from_arrays(ends, np.array(known, np.int32)[flat.indices.to_numpy()])

    return deal(words(text))


def bucket_idf(texts: DataFrame, text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Inverse document frequency per bucket: always ``dimensions`` numbers. One pass over the texts, or over their bucket lists."""
    listed = isinstance(texts.schema[text].dataType, T.ArrayType)
    buckets = F.col(text) if listed else bucket_list(F.col(text), dimensions)

    def count(batches: Iterator) -> Iterator:
        import numpy as np

        seen, texts = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            buckets, texts = batch.column(0), texts + batch.num_rows
            row = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy(zero_copy_only=False))
            once = np.unique(row * dimensions + buckets.flatten().to_numpy())
            seen += np.bincount(once % dimensions, minlength=dimensions)
        at = np.r_[-1, np.flatnonzero(seen)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[texts, seen[seen > 0]])], names=["bucket", "df"])

    counted = texts.select(buckets.alias("buckets")).mapInArrow(count, "bucket int, df long")
    sums = counted.groupBy("bucket").agg(F.sum("df").alias("df"))  # bucket -1 counts the texts
    n = F.max(F.when(F.col("bucket") < 0, F.col("df"))).over(Window.partitionBy(F.lit(0)))
    rows = sums.withColumn("n", n).select("bucket", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = [0.0] * dimensions
    for row in rows.where("bucket >= 0").collect():
        idf[row["bucket"]] = row["idf"]
    return idf


def vectorize_text(df: DataFrame, text: str, idf: list[float] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """Add ``vector``: unit-length hashed term weights of a text.

    Words are hashed to a fixed number of buckets, so the weights of all buckets are
    a short list whatever the vocabulary, and no text leaves its task. Without ``idf``, ``vector`` is
    the buckets of the words: much smaller, for searches that take the ``weights`` and apply them where vectors meet.
    """
    if idf is None:
        return df.withColumn("vector", bucket_list(F.col(text), dimensions))
    return _whole_vectors(df.withColumn("vector", bucket_list(F.col(text), len(idf))), idf)


def _weighed(idf: list[float]):
    """A function that makes unit-length rows of bucket lists; it travels with its task."""
    dimensions = len(idf)

    def weighed(buckets):
        import numpy as np

        n, counts = len(buckets), buckets.value_lengths().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(n), counts) * dimensions + buckets.flatten().to_numpy().astype(np.int64)
        v = np.bincount(at, minlength=n * dimensions).reshape(n, dimensions) * np.asarray(idf)
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    return weighed


def _best(k: int):
    """Best ``k`` chunks per query of one tile, as positions; equal scores go to the lower id."""

    def pick(queries, chunk_ids, chunks):
        import numpy as np

        order = np.argsort(chunk_ids, kind="stable")
        scores = np.round(queries @ chunks[order].T, SCORE_DIGITS) + 0.0
        rows = np.arange(len(scores))
        at, value = [], []
        # The first of equal scores has the lowest id, so ties need no list of their own.
        for _ in range(min(k, scores.shape[1])):
            best = scores.argmax(axis=1)
            at.append(order[best])
            value.append(scores[rows, best])
            scores[rows, best] = -np.inf
        return np.tile(rows, len(at)), np.concatenate(at), np.concatenate(value)

    return pick


def _unit_rows():
    """A function that makes unit-length rows of an Arrow list column; it travels with its task."""

    def unit(vectors):
        import numpy as np

        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = m.reshape(len(vectors), -1) if len(vectors) else m.reshape(0, 1)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    return unit


def _rank(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "chunk_id", "score", *columns_besides(found, "query_id", "chunk_id", "score"))
    )


def top_k_similar(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    by: list[str] | None = None,
    of_query: tuple[str, ...] = (),
    of_chunk: tuple[str, ...] = (),
    sent_bytes: int = SENT_BYTES,
    weights: list[float] | None = None,
) -> DataFrame:
    """The ``k`` nearest chunks of each query by cosine: (query_id, rank, chunk_id, score).

    ``queries`` has query_id and vector, ``chunks`` chunk_id and vector; ``by`` names
    columns that both must share. ``of_query`` and ``of_chunk`` name further columns
    that come along, which spares joining them again. Exact both ways: queries whose
    measured vectors fit ``sent_bytes`` are sent to the chunks, which stay where they are, and each
    task gives its own best ``k`` per query; more queries than that, or groups, are matrix products over
    tiles. Then both sides are cut into tiles of bounded size within each group of ``by``,
    however large the group, and every pair of tiles is one unit of work. With ``weights``, vectors are
    bucket lists as ``vectorize_text`` makes them without weights; those of groups are weighed where they meet.
    """
    found, whole = _nearest(queries, chunks, k, by, of_query, of_chunk, sent_bytes, weights)
    if not whole:
        return found
    rows = found.select("*", F.posexplode("hits").alias("__at", "h"))
    return rows.select(
        "query_id", (F.col("__at") + 1).alias("rank"), "h.chunk_id", "h.score", *of_query, *[f"h.{c}" for c in of_chunk]
    )


def _nearest(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    by: list[str] | None,
    of_query: tuple[str, ...],
    of_chunk: tuple[str, ...],
    sent_bytes: int = SENT_BYTES,
    weights: list[float] | None = None,
) -> tuple[DataFrame, bool]:
    """The rows of ``top_k_similar``; or, with True, a row for each query with its ``hits`` in order, which took no shuffle.

    That is so where each query is asked once and meets all chunks in one unit.
    """
    q_names, c_names = ["query_id", *of_query], ["chunk_id", *of_chunk]
    out = T.StructType(
        [
            *[T.StructField(n, queries.schema[n].dataType) for n in q_names],
            *[T.StructField(n, chunks.schema[n].dataType) for n in c_names],
            T.StructField("score", T.DoubleType()),
        ]
    )
    if weights is not None and not by:
        queries, chunks = _whole_vectors(queries, weights), _whole_vectors(chunks, weights)
    if not by and sent_bytes:
        queries = stored(queries.select(*q_names, F.col("vector").cast("array<double>").alias("vector")), "queries")
        if (queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0) <= sent_bytes:
            return _rank(_sent_search(queries, chunks, k, q_names, c_names, out), k), False
    found, one_unit = _tiled_search(queries, chunks, k, by or [], q_names, c_names, weights if by else None)
    if one_unit and queries.groupBy("query_id").count().where("count > 1").isEmpty():
        return found, True
    rows = found.select(*q_names, F.explode("hits").alias("h")).select(*q_names, *[f"h.{c}" for c in c_names], "h.score")
    return _rank(rows, k), False


def _sent_search(
    queries: DataFrame, chunks: DataFrame, k: int, q_names: list[str], c_names: list[str], out: T.StructType
) -> DataFrame:
    """Every task holds all queries and keeps their best ``k`` of the chunks that it reads."""
    pick, unit_rows, hits = _best(k), _unit_rows(), _hits()
    asked = queries.toArrow().combine_chunks()  # its size was checked

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        if not len(asked):
            return
        matrix = unit_rows(asked.column("vector").chunk(0))
        best = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_TILE):
                held = batch.slice(lo, CHUNK_TILE)
                ids, rows = held.column("chunk_id").to_numpy(zero_copy_only=False), unit_rows(held.column("vector"))
                for at in range(0, len(asked), QUERY_TILE):
                    q_at, c_at, score = pick(matrix[at : at + QUERY_TILE], ids, rows)
                    new = pa.Table.from_batches([hits(asked, q_names, q_at + at, held, c_names, c_at, score)])
                    new = new.append_column("__q", pa.array(q_at))
                    both = pa.concat_tables([best[at], new]) if at in best else new
                    both = both.sort_by([("__q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
                    q = both.column("__q").to_numpy()
                    start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
                    best[at] = both.filter(pa.array(np.arange(len(q)) - start < k)).combine_chunks()
        for table in best.values():
            yield from table.drop_columns("__q").to_batches()

    held = chunks.select(*c_names, F.col("vector").cast("array<double>").alias("vector"))
    return held.mapInArrow(run, out)


def _hits():
    """A function that puts the columns of found pairs together."""

    def hits(asked, q_names, q_at, held, c_names, c_at, score):
        columns = [asked.column(n).take(pa.array(q_at)) for n in q_names]
        columns += [held.column(n).take(pa.array(c_at)) for n in c_names]
        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*flat, pa.array(score)], names=[*q_names, *c_names, "score"])

    return hits


def _whole_vectors(df: DataFrame, weights: list[float]) -> DataFrame:
    weighed = _weighed(weights)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def weigh(buckets: pa.Array) -> pa.Array:
        import numpy as np

        v = weighed(buckets)
        return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())

    return df.withColumn("vector", weigh(F.col("vector")))


_PACKED = "struct<size:int,at:array<int>,value:array<double>>"


def _pack():
    """A column function: vectors for a shuffle, as the places and values that are not zero where most are, else whole."""

    @F.arrow_udf(_PACKED)
    def pack(vectors: pa.Array) -> pa.Array:
        import numpy as np

        n, sizes = len(vectors), vectors.value_lengths().fill_null(0).to_numpy()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(n), sizes)
        some = values != 0
        at = pa.nulls(n, pa.list_(pa.int32()))
        ends = np.r_[0, np.cumsum(sizes)]
        if some.sum() * 12 < len(values) * 8:
            place = (np.arange(len(values)) - ends[row])[some].astype(np.int32)
            ends = np.r_[0, np.cumsum(np.bincount(row[some], minlength=n))]
            at, values = pa.ListArray.from_arrays(ends.astype(np.int32), place), values[some]
        value = pa.ListArray.from_arrays(ends.astype(np.int32), values)
        lacks = vectors.is_null() if vectors.null_count else None
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), at, value], ["size", "at", "value"], mask=lacks)

    return pack


def _unpack():
    """A function that makes a matrix of packed vectors; it travels with its task."""

    def unpack(packed):
        import numpy as np

        size, at, value = packed.flatten()
        width = size[0].as_py()
        m = np.zeros((len(packed), width))
        counts = value.value_lengths().to_numpy(zero_copy_only=False)
        if (size.to_numpy(zero_copy_only=False) != width).any():
            raise ValueError("vectors differ in length")
        row = np.repeat(np.arange(len(packed)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        listed = at.is_valid().to_numpy(zero_copy_only=False)[row]
        place[listed] = at.flatten().to_numpy()
        m[row, place] = value.flatten().to_numpy()
        return m

    return unpack


#: Groups of more than one tile up to this number are sent to every task.
SENT_GROUPS = 100_000


def _tiled_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    by: list[str],
    q_names: list[str],
    c_names: list[str],
    weights: list[float] | None = None,
) -> tuple[DataFrame, bool]:
    """``q_names`` and ``hits``, the best ``k`` chunks of each query and unit in order, and whether every group has one tile of chunks.

    Only groups of more than one tile are looked up, so that the rows of others are shuffled once, by group. Small units that
    lie in one batch are solved together.
    """
    matrix = _unpack() if weights is None else _weighed(weights)
    pack = _pack() if weights is None else None

    def tiles(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    q_tiles, c_tiles = tiles(queries, QUERY_TILE, "__nq"), tiles(chunks, CHUNK_TILE, "__nc")
    plan, groups, one_unit = None, 0, False
    if by:
        plan = stored(q_tiles.where("__nq > 1").join(c_tiles.where("__nc > 1").hint("merge"), by, "full"), "large-groups")
        groups, apart = plan.agg(F.count(F.lit(1)), F.count_if(F.col("__nc") > 1)).first()
        one_unit = not apart

    def spread(df: DataFrame, names: list[str], own: str, other: str, own_tile: str, other_tile: str) -> DataFrame:
        vector = pack(F.col("vector").cast("array<double>")) if pack else F.col("vector").cast("array<smallint>" if len(weights) < 1 << 15 else "array<int>")
        sized = df.select(*by, *names, vector.alias("vector"))
        if by:
            # as in a join, a group without a name has no other side
            sized = sized.where(" and ".join(f"`{c}` is not null" for c in by))
            if not groups:
                return sized.select(*by, F.lit(0).alias(own_tile), F.lit(0).alias(other_tile), *names, "vector")
            sized = sized.join(F.broadcast(plan) if groups <= SENT_GROUPS else plan.hint("merge"), by, "left")
            sized = sized.fillna(1, ["__nq", "__nc"])
        else:
            sized = sized.withColumns({"__nq": q_tiles.scalar(), "__nc": c_tiles.scalar()})
        return sized.select(
            *by,
            F.pmod(F.xxhash64(names[0]), F.col(own)).cast("int").alias(own_tile),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_tile),
            *names,
            "vector",
        )

    unit = [*by, "__qt", "__ct"]
    asked = spread(queries, q_names, "__nq", "__nc", "__qt", "__ct")
    held = spread(chunks, c_names, "__nc", "__nq", "__ct", "__qt")
    hit = T.StructType([*[T.StructField(n, chunks.schema[n].dataType) for n in c_names], T.StructField("score", T.DoubleType())])
    out = T.StructType([*[T.StructField(n, queries.schema[n].dataType) for n in q_names], T.StructField("hits", T.ArrayType(hit))])

    def starts(block):
        """Where units begin."""
        import numpy as np

        step = np.ones(block.num_rows, dtype=bool)
        step[1:] = False
        for c in unit:
            step[1:] |= np.diff(block.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)) != 0
        return np.flatnonzero(step).tolist()

    def solve(block, at):
        """Units of a block; in each, chunks come before queries and in the order of their ids."""
        import numpy as np

        side = block.column("query_id").is_valid().to_numpy(zero_copy_only=False)
        m = matrix(block.column("vector"))
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        q_at, c_at, value, counts = [], [], [], []
        for lo, hi in zip(at, [*at[1:], len(side)]):
            cut = lo + int(np.searchsorted(side[lo:hi], True))
            if cut == lo or cut == hi:
                continue
            scores = np.round(m[cut:hi] @ m[lo:cut].T, SCORE_DIGITS) + 0.0
            rows, found = np.arange(hi - cut), min(k, cut - lo)
            places, best = np.empty((len(rows), found), np.int64), np.empty((len(rows), found))
            # The first of equal scores has the lowest id, so ties need no list of their own.
            for i in range(found):
                places[:, i] = scores.argmax(axis=1)
                best[:, i] = scores[rows, places[:, i]]
                scores[rows, places[:, i]] = -np.inf
            q_at.append(rows + cut)
            c_at.append((places + lo).ravel())
            value.append(best.ravel())
            counts.append(np.full(len(rows), found, np.int32))
        if not q_at:
            return
        mine, theirs = pa.array(np.concatenate(q_at)), pa.array(np.concatenate(c_at))
        fields = [block.column(n).take(theirs) for n in c_names] + [pa.array(np.concatenate(value))]
        ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
        hits = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, [*c_names, "score"]))
        yield pa.RecordBatch.from_arrays([*[block.column(n).take(mine) for n in q_names], hits], names=[*q_names, "hits"])

    def run(batches: Iterator) -> Iterator:
        open_ = None  # the rows of a unit that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch if open_ is None else pa.Table.from_batches([open_, batch]).combine_chunks().to_batches()[0]
            at = starts(block)
            if at[-1]:
                yield from solve(block.slice(0, at[-1]), at[:-1])
            open_ = block.slice(at[-1])
        if open_ is not None:
            yield from solve(open_, [0])

    found = (
        held.unionByName(asked, allowMissingColumns=True)
        .repartition(*unit)
        .sortWithinPartitions(*unit, F.asc_nulls_first("query_id"), F.asc_nulls_last("chunk_id"))
        .mapInArrow(run, out)
    )
    return found, one_unit


def query_texts(files: DataFrame) -> DataFrame:
    """Search text of each file: its first added lines, stripped and joined by spaces.

    Blank lines count and stay; a text shorter than ten characters asks nothing.
    """
    added = F.filter(F.flatten(F.transform("hunks", lambda h: h["lines"])), is_added)
    bare = F.transform(
        F.slice(added, 1, QUERY_LINES),
        lambda l: strip(F.substring(l, F.lit(2), F.length(l))),
    )
    keep = columns_besides(files, "hunks")
    # Spread from a list of one, as the test of a plain column would be moved before it and make all texts twice.
    texts = files.select(*keep, F.explode_outer(F.array(F.array_join(bare, " "))).alias("query"))
    return texts.where(F.length("query") >= QUERY_MIN_CHARS)


def retrieve_context(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    by: list[str] | None = None,
    weights: list[float] | None = None,
) -> DataFrame:
    """Context text per query: its ``k`` nearest chunks less those of the same file.

    ``queries`` has query_id, file and vector; ``chunks`` has chunk_id, file, content
    and vector, and ``weights`` is as in ``top_k_similar``. Own chunks leave after the best ``k`` are taken, so fewer may remain.
    """
    found, whole = _nearest(
        queries.withColumnRenamed("file", "query_file"),
        chunks.withColumnRenamed("file", "chunk_file"),
        k,
        by,
        of_query=("query_file",),
        of_chunk=("chunk_file", "content"),
        weights=weights,
    )

    def part(file: Column, score: Column, content: Column) -> Column:
        shown = F.round(score.cast("decimal(9,6)"), 2).cast("string")
        return F.format_string("--- %s (similarity: %s) ---\n%s\n", file, shown, content)

    if whole:
        others = F.filter("hits", lambda h: h["chunk_file"] != F.col("query_file"))
        kept = found.select("query_id", others.alias("__o")).where(F.size("__o") > 0)
        parts = F.transform("__o", lambda h: part(h["chunk_file"], h["score"], h["content"]))
        return kept.select("query_id", F.array_join(parts, "\n").alias("context"))
    text = part(F.col("chunk_file"), F.col("score"), F.col("content"))
    return (
        found.where(F.col("chunk_file") != F.col("query_file"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("part")))).alias("parts"))
        .select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("context"))
    )


@dataclass(frozen=True)
class Cells:
    """Centres of a partition of the space, unit length, and how many of them a query looks into."""

    centres: list[list[float]]
    probes: int


def fit_cells(
    vectors: DataFrame, key: str = "chunk_id", sample: int = 20_000, cells: int | None = None, recall: float = 0.95, k: int = 10
) -> Cells:
    """Cells for ``approximate_top_k``, fitted on at most ``sample`` vectors, those of the smallest hashes of ``key``.

    Centres come from spherical k-means; ``cells`` defaults to the square root of the sample. The number of
    probes is the smallest that finds ``recall`` of the ``k`` nearest of the sample's own vectors
    (500 of them, among the sample). Vectors without structure need most cells; clustered ones few. Only
    the fit is bounded: every row is put into a cell afterwards.
    """
    import numpy as np

    chosen = vectors.select(F.col("vector").cast("array<double>")).where("vector is not null").orderBy(F.xxhash64(key), key)
    rows = [r[0] for r in chosen.limit(sample).collect()]
    if not rows:
        return Cells([], 0)
    m = _unit_matrix(np.array(rows, dtype=float))
    count = min(len(m), cells or max(1, round(len(m) ** 0.5)))
    rng = np.random.default_rng(17)
    centres = m[rng.choice(len(m), count, replace=False)]
    for _ in range(12):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        centres = np.where(np.bincount(own, minlength=count)[:, None] > 0, _unit_matrix(sums), centres)
    own = (m @ centres.T).argmax(axis=1)
    asked = m[: min(500, len(m))]
    near = np.argsort(-(asked @ m.T), axis=1, kind="stable")[:, : min(k, len(m))]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of every cell, for every query
    needed = np.take_along_axis(place, own[near], axis=1)
    found = [(needed < p).mean() for p in range(1, count + 1)]
    return Cells(centres.tolist(), next(p for p, share in enumerate(found, 1) if share >= recall or p == count))


def _unit_matrix(m):
    import numpy as np

    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _with_cells(df: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """``df`` with ``cell``, a row for each of the ``probes`` nearest centres of its vector."""
    centres, unit_rows = cells.centres, _unit_rows()

    def near(batches: Iterator) -> Iterator:
        import numpy as np

        c = np.array(centres, dtype=float).reshape(len(centres), -1)
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            m = unit_rows(vectors)
            order = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :probes] if batch.num_rows else np.zeros((0, probes), int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=[*batch.schema.names, "__cells"]
            )

    typed = df.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = T.StructType([*typed.schema.fields, T.StructField("__cells", T.ArrayType(T.IntegerType()))])
    return typed.mapInArrow(near, schema).withColumn("cell", F.explode("__cells")).drop("__cells")


def approximate_top_k(
    queries: DataFrame, chunks: DataFrame, cells: Cells, k: int = TOP_K, by: list[str] | None = None
) -> DataFrame:
    """``top_k_similar`` over the cells nearest to each query: the same columns and scores, some neighbours may lack.

    For one large group. Every chunk lies in one cell, so no pair is compared twice, and what is found is ranked
    by its exact score. With as many probes as cells the result is the exact one.
    """
    if not cells.centres:
        return top_k_similar(queries, chunks, k, by)
    asked, held = _with_cells(queries, cells, cells.probes), _with_cells(chunks, cells, 1)
    return top_k_similar(asked, held, k, [*(by or []), "cell"])

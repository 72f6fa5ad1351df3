"""Near-duplicate removal by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the minimum and the
maximum, so 320 values cost 160 hash evaluations. Five values make a band, never both of one
permutation; documents that share a band are candidates, and links are confirmed on the
full shingle sets. A pair at the limit of 0.75 misses all 64 bands about once in 3e7.

Exact copies are one node. A bucket is not expanded into its pairs: every node is first
compared with one node of a bucket it is in (rounds of stars), linked nodes are contracted,
and only what then still lies outside the largest component of a bucket is compared with all of
it, block by block. Tasks give out links between components, never pairs, so rows stay in
proportion to the buckets as long as few of their nodes stay outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import fold_words, texts, written

WORDS = 5
PERCENT = 75
PERMUTATIONS = 160
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
CHUNK = 1 << 20  # shingles hashed at a time


@dataclass(frozen=True)
class Search:
    """``rounds`` of stars, among the ``stars`` centres of a node that it shares most bands with; ``estimate``: part of equal signature values a pair must show
    to be confirmed, five deviations below the limit; ``block`` nodes of a bucket meet in a
    task at a time; ``fan`` members share one copy of a star's centre."""

    rounds: int = 3
    stars: int = 4
    estimate: float = 0.62
    block: int = 1000
    fan: int = 500


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 320): minima of all permutations, then maxima. No set may be empty."""
    a, b = _permutations()
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    x = np.concatenate(sets).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for j in range(PERMUTATIONS):
        v = x * a[j] + b[j]
        out[:, j] = np.minimum.reduceat(v, starts)
        out[:, PERMUTATIONS + j] = np.maximum.reduceat(v, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(documents, 64) keys; the number of the band is part of its key."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # a copy in the same task needs no second signature

    def give(ids, kinds, sets) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s) and not (kinds[i] in seen or seen.add(kinds[i]))]
        keys: list = [None] * len(sets)
        marks: list = [None] * len(sets)
        if full:
            sig = signatures([sets[i] for i in full])
            for i, k, m in zip(full, bands(sig), sig.astype(np.uint8), strict=True):
                keys[i], marks[i] = k, m.tobytes()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "kind": pa.array(kinds, pa.binary()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "bands": pa.array(keys, pa.list_(pa.int64())),
                "marks": pa.array(marks, pa.binary()),
            }
        )

    for batch in batches:
        ids, kinds, sets, total = [], [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            words = fold_words(text)
            ids.append(doc)
            kinds.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(shingles(words))
            total += len(sets[-1])
            if total > CHUNK:
                yield give(ids, kinds, sets)
                ids, kinds, sets, total = [], [], [], 0
        if ids:
            yield give(ids, kinds, sets)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shingles(fold_words(t)).tobytes() for t in texts(batch.column(1))]
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column(0).slice(at, 500), "shingles": pa.array(rows[at : at + 500], pa.binary())}
            )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, its centre first: (a, salt, leaf, node, shingles) -> confirmed (a, b)."""
    star, centres = None, []
    for batch in batches:
        found = []
        for a, salt, leaf, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, salt) != star:
                star, centres = (a, salt), []
            own = np.frombuffer(body, np.uint64)
            if not leaf:
                centres.append(own)
            elif any(similar(c, own) for c in centres):
                found.append((a, node))
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}
        )


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by (key, first, second), their first three columns: one list for each."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(
    key: int, sides: list[int], comps: list[int], sizes: list[int], keys: np.ndarray, marks: np.ndarray, least: float
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) that may be similar, of different components, the most alike first.

    A pair belongs to the first band that it shares; in other buckets it is passed over.
    """
    side, comp, size = np.array(sides), np.array(comps), np.array(sizes)
    mine = (keys == key).any(axis=1)  # an id with several texts may be here with another one
    if not mine.any():
        return
    band = int(np.flatnonzero(keys[mine.argmax()] == key)[0])
    across = (side == 1).any()
    for i in np.flatnonzero(mine & (side == 0)):
        other = mine & ((side == 1) if across else (np.arange(len(side)) > i)) & (comp != comp[i])
        other &= 100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])
        js = np.flatnonzero(other)
        like = (marks[js] == marks[i]).mean(axis=1)
        js, like = js[like >= least], like[like >= least]
        first = ~(keys[js, :band] == keys[i, :band]).any(axis=1)
        if first.any():
            yield int(i), js[first][np.argsort(-like[first], kind="stable")]


def _needed(least: float):
    """Rows (key, first, second, side, node, comp, n, bands, marks) -> those that some candidate pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_blocks(batches):
            if len({r[5] for r in rows}) == 1:
                continue
            columns = list(zip(*rows, strict=True))
            keys = np.array(columns[7], np.int64)
            marks = np.frombuffer(b"".join(columns[8]), np.uint8).reshape(len(rows), -1)
            need = set()
            for i, js in _candidates(rows[0][0], columns[3], columns[5], columns[6], keys, marks, least):
                need |= {i, *js.tolist()}
            if need:
                kept = [rows[i][:6] for i in sorted(need)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*kept, strict=True), NEED.types, strict=True)], schema=NEED
                )

    return run


NEED = pa.schema(
    [
        ("key", pa.int64()),
        ("first", pa.int32()),
        ("second", pa.int32()),
        ("side", pa.int32()),
        ("node", pa.int64()),
        ("comp", pa.int64()),
    ]
)


def _links_in_blocks(least: float):
    """Rows (key, first, second, side, node, comp, shingles) -> confirmed links between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_blocks(batches):
            _, _, _, sides, nodes, comps, bodies = zip(*rows, strict=True)
            sets = [np.frombuffer(b, np.uint64) for b in bodies]
            sig = signatures(sets)
            group = {c: c for c in comps}

            def root(c: int, group: dict = group) -> int:
                while group[c] != c:
                    group[c] = c = group[group[c]]
                return c

            found = []
            near = _candidates(rows[0][0], sides, comps, [len(x) for x in sets], bands(sig), sig.astype(np.uint8), least)
            for i, js in near:
                for j in js.tolist():
                    a, b = root(comps[i]), root(comps[j])
                    if a != b and similar(sets[i], sets[j]):
                        group[max(a, b)] = min(a, b)
                        found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
            if found:
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b).

    Each node takes the neighbour of the smallest hash, pointers are followed once, and the
    graph is contracted, until no edge is left; the hash changes every round, so that a
    long chain shrinks by a constant part.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    roots = written(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots"
    )
    turn = 0
    while not edges.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("id"))
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        up = ends.groupBy("u").agg(F.least(rank("u"), F.min(rank("v"))).alias("p")).select("u", F.col("p.id").alias("p"))
        twice = written(
            up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.u")).select("x.u", F.col("y.p").alias("p")), "parents"
        )
        roots = written(
            roots.join(twice, roots.root == twice.u, "left").select("node", F.coalesce("p", "root").alias("root")), "roots"
        )
        edges = written(
            edges.join(twice.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(twice.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa != pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        turn += 1
    return roots


def _confirmed(pairs: DataFrame, sets: DataFrame, fan: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A centre's set is sent once for ``fan`` leaves."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / fan).alias("salts"))
    salted = pairs.join(fans, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    )
    leaves = salted.join(sets, salted.b == sets.node).select("a", "salt", F.lit(1).alias("leaf"), "node", "shingles")
    centres = (
        fans.select("a", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
        .join(sets, F.col("a") == sets.node)
        .select("a", "salt", F.lit(0).alias("leaf"), "node", "shingles")
    )
    rows = centres.unionByName(leaves).repartition("a", "salt").sortWithinPartitions("a", "salt", "leaf")
    return rows.mapInArrow(_confirm, "a bigint, b bigint")


def _contract(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the links; the new component is the smallest old one."""
    ends = (
        links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        .join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        .filter("ca != cb")
        .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    )
    roots = components(ends)
    least = roots.groupBy("root").agg(F.min("node").alias("low"))
    new = roots.join(least, "root").select(F.col("node").alias("comp"), "low")
    return written(
        comps.join(new, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "components"
    )


def _open_buckets(buckets: DataFrame, comps: DataFrame, turn: int = 0) -> DataFrame:
    """(key, big, inner, outer, centre) of the buckets that hold several components.

    ``big`` is the component of most nodes, ``inner`` and ``outer`` count nodes of it and of all others,
    and ``centre`` is one node of it, another one for every ``turn``.
    """
    held = buckets.join(comps, "node")
    parts = held.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre")
    )
    most = F.max(F.struct("n", F.col("comp").alias("big"), "centre")).alias("m")
    return (
        parts.groupBy("key")
        .agg(most, F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"))
        .filter("comps > 1")
        .select("key", "m.big", F.col("m.n").alias("inner"), (F.col("all") - F.col("m.n")).alias("outer"), "m.centre")
    )


def _fresh_stars(buckets: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """(a, b): every node outside the largest component of a bucket, with that one's centre; one centre a node."""
    open_ = _open_buckets(buckets, comps, turn)
    outside = buckets.select("key", "node").join(comps, "node").join(open_, "key").filter("comp != big")
    near = outside.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("bands"))
    best = near.groupBy("node").agg(F.max_by("centre", F.struct("bands", F.xxhash64("centre"))).alias("a"))
    return best.select("a", F.col("node").alias("b"))


def _block_rows(buckets: DataFrame, comps: DataFrame, search: Search) -> DataFrame:
    """(key, first, second, side, node, comp): which nodes of an open bucket meet in which task.

    Nodes of the largest component are not compared with each other. Of them and the others, the larger
    side is dealt into blocks, and the smaller one visits every block (second is -1); the
    others also meet each other, by pairs of blocks. So a bucket of m nodes with o outside its largest
    component gives about m + o * m / block rows.
    """
    held = buckets.select("key", "node").join(comps, "node").join(_open_buckets(buckets, comps), "key")
    own = F.xxhash64("node")
    count = lambda c: F.ceil(F.greatest(c, F.lit(1)) / search.block).cast("int")
    outer = F.col("comp") != F.col("big")
    dealt = outer == (F.col("outer") > F.col("inner"))
    blocks = count(F.greatest("inner", "outer"))
    none = F.lit(-1)
    apart = held.withColumn(
        "spot",
        F.explode(F.when(dealt, F.array(F.pmod(own, blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))),
    ).select("key", F.col("spot").alias("first"), none.alias("second"), outer.cast("int").alias("side"), "node", "comp")
    among = (
        held.filter(outer & (F.col("outer") > 1))
        .withColumn("blocks", count(F.col("outer")))
        .withColumn("own", F.pmod(own, F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "with").alias("first"),
            F.greatest("own", "with").alias("second"),
            F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
            "node",
            "comp",
        )
    )
    return apart.unionByName(among)


def _links_left(buckets: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame, search: Search) -> DataFrame:
    """All links (a, b) between components, found inside buckets that still hold several of them.

    The first pass looks at signatures alone and says whose sets the second one needs.
    """
    spot = ["key", "first", "second"]
    met = written(_block_rows(buckets, comps, search), "dedup-blocks")
    rows = met.join(nodes.select("node", "n", "bands", "marks"), "node").select(*spot, "side", "node", "comp", "n", "bands", "marks")
    needed = (
        rows.repartition(*spot)
        .sortWithinPartitions(*spot)
        .mapInArrow(_needed(search.estimate), "key bigint, first int, second int, side int, node bigint, comp bigint")
    )
    return (
        needed.join(sets, "node")
        .select(*spot, "side", "node", "comp", "shingles")
        .repartition(*spot)
        .sortWithinPartitions(*spot)
        .mapInArrow(_links_in_blocks(search.estimate), "a bigint, b bigint")
    )


def _texts_of_ids(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node) of every text of the ids that have several; an empty text counts, but has no node."""
    kind = F.xxhash64("kind")
    several = (
        facts.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(kind).alias("k0"), F.max(kind).alias("k1"))
        .filter("k0 < k1")
        .select("doc_id")
    )
    own = facts.filter("n > 0").select("doc_id", "kind").join(several, "doc_id")
    return own.join(nodes.select("kind", "node"), "kind").select("doc_id", "node").distinct()


def duplicate_groups(
    docs: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text: str = "text", tie_ids: bool = True
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blanks, A-Z lower-cased. Documents are linked when 100 * common
    shingles >= 75 * all shingles of the two; fewer than five words are one shingle, none
    are no shingle and no link. ``component_id`` is the smallest doc_id that can be
    reached, so ties need no choice. Rows that share a doc_id are one document, linked to
    what any of them is linked to; without ``tie_ids`` each text has the links of its own. A
    row with a null id has no component and is kept. An empty table gives no rows; other
    columns of ``docs`` are not looked at.
    """
    facts = written(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
            _describe, "doc_id bigint, kind binary, n bigint, bands array<bigint>, marks binary"
        ),
        "dedup-facts",
    )
    # Equal texts have equal signatures, so whichever row has one speaks for all.
    nodes = written(
        facts.filter("n > 0")
        .groupBy("kind")
        .agg(
            F.min("doc_id").alias("node"),
            F.max("n").alias("n"),
            F.any_value("bands", F.lit(True)).alias("bands"),
            F.any_value("marks", F.lit(True)).alias("marks"),
        )
        .filter("node is not null"),
        "dedup-nodes",
    )
    exploded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = (
        exploded.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
        .filter("low < high")
    )
    buckets = written(exploded.join(shared, "key"), "dedup-buckets")
    members = buckets.select("node").distinct()
    sets = written(
        docs.select(F.col(doc_id).cast("long").alias("node"), text)
        .join(members, "node", "left_semi")
        .mapInArrow(_shingle_rows, "node bigint, shingles binary")
        .filter(F.octet_length("shingles") > 0),  # an id with several texts may have an empty one
        "dedup-sets",
    )
    comps = written(members.withColumn("comp", F.col("node")), "components")
    # Stars: the lowest and highest node of a bucket are its centres. A node keeps the few that it shares most
    # bands with: a star only saves work, as what it does not link is compared by buckets in the end.
    best = Window.partitionBy("node").orderBy(F.desc("bands"), "centre")
    stars = written(
        buckets.select("node", F.explode(F.array("low", "high")).alias("centre"))
        .filter("node != centre")
        .groupBy("node", "centre")
        .agg(F.count(F.lit(1)).alias("bands"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= search.stars)
        .drop("place"),
        "dedup-stars",
    )
    for turn in range(search.rounds):
        open_ = (
            stars.join(comps.withColumnRenamed("comp", "own"), "node")
            .join(comps.select(F.col("node").alias("centre"), F.col("comp").alias("other")), "centre")
            .filter("own != other")
        )
        # Pairs tried in earlier rounds and still open are the first places.
        tried = open_.withColumn("place", F.row_number().over(best)).filter(F.col("place") == turn + 1)
        links = written(
            _confirmed(tried.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets, search.fan), "dedup-links"
        )
        if links.isEmpty():
            break
        comps = _contract(comps, links)

    # More stars with new centres, for as long as they link: each round moves one row for each open node.
    for turn in range(search.rounds):
        pairs = _fresh_stars(buckets, comps, turn)
        links = written(_confirmed(written(pairs, "dedup-stars"), sets, search.fan), "dedup-links")
        if links.isEmpty():
            break
        comps = _contract(comps, links)

    # What is left in different components of one bucket.
    links = written(_links_left(buckets, comps, nodes, sets, search), "dedup-links")
    of_ids = facts.select("doc_id", F.col("doc_id").alias("low")).limit(0)
    if tie_ids:
        own = written(_texts_of_ids(facts, nodes), "dedup-ids")
        of_ids = own.groupBy("doc_id").agg(F.min("node").alias("low"))
        tied = own.join(of_ids, "doc_id").filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
        alone = own.select("node").distinct().join(comps, "node", "left_anti")
        comps = comps.unionByName(alone.withColumn("comp", F.col("node")))
        links = links.unionByName(tied)
    comps = _contract(comps, links)

    by_kind = nodes.join(comps, "node", "left").select("kind", F.coalesce("comp", "node").alias("comp"))
    rows = facts.select("doc_id", "kind", F.col("n").alias("n_shingles"))
    by_id = of_ids.join(comps, of_ids.low == comps.node).select("doc_id", F.col("comp").alias("id_comp"))
    reached = (
        rows.join(by_kind, "kind", "left")
        .join(by_id, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(
                F.col("doc_id").isNotNull(),
                F.coalesce(F.when(F.col("n_shingles") > 0, F.col("comp")), "id_comp", "doc_id"),
            ).alias("component_id"),
        )
    )
    return reached.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they are.

    Each different text of the kept id stays once, so that none goes for its id alone. Rows
    with a null id stay.
    """
    groups = duplicate_groups(docs, search, doc_id, text, tie_ids=False)
    kept = groups.filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    mine = F.col(f"d.`{doc_id}`")
    rows = docs.alias("d").join(kept.alias("k"), mine.cast("long") == F.col("k.__kept"), "left").filter(
        mine.isNull() | F.col("k.__kept").isNotNull()
    )
    # The hash also keeps rows without an id from meeting in one task.
    spread = F.xxhash64(F.col(f"d.`{text}`"))
    place = F.row_number().over(Window.partitionBy(mine, spread).orderBy(F.col(f"d.`{text}`")))
    return rows.withColumn("__place", place).filter((F.col("__place") == 1) | mine.isNull()).select("d.*")

"""Sharding by balanced label propagation, native.

Documents with equal texts are linked. Every document starts in a hashed shard; in each
round, linked documents move towards the shard where most of their neighbours are, as
far as the quotas allow, so that fewer links are cut. What moves is a cell: the
documents of one text whose ids hash alike. A cell has a row, not its documents, and a
text that a third of all documents hold is many cells, which move on their own.
At the end the shards are levelled to equal counts, moving documents without links first,
then those of texts too common for a shard.

Law: ``rows``. Counts of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import written

CELLS = 64  # cells of a text for each shard it may start in
PARTS = 16  # a text of more documents than this part of a shard moves by cells
SLACK = 0.05  # by how much a shard may be overfull while documents move
LIKE = ["__hash", "__crc", "__size"]  # what equal texts share


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_documents(
    docs: DataFrame, shards: int = 24, rounds: int = 6, block_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs`` with its place.

    A null text counts as an empty one: size 8, linked to other empty texts. Rows with a
    null id start in one shard and are levelled like others; repeated rows each get a
    place. Ties between shards go by a hash of the text. An empty table gives no rows.
    Other columns of ``docs`` are not looked at. Slots of a shard run from 0 without gaps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    facts = written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.xxhash64(body).alias("__hash"),
            F.crc32(body.cast("binary")).alias("__crc"),
            size_of(F.col(text)).alias("__size"),
            F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards * CELLS)).cast("int").alias("__cell"),
        ),
        "shard-facts",
    )
    total = facts.count()
    cells = _propagate(_linked_cells(facts, shards), shards, rounds, total // shards)
    labelled = facts.alias("d").join(cells.alias("c"), [*LIKE, "__cell"], "left").select(
        "d.*",
        F.coalesce("c.__shard", F.pmod(F.col("d.__cell"), F.lit(shards))).alias("__label"),
        # Who must give way in the levelling: 0 last, 2 first.
        F.when(F.col("c.__shard").isNull(), 2).when(F.col("c.__all") > total // shards // PARTS, 1).otherwise(0).alias("__class"),
    )
    return _level(written(labelled, "shard-labels"), shards, total, block_rows)


def _linked_cells(facts: DataFrame, shards: int) -> DataFrame:
    cells = facts.groupBy(*LIKE, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    group = cells.withColumn("__all", F.sum("__n").over(Window.partitionBy(*LIKE)))
    start = F.pmod(F.col("__cell"), F.lit(shards)).cast("int")
    return written(group.filter("__all > 1").withColumn("__shard", start), "shard-cells")


def _by_shard(rows: DataFrame, key: str, shards: int) -> list[int]:
    """Sums for each shard: at most ``shards`` rows reach the driver."""
    found = {r[0]: r[1] for r in rows.groupBy(key).agg(F.sum("__n")).collect() if r[0] is not None}
    return [found.get(s, 0) for s in range(shards)]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _propagate(cells: DataFrame, shards: int, rounds: int, quota: int) -> DataFrame:
    """Move cells for some rounds. ``quota``: linked documents a shard may hold.

    What wants to leave a shard makes room for what wants to come.
    """
    most = quota * (1 + SLACK)
    for turn in range(rounds):
        load = _by_shard(cells, "__shard", shards)
        room = [max(0, int(quota * (1 + 2 * SLACK)) + 1 - x) for x in load]
        tie = F.pmod(F.xxhash64("__hash", "__shard"), F.lit(1 << 30))
        near = cells.groupBy(*LIKE, "__shard").agg(F.sum("__n").alias("__near")).withColumn(
            "__rank", F.struct("__near", tie.alias("__tie"), "__shard")
        )
        best = near.groupBy(*LIKE).agg(
            F.max(F.when(_pick(room, F.col("__shard")) > 0, F.col("__rank"))).alias("__best"),
        )
        wish = (
            cells.join(near.select(*LIKE, "__shard", "__rank"), [*LIKE, "__shard"])
            .join(best, LIKE)
            .select(
                *cells.columns,
                F.when(F.col("__best") > F.col("__rank"), F.col("__best.__shard")).alias("__to"),
            )
        )
        wish = written(wish, "shard-wishes")
        asked = _by_shard(wish, "__to", shards)
        if not any(asked):
            break
        leaving = _by_shard(wish.filter("__to is not null"), "__shard", shards)
        share = [
            int((1 << 30) * min(1.0, max(0.0, (most - x + out) / a))) if a else 0
            for x, out, a in zip(load, leaving, asked, strict=True)
        ]
        # A small group moves as one; a large one by its cells, or it would never fit.
        whole = F.col("__all") <= quota // PARTS
        coin = F.pmod(
            F.when(whole, F.xxhash64("__hash", F.lit(turn))).otherwise(F.xxhash64("__hash", "__cell", F.lit(turn))),
            F.lit(1 << 30),
        )
        moves = F.col("__to").isNotNull() & (coin < _pick(share, F.col("__to")))
        cells = wish.withColumn("__shard", F.when(moves, F.col("__to")).otherwise(F.col("__shard"))).drop("__to")
    return cells


def _level(rows: DataFrame, shards: int, total: int, block_rows: int) -> DataFrame:
    """Equal counts: what stands behind a shard's share goes to shards that lack documents.

    Rows are ranked by blocks, so that no shard is sorted in one task.
    """
    blocks = max(1, -(-total // (block_rows * shards)))
    mark = F.when(F.col("__class") == 0, F.xxhash64("__hash")).otherwise(F.xxhash64("doc_id", "__crc"))
    rows = rows.withColumn("__block", F.pmod(mark, F.lit(blocks)).cast("int"))
    spot = ["__label", "__class", "__block"]
    counts = rows.groupBy(*spot).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__label").orderBy("__class", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*spot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*spot).orderBy("__hash", "__crc", "__size", "doc_id")
    ranked = rows.withColumn("__row", F.row_number().over(inside) - 1).join(offsets, spot).withColumn(
        "__rank", F.col("__before") + F.col("__row")
    )

    held = _by_shard(counts, "__label", shards)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over, first = 0, []
    for h, q in zip(held, share, strict=True):
        first.append(over)
        over += max(0, h - q)
    label = F.col("__label")
    spare = _pick(first, label) + F.col("__rank") - _pick(share, label)  # place among all that must move
    target, slot, gap = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        if lack := max(0, share[s] - held[s]):
            here = (spare >= gap) & (spare < gap + lack)
            target = F.when(here, F.lit(s)).otherwise(target)
            slot = F.when(here, spare - gap + held[s]).otherwise(slot)
            gap += lack
    stays = F.col("__rank") < _pick(share, label)
    return ranked.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.when(stays, label).otherwise(target).cast("int").alias("shard"),
        F.when(stays, F.col("__rank")).otherwise(slot).cast("long").alias("slot"),
    )

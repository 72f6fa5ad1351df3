"""Running values over ordered groups of any size.

A plain window keeps a whole group in one task. Here rows are dealt by ranges of (keys,
order), so a group that holds a third of all rows lies in many partitions, and each
partition adds up its own stretch as it streams by. Only the last group of a partition can
go on in the next one: the totals at its end, two rows for each partition, are run over and added
in a second, narrow pass. The input itself is evaluated once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.session import stored


def _stretches(keys: list[str], names: list[str], since: set[str]):
    """Sums of each batch's rows, carried on within the partition; ``since`` names restart at a reset.

    ``head`` rows belong to the first group of the partition, ``open`` ones also come before its
    first reset: these are the rows that an earlier partition can have a share in.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, head, untouched, place = None, True, True, 0
        carried = dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            change = np.zeros(n, bool)
            for k in keys:
                col = batch.column(k)
                a, b = col.slice(1), col.slice(0, n - 1)
                unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                change[1:] |= unlike | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            change[0] = last is not None and first != last
            last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            reset = np.asarray(batch.column("__reset"))
            out = []
            for name in names:
                value = batch.column(f"__v_{name}").to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                start = np.maximum.accumulate(np.where(change | reset if name in since else change, np.arange(n), -1))
                before = np.where(start >= 0, total[start] - value[start], -carried[name])
                out.append(total - before)
                carried[name] = out[-1][-1]
            in_head = ~np.logical_or.accumulate(change) & head
            is_open = ~np.logical_or.accumulate(change | reset) & untouched
            head, untouched = bool(in_head[-1]), bool(is_open[-1])
            rest = [c for c in batch.schema.names if not c.startswith("__v_") and c != "__reset"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in rest],
                    *[batch.column(f"__v_{x}") for x in names],
                    *[pa.array(x) for x in out],
                    pa.array(in_head),
                    pa.array(is_open),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(place, place + n)),
                ],
                names=[*rest, *[f"__v_{x}" for x in names], *[f"__s_{x}" for x in names], "__head", "__open", "__part", "__place"],
            )
            place += n

    return run


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
    reset: Column | None = None,
    since: tuple[str, ...] = (),
) -> DataFrame:
    """Add running sums per ``keys`` in ``order``; those named in ``since`` start again at every row of ``reset``.

    ``order`` must be unique within a key. Values are long or double columns without
    nulls. The input is evaluated once, into a table below the shared folder.
    """
    names = [*sums, "__resets"]
    marked = df.withColumn("__reset", F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False))
    marked = marked.withColumns({f"__v_{n}": sums[n] for n in sums} | {"__v___resets": F.col("__reset").cast("long")})
    rows = stored(marked, "running-rows")
    kinds = {n: rows.schema[f"__v_{n}"].dataType for n in names}
    schema = T.StructType(
        [
            *df.schema.fields,
            *[T.StructField(f"__v_{n}", kinds[n]) for n in names],
            *[T.StructField(f"__s_{n}", kinds[n]) for n in names],
            T.StructField("__head", T.BooleanType()),
            T.StructField("__open", T.BooleanType()),
            T.StructField("__part", T.IntegerType()),
            T.StructField("__place", T.LongType()),
        ]
    )
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    summed = stored(dealt.mapInArrow(_stretches(keys, names, set(since)), schema), "running-sums")
    # At most two rows for each partition: where its first group ends, and its last one.
    ends = summed.groupBy("__part", "__head").agg(
        F.max_by(F.struct(*keys, *[f"__s_{n}" for n in names]), "__place").alias("e")
    )
    ends = ends.select("__part", "__head", *[f"e.{k}" for k in keys], *[f"e.__s_{n}" for n in names])
    along = Window.partitionBy(*keys).orderBy("__part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reached = ends.withColumn("__epoch", F.sum("__s___resets").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    epoch = Window.partitionBy(*keys, "__epoch").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    tails = reached.withColumns({f"__t_{n}": F.sum(f"__s_{n}").over(epoch) for n in since})
    share = {n: F.lag(f"__t_{n}").over(along) if n in since else F.sum(f"__s_{n}").over(before) for n in names}
    offsets = tails.withColumns({f"__o_{n}": share[n] for n in sums}).where("__head").select(
        F.col("__part").alias("__p"), *[f"__o_{n}" for n in sums]
    )
    joined = summed.join(F.broadcast(offsets), (F.col("__part") == F.col("__p")) & F.col("__head"), "left")

    def total(name: str) -> Column:
        mine = F.col("__open") if name in since else F.col("__head")
        whole = F.col(f"__s_{name}") + F.when(mine, F.coalesce(F.col(f"__o_{name}"), F.lit(0))).otherwise(0)
        return (whole if inclusive else whole - F.col(f"__v_{name}")).cast(kinds[name]).alias(name)

    return joined.select(*df.columns, *[total(n) for n in sums])


#: Keys are counted in so many slots; one over LARGE rows, and well over the mean, holds a key that is not left to one task.
SLOTS, LARGE, ABOVE_MEAN = 65_536, 100_000, 16


def ranks(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 1 in ``order``, which must be unique within a key.

    Keys of ordinary size meet in one shuffle by key and are numbered by a window, so what is joined by
    the same keys need not be dealt again. Rows of slots with a large key go through ``running_sums``, which spreads
    a key over tasks. The input is evaluated once, into a table; the slots over the limit, at most
    SLOTS / ABOVE_MEAN numbers, reach the driver.
    """
    rows = stored(df, "ranked-rows")
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    limit = max(LARGE, rows.count() * ABOVE_MEAN // SLOTS)
    large = [r["slot"] for r in rows.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).collect()]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if not large:
        return rows.withColumn(name, place)
    one = {name: F.lit(1).cast("long")}
    spread = running_sums(rows.where(slot.isin(large)), keys, order, one)
    return rows.where(~slot.isin(large)).withColumn(name, place).unionByName(spread)


def same_names(left: str, right: str, names: list[str]) -> Column:
    cond = None
    for name in names:
        one = F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
        cond = one if cond is None else cond & one
    return cond


def islands(df: DataFrame, keys: list[str], position: str, gap: int, name: str = "island") -> DataFrame:
    """Number the stretches of each key that a step of ``gap`` or more separates.

    The input is evaluated once, into a table. Blocks are ``gap`` wide, so two neighbours in one block are never apart: only
    the block totals (lowest and highest position) decide, and rows just look up
    their block's number.
    """
    rows = stored(df, "islands").withColumn("__block", F.expr(f"(`{position}` - pmod(`{position}`, {gap})) div {gap}"))
    spot = [*keys, "__block"]
    edges = rows.groupBy(*spot).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    along = Window.partitionBy(*keys).orderBy("__block")
    cut = edges.withColumn(
        "__cut", F.coalesce(F.col("__lo") - F.lag("__hi").over(along) >= gap, F.lit(True)).cast("int")
    )
    numbered = cut.select(
        *spot, F.sum("__cut").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(name)
    )
    return rows.alias("__rows").join(numbered.alias("__cuts"), same_names("__rows", "__cuts", spot)).select(
        *[f"__rows.{c}" for c in df.columns], f"__cuts.{name}"
    )

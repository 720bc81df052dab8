"""Ordered work per key that never puts a whole key into one task.

A plain window over ``partitionBy(key)`` sorts all rows of a key in one task; with a key
that holds a third of the table that task never ends. Every helper here takes a ``chunk``
column that grows along the order (a time slot, an offset range), works inside
``(key, chunk)`` and then carries a one-row summary per chunk over to the next chunk. Only
the summaries (one row per key and chunk) meet in one task; with ``fan`` not even those: runs
of ``fan`` chunks are summed up first, and one row per run meets. The detail rows are shuffled
once, on ``(key, chunk)``: the join with the carry table reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.timeutil import column
from opsloom.session import cut_lineage

CHUNK = "_chunk"
#: Keys and chunk in one struct. A struct is never null, and nulls inside compare as equal, so rows with a null key or a
#: null time find their own summaries; window and join share its partitioning.
PLACE = "_place"
RUN = "_run"


def placed(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """``df`` with ``CHUNK`` and ``PLACE``."""
    return df.withColumn(CHUNK, chunk).withColumn(PLACE, F.struct(*keys, CHUNK))


def slots(c: str | Column, width: int) -> Column:
    """Chunk number of an integer order column such as an offset or an id."""
    return F.floor(column(c) / F.lit(width))


def _carried(ends: DataFrame, keys: Sequence[str], names: dict[str, str], add: bool, fan: int | None) -> DataFrame:
    """``PLACE`` and what the key's earlier chunks leave: their sum, or their last value that isn't null.

    ``ends`` has one row per ``PLACE``; ``names`` maps its columns to those of the result. With ``fan`` (numeric chunks
    only) a task orders at most ``fan`` chunks of a key, or one row per ``fan`` chunks.
    """
    def fold(c: str, window: Window) -> Column:
        return (F.sum(c) if add else F.last(c, ignorenulls=True)).over(window)

    if fan is None:
        earlier = Window.partitionBy(*[f"{PLACE}.{k}" for k in keys]).orderBy(f"{PLACE}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select(PLACE, *[fold(c, earlier).alias(out) for c, out in names.items()])
    run = F.struct(*[F.col(f"{PLACE}.{k}").alias(k) for k in keys], F.floor(F.col(f"{PLACE}.{CHUNK}") / fan).alias(CHUNK))
    ends = ends.withColumn(RUN, run)
    at = F.struct(f"{PLACE}.{CHUNK}")
    runs = ends.groupBy(RUN).agg(*[(F.sum(c) if add else F.max_by(c, F.when(F.col(c).isNotNull(), at))).alias(c) for c in names])
    among = Window.partitionBy(*[f"{RUN}.{k}" for k in keys]).orderBy(f"{RUN}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(RUN).orderBy(f"{PLACE}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
    outer = runs.select(RUN, *[fold(c, among).alias(f"_outer_{c}") for c in names])
    near = ends.select(RUN, PLACE, *[fold(c, inside).alias(f"_near_{c}") for c in names])
    merge = (lambda a, b: F.coalesce(a + b, a, b)) if add else F.coalesce
    return near.join(outer, RUN).select(PLACE, *[merge(F.col(f"_near_{c}"), F.col(f"_outer_{c}")).alias(out) for c, out in names.items()])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column], fan: int | None = None
) -> DataFrame:
    """Running totals per key (the current row counts), named by ``values``' keys.

    Null keys are one key; rows without a chunk come first.
    """
    keys, order = list(keys), list(order)
    detail = placed(df, keys, chunk)
    inside = Window.partitionBy(PLACE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = detail.groupBy(PLACE).agg(*[F.sum(v).alias(f"_total_{n}") for n, v in values.items()])
    carry = _carried(totals, keys, {f"_total_{n}": f"_carry_{n}" for n in values}, True, fan)
    local = detail.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
    joined = local.join(carry, PLACE)
    merged = {n: F.when(F.col(f"_carry_{n}").isNull(), F.col(n))
              .otherwise(F.col(f"_carry_{n}") + F.coalesce(F.col(n), F.lit(0))) for n in values}
    return joined.withColumns(merged).drop(CHUNK, PLACE, *[f"_carry_{n}" for n in values])


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column], fan: int | None = None
) -> DataFrame:
    """Values of the row before this one within the key; null on the first row."""
    return _carry_last(df, keys, order, chunk, F.struct(*[v.alias(n) for n, v in values.items()]), values, True, fan)


def last_seen(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, when: Column, values: dict[str, Column],
    fan: int | None = None
) -> DataFrame:
    """Values of the latest row up to and including this one where ``when`` holds (as-of)."""
    seen = F.when(when, F.struct(*[v.alias(n) for n, v in values.items()]))
    return _carry_last(df, keys, order, chunk, seen, values, False, fan)


def _carry_last(df, keys, order, chunk, packed, values, lag, fan):
    keys, order = list(keys), list(order)
    detail = placed(df, keys, chunk).withColumn("_packed", packed)
    by_order = Window.partitionBy(PLACE).orderBy(*order)
    frame = by_order.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.lag("_packed").over(by_order) if lag else F.last("_packed", ignorenulls=True).over(frame)
    # max_by skips null orders: a chunk without a seen row gets a null end but keeps its row,
    # through which an earlier chunk's end is carried on.
    ends = detail.groupBy(PLACE).agg(
        F.max_by("_packed", F.when(F.col("_packed").isNotNull(), F.struct(*order))).alias("_end"))
    carry = _carried(ends, keys, {"_end": "_before"}, False, fan)
    found = detail.withColumn("_found", inside).join(carry, PLACE)
    best = F.coalesce("_found", "_before")
    return (found.withColumns({n: best.getField(n) for n in values})
            .drop(CHUNK, PLACE, "_packed", "_found", "_before"))


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "pos", size: str | None = None
) -> DataFrame:
    """Zero-based place of the row within its key; ``size`` also adds the key's row count."""
    numbered = running_sum(df, keys, order, chunk, {out: F.lit(1)}).withColumn(out, F.col(out) - 1)
    if size is None:
        return numbered
    sizes = df.groupBy(F.struct(*keys).alias(PLACE)).agg(F.count(F.lit(1)).alias(size))
    return numbered.withColumn(PLACE, F.struct(*keys)).join(sizes, PLACE).drop(PLACE)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column, salts: int = 64,
            out: str = "rn") -> DataFrame:
    """First ``n`` rows per key in ``order``, numbered from 1.

    Two levels: ``n`` rows per (key, salt) survive the first pass, so at most
    ``n * salts`` rows of one key meet in the second. ``salt`` must spread rows
    evenly (a hash of the row id); it never changes the result.
    """
    keys = list(keys)
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    local = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    merged = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    survivors = spread.withColumn(out, local).where(F.col(out) <= n).drop("_salt", out)
    return survivors.withColumn(out, merged).where(F.col(out) <= n)


def global_position(df: DataFrame, order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Zero-based place in the total order of the whole table, without a one-task window.

    The range-sorted rows are numbered inside their partition, and the partition sizes
    (one row each) give the offsets. The sorted rows are checkpointed, since both uses
    must see the same partition bounds.
    """
    numbered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_mid", 33)
    inner = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("_part", part)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")))
    return (numbered.join(offsets, "_part").withColumn(out, F.col("_offset") + inner)
            .drop("_part", "_mid", "_offset"))


def trailing_count(
    df: DataFrame, keys: Sequence[str], us: str, span_us: int, chunk_us: int | None = None, out: str = "n"
) -> DataFrame:
    """Rows of the key in ``[us - span, us]``, this row and equal times included.

    Each chunk also receives the tail of the chunk before it, so the range frame
    never needs more than one chunk.
    """
    width = max(chunk_us or 0, span_us)
    chunk = F.floor(F.col(us) / F.lit(width))
    near_end = F.col(us) >= (chunk + 1) * width - span_us
    both = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.withColumn("_shift", F.explode(both)).withColumn(CHUNK, chunk + F.col("_shift"))
    frame = Window.partitionBy(*keys, CHUNK).orderBy(us).rangeBetween(-span_us, 0)
    return spread.withColumn(out, F.count(F.lit(1)).over(frame)).where("_shift = 0").drop("_shift", CHUNK)

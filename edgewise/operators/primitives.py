"""Data-parallel primitives over rows with a position: reduce, scan, sort, partition, discontinuity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut

REDUCTIONS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor, "any": F.bool_or, "all": F.bool_and}
#: Positions in one range of the two-level scan.
RANGE = 1 << 16


def reduce(frame: DataFrame, columns: list[str], op: str = "sum") -> DataFrame:
    """One row; several columns at once are a reduction of tuples."""
    return frame.agg(*[REDUCTIONS[op](F.col(c)).alias(c) for c in columns])


def scan(frame: DataFrame, columns: list[str], op: str = "sum", exclusive: bool = False, identity: float | int = 0) -> DataFrame:
    """Add ``scan_<column>``: running values in order of ``position``.

    Two levels: ranges of positions are reduced, the few results scanned, and each range is scanned from there. Works
    for sum, min and max.
    """
    act = REDUCTIONS[op]
    join = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[op]
    wide = "_" * max(map(len, frame.columns))
    part, total, base, own = (x + wide for x in ("part", "total", "base", "own"))
    rows = frame.withColumn(part, F.floor(F.col("position") / RANGE))
    totals = rows.groupBy(part).agg(*[act(c).alias(total + c) for c in columns])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, *[act(total + c).over(before).alias(base + c) for c in columns])
    within = Window.partitionBy(part).orderBy("position").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    rows = rows.withColumns({own + c: act(c).over(within) for c in columns}).join(bases, part)
    out = {}
    for c in columns:
        x, y = F.col(base + c), F.col(own + c)
        out[f"scan_{c}"] = F.coalesce(join(x, y), x, y, F.lit(identity))
    return rows.withColumns(out).select(*frame.columns, *out)


def sort_pairs(frame: DataFrame, key: str = "key", start_bit: int | None = None, bits: int | None = None) -> DataFrame:
    """Stable sort by key, or by ``bits`` bits of it from ``start_bit`` on; the input position breaks ties."""
    order = F.col(key) if start_bit is None else F.shiftrightunsigned(key, start_bit).bitwiseAND((1 << bits) - 1)
    return frame.orderBy(order, "position")


def sort_ranks(frame: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Add ``rank``, the place of every row from 0 on in the order of ``keys``; rows of equal keys in any order.

    Two levels: rows are dealt out by ranges of the order, the ranges' counts scanned, and each range is numbered from there.
    """
    wide = "_" * max(map(len, frame.columns))
    part, base, names = "part" + wide, "base" + wide, [f"key{k}{wide}" for k in range(len(keys))]
    rows = frame.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in zip(names, keys, strict=True)})
    rows = cut(rows.repartitionByRange(*names).withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    bases = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*names)) - 1
    # One row per range.
    return rows.join(F.broadcast(bases), part).withColumn("rank", (F.col(base) + own).cast("long")).select(*frame.columns, "rank")


def pair_ranks(frame: DataFrame, key: str = "key", start_bit: int | None = None, bits: int | None = None) -> DataFrame:
    """Add ``rank``, the place of every row from 0 on in the order of ``sort_pairs``."""
    order = F.col(key) if start_bit is None else F.shiftrightunsigned(key, start_bit).bitwiseAND((1 << bits) - 1)
    return sort_ranks(frame, [order, "position"])


def bit_order(value: Column) -> Column:
    """Doubles in the order of a sort by their bits: -0.0 before 0.0, which compare as equal otherwise."""
    return F.struct(value.alias("value"), (value.cast("string") != "-0.0").alias("plus"))


def partition_slots(frame: DataFrame, bins: int, key: str = "key") -> DataFrame:
    """bin (key modulo ``bins``) and destination slot of each row in a stable partition by bin.

    Slots are places in the order by bin and position, so rows are dealt by ranges of that order and not by bin.
    """
    rows = frame.withColumn("bin", F.pmod(F.col(key), F.lit(bins)).cast("long"))
    return sort_ranks(rows, ["bin", "position"]).withColumnRenamed("rank", "slot")


def discontinuity(frame: DataFrame, value: str = "value") -> DataFrame:
    """flag is 1 where a value differs from the one before it in order of position, and for the first.

    Ranges are flagged apart; the last value of the range before comes from a small table.
    """
    wide = "_" * max(map(len, frame.columns))
    part, edge, first, previous, begins = (x + wide for x in ("part", "edge", "first", "previous", "begins"))
    rows = frame.withColumn(part, F.floor(F.col("position") / RANGE))
    last = rows.groupBy(part).agg(F.max_by(value, "position").alias(edge))
    edges = last.select(part, F.lag(edge).over(Window.orderBy(part)).alias(edge), F.lag(part).over(Window.orderBy(part)).isNull().alias(first))
    within = Window.partitionBy(part).orderBy("position")
    rows = rows.withColumns({previous: F.lag(value).over(within), begins: F.row_number().over(within) == 1}).join(edges, part)
    before = F.when(F.col(begins), F.col(edge)).otherwise(F.col(previous))
    changes = (F.col(begins) & F.col(first)) | ~before.eqNullSafe(F.col(value))
    return rows.withColumn("flag", F.when(changes, 1).otherwise(0)).select(*frame.columns, "flag")


def tree_sum(frames: list[DataFrame], column: str = "value") -> DataFrame:
    """The sum over several partial vectors (position, value), as an all-reduce gives it."""
    return fold(DataFrame.union, [f.select("position", column) for f in frames]).groupBy("position").agg(F.sum(column).alias(column))

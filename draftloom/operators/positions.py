"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: monotonically_increasing_id has the number of the partition above so many bits, and the row's number within it below.
_BITS = 33


def _ranged(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` dealt by range and sorted, as a table with _at: the number of the range and of the row in it."""
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")


def _part() -> Column:
    return F.shiftright("_at", _BITS)


def _before(of_parts: DataFrame, what: Column) -> DataFrame:
    """(_p, and ``what`` over all ranges before): ranges are few, so each one's predecessors are met in a join of those."""
    earlier = of_parts.select(*[F.col(c).alias(f"e_{c}") for c in of_parts.columns])
    return of_parts.join(earlier, F.col("e__part") < F.col("_part"), "left").groupBy(F.col("_part").alias("_p")).agg(what.alias("_before"))


def with_positions(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Adds ``name``: each row's place from 1 on in ``order``, within its group of ``by`` if that is given.

    Rows are dealt by range and sorted, numbered within their range, and moved up by the rows of all ranges before; a
    group's rows are then counted from its first. Ranges are cut by samples of the order, so a hot group is many ranges.
    What is read twice is a table, as another run may cut the ranges elsewhere. ``order`` has to tell all rows apart for a
    result that is the same each time; rows that are equal in it and nothing else take their places in any order.
    """
    keys = [F.col(b).asc_nulls_first() for b in by] + [o if isinstance(o, Column) else F.col(o) for o in order]
    placed = _ranged(df, keys)
    sizes = placed.groupBy(_part().alias("_part")).agg(F.count("*").alias("n"))
    before = _before(sizes, F.coalesce(F.sum("e_n"), F.lit(0)))
    found = placed.join(before, _part() == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1) + 1)
    if by:
        first = found.groupBy(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)]).agg(F.min(name).alias("_first"))
        same = [F.col(b).eqNullSafe(F.col(f"_by{k}")) for k, b in enumerate(by)]
        found = found.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1)
    return found.select(*df.columns, name)


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row in a global order: within ranges, plus what the ranges before have."""
    placed = _ranged(df, [o if isinstance(o, Column) else F.col(o) for o in order]).withColumn("_part", _part())
    before = _before(placed.groupBy("_part").agg(F.sum(value).alias("n")), F.coalesce(F.sum("e_n"), F.lit(0)))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_sum", within).join(before, F.col("_part") == F.col("_p")).withColumn(name, F.col("_sum") + F.col("_before")).select(*df.columns, name)


def last_before(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null in the rows before, in a global order: of the range, else of those before."""
    placed = _ranged(df, [o if isinstance(o, Column) else F.col(o) for o in order]).withColumn("_part", _part())
    lasts = placed.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, "_at").alias("v"))
    every = placed.select("_part").distinct().join(lasts, "_part", "left")
    before = _before(every, F.max_by(F.col("e_v"), F.when(F.col("e_v").isNotNull(), F.col("e__part"))))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_seen", seen).join(before, F.col("_part") == F.col("_p")).withColumn(name, F.coalesce("_seen", "_before")).select(*df.columns, name)


def every_kth(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Every k-th row in an order, the first included."""
    return with_positions(df, order, name="_pos").where((F.col("_pos") - 1) % k == 0).drop("_pos")


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """A page by its number from 1 on, however far down, with ``pos`` from 1 on; numbers beyond the end give the last page."""
    placed = with_positions(df, order)
    last = placed.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("_last"))
    wanted = F.least(F.lit(max(number, 1)), F.col("_last"))
    return placed.join(last, F.ceil(F.col("pos") / size) == wanted).drop("_last")

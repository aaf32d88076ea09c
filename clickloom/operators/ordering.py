"""Exact global order without sending all rows through one task.

``keys_at`` finds the rows at given positions of a global order. It counts rows per coarse time cell
(a small aggregate), keeps the cells that hold a wanted position, and sorts only the keys of those
cells: a cell of proven small size in one task, a larger one by range, equal keys as one row with their number. Callers then compare every row
with the found keys, which needs no shuffle.

``running_totals`` adds prefix sums over a sorted numeric key. Bucket limits come from a histogram that is
finer where values are crowded; rows of equal key are combined beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from clickloom.functions import temporal
from clickloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
_RANGE_BITS = (_ROW_BITS, 21, 10)
SMALL_CELL = 200_000  # rows one task may sort


@dataclass(frozen=True)
class TimeOrder:
    """Order by time with nulls last, then by the other columns with nulls last."""

    time: str = "event_timestamp"
    others: tuple[str, ...] = ("hour", "id")

    def parts(self) -> list[Column]:
        return [part for name in (self.time, *self.others) for part in (F.col(name).isNull(), F.col(name))]

    def sort_columns(self) -> list[Column]:
        return [F.col(name).asc_nulls_last() for name in (self.time, *self.others)]

    def key(self) -> Column:
        """The sort key of a row as one comparable struct."""
        return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(self.parts())])

    def literal(self, df: DataFrame, row: Row) -> Column:
        values = []
        for name in (self.time, *self.others):
            value = row[name]
            value = temporal.literal(value) if isinstance(value, datetime) else F.lit(value)
            value = value.cast(df.schema[name].dataType)
            values += [F.lit(row[name] is None), value]
        return F.struct(*[value.alias(f"k{i}") for i, value in enumerate(values)])


def sort_by_time(df: DataFrame, order: TimeOrder = TimeOrder()) -> DataFrame:
    return df.orderBy(*order.sort_columns())


@dataclass(frozen=True)
class Positions:
    total: int
    rows: dict[str, Row]
    places: dict[str, int] = field(default_factory=dict)


def keys_at(
    df: DataFrame,
    order: TimeOrder,
    positions: Callable[[Column], dict[str, Column]],
    small_cell: int = SMALL_CELL,
) -> Positions:
    """Key columns of the rows at named 0-based positions; positions are computed from the row count."""
    names = [order.time, *order.others]
    keys = df.select(*names)
    cell = temporal.hour_number(F.col(order.time))
    counted = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    by_cell = Window.orderBy(F.col("cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    wanted = F.create_map(*[
        part for name, place in positions(F.col("total")).items() for part in (F.lit(name), place.cast("bigint"))
    ])
    cells = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(by_cell), F.lit(0)))
        .withColumn("total", F.sum("n").over(everything))
        .select("*", F.explode(wanted).alias("name", "place"))
        .where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    )
    found = cells.select("cell", "n", "before", "total", "name", "place").collect()  # one row per position
    if not found:
        return Positions(keys.count(), {})

    def rows_of(value) -> DataFrame:
        return keys.where(cell.eqNullSafe(F.lit(value).cast("bigint")))

    rows = {}
    small = [row for row in found if row["n"] <= small_cell]
    if small:
        picks = [
            rows_of(row["cell"]).orderBy(*order.sort_columns()).offset(row["place"] - row["before"]).limit(1)
            .withColumn("_name", F.lit(row["name"]))
            for row in small
        ]
        rows.update({row["_name"]: row for row in reduce(DataFrame.union, picks).collect()})
    for value in {row["cell"] for row in found if row["n"] > small_cell}:
        rows.update(_keys_in_cell(rows_of(value), order, [row for row in found if row["cell"] == value]))
    return Positions(found[0]["total"], rows, {row["name"]: row["place"] for row in found})


def _keys_in_cell(keys: DataFrame, order: TimeOrder, wanted: list[Row]) -> dict[str, Row]:
    """The rows at the given positions of one cell, by a range sort of its distinct keys with the number of rows each has."""
    sort = order.sort_columns()
    distinct = keys.groupBy(*keys.columns).agg(F.count("*").alias("_n"))
    placed = materialize(
        distinct.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return {want["name"]: _row_at(placed, "_row", F.col("_n"), want["place"] - want["before"]) for want in wanted}


def _row_at(placed: DataFrame, number: str, weight: Column, position: int) -> Row:
    """The row of a stored table that covers a 0-based position, where each row stands for ``weight`` positions and ``number`` is its
    ``monotonically_increasing_id``. Sums by ever smaller ranges of numbers lead to it: the driver sees a row per partition, then
    at most some thousand a step, and nothing is sorted but the last range."""
    for bits in _RANGE_BITS:
        block = F.shiftright(number, bits)
        for size in placed.groupBy(block.alias("block")).agg(F.sum(weight).alias("n")).orderBy("block").collect():
            if position < size["n"]:
                placed = placed.where(block == size["block"])
                break
            position -= size["n"]
    for row in placed.withColumn("_weight", weight).orderBy(number).collect():  # a last range of 2**10 numbers
        if position < row["_weight"]:
            return row
        position -= row["_weight"]
    raise ValueError("no such position")


@dataclass(frozen=True)
class Cuts:
    """``frame`` has the rows cut; ``upto[name]`` tells whether a row is at or before the named position in the order."""

    total: int
    frame: DataFrame
    upto: dict[str, Column]

    def finish(self, df: DataFrame) -> DataFrame:
        """Without the helper column that tells equal rows apart."""
        return df.drop(_TIE)


_TIE = "_tie_row"


def cut_at(df: DataFrame, order: TimeOrder, positions: Callable[[Column], dict[str, Column]]) -> Cuts:
    """Cuts the rows at exact positions, also among rows that are equal in every order column.

    Usually a comparison with the boundary keys is enough and no row moves. If rows equal to a boundary key lie on both
    sides of it, the table is written once with fixed row numbers; those of the equal rows are counted by ranges of numbers, and
    one row number becomes the boundary among them.
    """
    found = keys_at(df, order, positions)
    literals = {name: order.literal(df, row) for name, row in found.rows.items()}
    if not literals:
        return Cuts(found.total, df, {})
    counts = df.agg(*[
        F.count_if(test).alias(f"{name}_{side}") for name, limit in literals.items()
        for side, test in (("below", order.key() < limit), ("equal", order.key() == limit))
    ]).first()
    lower = {name: found.places[name] + 1 - counts[f"{name}_below"] for name in literals}  # equal rows up to the position
    tied = {name for name in literals if lower[name] < counts[f"{name}_equal"]}
    frame = materialize(df.withColumn(_TIE, F.monotonically_increasing_id())) if tied else df
    upto = {}
    for name, limit in literals.items():
        if name not in tied:
            upto[name] = order.key() <= limit
            continue
        last = _row_at(frame.where(order.key() == limit).select(_TIE), _TIE, F.lit(1), lower[name] - 1)[_TIE]
        upto[name] = (order.key() < limit) | ((order.key() == limit) & (F.col(_TIE) <= last))
    return Cuts(found.total, frame, upto)


CELLS_PER_OCTAVE = 256
FINE = 8  # cells a bucket's share of rows is cut into where values are crowded


def histogram(df: DataFrame, column: str, buckets: int) -> list[tuple[float, int]]:
    """Smallest value and row count of the cells of a numeric column, ascending.

    The first pass counts in fixed cells, so wide that all numbers have some 10^5 of them and usual data some thousand. A
    cell with more than a ``buckets``-th of the rows (there are fewer such cells than buckets) is cut finer in a second
    pass. Both are ordinary partial aggregates; nulls and NaN are left out.
    """
    x = F.col(column).cast("double")
    cell = F.floor(F.signum(x) * F.log2(1 + F.abs(x)) * CELLS_PER_OCTAVE)
    values = df.select(x.alias("x"), cell.alias("cell")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    coarse = values.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    share = max(1.0, sum(row["n"] for row in coarse) / buckets)
    crowded = [row for row in coarse if row["n"] > share and row["low"] < row["high"]]
    out = [(row["low"], row["n"]) for row in coarse if row not in crowded]
    if crowded:
        ranges = F.create_map(*[
            part for row in crowded for part in (
                F.lit(row["cell"]), F.array(F.lit(row["low"]), F.lit(row["high"] - row["low"]), F.lit(float(FINE * math.ceil(row["n"] / share)))))
        ])
        inside = values.where(F.col("cell").isin([row["cell"] for row in crowded])).withColumn("r", ranges[F.col("cell")])
        fine = F.floor((F.col("x") - F.col("r")[0]) / F.col("r")[1] * F.col("r")[2])
        out += [(row["low"], row["n"]) for row in inside.groupBy("cell", fine.alias("fine")).agg(
            F.count("*").alias("n"), F.min("x").alias("low")).collect()]
    return sorted(out)


def bucket_limits(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Limits that cut the rows into about equally large buckets by a numeric column, from its histogram.

    The number follows the session's shuffle partitions, which grow with the data.
    """
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if buckets < 2:
        return []
    cells = histogram(df, column, buckets)
    share, before, limits = sum(n for _, n in cells) / buckets, 0, []
    for low, n in cells:
        if before and before >= (len(limits) + 1) * share * (1 - 1e-9):
            limits.append(low)
        before += n
    return limits[: buckets - 1]


def add_bucket(df: DataFrame, column: str, limits: Sequence[float], name: str) -> DataFrame:
    """Bucket number of a value: how many of the limits it reaches."""
    if not limits:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *limits, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame, keys: list[str], column: str, sums: Sequence[str], limits: Sequence[float]
) -> DataFrame:
    """Adds ``cum_x`` (inclusive, ascending by ``column``) and ``all_x`` per key group for each summed x.

    ``df`` has one row per (keys, column) and no null keys.
    """
    group = [*keys, "_bucket"]
    bucketed = add_bucket(df, column, limits, "_bucket")
    within = Window.partitionBy(*group).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    rows = bucketed.withColumns({f"cum_{name}": F.sum(name).over(within) for name in sums})
    # One row per key group and bucket. It is joined on the window's own partitioning, so the rows
    # above stay where they are.
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(*keys)
    buckets = bucketed.groupBy(*group).agg(*[F.sum(name).alias(f"_sum_{name}") for name in sums])
    buckets = buckets.select(
        *group,
        *[F.coalesce(F.sum(f"_sum_{name}").over(by_bucket), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(by_key).alias(f"all_{name}") for name in sums],
    )
    return rows.join(buckets, group).select(
        *df.columns,
        *[(F.col(f"cum_{name}") + F.col(f"_before_{name}")).alias(f"cum_{name}") for name in sums],
        *[f"all_{name}" for name in sums],
    )

"""Ordered target statistics: the click rate of a category as far as it was known before a row's time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clickloom.functions import temporal
from clickloom.session import materialize

_LAST = 1 << 62  # rows without a time come after all others
CHUNK = 50_000  # rows that meet their rates in one call; a chunk holds fewer than three times as many


def _lookup(wanted: pa.Table, known: pa.Table, key: str) -> np.ndarray:
    """The rate of each wanted (cell, key); ``known`` has every such pair once."""
    cells, keys = pc.unique(known["cell"]), pc.unique(known["key"])

    def codes(table: pa.Table, name: str) -> np.ndarray:
        cell, own = pc.index_in(table["cell"], value_set=cells), pc.index_in(table[name].cast(pa.string()), value_set=keys)  # a null is a key
        return cell.to_numpy().astype(np.int64) * len(keys) + own.to_numpy()

    have = codes(known, "key")
    order = np.argsort(have)
    return known["rate"].to_numpy()[order[np.searchsorted(have[order], codes(wanted, key))]]


def ordered_rates(
    df: DataFrame, keys: Mapping[str, Column], target: str, time_col: str, prior: float, smoothing: float, suffix: str = "_rate",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``<name><suffix>`` for each key: clicks and rows of the same key in hours strictly before the row's own, as a rate
    smoothed towards ``prior``. Rows of one hour don't see each other, so no row sees its own click. ``keep`` names the other
    columns that are wanted; all of them if it is not given.

    Rows are counted per (key, hour) before prefix sums run over the hours of a key: a category that most rows share is one row an
    hour there. Rows then meet the rates of their hour in chunks: hours with few rows share one, an hour with many is dealt over
    several, each with the rates of that hour, so a row moves once whatever the number of keys. A null target counts as a row
    without a click; a null key is a category of its own; rows without a time come last.
    """
    names, kept = list(keys), list(df.columns if keep is None else keep)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    plain = df.select(*keys.values()).schema.fields
    own = [F.col(f"_k{i}") if isinstance(field.dataType, whole) else F.col(f"_k{i}").cast("string") for i, field in enumerate(plain)]
    stored = materialize(df.select(
        *kept, F.coalesce(temporal.hour_number(F.col(time_col)), F.lit(_LAST)).alias("_cell"),
        F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y"), F.monotonically_increasing_id().alias("_row"),
        *[keys[name].alias(f"_k{i}") for i, name in enumerate(names)]))
    stored = stored.withColumns({f"_k{i}": key for i, key in enumerate(own)})
    entries = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"_k{i}").cast("string").alias("key")) for i in range(len(names))])
    long = stored.select(F.col("_cell").alias("cell"), F.col("_y").alias("y"), F.inline(entries))
    counted = long.groupBy("column", "key", "cell").agg(F.count("*").alias("n"), F.sum("y").alias("clicks"))
    before = Window.partitionBy("column", "key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    n, clicks = (F.coalesce(F.sum(name).over(before), F.lit(0)) for name in ("n", "clicks"))
    rates = counted.select("column", "key", "cell", ((clicks + prior * smoothing) / (n + smoothing)).alias("rate"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    hours = stored.groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("n")).select(
        "cell", F.expr("CAST(ceil(n / {}) AS BIGINT)".format(CHUNK)).alias("parts"),
        F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / CHUNK).alias("first"))
    hours = materialize(hours)
    left = stored.join(F.broadcast(hours.withColumnRenamed("cell", "_cell")), "_cell").select(
        (F.col("first") + F.pmod(F.col("_row"), F.col("parts"))).alias("chunk"), F.col("_cell").alias("cell"),
        *[f"_k{i}" for i in range(len(names))], *[F.col(name).alias(f"_c{i}") for i, name in enumerate(kept)])
    right = rates.join(F.broadcast(hours), "cell").select(
        F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("chunk"), "cell", "column", "key", "rate")

    def work(rows: pa.Table, known: pa.Table) -> pa.Table:
        rated = [_lookup(rows, known.filter(pc.equal(known["column"], i)), f"_k{i}") for i in range(len(names))]
        return pa.table([rows[f"_c{i}"] for i in range(len(kept))] + [pa.array(rate, pa.float64()) for rate in rated], names=out.names)

    out = T.StructType([T.StructField(name, df.schema[name].dataType) for name in kept] + [T.StructField(f"{name}{suffix}", T.DoubleType()) for name in names])
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(work, out)

"""Boosted symmetric trees by Newton steps, with L2 on the leaves and a stop by validation loss.

A tree asks the same question at all nodes of a level, so a leaf is a number made of one bit a level. Training is one
aggregate a level: tasks sum gradient, curvature and rows by (node, feature, bin) of the binned table, those sums meet in a
shuffle, and the driver sees one row per cell, whose number is bounded by depth, features and bins whatever the input. Below
the root only the rows on the smaller side of the last question are summed; the other side is the difference. The split with the largest gain over all nodes is taken, ``-G / (H + l2)`` becomes the value of a leaf.

Sums are whole numbers (gradients in units of 2**-24), so they don't depend on the order of tasks: a repeated run, or one
that lost executors, learns the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import materialize

UNIT = float(1 << 24)
REFRESH = 16  # trees after which the running scores are written again, so that a pass applies fewer trees than that
LEAST_GAIN = 1e-9
ROWS_PER_TASK = 100_000  # a pass over them takes about as long as starting a task does
TASKS_PER_CORE = 3


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 250
    depth: int = 6
    learning_rate: float = 0.08
    l2: float = 3.0
    patience: int = 30
    bins: int = 32

    def check(self) -> None:
        if self.rounds < 1 or not 1 <= self.depth <= 8 or not 2 <= self.bins <= 256 or self.patience < 1 or self.l2 < 0:
            raise ValueError("rounds and patience from 1, depth 1 to 8, bins 2 to 256, l2 from 0")


@dataclass(frozen=True)
class Tree:
    """Level k adds ``1 << k`` to the leaf number of rows whose feature is above its border. ``weights`` are training rows a leaf."""

    features: list[str]
    borders: list[float]
    values: list[float]
    weights: list[int]

    def leaf_sql(self) -> str:
        bits = [f"CASE WHEN `{clean_name(name)}` > {border!r}D THEN {1 << k} ELSE 0 END"
                for k, (name, border) in enumerate(zip(self.features, self.borders))]
        return " + ".join(bits) or "0"

    def value_sql(self) -> str:
        return f"element_at(array({', '.join(f'{value!r}D' for value in self.values)}), 1 + {self.leaf_sql()})"


def clean_name(name: str) -> str:
    return f"_x_{name}"


@dataclass(frozen=True)
class BoostedTrees:
    base: float
    trees: list[Tree] = field(default_factory=list)

    @classmethod
    def from_dict(cls, document: dict) -> BoostedTrees:
        return cls(document["base"], [Tree(**tree) for tree in document["trees"]])

    def to_dict(self) -> dict:
        return asdict(self)

    def cut(self, rounds: int) -> BoostedTrees:
        return BoostedTrees(self.base, self.trees[:rounds])

    def used(self) -> list[str]:
        return list(dict.fromkeys(name for tree in self.trees for name in tree.features))

    def prepare(self, df: DataFrame) -> DataFrame:
        """Adds the features as plain numbers; null and NaN count as the smallest."""
        smallest = F.lit(float("-inf"))
        return df.withColumns({
            clean_name(name): F.coalesce(F.nanvl(F.col(name).cast("double"), smallest), smallest) for name in self.used()})

    def _sum_sql(self, terms: list[str]) -> str:
        if len(terms) == 1:
            return terms[0]
        middle = len(terms) // 2  # halves, so that the expression of many trees stays shallow
        return f"({self._sum_sql(terms[:middle])} + {self._sum_sql(terms[middle:])})"

    def raw(self) -> Column:
        """The log odds, on columns of ``prepare``."""
        return F.expr(self._sum_sql([f"{self.base!r}D", *[tree.value_sql() for tree in self.trees]]))

    def transform(self, df: DataFrame, name: str = "probability") -> DataFrame:
        scored = self.prepare(df).withColumn(name, 1 / (1 + F.exp(-self.raw())))
        return scored.drop(*[clean_name(used) for used in self.used()])

    def staged(self) -> Column:
        """Log odds after 0, 1, 2, ... trees as an array, on columns of ``prepare``."""
        if not self.trees:
            return F.array(F.lit(self.base))
        terms = F.array(*[F.expr(tree.value_sql()) for tree in self.trees])
        return F.aggregate(terms, F.array(F.lit(self.base)), lambda sums, term: F.concat(sums, F.array(F.element_at(sums, -1) + term)))

    def importance(self) -> dict[str, float]:
        """Share of each feature, in percent, in how far predictions change from one side of its splits to the other.

        Two leaves that differ in one question only are its two sides: the squared distance of each value from their mean,
        weighted by the training rows, goes to the question's feature.
        """
        share: dict[str, float] = {}
        for tree in self.trees:
            values, weights = np.array(tree.values), np.array(tree.weights, dtype=float)
            for k, name in enumerate(tree.features):
                low = np.flatnonzero((np.arange(len(values)) >> k) & 1 == 0)
                a, b, v, w = weights[low], weights[low | 1 << k], values[low], values[low | 1 << k]
                both = a + b
                mean = np.divide(a * v + b * w, both, out=np.zeros_like(both), where=both > 0)
                share[name] = share.get(name, 0.0) + float((a * (v - mean) ** 2 + b * (w - mean) ** 2).sum())
        whole = sum(share.values())
        return {name: 100.0 * value / whole if whole else 0.0 for name, value in share.items()}


def log_loss(raw: Column, target: Column) -> Column:
    return F.greatest(raw, F.lit(0.0)) - raw * target + F.log1p(F.exp(-F.abs(raw)))


def staged_losses(df: DataFrame, model: BoostedTrees, target: str) -> DataFrame:
    """(round, n, loss): the mean log loss after each number of trees, in one pass over the rows."""
    rows = model.prepare(df).select(F.col(target).cast("double").alias("y"), F.posexplode(model.staged()).alias("round", "raw"))
    return rows.groupBy("round").agg(F.count("*").alias("n"), F.avg(log_loss(F.col("raw"), F.col("y"))).alias("loss"))


def stopping_round(losses: DataFrame, patience: int) -> DataFrame:
    """One row: ``best_round``, ``best_loss`` and ``stopped_at`` (null if it ran to the end) of a table (round, loss).

    Training ends at the first round that comes ``patience`` rounds after the last improvement; the best round up to
    there is kept. One row a round, so the windows are small.
    """
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    lowest = F.min("loss").over(before)
    marked = losses.select("round", "loss", (lowest.isNull() | (F.col("loss") < lowest)).alias("better"))
    marked = marked.withColumn("last", F.max(F.when(F.col("better"), F.col("round"))).over(upto))
    end = F.min(F.when(F.col("round") - F.col("last") >= patience, F.col("round"))).over(Window.partitionBy())
    kept = marked.withColumn("end", end).where("end IS NULL OR round <= end")
    best = F.max(F.when(F.col("better"), F.struct("round", "loss")))
    return kept.agg(best.alias("best"), F.max("end").alias("stopped_at")).select(
        F.col("best.round").alias("best_round"), F.col("best.loss").alias("best_loss"), "stopped_at")


def leaf_weights(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """(tree, leaf, n): how many rows reach each leaf of each tree, leaves without rows left out."""
    leaves = F.array(*[F.expr(tree.leaf_sql()) for tree in model.trees]) if model.trees else F.array().cast("array<int>")
    rows = model.prepare(df).select(F.posexplode(leaves).alias("tree", "leaf"))
    return rows.groupBy("tree", "leaf").agg(F.count("*").alias("n"))


def quantile_borders(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins - 1`` borders a column, at its quantiles; they come from one pass with small summaries."""
    steps = [i / bins for i in range(1, bins)]
    number = lambda name: F.col(name).cast("double")
    found = df.agg(*[
        F.percentile_approx(F.when(~F.isnan(number(name)), number(name)), steps, 10_000).alias(f"q{i}") for i, name in enumerate(columns)]).first()
    return {name: sorted(set(found[i] or [])) for i, name in enumerate(columns)}


_BLOCKS = "bins binary, y binary, held binary, raw binary"


def _block(bins: np.ndarray, y: np.ndarray, held: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (bins, y, held, raw)], ["bins", "y", "held", "raw"])


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins with a row for each feature, so that a question reads consecutive bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            yield (np.frombuffer(row["bins"], dtype=np.uint8).reshape(width, -1), np.frombuffer(row["y"]),
                   np.frombuffer(row["held"], dtype=bool), np.frombuffer(row["raw"]))


def bin_rows(df: DataFrame, borders: dict[str, list[float]], target: str, base: float, held_col: str | None = None) -> DataFrame:
    """The rows in blocks, one for each batch a task reads: bins (a byte a feature: the number of its borders below the value),
    target, whether held out, and the running log odds. Passes over blocks have no cost per row outside numpy."""
    names = list(borders)
    limits = [np.array(borders[name], dtype=float) for name in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.zeros((len(names), batch.num_rows), dtype=np.uint8)
            for i, limit in enumerate(limits):
                x = np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                bins[i] = np.searchsorted(limit, x, side="left")
            yield _block(bins, batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), np.full(batch.num_rows, base))

    held = F.col(held_col) if held_col else F.lit(False)
    plain = df.where(F.col(target).isNotNull()).select(
        *[F.col(name).cast("double").alias(f"c{i}") for i, name in enumerate(names)], F.col(target).cast("double").alias("y"), held.alias("held"))
    return plain.mapInArrow(work, _BLOCKS)


def _add_trees(raw: np.ndarray, bins: np.ndarray, trees: Sequence[tuple[list[int], list[int], np.ndarray]]) -> np.ndarray:
    for columns, places, values in trees:
        raw = raw + values[_leaves(bins, columns, places)]
    return raw


def _leaves(bins: np.ndarray, columns: Sequence[int], places: Sequence[int]) -> np.ndarray:
    """Leaf numbers; a byte is enough for the greatest depth."""
    out = np.zeros(bins.shape[1], dtype=np.uint8)
    for k, (column, place) in enumerate(zip(columns, places)):
        out |= (bins[column] > place).view(np.uint8) << np.uint8(k)
    return out


def level_sums(
    binned: DataFrame, width: int, bins: int, trees: list, columns: list[int], places: list[int], side: int | None = None
) -> DataFrame:
    """(cell, g, h, n) of a level: sums over the training rows per ``(node * width + feature) * bins + bin``, and in cell -1 the sum
    of the log loss and the number of the rows held out, before this tree.

    With a ``side``, 0 or 1, only the training rows with that answer to the last question are summed, by the node they were in
    before it, and the rows held out are not looked at.
    """
    nodes = 1 << (len(columns) - (side is not None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, held_rows = np.zeros((width, 3, nodes * bins)), 0.0, 0
        for own, y, held, raw in _unpacked(batches, width):
            inside = ~held
            if side is not None:
                inside &= (own[columns[-1]] > places[-1]) == bool(side)
            elif held.any():
                t = y[held]
                r = _add_trees(raw[held], own[:, held], trees)
                loss += float(np.rint((np.maximum(r, 0) - r * t + np.log1p(np.exp(-np.abs(r)))) * UNIT).sum())
                held_rows += len(r)
            if not inside.all():
                inside = np.flatnonzero(inside)
                if not len(inside):
                    continue
                own, y, raw = own.take(inside, axis=1), y[inside], raw[inside]
            p = 1 / (1 + np.exp(-_add_trees(raw, own, trees)))
            asked = len(columns) if side is None else -1
            node = _leaves(own, columns[:asked], places[:asked]).astype(np.intp) * bins
            weights = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT), None
            for column in range(width):
                cell = node + own[column]
                for i, weight in enumerate(weights):
                    sums[column, i] += np.bincount(cell, weights=weight, minlength=nodes * bins)
        sums = sums.reshape(width, 3, nodes, bins).transpose(1, 2, 0, 3).reshape(3, -1)
        filled = np.flatnonzero(sums[2])
        g, h, n = (np.append(sums[i, filled], extra).astype(np.int64) for i, extra in enumerate((loss, 0, held_rows)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(filled, -1)), pa.array(g), pa.array(h), pa.array(n)], ["cell", "g", "h", "n"])

    return binned.mapInArrow(work, "cell long, g long, h long, n long").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def _with_scores(binned: DataFrame, width: int, trees: list) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, y, held, raw in _unpacked(batches, width):
            yield _block(own, y, held, _add_trees(raw, own, trees))

    return binned.mapInArrow(work, _BLOCKS)


@dataclass(frozen=True)
class Fitted:
    """The model cut at its best round, and the loss of the held out rows after 0, 1, 2, ... trees (empty without such rows)."""

    model: BoostedTrees
    losses: list[float]
    best_round: int


def _best_split(g: np.ndarray, h: np.ndarray, l2: float, limits: list[int]) -> tuple[float, int, int]:
    """Gain, feature and border of the split that gains most over all nodes; sums have shape (node, feature, bin)."""
    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.divide(g * g, h + l2, out=np.zeros_like(g), where=h + l2 > 0)

    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    gain = (score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)).sum(axis=0)
    for i, limit in enumerate(limits):
        gain[i, limit:] = -np.inf
    place = int(gain.argmax())  # of equal ones the first feature and the lowest border
    return float(gain.flat[place]), place // gain.shape[1], place % gain.shape[1]


def fit(
    train: DataFrame, validation: DataFrame | None, columns: Sequence[str], target: str, config: BoostConfig = BoostConfig(),
    borders: dict[str, list[float]] | None = None,
) -> Fitted:
    """Learns trees from the rows of ``train``; ``validation`` decides how many of them stay.

    ``columns`` are numeric; null and NaN count as the smallest value. Without rows, or with one class only, no tree is learned.
    """
    config.check()
    counted = train.agg(F.count(target).alias("n"), F.sum(F.col(target).cast("double")).alias("clicks")).first()
    rate = min(max((counted["clicks"] or 0.0) / max(counted["n"], 1), 1e-6), 1 - 1e-6)
    base = math.log(rate / (1 - rate))
    borders = {name: list(borders[name]) for name in columns} if borders else quantile_borders(train, columns, config.bins)
    names, width = list(borders), len(borders)
    limits = [len(borders[name]) for name in names]
    bins = max(limits) + 1
    if bins > 256:
        raise ValueError("a feature has more than 255 borders")
    marked = train.select(*columns, target, F.lit(False).alias("_held"))
    if validation is not None:
        marked = marked.unionByName(validation.select(*columns, target, F.lit(True).alias("_held")))
    binned = materialize(bin_rows(marked, borders, target, base, "_held"))
    # A pass ends with one row per task and filled cell, so more tasks than keep the cores busy only add to what is summed.
    tasks = max(1, min(-(-counted["n"] // ROWS_PER_TASK), TASKS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism))
    binned = binned.coalesce(tasks)
    trees: list[Tree] = []
    recent: list = []
    losses: list[float] = []
    best = 0
    for number in range(config.rounds + 1):
        columns_of, places_of = [], []
        values = weights = parent = side = None
        for level in range(config.depth):
            table = level_sums(binned, width, bins, recent, columns_of, places_of, side).toArrow()
            cell, g, h, n = (table.column(i).to_numpy() for i in range(4))
            if level == 0:
                held = np.flatnonzero(cell == -1)
                if len(held) and n[held].sum():
                    losses.append(float(g[held].sum() / UNIT / n[held].sum()))
                    if number == 1 or number > 1 and losses[-1] < losses[best]:
                        best = number  # at least one tree stays
                if number == config.rounds or (losses and number - best >= config.patience):
                    break
            inside = cell >= 0
            whole = np.zeros((3, (1 << max(0, level - 1)) * width * bins), dtype=np.int64)
            whole[:, cell[inside]] = g[inside], h[inside], n[inside]
            whole = whole.reshape(3, -1, width, bins)
            if level:  # the other side is what is left of the level before, to the unit
                whole = np.concatenate([whole, parent - whole] if side == 0 else [parent - whole, whole], axis=1)
            parent, sums = whole, whole / np.array([UNIT, UNIT, 1.0]).reshape(3, 1, 1, 1)
            gain, column, place = _best_split(sums[0], sums[1], config.l2, limits)
            if not gain > LEAST_GAIN:
                break
            columns_of.append(column)
            places_of.append(place)
            left = sums[:, :, column, : place + 1].sum(axis=2)
            both = np.concatenate([left, sums[:, :, column].sum(axis=2) - left], axis=1)  # the right side is the higher bit
            down = both[1] + config.l2
            values = -config.learning_rate * np.divide(both[0], down, out=np.zeros_like(down), where=down > 0)
            weights = np.rint(both[2]).astype(np.int64)
            side = int(weights[1 << level:].sum() < weights[: 1 << level].sum())  # the next pass reads the smaller side only
        if values is None:
            break
        trees.append(Tree([names[c] for c in columns_of], [float(borders[names[c]][p]) for c, p in zip(columns_of, places_of)],
                          values.tolist(), weights.tolist()))
        recent.append((columns_of, places_of, values))
        if len(recent) == REFRESH:
            binned, recent = materialize(_with_scores(binned, width, recent)), []
    model = BoostedTrees(base, trees)
    return Fitted(model.cut(best) if losses else model, losses, best if losses else len(trees))

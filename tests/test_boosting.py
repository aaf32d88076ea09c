import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import boosting, statistics
from clickloom.operators.model import ClickModel, RateEncoder

BORDERS = {"a": [0.0, 1.0, 2.0, 3.0], "b": [-1.0, 0.0, 1.0], "c": [0.5]}


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice([None, float("nan"), 0.0, 1.0, 2.0, 3.0, 4.0]), rng.uniform(-2, 2), float(rng.random() < 0.5)
        p = 0.1 + 0.5 * (a is not None and a > 1) * (b > 0) + 0.2 * c
        out.append((i, a, b, c, float(rng.random() < p)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double").repartition(5)


def plain_fit(data, config):
    """Symmetric Newton trees by plain loops over rows."""
    x = [[-math.inf if v is None or v != v else v for v in row[1:4]] for row in data]
    y = [row[4] for row in data]
    rate = sum(y) / len(y)
    raw = [math.log(rate / (1 - rate))] * len(y)
    trees = []
    for _ in range(config.rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        node, questions = [0] * len(y), []
        for level in range(config.depth):
            best = None
            for f, name in enumerate(BORDERS):
                for border in BORDERS[name]:
                    sides = {}
                    for i in range(len(y)):
                        g, h = sides.get((node[i], x[i][f] > border), (0.0, 0.0))
                        sides[node[i], x[i][f] > border] = g + p[i] - y[i], h + p[i] * (1 - p[i])
                    whole = {}
                    for (at, _), (g, h) in sides.items():
                        whole[at] = tuple(map(sum, zip(whole.get(at, (0, 0)), (g, h))))
                    gain = sum(g * g / (h + config.l2) for g, h in sides.values()) - sum(g * g / (h + config.l2) for g, h in whole.values())
                    if best is None or gain > best[0] + 1e-6:
                        best = gain, f, name, border
            questions.append((best[2], best[3]))
            node = [at | (x[i][best[1]] > best[3]) << level for i, at in enumerate(node)]
        values, weights = [], []
        for leaf in range(1 << config.depth):
            inside = [i for i, at in enumerate(node) if at == leaf]
            g, h = sum(p[i] - y[i] for i in inside), sum(p[i] * (1 - p[i]) for i in inside)
            values.append(-config.learning_rate * g / (h + config.l2))
            weights.append(len(inside))
        raw = [r + values[at] for r, at in zip(raw, node)]
        trees.append((questions, values, weights))
    return trees, raw


def test_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)  # so that scores are written in between
    data, config = rows(), boosting.BoostConfig(rounds=5, depth=3, learning_rate=0.4)
    fitted = boosting.fit(frame(spark, data), None, list(BORDERS), "y", config, BORDERS)
    trees, raw = plain_fit(data, config)
    assert len(fitted.model.trees) == 5 and fitted.losses == []
    for tree, (questions, values, weights) in zip(fitted.model.trees, trees):
        assert list(zip(tree.features, tree.borders)) == questions
        assert tree.values == pytest.approx(values, abs=1e-6)
        assert tree.weights == weights
    found = {row["id"]: row["probability"] for row in fitted.model.transform(frame(spark, data)).collect()}
    assert found == pytest.approx({row[0]: 1 / (1 + math.exp(-r)) for row, r in zip(data, raw)}, abs=1e-6)


def test_stops_at_the_best_round(spark):
    data, noise = rows(150), rows(150, seed=2)
    held = [(*row[:4], float(random.Random(i).random() < 0.3)) for i, row in enumerate(noise)]
    config = boosting.BoostConfig(rounds=60, depth=3, learning_rate=0.5, l2=0.5, patience=4)
    fitted = boosting.fit(frame(spark, data), frame(spark, held), list(BORDERS), "y", config, BORDERS)
    losses = fitted.losses[1:]
    assert fitted.best_round == losses.index(min(losses)) + 1 == len(fitted.model.trees)
    assert len(losses) == fitted.best_round + 4 < 60
    told = {row["round"]: row["loss"] for row in boosting.staged_losses(frame(spark, held), fitted.model, "y").collect()}
    assert told == pytest.approx(dict(enumerate(fitted.losses[: fitted.best_round + 1])), abs=1e-6)
    table = spark.createDataFrame(list(enumerate(fitted.losses))[1:], "round int, loss double")
    row = boosting.stopping_round(table, 4).first()
    assert (row["best_round"], row["stopped_at"]) == (fitted.best_round, fitted.best_round + 4)
    assert boosting.stopping_round(table, 60).first()["stopped_at"] is None


def test_importance_equals_brute_force(spark):
    """Rows of leaves that differ in one question only are pooled; their values' spread is the question's."""
    data = rows()
    model = boosting.fit(frame(spark, data), None, list(BORDERS), "y", boosting.BoostConfig(rounds=3, depth=3, learning_rate=0.4), BORDERS).model
    change = {}
    for tree in model.trees:
        for k, name in enumerate(tree.features):
            for leaf in range(8):
                if not leaf >> k & 1:
                    pool = [tree.values[leaf]] * tree.weights[leaf] + [tree.values[leaf | 1 << k]] * tree.weights[leaf | 1 << k]
                    change[name] = change.get(name, 0) + (np.var(pool) * len(pool) if pool else 0)
    share = model.importance()
    assert sum(share.values()) == pytest.approx(100)
    assert share == pytest.approx({name: 100 * value / sum(change.values()) for name, value in change.items()})
    counted = {(row["tree"], row["leaf"]): row["n"] for row in boosting.leaf_weights(frame(spark, data), model).collect()}
    assert counted == {(t, i): n for t, tree in enumerate(model.trees) for i, n in enumerate(tree.weights) if n}


def test_empty_one_class_and_odd_settings(spark):
    none = frame(spark, rows()).limit(0)
    assert boosting.fit(none, None, list(BORDERS), "y", boosting.BoostConfig(rounds=2), BORDERS).model.trees == []
    same = frame(spark, [(*row[:4], 1.0) for row in rows(50)])
    model = boosting.fit(same, same, list(BORDERS), "y", boosting.BoostConfig(rounds=2, l2=0.0)).model
    low, high = model.transform(same).agg(F.min("probability"), F.max("probability")).first()
    assert 0.9 < low <= high <= 1.0
    with pytest.raises(ValueError):
        boosting.BoostConfig(depth=0).check()


def test_ordered_rates_equal_a_plain_version(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot"] * 8 + ["x", "y", None, "", "null"]), f"u{rng.randrange(40)}", rng.choice([0.0, 1.0, None]),
             None if i % 50 == 0 else f"2024-01-0{rng.randrange(1, 4)} 0{rng.randrange(3)}:{rng.randrange(10, 60)}:00") for i in range(400)]
    df = spark.createDataFrame(data, "id int, k string, u string, y double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    found = {row["id"]: (row["k_rate"], row["u_rate"]) for row in statistics.ordered_rates(
        df, {"k": F.col("k"), "u": F.col("u")}, "y", "t", 0.3, 5.0).collect()}
    hour = lambda row: "9" if row[4] is None else row[4][:13]

    def rate(row, i):
        seen = [other[3] or 0.0 for other in data if other[i] == row[i] and hour(other) < hour(row)]
        return (sum(seen) + 0.3 * 5.0) / (len(seen) + 5.0)

    assert found == {row[0]: (pytest.approx(rate(row, 1)), pytest.approx(rate(row, 2))) for row in data}


def test_a_broken_save_leaves_the_earlier_version(spark, folder, monkeypatch):
    trees = boosting.BoostedTrees(0.1, [boosting.Tree(["a"], [0.5], [-0.1, 0.2], [3, 4])])
    encoder = RateEncoder(1, 1, {}, {})
    ClickModel(None, encoder, {"model_version": "one"}, trees).save(spark, folder)
    writer = type(spark.range(1).write)
    real = writer.parquet
    for step in range(2):  # the document, then the row that names it
        left = [step]

        def failing(self, path, *args, **options):
            if left[0] == 0:
                raise OSError("lost")
            left[0] -= 1
            return real(self, path, *args, **options)

        monkeypatch.setattr(writer, "parquet", failing)
        with pytest.raises(OSError):
            ClickModel(None, encoder, {"model_version": "two"}, trees).save(spark, folder)
        monkeypatch.setattr(writer, "parquet", real)
        loaded = ClickModel.load(spark, folder)
        assert loaded.version == "one" and loaded.trees == trees
    ClickModel(None, encoder, {"model_version": "two"}, trees).save(spark, folder)
    assert ClickModel.load(spark, folder).version == "two"


def test_passes_sum_the_smaller_side_in_few_tasks(spark, monkeypatch):
    """Below the root one side of the last question is read, the other follows; tasks don't grow in number with the rows."""
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(boosting, "TASKS_PER_CORE", 1)
    seen, real = [], boosting.level_sums

    def watched(binned, width, bins, trees, columns, places, side=None):
        table = real(binned, width, bins, trees, columns, places, side)
        n = table.where("cell >= 0").agg(F.sum("n")).first()[0] // width
        seen.append((len(columns), n, binned.rdd.getNumPartitions()))
        return table

    monkeypatch.setattr(boosting, "level_sums", watched)
    data = frame(spark, rows()).repartition(3 * spark.sparkContext.defaultParallelism)
    model = boosting.fit(data, None, list(BORDERS), "y", boosting.BoostConfig(rounds=2, depth=3), BORDERS).model
    assert [level for level, _, _ in seen] == [0, 1, 2] * 2 + [0]
    assert all(n == 600 if level == 0 else 0 < n <= 300 for level, n, _ in seen)
    assert all(tasks <= spark.sparkContext.defaultParallelism for _, _, tasks in seen)
    assert [sum(tree.weights) for tree in model.trees] == [600, 600]


def test_ordered_rates_of_split_and_shared_hours(spark, monkeypatch):
    """Chunks of a few rows: crowded hours are dealt over several of them, others share one. No key is joined row by row."""
    monkeypatch.setattr(statistics, "CHUNK", 7)
    data = [(i, i % 3 if i % 5 else None, float(i % 2), f"2024-01-01 {'00' if i < 60 else f'{i % 20:02d}'}:05:00" if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(data, "id int, k int, y double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    rated = statistics.ordered_rates(df, {"k": F.col("k")}, "y", "t", 0.3, 5.0, keep=["id"])
    assert rated.columns == ["id", "k_rate"]
    found = {row["id"]: row["k_rate"] for row in rated.collect()}
    hour = lambda row: "9" if row[3] is None else row[3][:13]
    assert len(found) == 200
    for row in data:
        seen = [other[2] for other in data if other[1] == row[1] and hour(other) < hour(row)]
        assert found[row[0]] == pytest.approx((sum(seen) + 0.3 * 5.0) / (len(seen) + 5.0))

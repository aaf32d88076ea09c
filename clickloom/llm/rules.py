"""Quality rules: statistics of whole texts as SQL expressions, and ordered rules learned from labelled statistics.

The learner is sequential covering. A rule is a conjunction of thresholds; it grows one condition at a time by information
gain on one part of the labelled rows and is pruned on the other part, the rows it covers are set aside, and the next rule
is learned on what is left. The result is an ordered list, written as one SQL CASE. Everything on rows is done by Spark
expressions; the driver sees counts by feature and bin only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.sql import bind

SPACE = r"\\x20\\x09-\\x0D"


def _repeat_words() -> str:
    """Words in windows of three words that occur twice or more, from the hashes ``h`` of the words.

    Most texts have no such window, which the number of distinct windows tells. Otherwise windows are sorted with their
    places; each repeated one adds its three words, less those that the next repeated one brings.
    """
    windows = "if(size(h) < 3, array(), transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])))"
    ordered = "sort_array(transform(t, (x, i) -> named_struct('x', x, 'i', i)))"
    repeated = ("sort_array(transform(filter(sequence(0, size(o) - 1), j -> (j > 0 AND o[j].x = o[greatest(j - 1, 0)].x) OR "
                "(j < size(o) - 1 AND o[j].x = o[least(j + 1, size(o) - 1)].x)), j -> o[j].i))")
    covered = "aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + if(k = size(p) - 1, 3, least(3, p[least(k + 1, size(p) - 1)] - p[k])))"
    slow = bind(ordered, "o", bind(repeated, "p", covered))
    return bind(windows, "t", f"if(size(array_distinct(t)) = size(t), 0L, {slow})")


def statistics_sql(text: str = "text") -> str:
    """SQL for a struct of the statistics of the whole text in column ``text``; null counts as empty."""
    lines = bind(f"filter(split(x, '\\\\n', -1), l -> l rlike '[^{SPACE}]')", "l", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)")
    fields = {
        "n_words": "CAST(size(w) AS BIGINT)",
        "word_chars": "CAST(char_length(array_join(w, '')) AS BIGINT)",
        "n_symbols": "CAST(char_length(x) - char_length(regexp_replace(x, '[#*$%&|<>]+', '')) AS BIGINT)",
        "n_dup_lines": lines,
        "n_repeat_words": bind("transform(w, y -> xxhash64(y))", "h", _repeat_words()),
        "n_marks": "CAST(char_length(x) - char_length(replace(x, '!', '')) AS BIGINT)",
        "n_lines": "CAST(size(split(x, '\\\\n', -1)) AS BIGINT)",
    }
    struct = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    words = f"array_remove(split(x, '[{SPACE}]+', -1), '')"
    return bind(f"coalesce(CAST(`{text}` AS STRING), '')", "x", bind(words, "w", f"named_struct({struct})"))


BASE_FAILED = "(s.n_words < 50 OR 100 * s.n_repeat_words > 50 * s.n_words)"

FEATURES = {
    "words": "CAST(s.n_words AS DOUBLE)",
    "word_length": "s.word_chars / greatest(s.n_words, 1)",
    "symbols": "s.n_symbols / greatest(s.n_words, 1)",
    "marks": "s.n_marks / greatest(s.n_words, 1)",
    "repeated": "s.n_repeat_words / greatest(s.n_words, 1)",
    "dup_lines": "s.n_dup_lines / greatest(s.n_lines, 1)",
    "line_words": "s.n_words / greatest(s.n_lines, 1)",
}
"""What rules are about: shares of the statistics, so that a text's length matters only as ``words``."""


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


class Rule(NamedTuple):
    """Rejects the rows that meet all conditions."""

    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(condition.sql() for condition in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column()
        return out


def decision_sql(rules: list[Rule]) -> str:
    """SQL for whether a text with statistics ``s`` is kept: the base rule first, then the first rule that holds decides."""
    whens = "".join(f" WHEN {rule.sql()} THEN false" for rule in rules)
    return f"CASE WHEN {BASE_FAILED} THEN false{whens} ELSE true END"


def labelled_features(docs: DataFrame, labels: DataFrame, bad: Column, id_col: str = "doc_id", text_col: str = "text",
                      max_rows: int = 20_000) -> DataFrame:
    """Features and ``bad`` (0 or 1) of at most ``max_rows`` labelled rows, those whose ids have the smallest hashes.

    Rows of the base rule's rejects are left out: the list need not cover them again. Repeated labels of an id: bad if any
    is; a null verdict counts as good.
    """
    sample = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("bad"))
    sample = sample.orderBy(F.xxhash64("id", F.lit("rules")), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = texts.join(F.broadcast(sample), "id")  # at most max_rows short rows
    features = ", ".join(f"'{name}', {value}" for name, value in FEATURES.items())
    body = f"named_struct('failed', {BASE_FAILED}, {features})"
    return picked.select("id", "bad", F.expr(f"inline(array({bind(statistics_sql(), 's', body)}))")).where("NOT failed").drop("failed")


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn(rows: DataFrame, max_rules: int = 8, max_conditions: int = 4, bins: int = 32, least_purity: float = 0.95,
          least_covered: int = 4) -> list[Rule]:
    """The ordered rules. ``rows`` has the features, ``id`` and ``bad``; it is read many times, so store it before.

    Thresholds lie midway between neighbouring quantiles of each feature among bad and among good rows. A rule is taken if, after pruning, at least
    ``least_purity`` of what it covers (in both parts) is bad and it covers ``least_covered`` bad rows; the first rule that
    isn't ends the list. Without bad rows, or without rows, the list is empty.
    """
    shares = [i / bins for i in range(bins + 1)]
    cuts: dict[str, list[float]] = {name: [] for name in FEATURES}
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(name, shares, 10_000).alias(name) for name in FEATURES]).collect()
    for name in FEATURES:
        values = sorted({value for row in quantiles for value in row[name] or []})
        cuts[name] = [(low + high) / 2 for low, high in zip(values, values[1:])]
    grow = F.pmod(F.xxhash64("id", F.lit("grow")), F.lit(3)) > 0
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        covered = left.where(grow)
        while len(conditions) < max_conditions:
            best = _best_condition(covered, cuts)
            if best is None:
                break
            condition, good = best
            conditions.append(condition)
            covered = covered.where(condition.column())
            if not good:
                break
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: i + 1])) for i in range(len(conditions))]
        sums = []
        for i, rule in enumerate(prefixes):
            for part, chosen in (("prune", ~grow), ("all", F.lit(True))):
                for bad in (0, 1):
                    sums.append(F.sum((rule.column() & chosen & (F.col("bad") == bad)).cast("int")).alias(f"{part}{bad}_{i}"))
        counts = left.agg(*sums).first().asDict()
        worth = [((counts[f"prune1_{i}"] - counts[f"prune0_{i}"]) / max(1, counts[f"prune1_{i}"] + counts[f"prune0_{i}"]), -i)
                 for i in range(len(prefixes))]
        chosen = -max(worth)[1]
        bad, good = counts[f"all1_{chosen}"], counts[f"all0_{chosen}"]
        if bad < least_covered or bad < least_purity * (bad + good):
            break
        rules.append(prefixes[chosen])
        left = left.where(~prefixes[chosen].column())
    return rules


def _best_condition(covered: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition with the highest gain, and how many good rows still meet it; None if none gains.

    Counts by feature and bin come from one aggregation; sums over bins give the counts of every threshold.
    """
    binned = []
    for name, limits in cuts.items():
        place = F.expr(f"size(filter(array({', '.join(f'{limit!r}D' for limit in limits)}), cut -> `{name}` > cut))")
        binned.append(F.struct(F.lit(name).alias("feature"), place.alias("bin")))
    counted = covered.select("bad", F.explode(F.array(*binned)).alias("f")).groupBy("f.feature", "f.bin").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    best, best_gain = None, 1e-9
    for name, limits in cuts.items():
        own = {row["bin"]: (row["bad"], row["good"]) for row in counted if row["feature"] == name}
        all_bad, all_good = (sum(pair[i] for pair in own.values()) for i in (0, 1))
        if not all_bad or not all_good:
            continue
        bad = good = 0
        for i, limit in enumerate(limits):  # bin i holds the values up to limit i
            bad, good = bad + own.get(i, (0, 0))[0], good + own.get(i, (0, 0))[1]
            for above, x, y in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                gain = _gain(x, y, all_bad, all_good)
                if gain > best_gain:
                    best, best_gain = (Condition(name, above, limit), y), gain
    return best


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text: the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` and ``kept``.

    A null, empty or blank text has no words and fails the base rule. Rows are independent: equal and repeated rows get
    equal results, an empty table gives none, and other columns don't matter.
    """
    counts = ", ".join(f"'{name}', s.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    body = f"named_struct({counts}, 'base_failed', {BASE_FAILED}, 'kept', {decision_sql(rules)})"
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text_of"))
    return source.select(id_col, F.expr(f"inline(array({bind(statistics_sql('text_of'), 's', body)}))"))


def only_kept(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.where(F.expr(bind(statistics_sql(text_col), "s", decision_sql(rules))))

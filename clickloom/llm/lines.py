"""Line deduplication: lines found on many sites are boilerplate, and only their first occurrence stays.

How far a line is spread is estimated by merging HyperLogLog sketches of the sites per line hash. Lines whose estimate is
near the threshold, where the sketch can err, get an exact distinct count; far below and far above it the estimate decides.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import reliable
from clickloom.llm.sql import bind

MIN_SITES = 4
SHORT_WORDS = 4
"""Lines of fewer words recur by chance; they count as boilerplate on ``SHORT_FACTOR`` times as many sites only."""
SHORT_FACTOR = 2
PRECISION = 10
"""lgConfigK of the sketches: a relative standard error of about 3 percent, none for the few sites of most lines."""
NEAR = 0.25
"""Estimates within this share of the threshold are counted exactly; that is eight standard errors."""
SPACE = r"\\x20\\x09-\\x0D"


def _hash(line: Column) -> Column:
    """128 bits of a line, white space at its ends left out: two hashes, so that different lines never share both."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit("line"), line).alias("y"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, place, site, x, y, short) of every line with a word; places count from 0.

    The patterns take time in proportion to the line: one looks for a character, the other is anchored and never goes back.
    """
    text = bind(f"coalesce(CAST(`{text_col}` AS STRING), '')", "t", (
        "filter(transform(split(t, '\\\\n', -1), (l, i) -> named_struct('i', i, 'l', trim(l), "
        f"'s', NOT l rlike '^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{SHORT_WORDS - 1}}}[^{SPACE}]')), p -> p.l rlike '[^{SPACE}]')"))
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.expr(text).alias("kept"))
    one = picked.select("id", "site", F.explode("kept").alias("p"))
    return one.select("id", F.col("p.i").alias("place"), "site", _hash(F.col("p.l")).alias("h"), F.col("p.s").alias("short")).select(
        "id", "place", "site", "h.x", "h.y", "short")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(x, y, first_id, first_place) of the lines on ``min_sites`` distinct sites or more (short ones: ``SHORT_FACTOR`` times as many),
    with where each stands first.

    A line is summed up per site before sketches are made, so a line on a site holding a third of all rows is one entry.
    """
    # Stored, as both the estimates and the exact counts are made from it: texts are split here once.
    by_site = reliable(lines.groupBy("x", "y", "site").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"),
                                                            F.first("short").alias("short")))
    spread = by_site.groupBy("x", "y").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(PRECISION))).alias("about"), F.min("first").alias("first"), F.sum("n").alias("n"),
        F.when(F.first("short"), min_sites * SHORT_FACTOR).otherwise(min_sites).alias("needed"))
    spread = spread.where("n > 1")
    sure = spread.where(F.col("about") > F.col("needed") * (1 + NEAR))
    near = spread.where((F.col("about") <= F.col("needed") * (1 + NEAR)) & (F.col("about") >= F.col("needed") * (1 - NEAR)))
    exact = by_site.join(near.select("x", "y"), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.countDistinct("site").alias("sites"))
    confirmed = near.join(exact, ["x", "y"]).where(F.col("sites") >= F.col("needed")).drop("sites")
    both = sure.unionByName(confirmed)
    return both.select("x", "y", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def deduplicate_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                      site_col: str = "source", count_col: str = "removed_lines") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, all columns and rows kept, and ``removed_lines`` (how many).

    A line is boilerplate if it stands on ``min_sites`` distinct sites or more, one of fewer than ``SHORT_WORDS`` words if on
    ``SHORT_FACTOR`` times as many; its first occurrence (lowest id, then place) stays, so nothing vanishes from the corpus.
    Lines are compared without blanks at their ends; lines without a word are never removed. Null texts stay null; a null site is a site of its own; rows of one id are
    treated alike, line by line; a null id is the lowest. A document of boilerplate only becomes empty, not null. An empty
    table stays empty. An existing column ``count_col`` is replaced; other columns may have any names.
    """
    own_id, places = unused(docs, "line_owner"), unused(docs, "line_places")
    lines = lines_of(docs, id_col, text_col, site_col)
    found = reliable(boilerplate(lines, min_sites))
    where = lines.join(found, ["x", "y"]).where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place"))))
    gone = where.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("place").alias(places))  # at most the lines of one document
    marked = docs.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)), "left")
    text = f"CAST(`{text_col}` AS STRING)"
    left = f"array_join(filter(split({text}, '\\\\n', -1), (l, i) -> NOT array_contains(`{places}`, i)), '\\n')"
    marked = marked.withColumn(count_col, F.coalesce(F.size(places), F.lit(0)))
    return marked.withColumn(text_col, F.expr(f"CASE WHEN `{places}` IS NULL THEN {text} ELSE {left} END")).drop(own_id, places)

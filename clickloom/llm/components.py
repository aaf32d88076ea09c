"""Connected components of a table of links, by contraction in Spark.

Each round every vertex hooks to its smallest neighbour if that is smaller than itself, chains of hooks are shortened by
joining the table of hooks with itself, and the links are rewritten between what is left. Every vertex that is not smaller
than all its neighbours goes, so the links shrink fast. Each round's tables are written in the shared folder: lost executors
cost one round. What a round asks about a table (is anything left, has anything moved) is counted while the table is written.
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.session import work_path


def reliable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in ``spark.checkpoint.dir``; a local session may leave that unset."""
    prepare(df.sparkSession)
    return df.checkpoint()


class Written:
    """A large intermediate table, written as Parquet in the shared folder. ``drop`` deletes it once nothing needs it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, work_path(df.sparkSession, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def counted(df: DataFrame, *sums: str) -> tuple[DataFrame, dict[str, int]]:
    """An intermediate table that is used more than once, written as Parquet in the shared folder and read again in as many
    partitions as its files call for. Its size in the plans to come is that of the files: a checkpoint would keep the estimate of
    the plan it came from, which rounds of joins multiply until its digits alone slow down the driver.

    The number of rows (``n``) and the sums of the named flags are counted while the table is written; a repeated task may count
    rows twice, so they tell nothing but whether there are any.
    """
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in sums])
    stored = Written(observed, "step").df
    return stored, {name: value or 0 for name, value in seen.get.items()}


def compact(df: DataFrame) -> DataFrame:
    """The table of ``counted``."""
    return counted(df)[0]


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps left behind. Spark deletes shuffle files and broadcasts once nothing on the driver refers to
    them, which it notices at a garbage collection; left alone, that may be half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prepare(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clickloom-checkpoint-"))


def components(links: DataFrame) -> DataFrame:
    """Columns ``vertex`` and ``root``, the smallest vertex of its component, for every vertex of a link.

    ``links`` has columns ``a`` and ``b`` of one type; direction, repetition, loops and nulls don't matter (a loop makes its
    vertex appear, a link with a null end is ignored). Without links the result is empty.
    """
    whole = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    left, seen = counted(whole.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = compact(whole.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root")))
    while seen["n"]:
        # b is the larger end of each link: it hooks to the smallest vertex it is linked to.
        hooks, moved = compact(left.groupBy("b").agg(F.min("a").alias("a"))), True
        while moved:
            # Twice as far, and twice that; most chains end before, and need no second turn.
            farther, told = counted(_shortened(_shortened(hooks).select("b", "a")), "moved")
            hooks, moved = farther.select("b", "a"), told["moved"] > 0
        at = hooks.select(F.col("b").alias("was"), F.col("a").alias("now"))
        roots = compact(roots.join(at, roots["root"] == at["was"], "left").select("vertex", F.coalesce("now", "root").alias("root")))
        left = left.join(at, left["a"] == at["was"], "left").select(F.coalesce("now", "a").alias("a"), "b")
        left = left.join(at, left["b"] == at["was"], "left").select("a", F.coalesce("now", "b").alias("b"))
        left, seen = counted(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots


def _shortened(hooks: DataFrame) -> DataFrame:
    """Each hook (b, a) put to where a hooks, and whether it ``moved``."""
    above = hooks.select(F.col("b").alias("a"), F.col("a").alias("next"))
    return hooks.join(above, "a", "left").select("b", F.coalesce("next", "a").alias("a"), F.col("next").isNotNull().alias("moved"))

"""Document fingerprints by spot signatures, in SQL expressions.

A signature is a common word (the anchor) with the chain of content words that follow it; a text's fingerprint is the set of
its signatures. Sets are compared by Jaccard similarity, which is returned as it is. Whether two sets are near duplicates is
decided by their lengths first: lengths fall into partitions so wide that sets more than one partition apart can't be as
alike as asked, and within that the bound from the lengths themselves prunes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.sql import bind

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui se sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el es esta las lo los para por su y"
).split()
CHAIN = 3
DISTANCE = 1
LEAST = 0.8
"""Likeness from which texts count as near duplicates."""
BUCKET = 1000
"""Ids whose documents are put in order together; a bucket holds no more documents than that, as ids are keys."""


def signatures_sql(text: str, chain: int = CHAIN, distance: int = DISTANCE, anchors: list[str] = ANCHORS) -> str:
    """SQL for the sorted distinct signatures of a text, each as a hash.

    The j-th anchor, at place p, has p - j content words before it, which is where its chain begins in the list of content
    words. Chains that the text's end cuts off give none. A text without any signature gets one of all its words, or of its
    characters if it has no word either; an empty one gets no signature.
    """
    listed = ", ".join(f"'{word}'" for word in dict.fromkeys(anchors))
    reach = (chain - 1) * distance + 1
    links = ", ".join(f"c[p - j + {i * distance}]" for i in range(chain))
    made = f"array_compact(transform(a, (p, j) -> if(p - j + {reach} <= size(c), xxhash64(w[p], {links}), NULL)))"
    places = f"filter(sequence(0, size(w) - 1), i -> w[i] IN ({listed}))"
    spots = bind(f"filter(w, v -> NOT (v IN ({listed})))", "c", bind(places, "a", made))
    whole = "array(if(size(w) = 0, xxhash64(x), xxhash64(array_join(w, ' '))))"
    some = bind(f"if(size(w) = 0, array(), {spots})", "s", f"if(size(s) = 0, if(x = '', s, {whole}), sort_array(array_distinct(s)))")
    words = "array_remove(split(lower(x), '[^\\\\p{L}\\\\p{N}]+', -1), '')"
    return bind(f"coalesce(CAST({text} AS STRING), '')", "x", bind(words, "w", some))


def fingerprint(signatures: Column) -> Column:
    """Digest of a signature set, equal for equal sets."""
    return F.sha2(F.concat_ws(",", F.transform(signatures, lambda s: s.cast("string"))), 256)


def length_partition(size: Column, least: float) -> Column:
    """Sets with a likeness of ``least`` or more are in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(1 / least)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, however small. Two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(common / (n + m - common))


def near(a: Column, b: Column, value: Column, least: float = LEAST) -> Column:
    """Whether the likeness ``value`` of two sets is ``least`` or more; lengths too far apart settle it without the value."""
    n, m = F.size(a), F.size(b)
    apart = F.abs(length_partition(n, least) - length_partition(m, least)) > 1
    return F.when(apart | ((F.greatest(n, m) > 0) & (F.least(n, m) / F.greatest(n, m, F.lit(1)) < least)), F.lit(False)).otherwise(value >= least)


def next_keys(keys: DataFrame) -> DataFrame:
    """For distinct long values ``key`` the next smaller one, and for the smallest the largest, as ``next``.

    Groups of 1000 keys are ordered in one task each; only the first key of each group goes into the order of the groups.
    """
    grouped = keys.select("key", F.floor(F.col("key") / 1000).alias("group"))
    tops = grouped.groupBy("group").agg(F.max("key").alias("top"))
    above = Window.orderBy(F.desc("group"))
    everything = above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("group", F.coalesce(F.lead("top").over(above), F.max("top").over(everything)).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("group").orderBy(F.desc("key")))
    return grouped.withColumn("inside", inside).join(tops, "group").select("key", F.coalesce("inside", "after").alias("next"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, Window]:
    """Documents dealt out by runs of ids, each run followed by the first document of the next; and the window they are in.

    Columns ``id``, ``text``, ``bucket`` and ``guest``; the guests are copies to look ahead to and are to be left out in the
    end. Texts are shuffled once, a guest for each ``bucket`` ids besides.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("id") / bucket), F.lit(-(2**62))))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).withColumn("bucket", F.coalesce(F.floor(F.col("id") / bucket), F.lit(-(2**62))))
    heads = ids.groupBy("bucket").agg(F.max("id").alias("head"))
    order = next_keys(heads.select(F.col("bucket").alias("key"))).select(F.col("next").alias("bucket"), F.col("key").alias("host"))
    hosts = heads.join(order, "bucket").select(F.col("bucket").alias("of"), "head", "host")
    guests = rows.join(hosts, (F.col("bucket") == F.col("of")) & F.col("id").eqNullSafe(F.col("head"))).select(
        "id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return both, Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    The edited text has its last half, rounded down, replaced by as many first characters of the next document (descending
    id; after the last the first), or by all it has. Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, the sizes of the two sets, and ``same_next``, whether the next
    document is a near duplicate by ``least``. A null text counts as empty; null
    ids come last; rows of one id follow each other by their text; a single document is its own next; equal texts have equal
    fingerprints; an empty table gives none.
    """
    rows, window = with_next(docs, id_col, text_col)
    ahead = rows.withColumn("next_text", F.lead("text").over(window))
    ahead = ahead.withColumn("own", F.expr(signatures_sql("text")))
    ahead = ahead.withColumn("next_own", F.lead("own").over(window)).where("NOT guest")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    ahead = ahead.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    ahead = ahead.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
                         F.expr(signatures_sql("edited")).alias("changed"))
    ahead = ahead.withColumn("near_next", likeness(F.col("own"), F.col("next_own")))
    return ahead.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        "near_next", F.size("own").alias("n_signatures"), F.size("changed").alias("n_edited_signatures"),
        near(F.col("own"), F.col("next_own"), F.col("near_next"), least).alias("same_next"))

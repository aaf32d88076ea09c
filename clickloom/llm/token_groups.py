"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups of a few dozen, and of each group the matrix holds the union of its tokens (hashes of
word shingles). A query set that is similar to a member shares at least ``ceil(percent * n / 100)`` of its n tokens with the
union of the member's group, so a group with less overlap need not be opened. Every bound used is exact; no pair is left
to chance but for equal 64-bit hashes of different shingles.

* Equal sets are one set from the start.
* The matrix is not looked up token by token of whole sets. Of each set the first tokens in the order of their hashes are
  taken, so many (``head_size``) that two similar sets have ``sure_common`` of them in common; among those the rarest are
  entered, so many that two similar sets still share one. Tokens of a common passage are frequent and thus left out, unless a
  set consists of little else; tokens of one set only lead nowhere. What remains names the few documents that can have links.
* Groups: sets with the same smallest hashes are compared in chunks of ``CHUNK``, then one of each set of linked ones goes on
  to the next round, until a key has one chunk. Copies with small changes, however many, thus become one component with some
  chunks' worth of comparisons each. A large component is divided into groups of its own; other sets are grouped by their
  smallest hash, so that texts which resemble each other without being linked are in few groups too.
* Lookup: where an entered token is held by several groups, those outside the component that holds most of them are paired with
  the others. Pairs within one component need no comparison, as only components are asked for.
* A token held by more than ``OFTEN`` groups pairs nothing. The sets that entered such a one, say as half of their tokens are a
  common passage, are looked at once more with all their tokens: of these the rarest are entered, so many that two similar sets
  share one, and no frequent one unless ``percent`` of a set's tokens are frequent.
* Each set of the smaller group of a pair is a query: its overlap with the union of the other group bounds its similarity to all
  its members. Groups that qualify are opened and their members compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import slices
from clickloom.llm.components import compact, components, release, reliable
from clickloom.llm.minhash import FILTER_BITS, _bitmap, full_sets, shingle_sets, sketches

CHUNK = 256
"""Members of a group, and sets that are compared with each other at once."""
TOKENS = 2_000_000
"""Tokens of a group's members together; a single set may have more."""
KEYS = 2
"""Smallest hashes of a set by which it meets others when groups are formed."""
OFTEN = 32
"""Groups that a token is held by at most to pair them at the first look."""
QUERIES = 1000
"""Queries that meet a copy of a group in one task."""
HOT_SHARE = 1e-4
"""Keys with more than this share of all rows are joined by themselves; there are at most 1 / HOT_SHARE."""


def required(n: int, percent: int) -> int:
    """Tokens a set of ``n`` shares at least with any similar set."""
    return -(-percent * n // 100)


def sure_common(n: int, percent: int) -> int:
    """Tokens that the heads of two similar sets of ``n`` or more have in common at least."""
    return min((100 - percent) * n // 100 + 1, required(n, percent))


def head_size(n: int, percent: int) -> int:
    """Length of a set's head. Of the tokens common to two similar sets, ``required`` or more, the ``sure_common``-th stands at this
    place at the latest, as the rest of them come after it."""
    return n - required(n, percent) + sure_common(n, percent)


def _entered(n: Column, percent: int) -> Column:
    """How many of the rarest tokens of its head a set enters: a similar set may be as small as ``required``, so that many heads'
    tokens are sure to be shared, and of those one is among the rarest so many of both."""
    need = F.ceil(n * percent / F.lit(100))
    common = lambda size: F.least(F.floor(size * (100 - percent) / F.lit(100)) + 1, F.ceil(size * percent / F.lit(100)))
    return (n - need + common(n) - common(need) + 1).cast("int")


def _entered_whole(n: Column, percent: int) -> Column:
    """The same where the head is the whole set: a similar set has ``required`` of its tokens."""
    return (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def heads(docs: DataFrame, chosen: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, copy, head) of the sets of the chosen ids, and of a few others: a bitmap decides which texts are worked on."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(chosen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("spot").to_numpy(zero_copy_only=False)
            hit = (bits.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1
            for part in slices(batch.take(pa.array(np.flatnonzero(hit))), "text"):
                sets = list(shingle_sets(part.column("text"), width))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(own) for own in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in sets], pa.binary()),
                     _lists([own[: head_size(len(own), percent)] for own in sets])], ["id", "n", "copy", "head"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    return source.withColumn("spot", spot).mapInArrow(work, f"id {kind}, n long, copy binary, head array<long>")


def _with_sizes(rows: DataFrame, sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the stored ``sizes`` of their keys. Few keys have a large share of the rows; those sizes are broadcast, so
    that no task gets all rows of such a key."""
    hot = F.col(size) > max(1, int(total * HOT_SHARE))
    return rows.join(sizes.where(~hot), key).unionByName(rows.join(F.broadcast(sizes.where(hot)), key))


def entries(headed: DataFrame, distinct: DataFrame, entered: Column) -> DataFrame:
    """(value, id, n) of the rare tokens each set enters, those of a single set left out. ``entered`` of its head's tokens are the
    rarest, by how many of the given heads have them."""
    every = headed.select("id", F.explode("head").alias("value"))
    counts = reliable(every.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"))
    total = headed.agg(F.sum(F.size("head"))).first()[0] or 0
    release(headed.sparkSession)  # the shuffle of the counts is as large as the next one
    shared = _with_sizes(every, counts, "value", "length", total)
    ranked = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("values"))  # one head's
    sizes = distinct.select("id", "n").join(headed.select("id", F.size("head").alias("held")).dropDuplicates(["id"]), "id")
    # Tokens of one set are the rarest of all: they take places first.
    room = entered - (F.col("held") - F.size("values"))
    left = ranked.join(sizes, "id").withColumn("room", room.cast("int")).where("room > 0")
    return left.select("id", "n", F.explode(F.slice("values", 1, F.col("room"))).alias("e")).select("e.value", "id", "n")


def _links_of(owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``left`` and ``right`` of the similar pairs among sets given as (owner, code) incidences, by matrix products."""
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(code.max(initial=-1)) + 1, 4096):
        inside = (code >= start) & (code < start + 4096)
        has = np.zeros((len(sizes), 4096), dtype=np.float32)
        has[owner[inside], code[inside] - start] = 1
        common += has[left] @ has[right].T
    shared = common.astype(np.int64)
    return np.nonzero(100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared))


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, sizes) of some sets: their tokens that at least two of them hold, numbered."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, code, seen = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    often = seen[code] > 1
    return np.repeat(np.arange(len(sizes)), sizes)[often], np.unique(code[often], return_inverse=True)[1].reshape(-1), sizes


def _chunk_roots(table: pa.Table, percent: int) -> np.ndarray:
    """For each row of a chunk the position of the row that stands for its component within the chunk."""
    owner, code, sizes = _coded(table.column("members").combine_chunks())
    every = np.arange(len(sizes))
    a, b = _links_of(owner, code, sizes, every, every, percent)
    root = every.copy()
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _chunks(rows: Column, tokens: Column) -> Column:
    """Into how many chunks so many sets with so many tokens are dealt."""
    return F.greatest(F.ceil(rows / CHUNK), F.ceil(tokens / TOKENS)).cast("int")


def gather(sets: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join most similar sets with the same key: rounds of comparisons in chunks.

    ``sets`` has (id, members), ``keyed`` (key, id, n). After a round one set of each component found goes on; a key leaves when it
    fits one chunk, or when a round left it more than half of its sets (they resemble each other little).
    """
    id_type, links, number = sets.schema["id"].dataType.simpleString(), [], 0
    while True:
        keyed = compact(keyed)
        counts = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
        counts = compact(counts.select("key", "size", _chunks(F.col("size"), F.col("tokens")).alias("chunks")))
        dealt = _with_sizes(keyed, counts, "key", "size", keyed.count())
        dealt = dealt.select("key", "id", "n", "size", "chunks", F.pmod(F.xxhash64("id", F.lit(number)), F.col("chunks")).alias("chunk"))

        def compare(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            stands = table.column("id").take(pa.array(_chunk_roots(table, percent)))
            return table.select(["key", "id", "n", "size", "chunks"]).append_column("root", stands)

        compared = dealt.join(sets, "id").groupBy("key", "chunk").applyInArrow(
            compare, f"key long, id {id_type}, n long, size long, chunks int, root {id_type}")
        compared = compact(compared)
        links.append(compared.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        standing = compared.where("id = root AND chunks > 1")
        left = compact(standing.groupBy("key").agg(F.count("*").alias("now"), F.max("size").alias("size")).where("now * 2 <= size").select("key", "now"))
        if left.isEmpty():
            break
        keyed = _with_sizes(standing.select("key", "id", "n"), left, "key", "now", standing.count()).select("key", "id", "n")
        number += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return compact(out.distinct())


def form_groups(active: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, n, root, grp, side): the group of each set. ``side`` is one for all groups of a large component, else the group itself;
    groups of one side need not be compared."""
    labelled = active.join(roots, F.col("id") == F.col("vertex"), "left").select("id", "n", F.col("sketch")[0].alias("key"), F.coalesce("root", "id").alias("root"))
    own = labelled.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") >= CHUNK)
    total = labelled.count()
    large = _with_sizes(labelled, compact(own), "root", "members", total)
    large = large.select("id", "n", "root", F.concat(F.lit("component "), F.col("root").cast("string")).alias("cluster"), F.lit(True).alias("whole"))
    small = labelled.join(large.select("id"), "id", "left_anti").select(
        "id", "n", "root", F.concat(F.lit("hash "), F.col("key").cast("string")).alias("cluster"), F.lit(False).alias("whole"))
    both = compact(large.unionByName(small))
    sizes = compact(both.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")))
    dealt = _with_sizes(both, sizes, "cluster", "size", total)
    group = F.concat_ws("/", "cluster", F.pmod(F.xxhash64("id"), _chunks(F.col("size"), F.col("tokens"))).cast("string"))
    return dealt.select("id", "n", "root", group.alias("grp"), F.when(F.col("whole"), F.col("cluster")).otherwise(group).alias("side"))


def _matrix(listed: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, grp, side) of the groups that hold a token, and (value, main, groups) of tokens held on several sides: the one with
    most groups, and how many there are."""
    matrix = compact(listed.select("value", "id").join(grouped.select("id", "grp", "side"), "id").select("value", "grp", "side").distinct())
    by_side = matrix.groupBy("value", "side").agg(F.count("*").alias("groups"))
    main = by_side.groupBy("value").agg(F.max(F.struct("groups", "side")).alias("m"), F.count("*").alias("sides"), F.sum("groups").alias("groups"))
    return matrix, compact(main.where("sides > 1").select("value", F.col("m.side").alias("main"), "groups"))


def _met(matrix: DataFrame, main: DataFrame) -> DataFrame:
    """(a, b), a before b: groups of different sides that hold one of the tokens in ``main``."""
    outside = matrix.join(main.select("value", "main"), "value").where("side <> main")
    other = matrix.select("value", F.col("grp").alias("grp_b"), F.col("side").alias("side_b"))
    met = outside.join(other, "value").where("side <> side_b AND (side_b = main OR grp < grp_b)")
    return met.select(F.least("grp", "grp_b").alias("a"), F.greatest("grp", "grp_b").alias("b")).distinct()


def candidates(listed: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(query, grp): sets and the groups they are to be compared with. ``listed`` has (value, id, n), ``grouped`` is that of
    ``form_groups``. Two groups meet if they hold an entered token in common and their sizes allow for similarity, a group
    meets itself if it holds sets of several components; the sets of the smaller one become the queries.

    Of two similar sets the rarest token common to their heads is entered by both. If many groups hold it, both sets are among
    those that entered a frequent token, and meet at the second look.
    """
    about = compact(grouped.groupBy("grp", "side").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("root") != F.max("root")).alias("mixed")))
    matrix, main = _matrix(listed, grouped)
    met = _met(matrix, main.where(F.col("groups") <= OFTEN))
    often = main.where(F.col("groups") > OFTEN).select("value", "groups")
    again = compact(_with_sizes(listed.select("value", "id"), often, "value", "groups", listed.count()).select("id").distinct())
    if not again.isEmpty():
        whole = sets.join(again, "id", "left_semi").select("id", F.col("members").alias("head"))
        second = compact(entries(whole, grouped.select("id", "n"), _entered_whole(F.col("n"), percent)))
        met = met.unionByName(_met(*_matrix(second, grouped))).distinct()
    for end in "ab":
        met = met.join(about.select(F.col("grp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "least", "most")]), end)
    near = (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent)
    fewer = F.col("size_a") <= F.col("size_b")
    met = met.where(near).select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("asking"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("grp"))
    met = met.unionByName(about.where("mixed").select(F.col("grp").alias("asking"), "grp"))
    return met.join(grouped.select(F.col("grp").alias("asking"), F.col("id").alias("query")), "asking").select("query", "grp")


def open_groups(pairs: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the pairs of query and group: the bound first, then the members of groups that qualify.

    The queries of a group are dealt into parts of about ``QUERIES``, each of which gets the group's sets once.
    """
    asked = pairs.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slots"))
    asking = pairs.join(asked, "grp").select(
        "grp", F.pmod(F.xxhash64("query"), F.col("slots")).cast("int").alias("slot"), F.col("query").alias("id"), F.lit(True).alias("asks"))
    members = grouped.select("grp", "id").join(asked, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "id", F.lit(False).alias("asks"))
    both = asking.unionByName(members).join(sets, "id")
    id_type = sets.schema["id"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        asks, lists = table.column("asks").to_numpy(), table.column("members").combine_chunks()
        queries, held = np.flatnonzero(asks), np.flatnonzero(~asks)
        union = np.unique(lists.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False))
        asked_sets = lists.take(pa.array(queries))
        sizes = asked_sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.isin(asked_sets.flatten().to_numpy(zero_copy_only=False), union)
        overlap = np.bincount(np.repeat(np.arange(len(queries)), sizes)[inside], minlength=len(queries))
        queries = queries[100 * overlap >= percent * sizes]
        owner, code, size = _coded(lists.take(pa.array(np.concatenate([queries, held]))))
        every = np.arange(len(size))
        x, y = _links_of(owner, code, size, every[: len(queries)], every[len(queries) :], percent)
        ids = table.column("id").combine_chunks()
        a, b = ids.take(pa.array(queries[x])), ids.take(pa.array(held[y]))
        apart = pc.not_equal(a, b)
        return pa.table({"a": a.filter(apart), "b": b.filter(apart)})

    return both.groupBy("grp", "slot").applyInArrow(compare, f"a {id_type}, b {id_type}")


def join_by_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links. Words are runs of characters other
    than ASCII white space, A-Z in lower case; fewer than ``width`` words make one shingle. A text without words, or null, has an
    empty set and is linked with nothing. Ids are keys: repeated rows of one id share its component, and if they differ in
    text, the set with the smallest digest stands for the id. A null id stays null and is linked with nothing. An empty table
    gives none. Other columns, whatever their names, play no part. ``percent`` is 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    known = reliable(sketches(docs, width, id_col, text_col, KEYS))
    present = known.where("n > 0 AND id IS NOT NULL")
    several = present.groupBy("id").agg(F.min("copy").alias("first"), F.max("copy").alias("last")).where("first <> last").select("id", "first")
    present = present.join(several, "id", "left").where("first IS NULL OR copy = first").drop("first")
    distinct = reliable(present.groupBy("copy").agg(F.min(F.struct("id", "n", "sketch")).alias("s")).select("copy", "s.id", "s.n", "s.sketch"))
    headed = heads(docs, distinct, width, percent, id_col, text_col).where("n > 0")
    headed = reliable(headed.join(distinct.select("id", "copy"), ["id", "copy"], "left_semi").dropDuplicates(["id"]).select("id", "head"))
    release(docs.sparkSession)
    listed = compact(entries(headed, distinct, _entered(F.col("n"), percent)))
    release(docs.sparkSession)
    active = compact(distinct.join(listed.select("id").distinct(), "id", "left_semi"))
    sets = reliable(full_sets(docs, active.select("id", "copy"), width, id_col, text_col))
    links = gather(sets, active.select("id", "n", F.explode("sketch").alias("key")), percent)
    grouped = compact(form_groups(active, components(links)))
    release(docs.sparkSession)
    pairs = compact(candidates(listed, grouped, sets, percent))
    links = compact(links.unionByName(open_groups(pairs, grouped, sets, percent)))
    roots = components(links)
    label = distinct.join(roots.withColumnRenamed("vertex", "id"), "id", "left").select("copy", F.coalesce("root", "id").alias("root"))
    copies = present.select("id", "copy").distinct().join(label, "copy").select(F.col("id").alias("of"), "root")
    out = known.join(copies, (F.col("id") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))

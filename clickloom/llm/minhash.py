"""Near duplicates by bottom-k sketches from one hash function.

The sketch of a set is its ``k`` smallest hashes. Two sets of Jaccard similarity 0.8 or more share at least ``least`` of
them: of the ``k`` smallest hashes of the union each is in both sets with probability 0.8, and the chance of fewer than 20
of 48 is 1e-8 at exactly 0.8 and less above. A set of at most ``k`` elements is its own sketch, and the number it shares at
least with any similar set is exact, also where the other set is larger and shows only its ``k`` smallest hashes. From that
follow the steps.

* Copies (equal sets) are grouped by a digest of the set; from here on only one of each group takes part.
* Inverted lists: each sketch enters the lists of its rarest values, so many that two sketches which share ``least`` values
  meet in one of them. Values of one set make no lists. An entry carries 256 bits, one set for each value that its sketch
  shares with any other, and how many of them a similar set may lack. Two sets that meet are a pair only if neither lacks
  more of the other's bits, which is told while lists are joined: the more sets there are, the more of them meet by chance in
  values that many texts have, and those never leave the join.
* The pairs of short lists are filtered by set size, bits and the share of the union sketch, then confirmed on the full sets:
  first each set's nearest, then those whose ends are not connected by then.
* A long list may hold many near copies of one text, and is not turned into all its pairs. Its sets are compared with a few
  leaders, those that share most; then only sets that no leader is linked to meet the rest, in blocks, by size and bits. No
  pairs are made there, as texts of one template, alike but not enough, might make a great many: the sets that still may have
  a partner are taken whole and compared in blocks, by one matrix product a block, and only links come out.
* Components of the confirmed links; copies follow the set they stand for.

Joins with tables that grow with the input are merge joins by hint: a broadcast chosen at run time would put them through the
driver's memory just below the session's limit, several at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import ascii_words, slices
from clickloom.llm.components import Written, compact, components, counted, release

K = 48
LEAST = 20
LONG_LIST = 40
"""Lists of more sets meet leaders first."""
LEADERS = 4
BLOCK = 1000
"""Entries of a long list that meet as many others in one group."""
MATRIX = 250
"""Full sets of a crowd that are compared with as many others at once."""
BITS = ("bits_0", "bits_1", "bits_2", "bits_3")
ENTRY = ("id", "n", "left", *BITS)
"""What is known of a set where it meets others: ``left`` is more than it may lack of a similar set's bits."""
FILTER_BITS = 1 << 25
"""Size of the bitmap that keeps most unwanted documents out of a shuffle: 4 MB, whatever the input."""

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(33)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _C)) * _B
    return values ^ (values >> _C)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The hashes of each text's distinct shingles of ``width`` words, ascending; with fewer words all make one shingle."""
    words = ascii_words(texts)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in words.distinct), dtype=np.uint64, count=len(words.distinct))
    values = names[words.code] if len(words.code) else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(np.bincount(words.text, minlength=len(texts)))
    for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
        own = values[start:end]
        n = min(width, len(own))
        if not n:
            yield own
            continue
        mixed = np.full(len(own) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            mixed = _mix(mixed * _A + own[i : len(own) - n + 1 + i])
        yield np.unique(mixed)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per document the id, ``n`` (size of its set), ``copy`` (digest of the set) and the ``k`` smallest hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, digests, smallest = [], [], []
                for own in shingle_sets(part.column("text"), width):
                    n.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    smallest.append(own[:k].view(np.int64))
                ends = np.cumsum([0, *map(len, smallest)])
                flat = pa.array(np.concatenate(smallest) if smallest else np.zeros(0, np.int64), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n", "copy", "sketch"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, n long, copy binary, sketch array<long>")


def _spot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def _bit_rows(ids: DataFrame) -> DataFrame:
    """(row, bits): a bit for each hash of an id, ``FILTER_BITS`` in all; built by the tasks, 4 KB a row."""
    spots = ids.select(_spot("id").alias("spot"))
    return spots.groupBy(F.floor(F.col("spot") / 32768).alias("row")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """The table of ``_bit_rows`` as one array."""
    out = np.zeros((FILTER_BITS // 32768, 4096), dtype=np.uint8)
    for row in _bit_rows(ids).toLocalIterator():
        out[row["row"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose id is surely none of ``ids`` (column id), nulls among them, and the others: those of ``ids`` and a few by chance.
    A bitmap decides, broadcast as a table, so no text is shuffled for it."""
    spot, row, bits = F.col("spot_of_id"), F.col("bit_row"), F.col("bits_of_row")
    told = F.broadcast(_bit_rows(ids).select(F.col("row").alias("bit_row"), F.col("bits").alias("bits_of_row")))
    # All columns travel as one, so that theirs and these can't be of one name.
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _spot(id_col).alias("spot_of_id"))
    held = packed.join(told, F.floor(spot / 32768) == row, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.floor(spot / 8) % 4096 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    caught = F.coalesce(F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2 == 1, F.lit(False)) & F.col(f"doc.{id_col}").isNotNull()
    return held.where(~caught).select("doc.*"), held.where(caught).select("doc.*")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, members) for the wanted (id, copy): the full set of each. Only sets that may be wanted are made and shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("spot").to_numpy(zero_copy_only=False)
            hit = (bits.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1
            for part in slices(batch.take(pa.array(np.flatnonzero(hit))), "text"):
                sets = [own.view(np.int64) for own in shingle_sets(part.column("text"), width)]
                digests = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), lists], ["id", "copy", "members"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()
    made = source.withColumn("spot", _spot("id")).mapInArrow(work, f"id {kind}, copy binary, members array<long>")
    return made.join(wanted.hint("merge"), ["id", "copy"], "left_semi").dropDuplicates(["id", "copy"]).select("id", "members")


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def inverted_lists(sets: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """(value and ``ENTRY``) of the lists each sketch enters; values of one set only are left out.

    A sketch with s values that must share m of them enters the lists of its s - m + 1 rarest values. A value is as rare as the
    number of sets that have it in their sketch.
    """
    entries = sets.select("id", F.explode("sketch").alias("value"))
    lengths = entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    shared = entries.join(lengths, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("values"))
    held = F.size("sketch")
    # A similar set is at most 100 / percent times as large. Within k it shares percent of n; beyond, up to n * 100 / percent - k
    # of its hashes are hidden, and if all of n are in it, as many of them may be among the hidden ones.
    seen = F.ceil(k - F.col("n") * (100 - percent) / F.lit(float(percent)))
    must = F.when(F.col("n") <= k, F.least(F.ceil(held * percent / F.lit(100.0)), seen)).otherwise(F.lit(least))
    rooms = sets.select("id", "n", held.alias("held"), (held - F.greatest(must, F.lit(1)) + 1).alias("room"))
    # Values of one set are the rarest: they fill the room first, the shared ones have what is left. At most k values a set.
    left = (F.col("room") - (F.col("held") - F.size("values"))).cast("int")
    word = "aggregate(values, 0L, (b, v) -> IF(shiftright(v.value, 6) & 3 = {}, b | shiftleft(1L, CAST(v.value & 63 AS INT)), b))"
    return shared.join(rooms.hint("merge"), "id").withColumn("left", left).where("left > 0").withColumns(
        {name: F.expr(word.format(i)) for i, name in enumerate(BITS)}).select(*ENTRY, F.explode(F.slice("values", 1, F.col("left"))).alias("entry")).select(F.col("entry.value").alias("value"), *ENTRY)


def _other(sets: DataFrame) -> DataFrame:
    """The sets of a list as those that others meet: the columns of ``ENTRY`` by other names."""
    return sets.withColumnsRenamed({name: f"other_{name}" for name in ENTRY})


def _lacks(one: str, other: str) -> Column:
    """How many bits of one set the other has not."""
    return F.expr(" + ".join(f"bit_count({one}{name} & ~{other}{name})" for name in BITS))


def _may_be_alike(k: int, percent: int) -> Column:
    """Whether sizes and bits allow a set and its ``_other`` to be alike.

    If both are beyond k their sketches share ``least`` values or they are no pair, so each lacks less than ``left`` of the
    other's. A set within k lacks less of any similar set's; what a larger one lacks of it, nothing is known of.
    """
    sides = [(F.col(f"{a}n") > k) & (F.col(f"{b}n") <= k) | (_lacks(a, b) < F.col(f"{a}left")) for a, b in (("", "other_"), ("other_", ""))]
    return _size_fits(F.col("n"), F.col("other_n"), percent) & sides[0] & sides[1]


def _pair() -> list[Column]:
    return [F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")]


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    for end in "ab":
        pairs = pairs.join(full.select(F.col("id").alias(end), F.col("members").alias(f"m_{end}")).hint("merge"), end)
    both = F.size(F.array_intersect("m_a", "m_b"))
    return pairs.where(both * 100 >= (F.size("m_a") + F.size("m_b") - both) * percent).select("a", "b")


def _likely(pairs: DataFrame, sets: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs (a, b) whose sketches share enough of their union's, and how many values those are (``common``)."""
    for end in "ab":
        own = sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(own.hint("merge"), end)
    bottom = F.slice(F.sort_array(F.array_distinct(F.concat("sketch_a", "sketch_b"))), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), bottom))
    small = (F.col("n_a") <= k) | (F.col("n_b") <= k)  # the exact test follows; its bound isn't that of two sketches
    return pairs.withColumn("common", common).where(small | (F.col("common") >= least)).select("a", "b", "common")


def _nearest(likely: DataFrame) -> DataFrame:
    """Of each set's likely pairs (a, b) with smaller ids the one that shares most: a pair a set at most, enough to connect most
    groups."""
    return likely.groupBy("b").agg(F.min(F.struct((-F.col("common")).alias("apart"), "a")).alias("m")).select("m.a", "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component yet."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("vertex").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _short_pairs(lists: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the short lists that may be alike, each once."""
    short = lists.join(sizes.where(F.col("size") <= LONG_LIST).select("value").hint("merge"), "value")
    return short.join(_other(short).hint("merge"), "value").where((F.col("id") < F.col("other_id")) & _may_be_alike(k, percent)).select(*_pair()).distinct()


def _led(long_lists: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of each set in long lists with a few leaders of the longest of them: sets that are in most long lists."""
    known = F.first(F.struct(*ENTRY[1:])).alias("known")
    spread = long_lists.groupBy("id").agg(known, F.count("*").alias("lists"), F.max(F.struct("size", "value")).alias("longest"))
    spread = compact(spread.select("id", "known.*", "lists", F.col("longest.value").alias("value")))
    by_list = spread.groupBy("value", F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("part"))
    leaders = by_list.agg(F.max(F.struct("lists", F.xxhash64("id").alias("h"), *ENTRY)).alias("l"))
    leaders = _other(leaders.select("value", *[f"l.{name}" for name in ENTRY]))
    return spread.join(leaders, "value").where((F.col("id") != F.col("other_id")) & _may_be_alike(k, percent)).select(*_pair()).distinct()


def _open_sets(long_lists: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """The ids of the sets that meet, in a long list, one they may be alike to and that is in another component.

    Of each list the sets outside its largest component meet all, in blocks of ``BLOCK`` by ``BLOCK``; each block is a group of
    its own, so that a list spreads over tasks however large it is. A set is looked for one partner, so no pairs come out.
    """
    rooted = long_lists.join(roots.hint("merge"), long_lists["id"] == roots["vertex"], "left").select("value", *ENTRY, F.coalesce("root", "id").alias("root"))
    main = rooted.groupBy("value", "root").agg(F.count("*").alias("size")).groupBy("value").agg(
        F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("size")).where("m.size < size")
    blocks = lambda count: F.ceil(count / BLOCK).cast("int")
    main = main.select("value", F.col("m.root").alias("main"), blocks(F.col("size")).alias("rows"), blocks(F.col("size") - F.col("m.size")).alias("columns"))
    dealt = compact(rooted.join(main.hint("merge"), "value").withColumn("outside", F.col("root") != F.col("main")).drop("main"))
    place = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asking = dealt.where("outside").select("value", *ENTRY, "root", place("columns").alias("column"), every("rows").alias("row"))
    asked = dealt.select("value", *ENTRY, F.col("root").alias("other_root"), "outside", every("columns").alias("column"), place("rows").alias("row"))
    asked = _other(asked)

    def meeting(one: DataFrame, two: DataFrame) -> DataFrame:
        same = [F.col(f"one.{name}") == F.col(f"two.{name}") for name in ("value", "row", "column")]
        alike = (F.col("root") != F.col("other_root")) & _may_be_alike(k, percent)
        return one.alias("one").join(two.alias("two").hint("merge"), [*same, alike], "left_semi")

    inside = meeting(asked.where("NOT outside"), asking).select(F.col("other_id").alias("id"))
    return meeting(asking, asked).select("id").unionByName(inside).distinct()


def _crowd_links(long_lists: DataFrame, roots: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between sets of a long list that the leaders have not put into one component.

    Long lists with the same largest component are one crowd. Its sets outside that component meet all its sets, in blocks
    of ``MATRIX`` by ``MATRIX``; each block is a group of its own, so that a crowd spreads over tasks however large it is.
    """
    rooted = long_lists.join(roots, long_lists["id"] == roots["vertex"], "left").select("value", "id", F.coalesce("root", "id").alias("root"))
    main = rooted.groupBy("value", "root").agg(F.count("*").alias("size")).groupBy("value").agg(
        F.max(F.struct("size", "root")).alias("m")).select("value", F.col("m.root").alias("crowd"))
    members = rooted.join(main, "value").select("crowd", "id", (F.col("root") != F.col("crowd")).alias("outside")).distinct()
    members = compact(members)
    sizes = members.groupBy("crowd").agg(F.count("*").alias("size"), F.sum(F.col("outside").cast("int")).alias("out")).where("out > 0")
    blocks = lambda count: F.ceil(F.col(count) / MATRIX).cast("int")
    dealt = members.join(sizes, "crowd").select(
        "crowd", "id", "outside", F.pmod(F.xxhash64("id"), blocks("size")).cast("int").alias("row"),
        F.pmod(F.xxhash64("id"), blocks("out")).cast("int").alias("column"), blocks("size").alias("rows"), blocks("out").alias("columns"))
    asking = dealt.where("outside").select("crowd", "id", F.lit(True).alias("asks"), "column", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    asked = dealt.select("crowd", "id", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "row")
    both = asking.unionByName(asked).join(full, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        lists = table.column("members").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        asks = table.column("asks").to_numpy()
        _, code, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner, often = np.repeat(np.arange(len(ids)), sizes), seen[code] > 1
        owner, code = owner[often], np.unique(code[often], return_inverse=True)[1]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        for start in range(0, int(code.max(initial=-1)) + 1, 4096):
            own = (code >= start) & (code < start + 4096)
            has = np.zeros((len(ids), 4096), dtype=np.float32)
            has[owner[own], code[own] - start] = 1
            common += has[a] @ has[b].T
        common = common.astype(np.int64)
        x, y = np.nonzero(common * 100 >= (sizes[a][:, None] + sizes[b][None, :] - common) * percent)
        left, right = ids[a[x]], ids[b[y]]
        apart = left != right
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(left[apart].tolist(), kind), "b": pa.array(right[apart].tolist(), kind)})

    kind = full.schema["id"].dataType.simpleString()
    return both.groupBy("crowd", "row", "column").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    k: int = K, least: int = LEAST) -> DataFrame:
    """Groups documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more, or that are
    connected by such documents.

    Returns the id, ``n_shingles``, ``component_id`` (smallest id of the group) and ``kept`` (whether that is the document's
    own). Words are runs of characters other than ASCII white space, A-Z in lower case. A text without words, or null, has
    an empty set and is linked with nothing. Ids are keys: repeated rows of one id share its fate, and if they differ in
    text, the set with the smallest digest stands for the id. A null id stays null, is linked with nothing and kept. An empty
    table gives none. ``k`` and ``least`` hold for 80 percent and more; a lower percentage needs others.
    """
    if percent < 80 and (k, least) == (K, LEAST):
        raise ValueError("below 80 percent choose k and least anew")
    read = Written(sketches(docs, width, id_col, text_col, k), "sketches")
    present = read.df.where("n > 0 AND id IS NOT NULL")
    other = present.groupBy("id").agg(F.min("copy").alias("copy"), F.max("copy").alias("high")).where("copy <> high").select("id", F.col("copy").alias("first"))
    present = present.join(other, "id", "left").where("first IS NULL OR copy = first").drop("first")
    first = present.groupBy("copy").agg(F.min(F.struct("id", "n", "sketch")).alias("s")).select("copy", "s.id", "s.n", "s.sketch")
    sketched = Written(first, "sets")
    known = Written(read.df.select("id", "n", "copy"), "known").df
    present = Written(present.select("id", "copy").distinct(), "copies").df
    read.drop()
    release(docs.sparkSession)
    lists = compact(inverted_lists(sketched.df, k, least, percent))
    release(docs.sparkSession)
    sizes = compact(lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"))
    release(docs.sparkSession)
    likely = compact(_likely(_short_pairs(lists, sizes, k, percent), sketched.df, k, least))
    sets = Written(sketched.df.select("id", "copy"), "heads").df
    sketched.drop()
    release(docs.sparkSession)
    long_lists, told = counted(lists.join(sizes.where(F.col("size") > LONG_LIST).hint("merge"), "value"))
    some_long = told["n"] > 0
    first = _nearest(likely)
    if some_long:
        first = first.unionByName(_led(long_lists, k, percent)).distinct()

    def whole(ids: DataFrame) -> Written:
        """The full sets of the ids."""
        wanted = compact(sets.join(ids.distinct().hint("merge"), "id", "left_semi"))
        made = Written(full_sets(docs, wanted, width, id_col, text_col), "full-sets")
        release(docs.sparkSession)
        return made

    ends = F.explode(F.array("a", "b")).alias("id")
    first = compact(first)
    compared = whole(first.select(ends))
    links = compact(_linked(first, compared.df, percent))
    compared.drop()
    release(docs.sparkSession)
    # Pairs whose ends the first links connect would change no component: only the others are compared as well.
    roots = components(links)
    more = compact(_between(likely, roots))
    wanted = more.select(ends)
    if some_long:
        still = compact(_open_sets(long_lists, roots, k, percent))
        wanted = wanted.unionByName(still)
    release(docs.sparkSession)
    compared = whole(wanted)
    links = links.unionByName(compact(_linked(more, compared.df, percent)))
    release(docs.sparkSession)
    if some_long:
        crowded = long_lists.select("value", "id").join(still.hint("merge"), "id", "left_semi")
        links = links.unionByName(_crowd_links(crowded, roots, compared.df, percent))
    links = compact(links)
    compared.drop()
    release(docs.sparkSession)
    roots = components(links)
    label = sets.join(roots.select(F.col("vertex").alias("id"), "root"), "id", "left").select("copy", F.coalesce("root", "id").alias("root"))
    label = present.join(label.hint("merge"), "copy").select(F.col("id").alias("of"), "root")
    out = known.join(label.hint("merge"), (F.col("id") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

"""Best-fit packing of documents into sequences of several permitted lengths.

The pieces of documents are dealt by a hash into groups of bounded size, which Spark packs side by side. Within a group,
pieces go by decreasing length into the open bin they fill best. If none has room, a bin is opened: of all permitted
lengths the one with the least cost for what it is expected to hold, which a histogram of the pieces still to come tells. In
the end each bin is cut down to the cheapest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import counted

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32.0
"""Cost of a sequence besides its length, in the same unit: a sequence too many costs something even if short."""
PIECES_PER_GROUP = 20_000
CLASSES = 64
"""Classes of sizes in the histogram of the pieces still to come."""


class Bin(NamedTuple):
    capacity: int
    pieces: list[int]


def cost(capacity: int, overhead: float = OVERHEAD) -> float:
    return capacity + overhead


class Ahead:
    """How many pieces of each class of sizes are still to come, and their total size."""

    def __init__(self, sizes: list[int], longest: int):
        self.width = -(-longest // CLASSES)
        self.count, self.total = [0] * (CLASSES + 1), [0] * (CLASSES + 1)
        for size in sizes:
            self.add(size, 1)

    def add(self, size: int, times: int) -> None:
        at = size // self.width
        self.count[at] += times
        self.total[at] += times * size

    def filled(self, room: int) -> int:
        """What of the room the pieces still to come would fill if they went in by class, the largest first."""
        left = room
        for at in range(min(room // self.width, CLASSES), -1, -1):
            if self.count[at]:
                mean = max(1, self.total[at] // self.count[at])
                left -= min(self.count[at], left // mean) * mean
        return room - left


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD) -> list[Bin]:
    """Bins of indexes into ``sizes``, which are positive and at most the longest permitted length."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ahead = Ahead(sizes, lengths[-1])
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    bins: list[list[int]] = []
    for i in order:
        size = sizes[i]
        ahead.add(size, -1)
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            # What a length would hold: this piece and what those to come would fill of the rest.
            number, room = len(bins), min((c for c in lengths if c >= size), key=lambda c: (cost(c, overhead) / (size + ahead.filled(c - size)), c))
            bins.append([])
        bins[number].append(i)
        if room > size:
            insort(rooms, (room - size, number))
    out = []
    for content in bins:
        total = sum(sizes[i] for i in content)
        out.append(Bin(min((c for c in lengths if c >= total), key=lambda c: (cost(c, overhead), c)), content))
    return out


def pieces_of(docs: DataFrame, length_sql: str, longest: int, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, size): documents cut where they exceed ``longest``; those without length have no piece."""
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(F.expr(length_sql), F.lit(0)).cast("long").alias("length")).where("length > 0")
    cut = sized.select("id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / longest))).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("length") - start).cast("int").alias("size"))


def pack_documents(docs: DataFrame, length_sql: str = "octet_length(text)", lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD,
                   id_col: str = "doc_id") -> DataFrame:
    """Where each piece of each document goes: the id, ``piece``, ``start``, ``size``, ``bin``, ``capacity``, ``bin_start``.

    ``length_sql`` is a document's length; by default its UTF-8 bytes, the tokens of a byte-level vocabulary. Documents
    longer than the longest permitted length are cut into pieces of it; nothing is dropped, padded in between or truncated.
    Documents without length (null or empty text) need no place and have no row. ``bin`` is unique over all groups. Repeated
    rows are packed each; ties go by id and piece; a null id is packed like any other; an empty table gives none. The number
    of groups follows the number of pieces, and a hash of id, piece, size and a row's copy deals them, so groups are equally
    large, also where many rows have one id or none: equal pieces are counted first and numbered.
    """
    pieces = pieces_of(docs, length_sql, max(lengths), id_col)
    equal, seen = counted(pieces.groupBy("id", "piece", "start", "size").agg(F.count("*").alias("copies")), "copies")
    groups = max(1, -(-seen["copies"] // PIECES_PER_GROUP))
    kind = pieces.schema["id"].dataType.simpleString()

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("piece", "ascending"), ("id", "ascending")])
        sizes = table.column("size").to_pylist()
        group = table.column("group")[0].as_py()
        number, capacity, start = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for i, content in enumerate(pack(sizes, lengths, overhead)):
            at = 0
            for piece in content.pieces:
                number[piece], capacity[piece], start[piece] = i * groups + group, content.capacity, at
                at += sizes[piece]
        out = table.select(["id", "piece", "start", "size"])
        for name, values, type_ in (("bin", number, pa.int64()), ("capacity", capacity, pa.int32()), ("bin_start", start, pa.int32())):
            out = out.append_column(name, pa.array(values, type_))
        return out.rename_columns([id_col, *out.column_names[1:]])

    # Hashes of the content and the copy's number: a retried task deals its rows as before.
    copies = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = copies.select("id", "piece", "start", "size", F.pmod(F.xxhash64("id", "piece", "size", "copy"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(
        pack_group, f"`{id_col}` {kind}, piece long, start long, size int, bin long, capacity int, bin_start int")

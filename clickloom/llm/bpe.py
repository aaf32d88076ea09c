"""Byte-level BPE as a transducer determinised while texts are read, and its streaming decoder.

A rank file defines which neighbouring tokens a merge procedure would leave apart: two tokens can be neighbours exactly
if merging the bytes of both gives back these two, and a sequence of tokens is the encoding of its bytes exactly if all
its neighbours can be. So the encoding is the one path through a non-deterministic transducer whose states are
(last token, place in the trie of token bytes). A state of the determinised one is the set of hypotheses still alive. No
hypothesis reaches back further than the longest token, so the lookahead is bounded.

* Pieces of text not seen before are read side by side, a byte of each at a time: the hypotheses of all of them are rows of
  numpy arrays. Exactly one ends with a whole token after each byte, as every beginning has one encoding; where it began is
  kept, and the tokens are read off from the end.
* A long piece is read by itself, with a table of states: each is a set of hypotheses with the tokens not yet emitted, and
  tokens are emitted as soon as all hypotheses agree on them. A full table is begun anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import slices

MAX_STATES = 40_000
"""States of the table by which long pieces are read, per task."""
MAX_PIECES = 300_000
"""Pieces of text whose encoding is remembered per task, besides those of the texts at hand."""
MAX_PAIRS = 1_000_000
"""Pairs of tokens whose verdict is remembered per task."""
LONG = 256
"""Bytes from which on a piece is read by itself."""

NONE = -1
START: tuple = ((NONE, (), 0),)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and one rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Table:
    """Map of non-negative integers, given at once, to integers, for lookups by the array; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


class Encoder:
    """Encodes pieces of text. Every single byte must be a token, and every token must rank after the two it is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [byte for byte in range(256) if bytes([byte]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} of the 256 single bytes have no rank")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: node and byte (node << 8 | byte) to the next node.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [NONE]
        self.pairs: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(NONE)
            self.token_at[node] = rank
        self._begin()
        self._tables()
        self._known: dict[str, _Known] = {}

    def _begin(self) -> None:
        self.states: dict[tuple, int] = {START: 0}
        self.hypotheses: list[tuple] = [START]
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _tables(self) -> None:
        """What ``encode_all`` looks up: edges of the trie, pairs of tokens that make a token, and the pair a token is merged from."""
        edges = np.array(list(self.child), np.int64)
        self.edges = _Table(edges, np.array(list(self.child.values()), np.int64))
        self.tokens, self.inner = np.array(self.token_at, np.int32), np.zeros(len(self.token_at), bool)
        self.inner[edges >> 8] = True
        size = max(self.bytes_of) + 1
        self.made, self.first, self.second = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs, merged, ranks = [], [], self.ranks
        for token, rank in ranks.items():
            if len(token) > 1:
                cuts = [at for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks]
                pairs += [ranks[token[:at]] << 32 | ranks[token[at:]] for at in cuts]
                merged += [rank] * len(cuts)
                one, two = (token[: cuts[0]], token[cuts[0] :]) if len(cuts) == 1 else self._split(token)
                self.made[rank], self.first[rank], self.second[rank] = rank, ranks[one], ranks[two]
        if (np.maximum(self.made[self.first], self.made[self.second]) > self.made).any():
            raise ValueError("a token ranks before one that it is merged from")
        self.lists = self.made.tolist(), self.first.tolist(), self.second.tolist()
        self.merges = _Table(np.array(pairs, np.int64), np.array(merged, np.int64))
        # The last pair whose verdict fell on a slot: twice its number, and one more if the two can be neighbours.
        self.verdicts = np.full(MAX_PAIRS, -1, np.int64)

    def known(self, pattern: regex.Pattern) -> _Known:
        if pattern.pattern not in self._known:
            self._known[pattern.pattern] = _Known(self, pattern)
        return self._known[pattern.pattern]

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge is the last one that makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether an encoding can hold the tokens of each pair side by side.

        The merges at the two ends that touch are undone, the last one first. The tokens stay apart unless, at some time,
        merging the two parts that touch ranked before the next merge at either end. Of equal ranks the one further left goes
        first.
        """
        verdict, at = np.ones(len(left), bool), np.arange(len(left))
        grows = joins = np.full(len(left), np.iinfo(np.int64).max)
        while len(at):
            rank = self.merges.get(left << 32 | right)
            wrong = (rank >= 0) & (rank < grows) & (rank <= joins)
            verdict[at[wrong]] = False
            made, other = self.made[left], self.made[right]
            on = np.flatnonzero(~wrong & ((made >= 0) | (other >= 0)))
            at, left, right, made, other = at[on], left[on], right[on], made[on], other[on]
            undo = made > other
            grows, joins = np.where(undo, made, grows[on]), np.where(undo, joins[on], other)
            left, right = np.where(undo, self.second[left], left), np.where(undo, right, self.first[right])
        return verdict

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_apart`` from memory where the pair is known; true where ``left`` is ``NONE``."""
        pair = (left + 1) << 32 | right
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(len(self.verdicts))).view(np.int64)
        held = self.verdicts[slot]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            seen = np.ones(len(new), bool)
            inside = np.flatnonzero(left[new] != NONE)
            seen[inside] = self._apart(left[new[inside]], right[new[inside]])
            held[new] = self.verdicts[slot[new]] = pair[new] << 1 | seen
        return (held & 1).astype(bool)

    def adjacent(self, left: int, right: int) -> bool:
        """``_fits`` of one pair, without arrays."""
        if left == NONE:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            made, first, second = self.lists
            grows = joins = float("inf")
            a, b = left, right
            while known is None:
                rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                if rank is not None and rank < grows and rank <= joins:
                    known = False
                elif made[a] > made[b]:
                    grows, a = made[a], second[a]
                elif made[b] >= 0:
                    joins, b = made[b], first[b]
                else:
                    known = True
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and emitted tokens; new ones are entered into the table."""
        moved = []
        for last, pending, node in self.hypotheses[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                moved.append((last, pending, node))
            token = self.token_at[node]
            if token != NONE and self.adjacent(pending[-1] if pending else last, token):
                moved.append((last, pending + (token,), 0))
        last = moved[0][0]
        shared = 0
        shortest = min(len(pending) for _, pending, _ in moved)
        while shared < shortest and len({pending[shared] for _, pending, _ in moved}) == 1:
            shared += 1
        emitted = moved[0][1][:shared]
        if shared:
            last = emitted[-1]
        target = tuple(sorted((last, pending[shared:], node) for _, pending, node in moved))
        number = self.states.get(target)
        if number is None:
            if len(self.hypotheses) >= MAX_STATES:
                self._begin()
                state = None
            number = self.states[target] = len(self.hypotheses)
            self.hypotheses.append(target)
            self.step.append({})
        result = (number, emitted)
        if state is not None:
            self.step[state][byte] = result
        return result

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece, by the table of states."""
        state, tokens = 0, []
        for byte in piece:
            state, emitted = self.step[state].get(byte) or self._advance(state, byte)
            if emitted:
                tokens += emitted
        for _, pending, node in self.hypotheses[state]:
            if node == 0:  # the one hypothesis that ends with a whole token
                tokens += pending
        return tuple(tokens)

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, one after the other, and how many each has: short ones read side by side, long ones by ``encode``."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        long = [(place, np.array(self.encode(pieces[place]), np.int64)) for place in np.flatnonzero(sizes >= LONG)]
        found = [(np.full(len(tokens), place), tokens) for place, tokens in long]
        # The longest first: those that go on at a byte are the first so many.
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] < LONG)]
        sizes = sizes[order]
        data = np.frombuffer(b"".join([pieces[place] for place in order.tolist()]), np.uint8)
        begins = np.cumsum(sizes) - sizes
        # For each place after a byte, the token that ends there and the place where it begins. A piece has a place before it, too.
        places = begins + np.arange(len(order))
        ends_with, began = np.full(len(data) + len(order), NONE, np.int64), np.zeros(len(data) + len(order), np.int64)
        going_on = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        piece = start = node = np.zeros(0, np.int64)
        for at, count in enumerate(going_on.tolist()):
            held = piece < count
            fresh = np.arange(count)
            piece, start, node = (np.concatenate([piece[held], fresh]), np.concatenate([start[held], places[:count] + at]),
                                  np.concatenate([node[held], np.zeros(count, np.int64)]))
            node = self.edges.get(node << 8 | data[begins[piece] + at]).astype(np.int64)
            alive = np.flatnonzero(node >= 0)
            piece, start, node = piece[alive], start[alive], node[alive]
            token = self.tokens[node].astype(np.int64)
            whole = np.flatnonzero(token != NONE)
            whole = whole[self._fits(ends_with[start[whole]], token[whole])]
            here = places[piece[whole]] + at + 1
            ends_with[here], began[here] = token[whole], start[whole]
            inner = np.flatnonzero(self.inner[node])
            piece, start, node = piece[inner], start[inner], node[inner]
        now, left = places + sizes, np.arange(len(order))
        while len(left):
            found.append((order[left], ends_with[now]))
            now = began[now]
            on = now > places[left]
            left, now = left[on], now[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        owner, token = (np.concatenate(column) for column in zip(*found[::-1]))
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))


SPACES = re.compile(r"\s | \s")
"""A space beside other white space."""


class _Known:
    """Tokens of pieces, and of stretches of several pieces, that came up before: a row of ``tokens`` each."""

    def __init__(self, encoder: Encoder, pattern: regex.Pattern):
        self.encoder, self.pattern = encoder, pattern
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.stretches: dict[str, int] = {}  # what stands between two spaces, to the row of the first space and it
        self.tokens, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, tokens: np.ndarray, counts: np.ndarray) -> range:
        """Numbers of the new rows."""
        first = len(self)
        self.tokens = np.concatenate([self.tokens, tokens])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return range(first, len(self))

    def joined(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the rows one after the other, and how many each run of so many rows has."""
        begins, counts = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(counts)
        tokens = self.tokens[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return tokens, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])

    def learn(self, stretches: set[str], pieces: set[str]) -> None:
        """Enters what stands between two spaces, and pieces."""
        new = list(stretches.difference(self.stretches))
        split = self.pattern.findall(f" {' '.join(new)}") if new else []
        begins = np.flatnonzero(np.fromiter((piece[0] == " " for piece in split), bool, len(split)))
        if len(begins) != len(new):
            raise ValueError("a space between two other characters must begin a match of the pattern")
        pieces = list(pieces.union(split).difference(self.pieces))
        self.pieces.update(zip(pieces, self.add(*self.encoder.encode_all([piece.encode() for piece in pieces]))))
        rows = np.fromiter(map(self.pieces.__getitem__, split), np.int64, len(split))
        sizes = np.diff(begins, append=len(split))
        entered, several = rows[begins], sizes > 1
        entered[several] = self.add(*self.joined(rows[np.repeat(several, sizes)], sizes[several]))
        self.stretches.update(zip(new, entered.tolist()))


def _utf8_step(pending: bytes, token: bytes) -> tuple[str, bytes]:
    """Whole characters of ``pending + token`` and the unfinished bytes after them.

    Bytes that can't be part of a character become U+FFFD, one for each longest wrong start.
    """
    data, out, i = pending + token, [], 0
    while i < len(data):
        lead = data[i]
        if lead < 0x80:
            need, low, high = 0, 0, 0
        elif 0xC2 <= lead <= 0xDF:
            need, low, high = 1, 0x80, 0xBF
        elif 0xE0 <= lead <= 0xEF:
            need, low, high = 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        elif 0xF0 <= lead <= 0xF4:
            need, low, high = 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        else:
            out.append("�")
            i += 1
            continue
        end = i + 1
        while end <= i + need and end < len(data) and low <= data[end] <= high:
            low, high = 0x80, 0xBF
            end += 1
        if end == i + need + 1:
            out.append(data[i:end].decode())
        elif end == len(data):
            return "".join(out), data[i:]
        else:
            out.append("�")
        i = end
    return "".join(out), b""


class _DecoderState(dict):
    """Token to (text, next state) for one run of unfinished bytes; entries are made when first needed."""

    def __init__(self, pending: bytes, decoder: Decoder):
        super().__init__()
        self.pending, self.decoder = pending, decoder

    def __missing__(self, token: int) -> tuple[str, _DecoderState]:
        text, rest = _utf8_step(self.pending, self.decoder.bytes_of[token])
        found = self[token] = (text, self.decoder.state(rest))
        return found


class Decoder:
    """Turns tokens into text as they come; what is returned never ends within a character."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._states: dict[bytes, _DecoderState] = {}
        self.clean = self.state(b"")
        self.whole = {token: text for token, (text, rest) in ((t, _utf8_step(b"", b)) for t, b in bytes_of.items()) if not rest}
        self.reset()

    def state(self, pending: bytes) -> _DecoderState:
        if pending not in self._states:
            self._states[pending] = _DecoderState(pending, self)
        return self._states[pending]

    def reset(self) -> None:
        self.now = self.clean

    def feed(self, tokens: list[int]) -> str:
        if self.now is self.clean:
            # Tokens of whole characters need no state; one that ends within a character leads to the loop below.
            texts = list(map(self.whole.get, tokens))
            if None not in texts:
                return "".join(texts)
            done = texts.index(None)
        else:
            texts, done = [], 0
        out, now = texts[:done], self.now
        for token in tokens[done:]:
            text, now = now[token]
            out.append(text)
        self.now = now
        return "".join(out)

    def finish(self) -> str:
        """What is left: one U+FFFD for an unfinished character."""
        left = "�" if self.now.pending else ""
        self.reset()
        return left


@lru_cache(2)
def coder(ranks: tuple[bytes, ...], pattern: str) -> tuple[Encoder, Decoder, regex.Pattern]:
    """Encoder, decoder and pattern of a vocabulary, built once per Python worker."""
    encoder = Encoder(read_ranks(ranks))
    return encoder, Decoder(encoder.bytes_of), regex.compile(pattern)


def encode_texts(texts: list[str], encoder: Encoder, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, one after the other, and how many each has. Each match of the pattern is encoded by itself; every
    character must be in a match."""
    known = encoder.known(pattern)
    if len(known) > MAX_PIECES:
        known.clear()
    # A space between two other characters belongs to what follows it, whatever is around: so each stretch from one such
    # space to the next splits by itself, and common stretches are looked up whole.
    cut = [[text] if SPACES.search(text) else text.split(" ") for text in texts]
    firsts, rests = [pattern.findall(parts[0]) for parts in cut], [parts[1:] for parts in cut]
    known.learn(set(chain.from_iterable(rests)), set(chain.from_iterable(firsts)))
    piece, stretch = known.pieces.__getitem__, known.stretches.__getitem__
    rows = chain.from_iterable(chain(map(piece, first), map(stretch, rest)) for first, rest in zip(firsts, rests))
    sizes = np.array([len(first) + len(rest) for first, rest in zip(firsts, rests)], np.int64)
    return known.joined(np.fromiter(rows, np.int64, sizes.sum()), sizes)


def encode_text(text: str, encoder: Encoder, pattern: regex.Pattern) -> list[int]:
    """Tokens of one text."""
    return encode_texts([text], encoder, pattern)[0].tolist()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               with_tokens: bool = False) -> DataFrame:
    """Encodes each whole text, decodes the tokens again and returns counts and digests of both.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256`` (bytes decoded) and,
    on request, the ``tokens``. A null text counts as empty: no tokens, digests of nothing. Rows are independent, so equal
    or repeated rows each return a row, an empty table returns none, and other columns of the input don't matter.
    The rank file is read by the driver and broadcast; its size is that of the vocabulary.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        shipped = spark.sparkContext.broadcast(tuple(file.readlines()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, compiled = coder(shipped.value, pattern)
        decimal = pa.array([f" {token}" for token in range(max(encoder.bytes_of) + 1)])
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, counts = encode_texts([text or "" for text in part.column("text").to_pylist()], encoder, compiled)
                written = decimal.take(pa.array(tokens))
                places = np.concatenate([[0], np.cumsum(pc.binary_length(written).to_numpy(zero_copy_only=False))])
                letters = memoryview(written.buffers()[2] or b"")
                ids, decoded, kept, begin = [], [], [], 0
                for end in np.cumsum(counts).tolist():
                    # Without the space before the first id.
                    ids.append(hashlib.sha256(letters[places[begin] + 1 : places[end]]).hexdigest())
                    own = tokens[begin:end].tolist()
                    out = decoder.feed(own) + decoder.finish()
                    decoded.append(hashlib.sha256(out.encode()).hexdigest())
                    if with_tokens:
                        kept.append(own)
                    begin = end
                columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_tokens:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "tokens"]
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(work, schema + (", tokens array<int>" if with_tokens else ""))

"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of the pieces are found without a regular expression.  Every code
point gets a symbol (letter, number, other, white space by what follows it,
apostrophe by the contraction it may open).  A symbol is a transition function on
eight states; functions compose associatively, so blocks of code points are
composed side by side, the block functions are scanned by doubling, and a second
walk from the known entry states yields the state, and so the boundary, at each
code point.  The resulting byte slices go through a cache of merged pieces;
pieces not seen before are merged together in one vectorised pass.

The token ids keep their byte offsets, so that a decoder can cut or check any part
of a text.

Nulls and empty texts give no tokens, an empty offset list and an empty decoded
value.  A text of any length is encoded whole.  Repeated rows are encoded each, an
empty table gives an empty table, and further columns of the input are kept unless
they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.common import by_place, slices, utf8

# White space of the pattern (Unicode White_Space).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000]
# Letters after an apostrophe that make one piece with it.
SHORT_ENDINGS = ["s", "t", "m", "d"]
LONG_ENDINGS = ["re", "ve", "ll"]

LETTER, NUMBER, OTHER, SPACE = range(4)
# symbols
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_JOINS, S_SINGLE = range(8)
# states: nothing open, in a letter, number, other or white-space piece, after a
# space that opens the next piece, one or two contraction letters to come
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, JOINED, ONE_MORE, TWO_MORE = range(8)
STATES = 8

#: Code points side by side in one block, distinct pieces a task keeps.
BLOCK = 256
CACHE_PIECES = 200_000
#: Bytes of text, and ids, that a task works on at once.
ENCODED_BYTES, DECODED_IDS = 1 << 20, 1 << 19
#: Pieces above this many bytes are merged one by one with a heap.
LONG_PIECE = 40


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
        np.uint8, sys.maxunicode + 1)
    out[SPACES] = SPACE
    return out


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol (twice: first in text) and state."""
    goes = np.zeros((16, STATES), np.uint8)
    starts = np.ones((16, STATES), bool)

    def rule(symbol: int, into: int, joins: dict[int, int] | None = None) -> None:
        goes[symbol] = into
        for state, then in (joins or {}).items():
            goes[symbol, state], starts[symbol, state] = then, False
        goes[symbol + 8] = into  # the first code point of a text starts a piece

    rule(S_LETTER, IN_LETTER, {IN_LETTER: IN_LETTER, JOINED: IN_LETTER,
                               TWO_MORE: ONE_MORE, ONE_MORE: FRESH})
    rule(S_NUMBER, IN_NUMBER, {IN_NUMBER: IN_NUMBER, JOINED: IN_NUMBER})
    for symbol, into in ((S_OTHER, IN_OTHER), (S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):
        rule(symbol, into, {IN_OTHER: IN_OTHER, JOINED: IN_OTHER})
    rule(S_WHITE, IN_WHITE, {IN_WHITE: IN_WHITE})
    rule(S_JOINS, JOINED)
    rule(S_SINGLE, FRESH)
    return goes, starts


GOES, STARTS = _transitions()


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first`` marks those that begin a text."""
    n = len(points)
    kind = classes()[points]
    out = kind.copy()
    following = np.full(n, SPACE, np.uint8)
    following[:-1] = np.where(first[1:], SPACE, kind[1:])
    white = kind == SPACE
    last = white & (following != SPACE)
    out[white] = S_WHITE
    out[last] = np.where(points[last] == 32, S_JOINS, S_SINGLE)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        padded = np.concatenate([points, [0, 0]])
        broken = np.concatenate([first, [True, True]])
        one, two = padded[marks + 1], padded[marks + 2]
        near = ~broken[marks + 1]
        short = near & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        pairs = [ord(a) * 65536 + ord(b) for a, b in LONG_ENDINGS]
        both = one.astype(np.int64) * 65536 + two
        long = near & ~broken[marks + 2] & (two < 65536) & np.isin(both, pairs)
        out[marks[short]], out[marks[long]] = S_SHORT, S_LONG
    out[first] += 8
    return out


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Indexes at which a piece starts, by scans of composed transition functions."""
    n = len(sym)
    if n == 0:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_SINGLE, np.uint8)
    padded[:n] = sym
    steps = padded.reshape(blocks, BLOCK).T.astype(np.int64) * STATES
    flat = GOES.reshape(-1).astype(np.int64)
    # the function of each block, as the image of every state
    image = np.tile(np.arange(STATES), (blocks, 1))
    for step in steps:
        image = flat[step[:, None] + image]
    # inclusive scan over blocks by doubling
    reach = 1
    while reach < blocks:
        image[reach:] = np.take_along_axis(image[reach:], image[:-reach], axis=1)
        reach *= 2
    state = np.zeros(blocks, np.int64)
    state[1:] = image[:-1, FRESH]
    begins = np.empty((BLOCK, blocks), bool)
    opens = STARTS.reshape(-1)
    for i, step in enumerate(steps):
        at = step + state
        begins[i] = opens[at]
        state = flat[at]
    return np.flatnonzero(begins.T.reshape(-1)[:n])


class Merger:
    """Ranks of a vocabulary file with a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.size = size
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], 0)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a large value where it does not merge."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], np.iinfo(np.int64).max)

    def merge_one(self, piece: bytes) -> list[int]:
        """Merged ids of a long piece, lowest rank first, leftmost among equals."""
        n, size = len(piece), self.size
        ids = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pair_table()
        heap = [(r, i) for i in range(n - 1)
                if (r := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pairs.get(ids[i] * size + ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pairs.get(rank * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pairs.get(ids[before[i]] * size + rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def pair_table(self) -> dict[int, int]:
        if not hasattr(self, "pairs"):
            self.pairs = dict(zip(self.keys[:-1].tolist(), self.values[:-1].tolist()))
        return self.pairs

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        none = np.iinfo(np.int64).max
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), none, np.int64)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self.pair_ranks(ids[same], ids[same + 1])
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(ids)))
            each = np.repeat(least, size)
            over = each == none
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            found = np.flatnonzero((rank == each) & ~over)
            # the leftmost of the lowest pairs of each piece
            found = found[np.diff(owner[found], prepend=-1) != 0]
            ids[found] = rank[found]
            keep = ~over
            keep[found + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def learn(self, pieces: list[bytes]) -> None:
        """Add pieces that the cache lacks."""
        known, short, long = [], [], []
        for p in pieces:
            (known if p in self.ranks else short if len(p) <= LONG_PIECE else long).append(p)
        merged, counts = self.merge_many(short) if short else (np.zeros(0), np.zeros(0))
        rest = [self.merge_one(p) for p in long]
        ids = [np.array([self.ranks[p] for p in known]), merged,
               np.array([x for r in rest for x in r])]
        lengths = np.concatenate([np.ones(len(known)), counts, [len(r) for r in rest]])
        lengths = lengths.astype(np.int64)
        at = len(self.pool) + np.cumsum(lengths) - lengths
        for p in (*known, *short, *long):
            self.index[p] = len(self.index)
        self.pool = np.concatenate([self.pool, *ids]).astype(np.int32)
        self.begin = np.concatenate([self.begin, at])
        self.count = np.concatenate([self.count, lengths])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and the number of ids of each piece."""
        if len(self.index) > CACHE_PIECES:
            self.reset()
        missing = set(pieces).difference(self.index)
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return gather(self.pool, self.begin[at], self.count[at]), self.count[at]


def gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin - (ends - count), count) + np.arange(total)]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, begin and length by id."""
    with open(path, "rb") as lines:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    by_id = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    length = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(length) - length, length


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces of texts laid end to end, and the text of each."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(heads, offsets[:-1])] = True
    begins = heads[boundaries(symbols(points, first[:-1]))]
    return begins, np.searchsorted(offsets, begins, side="right") - 1


def encode_slice(bpe: Merger, data: np.ndarray, offsets: np.ndarray):
    """Ids, byte offset of each id in its text, and ids per text."""
    if len(data) == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    begins, text = pieces_of(data, offsets)
    raw, ends = data.tobytes(), np.append(begins[1:], len(data))
    ids, counts = bpe.encode([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())])
    _, _, length = vocabulary_of(bpe)
    size = length[ids]
    place = np.cumsum(size) - size - np.repeat(offsets[text], counts)
    per_text = np.bincount(text, weights=counts, minlength=len(offsets) - 1).astype(np.int64)
    return ids, place.astype(np.int32), per_text


def vocabulary_of(bpe: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return vocabulary(bpe.path)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


_INTS = T.ArrayType(T.IntegerType(), False)


def _kept(df: DataFrame, outputs: list[T.StructField], without: str = "") -> list[T.StructField]:
    """The columns of the input that no output replaces."""
    taken = {f.name.lower() for f in outputs}
    return [f for f in df.schema.fields if f.name.lower() not in taken and f.name != without]


def _encoded(df: DataFrame, text: str, path: str, kept: list[T.StructField],
             outputs: list[T.StructField], columns) -> DataFrame:
    """The kept columns and those that ``columns(ids, offsets, counts)`` makes of a slice."""
    names = [f.name for f in (*kept, *outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(path)
        bpe.path = path
        for batch in batches:
            data, at = utf8(batch.column(len(kept)))
            for low, high in slices(at, ENCODED_BYTES):
                own = at[low:high + 1] - at[low]
                found = encode_slice(bpe, data[at[low]:at[high]], own)
                rest = [batch.column(i).slice(low, high - low) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, *columns(*found)], names=names)

    return by_place(df, [f.name for f in kept], F.col(f"`{text}`")).mapInArrow(
        run, T.StructType(kept + outputs))


def encode(df: DataFrame, text: str, vocabulary_path: str, ids: str = "ids",
           offsets: str = "offsets", keep_text: bool = False) -> DataFrame:
    """Token ids of column ``text`` and the byte offset at which each begins."""
    outputs = [T.StructField(ids, _INTS), T.StructField(offsets, _INTS)]
    return _encoded(
        df, text, vocabulary_path, _kept(df, outputs, "" if keep_text else text), outputs,
        lambda token, place, counts: [_lists(token, counts), _lists(place, counts)])


def decoded_lists(token: np.ndarray, counts: np.ndarray, vocabulary_path: str,
                  place: np.ndarray | None = None) -> pa.Array:
    """The bytes of each list of ids, the lists laid end to end.

    With ``place``, the offsets kept from encoding, the bytes of an id go where it began.
    """
    pool, begin, length = vocabulary(vocabulary_path)
    sizes = length[token]
    running = np.concatenate([[0], np.cumsum(sizes)])
    bounds = running[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    raw = gather(pool, begin[token], sizes)
    if place is not None:
        start = np.repeat(bounds[:-1], counts) + place
        out = np.zeros(len(raw), np.uint8)
        out[gather(np.arange(len(raw)), start, sizes)] = raw
        raw = out
    out = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts),
        [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])
    return out.cast(pa.binary())


def decode(df: DataFrame, ids: str, vocabulary_path: str, decoded: str = "decoded") -> DataFrame:
    """Bytes that the token ids of column ``ids`` stand for; no ids give no bytes."""
    outputs = [T.StructField(decoded, T.BinaryType())]
    kept = _kept(df, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = np.asarray(lists.flatten(), np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            for low, high in slices(at, DECODED_IDS):
                out = decoded_lists(flat[at[low]:at[high]], counts[low:high], vocabulary_path)
                rest = [batch.column(i).slice(low, high - low) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, out], names=[*(f.name for f in kept), decoded])

    return by_place(df, [f.name for f in kept], F.col(f"`{ids}`")).mapInArrow(
        run, T.StructType(kept + outputs))


def round_trip(df: DataFrame, text: str, vocabulary_path: str, ids: str = "ids",
               decoded: str = "decoded", offsets: str = "offsets") -> DataFrame:
    """Token ids of column ``text``, their offsets, and the bytes that both decode to.

    One Python worker a task does both.
    """
    outputs = [T.StructField(ids, _INTS), T.StructField(offsets, _INTS),
               T.StructField(decoded, T.BinaryType())]

    def columns(token: np.ndarray, place: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        return [_lists(token, counts), _lists(place, counts),
                decoded_lists(token, counts, vocabulary_path, place)]

    return _encoded(df, text, vocabulary_path, _kept(df, outputs, text), outputs, columns)


def token_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of what they decode to."""
    both = round_trip(docs.select("doc_id", "text"), "text", vocabulary_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

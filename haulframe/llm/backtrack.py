"""Byte-pair encoding by longest matches, pair compatibility and backtracking; decoding.

Merging is not simulated.  A sequence of tokens is the one that the merges give if and
only if every two neighbours are compatible: merging the text of the two leaves the
boundary between them in place.  So an Aho-Corasick automaton over the vocabulary marks
the longest token that begins at each byte of a piece, the encoder takes the longest
token that is compatible with the one before it, tries the next shorter one otherwise,
and steps back where none is left.  A place found to be a dead end is never entered
again, which bounds the work by the length of the piece.  Compatibility of a pair is
found by undoing merges from both sides of the boundary, once per pair and worker.

A text is cut at the added tokens of the vocabulary file, and the parts into pieces by
the pattern of byte-level vocabularies.  Distinct pieces are encoded once per worker.
Decoding gathers the bytes of the ids through a table of offsets by id.

Nulls and empty texts give no ids and decode to the empty text.  A text of any length is
encoded whole.  Repeated rows are encoded each, an empty table gives an empty table.
Further columns are kept but for those that bear the name of an output column.  Null ids
and ids that the vocabulary lacks decode to nothing; bytes that are no UTF-8 decode to
the replacement character.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from haulframe.llm.common import by_place, slices, utf8

#: Bytes of text, and ids, that a task works on at once.
ENCODED_BYTES, DECODED_IDS = 1 << 20, 1 << 19
#: Pieces that are encoded in one go; pieces with their ids, and pairs, a worker remembers.
PIECES, CACHED, CACHED_PAIRS = 1 << 18, 1_500_000, 2_000_000

_NEVER = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file.

    Printable bytes of Latin-1 stand for themselves, the others follow from code point 256.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def patterns() -> tuple[regex.Pattern, frozenset[str], regex.Pattern]:
    """The pattern of pieces, the characters in doubt, the pattern for texts that hold some.

    In doubt are letters and numbers that this regular-expression module knows and the
    tokenizer library, built with another version of Unicode, does not.
    """
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    known = regex.findall(r"\p{L}|\p{N}", "".join(map(chr, points)))
    recent = {c for c in known if unicodedata.category(c) == "Cn"}
    doubt = "".join(sorted(c for c in recent if len(library.pre_tokenize_str("a" + c)) == 2
                           and len(library.pre_tokenize_str("1" + c)) == 2))
    plain = public_tokenizers.PATTERN
    if not doubt:
        return regex.compile(plain), frozenset(), regex.compile(plain)
    careful = (plain.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{doubt}])")
               .replace(r"\p{L}+", rf"[\p{{L}}--[{doubt}]]+")
               .replace(r"\p{N}+", rf"[\p{{N}}--[{doubt}]]+"))
    return regex.compile(plain), frozenset(doubt), regex.compile(careful, regex.V1)


class Vocabulary:
    """Tokens, merges and added tokens of a vocabulary file, ready for encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids: dict[str, int] = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]):
            raise ValueError("added tokens that take in white space are not supported")
        byte_of = {c: b for b, c in enumerate(byte_characters())}

        def raw(token: str) -> bytes:
            plain = all(c in byte_of for c in token)
            return bytes(byte_of[c] for c in token) if plain else token.encode()

        self.size = size = max([*ids.values(), *added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in {**ids, **added}.items():
            self.bytes[i] = raw(token)
        self.length = [len(b) for b in self.bytes]
        # a byte has rank -1; a token has the rank of the merge that makes it
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[a + b]
            if self.left[whole] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
            self.merges[ids[a] * size + ids[b]] = rank
        self.pairs: dict[int, bool] = {}
        usable = self._usable(ids.values())
        by_bytes = {self.bytes[i]: i for i in usable}
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in by_bytes.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((by_bytes[token[:k]] for k in range(len(token) - 1, 0, -1)
                                    if token[:k] in by_bytes), -1)
        self.automaton.make_automaton()
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first)) or "(?!)")
        # offset table of decoding
        self.sizes = np.array(self.length, np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.forget()

    def _usable(self, ids: Iterable[int]) -> list[int]:
        """Tokens that the merges make of their own bytes; no other ever comes out."""
        usable = set()
        for i in sorted(ids, key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            if self.rank[i] < 0 and self.length[i] == 1 or (
                    a in usable and b in usable and self._holds(a, b, self.rank[i])):
                usable.add(i)
        return list(usable)

    def _holds(self, a: int, b: int, bound: int = _NEVER) -> bool:
        """Whether no merge of a rank below ``bound`` crosses the boundary of two tokens.

        The later of the last merges of the two sides is undone, until two bytes are left.
        Of two merges of the same rank the one on the left comes first.
        """
        rank, merges, size = self.rank, self.merges, self.size
        while True:
            if merges.get(a * size + b, _NEVER) < bound:
                return False
            if rank[a] > rank[b]:
                bound, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                bound, b = rank[b] + 1, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._holds(a, b)
        return known

    def encode_piece(self, piece: str | int) -> list[int]:
        """Ids of one piece; an added token is its own."""
        if isinstance(piece, int):
            return [piece]
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        n, length = len(raw), self.length
        longest = [0] * n
        for end, token in self.automaton.iter(raw):
            longest[end + 1 - length[token]] = token  # a longer one ends later
        token = longest[0]
        if length[token] == n:
            return [token]
        out: list[int] = []
        at, alive = 0, bytearray(b"\1") * (n + 1)
        while True:
            end = at + length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                alive[at] = 0
                last = out.pop()
                at, token = at - length[last], self.shorter[last]

    def forget(self) -> None:
        self.index: dict[str | int, int] = {}
        self.cached = 0
        self.known = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def learn(self, pieces: list[str | int]) -> None:
        """Add pieces to those encoded before."""
        found = [self.encode_piece(p) for p in pieces]
        counts = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int32, int(counts.sum()))
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces))))
        self.first = np.concatenate([self.first, len(self.known) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.known = np.concatenate([self.known, flat])
        self.cached += len(pieces) + len(flat)

    def encode_pieces(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        if self.cached > CACHED:
            self.forget()
        missing = set(pieces).difference(self.index)
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return gathered(self.known, self.first[at], self.count[at]), self.count[at]

    def pieces(self, text: str) -> Iterator[list[str | int]]:
        """The pieces of a text in order, a bounded number at a time; added tokens as ids."""
        low = 0
        if any(t in text for t in self.added):
            for found in self.cut.finditer(text):
                yield from self.plain_pieces(text[low:found.start()])
                yield [self.added[found[0]]]
                low = found.end()
        yield from self.plain_pieces(text[low:])

    def plain_pieces(self, text: str) -> Iterator[list[str]]:
        plain, doubt, careful = patterns()
        pattern = plain if text.isascii() or doubt.isdisjoint(text) else careful
        if len(text) <= PIECES:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while some := list(islice(found, PIECES)):
            yield some

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[str | int] = []
        owner: list[int] = []
        sizes: list[int] = []

        def flush() -> None:
            found, each = self.encode_pieces(held)
            ids.append(found)
            np.add.at(counts, np.repeat(owner, sizes), each)
            for waiting in (held, owner, sizes):
                waiting.clear()

        for i, text in enumerate(texts):
            for some in self.pieces(text or ""):
                held += some
                owner.append(i)
                sizes.append(len(some))
                if len(held) >= PIECES:
                    flush()
        if held:
            flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids, the lists laid end to end."""
        known = (ids >= 0) & (ids < self.size)
        safe = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[safe], 0)
        raw = gathered(self.pool, self.begin[safe], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.append(0, counts))].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


def gathered(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches of ``pool`` one after another."""
    total = int(count.sum())
    if not total:
        return pool[:0]
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return pool[shift + np.arange(total)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _kept(df: DataFrame, outputs: list[T.StructField]) -> list[T.StructField]:
    """The columns of the input that no output replaces."""
    taken = {f.name.lower() for f in outputs}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _text(raw: list[bytes]) -> pa.Array:
    return pa.array([r.decode(errors="replace") for r in raw], pa.string())


def _encoded(df: DataFrame, text: str, outputs: list[T.StructField], keep_text: bool,
             columns) -> DataFrame:
    """The input with the columns that ``columns`` makes of slices of its texts."""
    kept = [f for f in _kept(df, outputs) if keep_text or f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(len(kept))
            _, at = utf8(whole)
            rest = [batch.column(i) for i in range(len(kept))]
            for low, high in slices(at, ENCODED_BYTES):
                part = whole.slice(low, high - low).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(low, high - low) for c in rest), *columns(part)],
                    names=[*names, *(f.name for f in outputs)])

    wanted = by_place(df, names, F.col(f"`{text}`"))
    return wanted.mapInArrow(run, T.StructType(kept + outputs))


_INTS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, text: str, path: str, ids: str = "ids", offsets: str = "offsets",
           keep_text: bool = False) -> DataFrame:
    """Token ids of column ``text`` and the byte of its UTF-8 at which each begins."""

    def columns(texts: list[str | None]) -> list[pa.Array]:
        words = vocabulary(path)
        found, counts = words.encode(texts)
        size = words.sizes[found]
        place = np.cumsum(size) - size
        first = np.cumsum(counts) - counts
        some = counts > 0
        place -= np.repeat(place[first[some]], counts[some])
        return [_lists(found, counts), _lists(place, counts)]

    return _encoded(df, text, [T.StructField(ids, _INTS), T.StructField(offsets, _INTS)],
                    keep_text, columns)


def decode(df: DataFrame, ids: str, path: str, decoded: str = "decoded") -> DataFrame:
    """The text that the token ids of column ``ids`` stand for, added tokens included."""
    outputs = [T.StructField(decoded, T.StringType())]
    kept = _kept(df, outputs)
    source = by_place(df, [f.name for f in kept], F.col(f"`{ids}`").cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column(len(kept))
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = np.asarray(lists.flatten().fill_null(-1), np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            for low, high in slices(at, DECODED_IDS):
                text = _text(words.decode(flat[at[low]:at[high]], counts[low:high]))
                rest = [batch.column(i).slice(low, high - low) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, text], names=[*(f.name for f in kept), decoded])

    return source.mapInArrow(run, T.StructType(kept + outputs))


def round_trip(df: DataFrame, text: str, path: str, packed: str = "packed",
               decoded: str = "decoded") -> DataFrame:
    """Ids of column ``text``, four bytes each and the lowest first, and what they decode to."""

    def columns(texts: list[str | None]) -> list[pa.Array]:
        words = vocabulary(path)
        found, counts = words.encode(texts)
        raw = found.astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        each = [raw[a:b] for a, b in zip(ends, ends[1:])]
        return [pa.array(each, pa.binary()), _text(words.decode(found, counts))]

    outputs = [T.StructField(packed, T.BinaryType()), T.StructField(decoded, T.StringType())]
    return _encoded(df, text, outputs, False, columns)


def backtrack_report(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of what they decode to."""
    return round_trip(docs.select("doc_id", "text"), "text", path).select(
        "doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

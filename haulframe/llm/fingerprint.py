"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, and these into short parts at words whose own bytes
decide, so that an edit changes the parts it touches and no others.  Long words, as in
scripts without blanks, are cut into shorter ones in the same way, by the bytes that follow.  A part has a 64-bit
digest (its n-th occurrence in a text another one).  A sketch adds each digest to one
cell of each of three tables: a count, a sum of digests and a sum of check values.  The
cells of two versions subtract, and peeling cells that hold one digest recovers what
differs.  If peeling stops early the pair is sketched again with four times the cells.
What differs and the two counts give the likeness: shared digests over all.

The cells are a function of the text alone, so equal texts have equal fingerprints.
Null and empty texts have no parts: alike to each other (1), unlike any other (0).  A
text of any length is cut whole.  The next document is that with the next smaller id;
after the smallest comes the largest, a null id comes last, equal ids follow by text.
Repeated rows each get their row.  An empty table gives an empty table.  Further
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulframe.llm.common import SLICE_BYTES, SpanHash, seeded, utf8, words
from haulframe.sources.scratch import new_path

#: Cells of each of the three tables of a stored sketch; a retry takes four times as many.
CELLS = 8
TABLES, GROWTH = 3, 4
#: Mean words of a part, and most of them, counted from its first word.
PART_WORDS, MOST_WORDS = 4, 8
#: Longer words, in bytes, are cut: where these many bytes say so, once in CUT, and at least
#: every MOST_BYTES.
LONG_BYTES, LOOK, CUT, MOST_BYTES = 32, 8, 6, 96


def shortened(begins: np.ndarray, ends: np.ndarray, data: np.ndarray, spans: SpanHash):
    """The words with long ones cut at code points, the place chosen by the bytes after it."""
    def inside(longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(ends - begins > longer)
        size = ends[own] - begins[own]
        first = np.repeat(begins[own], size)
        at = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + first
        return at, first, np.repeat(ends[own], size)

    def cut(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.sort(np.concatenate([begins, at])), np.sort(np.concatenate([ends, at]))

    at, first, last = inside(LONG_BYTES)
    if not len(at):
        return begins, ends
    heads = (data[at] & 0xC0) != 0x80
    free = heads & (at > first) & (at + LOOK <= last)
    at = at[free]
    begins, ends = cut(at[seeded(spans(at, at + LOOK), 14) % np.uint64(CUT) == 0])
    at, first, _ = inside(MOST_BYTES)
    # the first code point at or after every MOST_BYTES
    turn = (at - first) // MOST_BYTES
    heads = np.flatnonzero((data[at] & 0xC0) != 0x80)
    new = np.diff(turn[heads], prepend=0) != 0
    same = np.diff(first[heads], prepend=-1) == 0
    return cut(at[heads[new & same]])


def parts(data: np.ndarray, offsets: np.ndarray, mean: int = PART_WORDS):
    """Digest and text number of the parts of texts laid end to end."""
    begins, ends = words(data)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    if len(begins):
        # two texts may touch: cut words at the text's end
        cut = np.flatnonzero(offsets[owner + 1] < ends)
        while len(cut):
            edge = offsets[owner[cut] + 1]
            begins = np.concatenate([begins, edge])
            ends = np.concatenate([ends, ends[cut]])
            ends[cut] = edge
            order = np.argsort(begins, kind="stable")
            begins, ends = begins[order], ends[order]
            owner = np.searchsorted(offsets, begins, side="right") - 1
            cut = np.flatnonzero(offsets[owner + 1] < ends)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = SpanHash(data)
    begins, ends = shortened(begins, ends, data, spans)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    word = spans(begins, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    # a part ends at the end of a paragraph or text, or at a word that says so
    last = np.ones(len(begins), bool)
    last[:-1] = (owner[1:] != owner[:-1]) | (lines[begins[1:]] != lines[ends[:-1]])
    last |= seeded(word, 1) % np.uint64(mean) == 0
    head = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    since = np.arange(len(begins)) - np.repeat(head, np.diff(np.append(head, len(begins))))
    last |= since % MOST_WORDS == MOST_WORDS - 1
    head = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    digest = spans(begins[head], ends[np.flatnonzero(last)])
    owner = owner[head]
    # the n-th occurrence in a text gets a digest of its own
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(digest)), 0))
    nth = (np.arange(len(digest)) - first).astype(np.uint64)
    return seeded(digest + nth * np.uint64(0x9E3779B97F4A7C15), 2), owner


class Sketches:
    """Sketches of many texts side by side, each of three tables of ``cells`` cells."""

    def __init__(self, texts: int, cells: int):
        self.cells, self.texts = cells, texts
        self.count = np.zeros(texts * TABLES * cells, np.int32)
        self.sums = np.zeros(texts * TABLES * cells, np.uint64)
        self.checks = np.zeros(texts * TABLES * cells, np.uint32)

    def places(self, digest: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(TABLES):
            own = (seeded(digest, 3 + i) % np.uint64(self.cells)).astype(np.int64)
            yield (owner * TABLES + i) * self.cells + own

    def add(self, digest: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        signs = np.broadcast_to(np.asarray(sign, np.int32), digest.shape)
        value = np.where(signs > 0, digest, np.uint64(0) - digest)
        check = check_of(digest)
        check = np.where(signs > 0, check, np.uint32(0) - check)
        for at in self.places(digest, owner):
            np.add.at(self.count, at, signs)
            np.add.at(self.sums, at, value)
            np.add.at(self.checks, at, check)

    def packed(self) -> list[str]:
        """The cells of each text as text."""
        width = TABLES * self.cells
        rows = np.empty((self.texts, width * 16), np.uint8)
        rows[:, :width * 4] = self.count.astype("<i4").view(np.uint8).reshape(self.texts, -1)
        rows[:, width * 4:width * 12] = self.sums.view(np.uint8).reshape(self.texts, -1)
        rows[:, width * 12:] = self.checks.view(np.uint8).reshape(self.texts, -1)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.texts, self.cells)
        out.count, out.sums = self.count - other.count, self.sums - other.sums
        out.checks = self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that differ with owner and sign, and which texts were resolved."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = TABLES * self.cells
        look = np.flatnonzero(self.count != 0)
        while len(look):
            sign = self.count[look]
            value = np.where(sign > 0, self.sums[look], np.uint64(0) - self.sums[look])
            check = np.where(sign > 0, self.checks[look], np.uint32(0) - self.checks[look])
            pure = (np.abs(sign) == 1) & (check_of(value) == check)
            digest, owner, sign = value[pure], look[pure] // width, sign[pure]
            if not len(digest):
                break
            # a digest may stand alone in several of its cells
            order = np.lexsort((digest, owner))
            digest, owner, sign = digest[order], owner[order], sign[order]
            keep = np.ones(len(digest), bool)
            keep[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
            digest, owner, sign = digest[keep], owner[keep], sign[keep]
            self.add(digest, owner, -sign)
            found.append((digest, owner, sign))
            touched = np.unique(np.concatenate(list(self.places(digest, owner))))
            look = touched[self.count[touched] != 0]
        rest = (self.count != 0) | (self.sums != 0) | (self.checks != 0)
        done = ~rest.reshape(self.texts, width).any(axis=1)
        if not found:
            return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), done)
        return (*(np.concatenate(x) for x in zip(*found)), done)


def check_of(digest: np.ndarray) -> np.ndarray:
    return (seeded(digest, 9) >> np.uint64(32)).astype(np.uint32)


def sketch(digest: np.ndarray, owner: np.ndarray, texts: int, cells: int = CELLS) -> Sketches:
    out = Sketches(texts, cells)
    out.add(digest, owner)
    return out


def differences(left, right, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests on one side only, as (digest, text, sign), by subtracting and peeling.

    ``left`` and ``right`` are (digest, owner) of as many texts.  Pairs that do not peel
    are sketched again with more cells, until all are resolved.
    """
    out, names, cells = [], np.arange(texts), CELLS
    while len(names):
        gap = sketch(*left, len(names), cells).minus(sketch(*right, len(names), cells))
        digest, owner, sign, done = gap.peel()
        good = done[owner]
        out.append((digest[good], names[owner[good]], sign[good]))
        number = np.cumsum(~done) - 1
        left, right = ((d[~done[o]], number[o[~done[o]]]) for d, o in (left, right))
        names, cells = names[~done], cells * GROWTH
    digest, owner, sign = (np.concatenate(x) for x in zip(*out)) if out else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    return digest, owner, sign


def likeness(left, right, texts: int) -> np.ndarray:
    """Shared parts over all parts of each pair of texts."""
    _, owner, _ = differences(left, right, texts)
    apart = np.bincount(owner, minlength=texts)
    total = np.bincount(left[1], minlength=texts) + np.bincount(right[1], minlength=texts)
    # shared = (total - apart) / 2, all = (total + apart) / 2
    return np.where(total == 0, 1.0, (total - apart) / np.maximum(total + apart, 1))


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first code points of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def compare_versions(texts: list[str], following: list[str]) -> dict[str, list]:
    """Fingerprints of texts and their edited versions, and the likenesses."""
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, new, other = parts(*_laid(texts)), parts(*_laid(changed)), parts(*_laid(following))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": sketch(*own, n).packed(),
        "edited_fingerprint": sketch(*new, n).packed(),
        "near_edited": likeness(own, new, n).tolist(),
        "near_next": likeness(own, other, n).tolist(),
    }


_KINDS = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
_COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc_id, text, following) the results of ``compare_versions``."""
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        after = [x or "" for x in batch.column("following").to_pylist()]
        got = compare_versions(texts, after)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(got[k], kind) for k, kind in _KINDS.items())],
            names=["doc_id", *_KINDS])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text of an ordered partition with the next.

    The first and the last text are handed on (``edge`` 0 and 1) for the neighbouring
    partitions; the last is compared there.
    """
    part = TaskContext.get().partitionId()
    ids, texts, size, first = [], [], 0, True

    def out(rows_ids, got, edge=None, text=None):
        n = len(rows_ids)
        blank = {k: [None] * n for k in _KINDS}
        values = got or blank
        return pa.RecordBatch.from_arrays([
            pa.array(rows_ids, pa.int64()),
            *(pa.array(values[k], kind) for k, kind in _KINDS.items()),
            pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()),
            pa.array([text] * n, pa.string()),
        ], names=["doc_id", *_KINDS, "part", "edge", "text"])

    for batch in batches:
        numbers = batch.column("doc_id").to_pylist()
        for number, value in zip(numbers, batch.column("text")):
            text = value.as_py() or ""
            if first:
                yield out([number], None, 0, text)
                first = False
            ids.append(number)
            texts.append(text)
            size += len(text)
            if size > SLICE_BYTES // 2 and len(ids) > 1:
                yield out(ids[:-1], compare_versions(texts[:-1], texts[1:]))
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield out(ids[:-1], compare_versions(texts[:-1], texts[1:]))
    if ids:
        yield out(ids[-1:], None, 1, texts[-1])


def version_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    down = F.col("doc_id").desc_nulls_last()
    # rows without an id, or of one id, are spread by how their texts begin
    ordered = source.repartitionByRange(down, F.substring("text", 1, 64)).sortWithinPartitions(
        down, "text")
    compared = ordered.mapInArrow(
        _in_order, f"doc_id long, {_COLUMNS}, part int, edge int, text string")
    place = new_path(docs.sparkSession)
    # the cells are hashes in base 64, which only an entropy code makes smaller
    compared.write.option("compression", "zstd").parquet(place)
    done = docs.sparkSession.read.schema(compared.schema).parquet(place)
    inside = done.where("edge is null").drop("part", "edge", "text")
    # two rows per partition: the last text meets the first of the next partition
    edges = done.where("edge is not null").select("doc_id", "part", "edge", "text")
    parts_in_use = edges.where("edge = 0").select("part")
    order = Window.orderBy("part")
    steps = (parts_in_use.withColumn("next", F.lead("part").over(order))
             .withColumn("next", F.coalesce("next", F.min("part").over(
                 order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    lasts = edges.where("edge = 1").select("doc_id", "part", "text").join(steps, "part")
    firsts = edges.where("edge = 0").select(
        F.col("part").alias("next"), F.col("text").alias("following"))
    met = lasts.join(firsts, "next").select("doc_id", "text", "following").mapInArrow(
        _compared, f"doc_id long, {_COLUMNS}")
    return inside.unionByName(met)

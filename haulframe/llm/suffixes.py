"""Repeated byte strings, found by sorting sampled suffixes in range-partitioned buckets.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere.  Sorting
the suffixes of all positions is not needed: in each window of ``length`` bytes the place
with the smallest hash of the next ``gram`` bytes is an anchor, a choice that depends on
the window's bytes alone, so two equal windows have their anchors at the same place and
every repeated string shows up among the suffixes that start at anchors.  Around an
anchor the bytes matter that a window holding its gram can reach (its context).

1. Anchors are counted by gram; a gram that occurs once cannot be in a repeated string.
2. Equal contexts are combined: all their windows repeat.  Where a gram has several
   contexts, each goes on once, however often it occurs.
3. The suffixes of these contexts are range-partitioned by their leading bytes with
   sampled splitters, sorted in each bucket by multikey quicksort, and compared with
   their neighbours: the common bytes to the right, and likewise to the left of the
   anchors, say which windows repeat.
4. A gram whose suffixes fall on both sides of a splitter, as those of a very frequent one
   do, is compared across the boundary.  A window can only be shared with another bucket
   if its part to the right of the anchor is no longer than what the suffix has in
   common with the end of its bucket.  The suffixes that have such windows are dealt anew by
   their bytes to the left and compared there, and what an end of such a bucket has in
   common with others is compared by counted windows, so no bucket or group grows with
   the gram.

A null or empty text has no bytes.  Texts shorter than ``length`` lose nothing; a text of
any length is read whole.  Strings are judged on the input, also within one document.
Repeated rows are documents of their own, so they repeat each other, and get the same
result.  An empty table gives an empty table.  Further columns are kept, but for those
that bear the name of an output column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from haulframe.llm.common import (
    SLICE_BYTES,
    SpanHash,
    bounded,
    by_place,
    by_row,
    row_key,
    seeded,
    slices,
    small_batches,
    utf8,
)
from haulframe.sources.scratch import materialize, materialize_measured

#: Bytes of a repeated string, and of the gram that is hashed at each place.
LENGTH, GRAM = 400, 200
#: Bytes of suffixes in one bucket, by which the number of buckets is chosen.
BUCKET_BYTES = 6 << 20
#: Fewer strings than this are sorted at once.
FEW = 48
#: Suffixes handed on at once.
EDGES = 2_000


def sliding(x: np.ndarray, width: int, smaller: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` values in a row."""
    pick = np.minimum if smaller else np.maximum
    n = len(x)
    edge = np.iinfo(x.dtype).max if smaller else 0
    wide = np.full(-(-n // width) * width, edge, x.dtype)
    wide[:n] = x
    rows = wide.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).reshape(-1)
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of texts laid end to end: place, text, bytes to the left and right, two hashes.

    Ties are all anchors.  The first hash is of the gram, the second of the context.
    """
    n, span = len(data), length - gram
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = SpanHash(data)
    starts = np.arange(n - gram + 1)
    grams = hashes(starts, starts + gram)
    least = sliding(grams, span + 1, True)
    # a window counts if it lies in one text; otherwise no gram is its least
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(least))
    least[at + length > ends[:len(least)]] = 0
    padded = np.zeros(len(grams) + span, np.uint64)
    padded[span:span + len(least)] = least
    place = np.flatnonzero(sliding(padded, span + 1, False) == grams)
    place = place[grams[place] > 0]
    text = np.searchsorted(offsets, place, side="right") - 1
    left = np.minimum(place - offsets[text], span)
    right = np.minimum(offsets[text + 1] - place, length)
    context = seeded(hashes(place - left, place + right) + left.astype(np.uint64), 21)
    return place, text, left, right, grams[place], context


_ANCHOR = pa.struct([("g", pa.int64()), ("c", pa.int64()), ("pos", pa.int32()),
                     ("left", pa.int32()), ("right", pa.int32())])


def anchor_table(docs: DataFrame, id: str, text: str, length: int, gram: int) -> DataFrame:
    """(k1, k2, row, found): the anchors of each document, written once.

    ``row`` numbers the documents that were written; it is shorter to shuffle than keys.
    """
    source = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets, SLICE_BYTES // 4):
                own = offsets[low:high + 1] - offsets[low]
                place, row, left, right, g, c = anchors(
                    data[offsets[low]:offsets[high]], own, length, gram)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=high - low))])
                found = pa.StructArray.from_arrays([
                    pa.array(g.view(np.int64)), pa.array(c.view(np.int64)),
                    pa.array((place - own[row]).astype(np.int32)),
                    pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                ], fields=list(_ANCHOR))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").slice(low, high - low),
                     batch.column("k2").slice(low, high - low),
                     pa.array(np.arange(first + low, first + high)), lists],
                    names=["k1", "k2", "row", "found"])
            first += batch.num_rows

    kind = "array<struct<g:bigint,c:bigint,pos:int,left:int,right:int>>"
    return materialize(source.mapInArrow(run, f"k1 long, k2 long, row long, found {kind}"))


def context_texts(docs: DataFrame, wanted: DataFrame, id: str, text: str, length: int,
                  gram: int) -> DataFrame:
    """(g, c, right, left): bytes right of the anchor, and left of it in reverse; one row each.

    ``wanted`` is (k1, k2, many, pos, g, c).  Rows that repeat (``many``) all send their
    contexts, of which one goes on.
    """
    asked = wanted.groupBy("k1", "k2").agg(
        F.max("many").alias("many"), F.collect_list(F.struct("pos", "g", "c")).alias("wanted"))
    source = docs.select(*row_key(F.col(id), F.col(text)),
                         F.col(text).cast("binary").alias("text"))
    rows = source.join(bounded(asked), ["k1", "k2"]).select("text", "wanted", "many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for text, asked, many in zip(*batch.columns):
                raw, many = text.as_py(), many.as_py()
                for a in asked.as_py():
                    p = a["pos"]
                    out.append((a["g"], a["c"], many, raw[p:p + length],
                                raw[max(0, p - (length - gram)):p][::-1]))
                    held += 2 * length
                    if held > SLICE_BYTES:
                        yield _context_batch(out)
                        out, held = [], 0
            if out:
                yield _context_batch(out)

    found = rows.mapInArrow(run, "g long, c long, many boolean, right binary, left binary")
    found = materialize(found)
    once = found.where("many").dropDuplicates(["g", "c"])
    return found.where("not many").union(once).drop("many")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    g, c, many, right, left = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(many, pa.bool_()),
         pa.array(right, pa.binary()), pa.array(left, pa.binary())],
        names=["g", "c", "many", "right", "left"])


def multikey_order(strings: list[bytes], width: int) -> np.ndarray:
    """Order of byte strings: three-way partitions on eight bytes at a time."""
    n = len(strings)
    words = -(-width // 8)
    flat = b"".join(s.ljust(words * 8, b"\0") for s in strings)
    keys = np.frombuffer(flat, ">u8").reshape(n, words).astype(np.uint64)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2:
            continue
        own = order[low:high]
        if high - low <= FEW or depth == words:
            order[low:high] = sorted(own.tolist(), key=strings.__getitem__)
            continue
        word = keys[own, depth]
        some = np.sort(word[::max(1, len(word) // 64)])
        pivot = some[len(some) // 2]
        below, above = word < pivot, word > pivot
        same = ~(below | above)
        a, b = int(below.sum()), int(below.sum() + same.sum())
        order[low:high] = np.concatenate([own[below], own[same], own[above]])
        todo += [(low, low + a, depth), (low + a, low + b, depth + 1), (low + b, high, depth)]
    return order


def neighbours_in_common(strings: list[bytes], order: np.ndarray, width: int) -> np.ndarray:
    """Leading bytes that each string of the order shares with the one before it."""
    n = len(strings)
    out = np.zeros(n, np.int64)
    sizes = np.array([len(s) for s in strings])
    for low in range(1, n, 8_192):
        high = min(n, low + 8_192)
        own = [strings[i] for i in order[low - 1:high]]
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in own), np.uint8)
        grid = grid.reshape(len(own), width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        least = np.minimum(sizes[order[low:high]], sizes[order[low - 1:high - 1]])
        out[low:high] = np.minimum(first, least)
    return out


def repeated_windows(right: list[bytes], left: list[bytes], length: int, gram: int):
    """Least and greatest start before the anchor of a window that two suffixes share.

    A window that starts o bytes before the anchor holds the last o bytes to the left and the
    first length - o to the right.  -1 where none is shared.  Third, the bytes that each
    suffix has in common with the first or the last of all in order, the larger.
    """
    n, span = len(right), length - gram
    low, high = np.full(n, -1), np.full(n, -1)
    orders, commons, sizes = [], [], []
    for strings, width in ((right, length), (left, max(span, 1))):
        order = multikey_order(strings, width)
        orders.append(order)
        commons.append(neighbours_in_common(strings, order, width))
        sizes.append(np.array([len(s) for s in strings]))
    common = commons[0]
    edge = np.empty(n, np.int64)
    # common with the first: the least between; with the last: the same from behind
    from_first = np.minimum.accumulate(np.append(length, common[1:]))
    from_last = np.minimum.accumulate(np.append(length, common[:0:-1]))[::-1]
    edge[orders[0]] = np.maximum(from_first, from_last)
    # suffixes that share their gram with a neighbour
    alone = np.maximum(common, np.append(common[1:], 0)) < gram
    live = np.ones(n, bool)
    live[orders[0][alone]] = False
    member = np.flatnonzero(live)
    if not len(member):
        return low, high, edge
    for o in range(span + 1):
        fits = member[(sizes[0][member] >= length - o) & (sizes[1][member] >= o)]
        if len(fits) < 2:
            continue
        ranks = []
        for order, shared, depth in zip(orders, commons, (length - o, o)):
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(shared < depth)
            ranks.append(rank)
        key = ranks[0][fits] * (n + 1) + ranks[1][fits]
        by_key = np.argsort(key, kind="stable")
        same = key[by_key][1:] == key[by_key][:-1]
        shared = np.zeros(len(fits), bool)
        shared[by_key[1:][same]] = True
        shared[by_key[:-1][same]] = True
        hit = fits[shared]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high, edge


_RESULT = "g long, c long, low int, high int, bucket int, right binary, left binary"


def _rows(g, c, low, high, **more) -> pa.RecordBatch:
    """Rows (g, c, low, high) and further columns; what is None is missing in all."""
    ints = {"low": low, "high": high}
    columns = {"g": pa.array(g), "c": c if isinstance(c, pa.Array) else pa.array(c)}
    for name, x in ints.items():
        columns[name] = pa.nulls(len(g), pa.int32()) if x is None else pa.array(x, pa.int32())
    return pa.RecordBatch.from_pydict(columns | more)


def _bucket(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        g, c = np.asarray(whole.column("g")), np.asarray(whole.column("c"))
        right, left = whole.column("right").to_pylist(), whole.column("left").to_pylist()
        del whole
        low, high, common = repeated_windows(right, left, length, gram)
        part = TaskContext.get().partitionId()

        def batch(rows, lows, highs, rights, lefts):
            return _rows(g[rows], c[rows], lows, highs,
                         bucket=pa.array([part] * len(rows), pa.int32()),
                         right=pa.array(rights, pa.binary()), left=pa.array(lefts, pa.binary()))

        found = np.flatnonzero(high >= 0)
        none = [None] * len(found)
        yield batch(found, low[found], high[found], none, none)
        # only the gram of the first and that of the last suffix can go on in another bucket;
        # ``low`` is the shortest start of a window that another bucket can share
        edge = np.flatnonzero(common >= gram)
        for at in range(0, len(edge), EDGES):
            rows = edge[at:at + EDGES]
            yield batch(rows, length - common[rows], None,
                        [right[i] for i in rows], [left[i] for i in rows])

    return run


class Windows:
    """Hashes of the windows of suffixes, whose bytes are hashed some at a time."""

    def __init__(self, right: list[bytes], left: list[bytes], length: int):
        self.length, self.parts = length, []
        sizes = np.array([(len(a), len(b)) for a, b in zip(right, left)], np.int64).reshape(-1, 2)
        for low in range(0, len(right), EDGES):
            own = zip(right[low:low + EDGES], left[low:low + EDGES])
            data = np.frombuffer(b"".join(b[::-1] + a for a, b in own), np.uint8)
            size = sizes[low:low + EDGES]
            # places of the anchors
            place = np.cumsum(size.sum(axis=1)) - size[:, 0]
            self.parts.append((low, place, SpanHash(data)))

    def __call__(self, rows: np.ndarray, o: int) -> np.ndarray:
        """Of these suffixes, in order, the window that starts o bytes before the anchor."""
        out = np.empty(len(rows), np.uint64)
        ends = np.searchsorted(rows, [low for low, _, _ in self.parts[1:]] + [1 << 62])
        at = 0
        for end, (low, place, hashes) in zip(ends.tolist(), self.parts):
            start = place[rows[at:end] - low] - o
            out[at:end] = hashes(start, start + self.length)
            at = end
        return out


def _left_bucket(length: int, gram: int):
    """Windows that suffixes of different buckets share, among those alike to the left.

    Rows (g, c, low, high) are found here.  Rows with a window (o, window) are for other
    such buckets: windows whose part to the left an end of this bucket has too, one row
    each, with the suffix if it is the only one here.
    """
    span = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        g, c = np.asarray(whole.column("g")), np.asarray(whole.column("c"))
        least = np.asarray(whole.column("low"))
        right, left = whole.column("right").to_pylist(), whole.column("left").to_pylist()
        del whole
        n = len(g)
        order = multikey_order(left, max(span, 1))
        common = neighbours_in_common(left, order, max(span, 1))
        most, edge = np.empty(n, np.int64), np.empty(n, np.int64)
        from_first = np.minimum.accumulate(np.append(span, common[1:]))
        from_last = np.minimum.accumulate(np.append(span, common[:0:-1]))[::-1]
        edge[order] = np.maximum(from_first, from_last)
        most[order] = np.maximum(common, np.append(common[1:], 0))
        most = np.maximum(most, edge)
        size_r, size_l = (np.array([len(x) for x in side]) for side in (right, left))
        least, most = np.maximum(least, length - size_r), np.minimum(most, size_l)
        windows = Windows(right, left, length)
        low, high = np.full(n, -1), np.full(n, -1)
        for o in range(span + 1):
            own = np.flatnonzero((least <= o) & (most >= o))
            if not len(own):
                continue
            window, first, same, count = np.unique(
                windows(own, o), return_index=True, return_inverse=True, return_counts=True)
            hit = own[count[same] > 1]
            high[hit] = o
            low[hit[low[hit] < 0]] = o
            # the suffixes of a window are alike to the left: any of them tells
            beyond = np.flatnonzero(edge[own[first]] >= o)
            rows = own[first[beyond]]
            if len(rows):
                yield _rows(g[rows], pa.array(c[rows], mask=count[beyond] > 1), None, None,
                            o=pa.array([o] * len(rows), pa.int32()),
                            window=pa.array(window[beyond].view(np.int64)))
        found = np.flatnonzero(high >= 0)
        yield _rows(g[found], c[found], low[found], high[found],
                    o=pa.nulls(len(found), pa.int32()), window=pa.nulls(len(found), pa.int64()))

    return run


def across_buckets(edges: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, c, low, high) from suffixes whose gram lies in more than one bucket."""
    split = (edges.groupBy("g").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
             .where("a < b").select("g"))
    spread, size = materialize_measured(
        edges.join(bounded(split), "g").select("g", "c", "low", "right", "left"))
    buckets = max(1, -(-size // BUCKET_BYTES))
    found = materialize(spread.repartitionByRange(buckets, "left", "right").mapInArrow(
        _left_bucket(length, gram), "g long, c long, low int, high int, o int, window long"))
    windows = found.where("o is not null")
    shared = (windows.groupBy("g", "o", "window").agg(F.count("*").alias("n"))
              .where("n > 1").select("g", "o", "window"))
    alone = windows.where("c is not null").join(bounded(shared), ["g", "o", "window"], "left_semi")
    return found.where("o is null").select("g", "c", "low", "high").union(
        alone.groupBy("g", "c").agg(F.min("o").alias("low"), F.max("o").alias("high")))


def repeated_spans(docs: DataFrame, id: str, text: str, length: int, gram: int) -> DataFrame:
    """(k1, k2, __spans): the byte ranges of each document that repeated strings cover."""
    found = anchor_table(docs, id, text, length, gram)
    rows = found.select("row", "k1", "k2")
    each = found.select("row", F.explode("found").alias("a")).select("row", "a.*")
    grams = (each.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("a"),
                                   F.max("c").alias("b"))
             .where("n > 1").select("g", (F.col("a") != F.col("b")).alias("mixed")))
    # a gram that very many documents share is marked where it lies
    again = materialize(each.join(bounded(grams), "g"))
    contexts = materialize(again.groupBy("g", "c").agg(
        F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.max("left").alias("left"),
        F.max("right").alias("right"), F.min(F.struct("row", "pos")).alias("at")))
    # all windows of a context that occurs again
    whole = contexts.where((F.col("n") > 1) & (F.col("left") + F.col("right") >= length)).select(
        "g", "c", F.greatest(F.lit(0), F.lit(length) - F.col("right")).cast("int").alias("low"),
        F.col("left").alias("high"))
    mixed = contexts.where("mixed")
    size = mixed.agg(F.sum(F.col("left") + F.col("right"))).first()[0] or 0
    wanted = mixed.select("g", "c", "at.*").join(rows, "row")
    many = rows.groupBy("k1", "k2").agg((F.count("*") > 1).alias("many"))
    wanted = wanted.join(many, ["k1", "k2"])
    texts = context_texts(docs, wanted, id, text, length, gram)
    buckets = texts.repartitionByRange(max(1, -(-size // BUCKET_BYTES)), "right", "left")
    sorted_out = materialize(buckets.mapInArrow(_bucket(length, gram), _RESULT))
    inside = sorted_out.where("high is not null").select("g", "c", "low", "high")
    across = across_buckets(sorted_out.where("high is null"), length, gram)
    known = whole.union(inside).union(across).groupBy("g", "c").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    spans = again.join(bounded(known), ["g", "c"]).select(
        "row", F.struct((F.col("pos") - F.col("high")).alias("start"),
                             (F.col("pos") - F.col("low") + length).alias("end")).alias("span"))
    # maximal ranges of a document: a span that starts beyond all before it opens one
    in_row = Window.partitionBy("row").orderBy("span.start", "span.end")
    reach = F.max("span.end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("span.start") > reach, F.lit(True)).cast("int")
    runs = spans.distinct().withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(in_row))
    ranges = runs.groupBy("row", "run").agg(
        F.struct(F.min("span.start").alias("start"), F.max("span.end").alias("end")).alias("span"))
    by_row = ranges.groupBy("row").agg(F.collect_list("span").alias("__spans"))
    # repeated rows have the same spans
    return by_row.join(rows, "row").drop("row").dropDuplicates(["k1", "k2"])


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """All columns but the text, with ``kept`` (bytes), n_bytes, n_removed and n_spans.

    With ``digest`` the SHA-256 of the kept bytes, ``kept_sha256``, takes the place of ``kept``,
    and the result is written.
    """
    with small_batches(docs.sparkSession):
        spans = bounded(repeated_spans(docs, id, text, length, gram))
    result = T.StructField(*("kept_sha256", T.StringType()) if digest else
                           ("kept", T.BinaryType()))
    outputs = [result, *(T.StructField(n, T.LongType())
                         for n in ("n_bytes", "n_removed", "n_spans"))]
    taken = {f.name.lower() for f in outputs}
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in taken]
    names = [f.name for f in (*kept, *outputs)]
    joined = by_row(docs, id, text, spans, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(len(kept)), batch.column(len(kept) + 1)
            _, at = utf8(texts)
            for low, high in slices(at):
                out, sizes, gone, runs = [], [], [], []
                for one, ranges in zip(texts.slice(low, high - low), cuts.slice(low, high - low)):
                    whole = one.as_buffer() or b""
                    cut = merged_spans([(s["start"], s["end"]) for s in ranges.as_py() or []])
                    ends = [0, *(x for span in cut for x in span), len(whole)]
                    parts = [whole[a:b] for a, b in zip(ends[::2], ends[1::2])]
                    left = sum(map(len, parts))
                    if digest:
                        sha = hashlib.sha256()
                        for part in parts:
                            sha.update(part)
                        out.append(sha.hexdigest())
                    else:
                        out.append(b"".join(parts))
                    sizes.append(len(whole))
                    gone.append(len(whole) - left)
                    runs.append(len(cut))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(low, high - low) for i in range(len(kept))),
                     pa.array(out, pa.string() if digest else pa.binary()),
                     *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names=names)

    sent = by_place(joined, [f.name for f in kept], F.col(f"`{text}`"), F.col("__spans"))
    result = sent.mapInArrow(run, T.StructType(kept + outputs))
    if not digest:
        return result
    with small_batches(docs.sparkSession):
        return materialize(result)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what stays."""
    return remove_repeats(docs.select("doc_id", "text"), digest=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

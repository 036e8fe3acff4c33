"""Runs of words that repeat periodically, by a suffix automaton with link-cut access.

The words of a text are numbered by equality.  Where words are appended one by one, each
suffix of the text so far has a place at which it ended last.  In the tree of suffix
links of the automaton these places colour the path from a prefix to the root in
segments; appending a word gives the whole path of the new prefix one colour.  A link-cut
tree keeps every segment as a splay tree, and its access passes all segments that are
recoloured.  If the longest suffix of a segment has L words and ended d words earlier,
with d <= L, the last L + d words have the smallest period d, and no longer stretch that
ends here has it: a square, extended to the left as far as it goes.  The stretches of
one start and period, the longest of them, are the run.

Words of a run of length ``times`` * period or more occur ``times`` times in it, so words
that occur fewer times in a stretch of text cut it in two before the automaton is built;
this loses no run and leaves nearly nothing of ordinary prose.

A null or empty text has no words and no runs, and collapses to the empty text.  A text of
any length is worked on whole, in one task.  Repeated rows are worked on each, an empty
table gives an empty table.  Further columns are kept but for those that bear the name of
an output column.  Of runs with the same exponent the one that starts first is the
strongest, then that of the shorter period.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.common import by_place, slices, utf8

#: A run has so many periods, and so many words, at least.
TIMES, SHORTEST = 4, 6
#: Rounds of cutting at words that are too rare; further rounds would only save time.
ROUNDS = 20
#: Characters between words.
BLANK = "[\\x20\\x09-\\x0D]+"


class SuffixTree:
    """The links of the suffix automaton of a word sequence, with access from prefixes.

    State 0 is the root (the empty suffix), ``length`` the longest suffix of a state.
    """

    def __init__(self, words: list[int]):
        steps: list[dict[int, int]] = [{}]
        length, link = [0], [-1]
        self.prefix: list[int] = []
        last = 0
        for word in words:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and word not in steps[at]:
                steps[at][word] = new
                at = link[at]
            if at >= 0:
                after = steps[at][word]
                if length[after] == length[at] + 1:
                    link[new] = after
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[after])
                    steps.append(dict(steps[after]))
                    while at >= 0 and steps[at].get(word) == after:
                        steps[at][word] = copy
                        at = link[at]
                    link[after] = link[new] = copy
            self.prefix.append(new)
            last = new
        self.length = length
        # splay trees of the segments, ordered by depth; ``up`` leads to the parent in the
        # splay tree, or from its root to the state above the segment
        self.up = link
        self.low = [-1] * len(length)   # towards the root of the links
        self.high = [-1] * len(length)  # away from it
        self.colour = [-1] * len(length)  # of a segment, kept at its splay root

    def _splay(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        top = x
        while (y := up[top]) >= 0 and (low[y] == top or high[y] == top):
            top = y
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while True:
            y = up[x]
            if y < 0 or (low[y] != x and high[y] != x):
                return
            z = up[y]
            if z >= 0 and (low[z] == y or high[z] == y):
                self._rotate(y if (low[z] == y) == (low[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        y = up[x]
        z = up[y]
        if low[y] == x:
            inner = low[y] = high[x]
            high[x] = y
        else:
            inner = high[y] = low[x]
            low[x] = y
        if inner >= 0:
            up[inner] = y
        up[y] = x
        up[x] = z
        if z >= 0:
            if low[z] == y:
                low[z] = x
            elif high[z] == y:
                high[z] = x

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """Colour the path from a state to the root with ``place``.

        Returns (longest suffix, colour before) of the segments that the path met.
        """
        met: list[tuple[int, int]] = []
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            if self.colour[x] >= 0:
                met.append((self.length[x], self.colour[x]))
            off = self.high[x]
            if off >= 0:  # what lies deeper keeps its colour
                self.colour[off] = self.colour[x]
            self.high[x] = below
            below, x = x, self.up[x]
        self._splay(state)
        self.colour[state] = place
        return met


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """Last word of each stretch of smallest period p, two periods or longer, by (start, p)."""
    tree = SuffixTree(words)
    last: dict[tuple[int, int], int] = {}
    for i, state in enumerate(tree.prefix):
        for longest, before in tree.access(state, i):
            period = i - before
            if period <= longest:
                last[i - period - longest + 1, period] = i
    return last


def stretches(ids: np.ndarray, times: int, shortest: int) -> list[tuple[int, int]]:
    """Ranges outside which no word is in a run, each word in them occurring ``times`` times."""
    alive = np.arange(len(ids))
    part = np.zeros(len(ids), np.int64)
    for _ in range(ROUNDS):
        if len(alive) < shortest:
            return []
        _, same, count = np.unique(
            np.stack([part, ids[alive]]), axis=1, return_inverse=True, return_counts=True)
        often = count[same.reshape(-1)] >= times
        kept = alive[often]
        # a stretch ends where a word is missing
        part = np.cumsum(np.diff(kept, prepend=-2) != 1)
        size = np.bincount(part)
        long = size[part] >= shortest
        if often.all() and long.all():
            break
        alive, part = kept[long], part[long]
    heads = np.flatnonzero(np.diff(alive, prepend=-2) != 1)
    ends = np.append(heads[1:], len(alive))
    return [(int(alive[a]), int(alive[b - 1]) + 1) for a, b in zip(heads, ends)]


def runs(words: list[bytes], times: int = TIMES, shortest: int = SHORTEST):
    """(start, length, period) of the runs of a text's words, by start and period."""
    if len(words) < shortest:
        return []
    # most texts hold no stretch of words that all occur often enough
    often = {w: i for i, (w, n) in enumerate(Counter(words).items()) if n >= times}
    if not often:
        return []
    ids = np.fromiter((often.get(w, -1) for w in words), np.int64, len(words))
    out = []
    place = np.flatnonzero(ids >= 0)
    if not len(place):
        return []
    ids[ids < 0] = -1 - np.arange(int((ids < 0).sum()))  # all different
    for low, high in stretches(ids, times, shortest):
        for (start, period), last in squares(ids[low:high].tolist()).items():
            size = last - start + 1
            if size >= max(shortest, times * period):
                out.append((low + start, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; of equal ones the first, then the shortest period."""

    def compare(a, b) -> int:
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(found, key=cmp_to_key(compare)) if found else None


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run cut down to its first period."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in found:
        gone[start + period] += 1
        gone[start + size] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_OUTPUTS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(_RUN, False)),
    T.StructField("strongest", _RUN),
    T.StructField("collapsed", T.StringType()),
]


def periodic_runs(df: DataFrame, text: str = "text", times: int = TIMES,
                  shortest: int = SHORTEST, keep_text: bool = False) -> DataFrame:
    """All rows with n_words, their runs, the strongest run, and the text collapsed.

    ``text`` itself comes back only if asked for.
    """
    taken = {f.name for f in _OUTPUTS}
    kept = [f for f in df.schema.fields
            if f.name.lower() not in taken and (keep_text or f.name != text)]
    names = [*(f.name for f in kept), *(f.name for f in _OUTPUTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(len(kept))
            _, at = utf8(whole)
            for low, high in slices(at):
                counts, lists, best, short = [], [], [], []
                for one in whole.slice(low, high - low).cast(pa.binary()).to_pylist():
                    words = (one or b"").split()  # splits at the six characters of BLANK
                    found = runs(words, times, shortest)
                    counts.append(len(words))
                    lists.append([dict(zip(_RUN.names, r)) for r in found])
                    top = strongest(found)
                    best.append(top and dict(zip(_RUN.names, top)))
                    short.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(low, high - low) for i in range(len(kept))),
                     pa.array(counts, pa.int64()), pa.array(lists, pa.list_(_RUN_ARROW)),
                     pa.array(best, _RUN_ARROW), pa.array(short, pa.binary()).cast(pa.string())],
                    names=names)

    source = by_place(df, [f.name for f in kept], F.col(f"`{text}`"))
    return source.mapInArrow(run, T.StructType(kept + _OUTPUTS))


def looped(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by the check sum of the id) with a part that loops.

    With h the unsigned CRC-32 of the decimal id and g = h // 10, a text of n > 0 words with
    h % 10 = 0 has from word a = g % n on the p words from there over and over, p being
    1 + (n - a) // (3 + g % 8).  A row without an id stays as it is.
    """
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), BLANK), lambda w: w != "")
    split = docs.select("doc_id", "text", check.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    first = (g % F.nullif(n, F.lit(0))).cast("int")
    period = F.lit(1) + F.floor((n - first) / (3 + g % 8)).cast("int")
    loop = F.array_repeat(F.slice("words", first + 1, period),
                          F.ceil((n - first) / period).cast("int"))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), first), F.flatten(loop)), F.lit(1), n)
    return split.select(
        "doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def period_report(docs: DataFrame) -> DataFrame:
    """Number and digest of the runs of each document, its strongest run, and the collapsed text."""
    rows = periodic_runs(looped(docs))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
               .cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

"""Secret candidates and how widely the corpus owns them.

One pass over the texts finds the candidate spans.  The value of each is hashed, and
the corpus is counted by hash: in how many repositories and under how many owners a
value occurs.  A value with many owners or repositories is a copied example; one that
stays with an owner looks like a live credential.  Bare random-looking words, which
no keyword announces, are candidates too; they become spans (kind ``bare``) only if
their ownership looks live, so that widely copied digests and sample keys do not.

A null or empty text has no spans.  A text of any length is scanned whole.  Repeated
rows each get their row; a value is counted once per repository.  A null owner or
repository does not count.  Spans that start together come in the order of ``KINDS``.
An empty table gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.sources.scratch import materialize

KINDS = ["assign", "access", "hex", "bare"]

# The base patterns and the least length of what they match.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
HINTS = ("passw", "secret", "token", "api")

#: Bare words: at least so long, with so many digits and different characters.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BARE_DIGITS, BARE_DIFFERENT = 3, 10
#: Above so many owners, or repositories, a value counts as a copied example.
OWNERS, REPOSITORIES = 1, 5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind, end and value of each base span, by start and kind."""
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)
                  if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking words that no base span touches."""
    found = []
    for m in BARE.finditer(text):
        word = m[0]
        digits = sum(map(str.isdigit, word))
        if digits < BARE_DIGITS or digits == len(word) or len(set(word)) < BARE_DIFFERENT:
            continue
        if not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
            found.append((m.start(), 3, m.end(), word))
    return found


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                   ("value", pa.int64())])
_CANDIDATES = "array<struct<start:int,kind:int,end:int,value:bigint>>"


def candidates(docs: DataFrame, text: str, repository: str, owner: str) -> DataFrame:
    """A row per document: its candidate spans with hashed values, and the base digest.

    ``part`` and ``line`` number the rows; write the table before relying on them.
    """
    source = docs.select(
        F.col(repository).alias("repository"), F.col(owner).alias("owner"),
        F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = (f"part int, line long, repository {kinds['repository']}, owner {kinds['owner']}, "
              f"base_sha256 string, candidates {_CANDIDATES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, line = TaskContext.get().partitionId(), 0
        for batch in batches:
            digests, spans = [], []
            for value in batch.column("text"):
                content = value.as_py() or ""
                base = base_spans(content)
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([
                    (s, k, e, xxhash.xxh64_intdigest(v) - (1 << 63))
                    for s, k, e, v in base + bare_spans(content, base)])
            rows = len(digests)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * rows, pa.int32()),
                pa.array(range(line, line + rows), pa.int64()),
                batch.column("repository"), batch.column("owner"),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(_SPAN)),
            ], names=["part", "line", "repository", "owner", "base_sha256", "candidates"])
            line += rows

    return source.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate value.

    Counts combine before each shuffle, by (value, repository) and (value, owner)
    first, so a value that fills the corpus is spread over all tasks.
    """
    return (found.select("repository", "owner", F.explode("candidates.value").alias("value"))
            .groupBy("value")
            .agg(F.count_distinct("repository").alias("n_repositories"),
                 F.count_distinct("owner").alias("n_owners")))


def secret_spans(docs: DataFrame, text: str = "text", repository: str = "doc_id",
                 owner: str = "source") -> DataFrame:
    """Per document: its spans with the ownership of their values.

    ``spans`` is an array by start and kind of (start, kind, end, value, n_repositories,
    n_owners, live); bare spans are there only if live.
    """
    found = materialize(candidates(docs, text, repository, owner))
    each = found.select("part", "line", F.explode("candidates").alias("c")).select(
        "part", "line", "c.*")
    live = (F.col("n_owners") <= OWNERS) & (F.col("n_repositories") <= REPOSITORIES)
    # one row per value on the right; a hot value splits on the left
    rated = each.join(ownership(found), "value").withColumn("live", live)
    rated = rated.where("live or kind <> 3")
    spans = F.sort_array(F.collect_list(F.struct(
        "start", "kind", "end", "value", "n_repositories", "n_owners", "live"))).alias("spans")
    by_row = rated.groupBy("part", "line").agg(spans)
    return (found.select("part", "line", F.col("repository").alias(repository), "base_sha256")
            .join(by_row, ["part", "line"], "left")
            .drop("part", "line"))


def _counted(kind: int) -> Column:
    return F.coalesce(
        F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans as text."""
    live = F.size(F.filter("spans", lambda s: s["live"]))
    return secret_spans(docs).select(
        "doc_id",
        _counted(0).alias("n_assign"), _counted(1).alias("n_access"), _counted(2).alias("n_hex"),
        "base_sha256",
        spans_text(F.col("spans")).alias("spans"),
        F.when(F.col("spans").isNull(), 0).otherwise(live).cast("long").alias("n_live"),
    )

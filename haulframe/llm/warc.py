"""WARC archives: written as text, read back by boundary-chain verification.

Writing gives a record per row.  Of rows with equal payloads of a least size one is
the response; the others revisit it and hold no payload.

Reading splits archives at any byte.  Spark's own reader cuts a file at the version
line ``WARC/1.1``, so that a task gets the pieces of its block without seeing the rest
of the file; a payload may hold such a line too, so a piece is only a candidate.  A
task emits, for each candidate of its block, the offset at which the chain that starts
there leaves the block (a record names its successor by its content length).  Only the
candidates that such a chain reaches from another block matter further: pointer
jumping from the start of each file over them finds the one entry of every block.  The
second pass walks from the entry and so takes true records only; what a magic line in
a payload cuts off is put back, also when the rest lies in later blocks.

A null payload is empty.  A payload of any length is kept whole.  Line breaks in a url
are written as spaces; a null url is written empty and comes back empty.  Of
repeated rows with the largest id all are responses; rows with a null id are responses
of their own.  An empty table gives an empty archive and no records.  A chain that
meets no record at its next offset (a damaged file) ends there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulframe.llm.common import bounded, table
from haulframe.sources.scratch import (
    broadcast_limit,
    materialize,
    materialize_measured,
    new_path,
)

# The version line and what ends the header and the record.
MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
_MAGIC, _GAP = MAGIC.encode(), GAP.encode()
DATE = "2024-01-01T00:00:00Z"

#: Smaller payloads are stored again rather than revisited.
LEAST_REVISITED = 1000
#: Rows of one archive file at most.
RECORDS_PER_FILE = 100_000

_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: (\d+)(?:\r\n|$)")


def with_record_type(pages: DataFrame) -> DataFrame:
    """Add record_type and refers_to; needs page_id, payload, payload_digest, payload_bytes."""
    large = pages.where(F.col("payload_bytes") >= LEAST_REVISITED)
    copied = (large.groupBy("payload_digest")
              .agg(F.max("page_id").alias("first_id"), F.count("page_id").alias("copies"))
              .where("copies > 1").select("payload_digest", "first_id"))
    # copied to all tasks if its measured size allows, so that no payload is shuffled; beyond
    # that one row a digest on the right, and a digest of many pages splits on the left
    joined = pages.join(bounded(copied), "payload_digest", "left")
    revisit = ((F.col("payload_bytes") >= LEAST_REVISITED)
               & (F.col("page_id") < F.col("first_id")))
    return joined.select(
        *pages.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_text() -> Column:
    """Header and block of a record; the gap that ends it is the writer's."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"),
                                 F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(GAP), body)


def write_archives(pages: DataFrame, folder: str, payload: str = "html") -> None:
    """A record per row of (page_id, url, payload) into archive files under ``folder``."""
    content = F.coalesce(F.col(payload), F.lit(""))
    ready = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", content.alias("payload"),
        F.sha1(content.cast("binary")).alias("payload_digest"),
        F.octet_length(content).cast("long").alias("payload_bytes"))
    (with_record_type(ready).select(record_text().alias("value"))
     .write.option("lineSep", GAP).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each version line, in file order within a block of a file."""
    return (spark.read.option("lineSep", MAGIC).text(folder)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"),
                    F.col("value").cast("binary").alias("value")))


def successor(piece: bytes) -> int | None:
    """Bytes from the version line to the next record, if a header stands here."""
    head = piece.find(_GAP)
    found = _LENGTH.search(piece[:head]) if head >= 0 else None
    if found is None:
        return None
    return len(_MAGIC) + head + len(_GAP) + int(found[1]) + len(_GAP)


def _by_block(batches: Iterator[pa.RecordBatch]):
    """Rows as (file, block, offset of the version line in the block, value, batch row)."""
    now, at = None, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for i, value in enumerate(batch.column("value")):
            if (files[i], blocks[i]) != now:
                now, at = (files[i], blocks[i]), 0
            content = value.as_py()
            yield files[i], blocks[i], at - len(_MAGIC), content, batch, i
            at += len(content) + len(_MAGIC)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each block with the offset at which their chain leaves the block."""

    def closed(key, starts, nexts, size):
        leaves = {}
        for start, goes in zip(reversed(starts), reversed(nexts)):
            if goes is not None and goes < size - len(_MAGIC):
                goes = leaves.get(goes)
            leaves[start] = goes
        out = [(s, e) for s, e in leaves.items() if e is not None] or [(None, None)]
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * len(out)), pa.array([key[1]] * len(out), pa.int64()),
            pa.array([size] * len(out), pa.int64()),
            pa.array([s for s, _ in out], pa.int64()),
            pa.array([e for _, e in out], pa.int64()),
        ], names=["file", "block", "size", "start", "leaves"])

    now, starts, nexts, size = None, [], [], 0
    for file, block, at, content, _, _ in _by_block(batches):
        if (file, block) != now:
            if now:
                yield closed(now, starts, nexts, size)
            now, starts, nexts = (file, block), [], []
        step = successor(content)
        if not (block == 0 and at < 0):  # before the first version line of a file
            starts.append(at)
            nexts.append(None if step is None else at + step)
        size = at + len(_MAGIC) + len(content) + len(_MAGIC)
    if now:
        yield closed(now, starts, nexts, size)


def block_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The first true record of each block as an offset in the block, and the table's bytes.

    One row per block that a chain from the start of its file enters.
    """
    chains = materialize(pieces(spark, folder).mapInArrow(
        _chains, "file string, block long, size long, start long, leaves long"))
    in_file = Window.partitionBy("file").orderBy("block")
    # one row a block: the sizes of a file's blocks, not of its records
    blocks = materialize(
        chains.groupBy("file", "block").agg(F.first("size").alias("size"))
        .withColumn("base", F.sum("size").over(in_file) - F.col("size"))
        .withColumn("nth", F.row_number().over(in_file)))
    places = chains.where("start is not null").join(blocks, ["file", "block"]).select(
        "file", "block", "base", (F.col("base") + F.col("start")).alias("at"),
        (F.col("base") + F.col("leaves")).alias("next"))
    starts = blocks.where("nth = 1").select("file", F.lit(0).cast("long").alias("at"))
    targets = places.select("file", F.col("next").alias("at")).union(starts).distinct()
    # candidates that a chain from elsewhere can enter
    graph = materialize(places.join(targets, ["file", "at"], "left_semi"))
    longest = blocks.agg(F.max("nth")).first()[0] or 1
    reached, jump = starts, graph.select("file", "at", "next")
    for _ in range(math.ceil(math.log2(longest))):
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = materialize(reached.union(onward).distinct())
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("last"))
        jump = materialize(jump.join(further, ["file", "next"]).select(
            "file", "at", F.col("last").alias("next")))
    entries = graph.join(reached, ["file", "at"], "left_semi").select(
        "file", "block", "base", (F.col("at") - F.col("base")).alias("entry"))
    # blocks without an entry are needed as well: they may hold the rest of a payload
    every = blocks.select("file", "block", "base").join(
        entries.select("file", "block", "entry"), ["file", "block"], "left")
    return materialize_measured(every)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True records of each block, and pieces that belong to a record of an earlier block."""
    fields = ["file", "at", "head", "length", "body"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows, held = [], 0

    def flushed():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=fields)

    now, record, expected, base = None, None, None, 0

    def ended():
        file, at, head, length, parts = record
        return (file, at, head, length, b"".join(parts)[:length])

    for file, block, at, content, batch, i in _by_block(batches):
        if (file, block) != now:
            if record:
                rows.append(ended())
            now, record = (file, block), None
            expected, base = batch.column("entry")[i].as_py(), batch.column("base")[i].as_py()
        step = successor(content) if at == expected else None
        if step is not None:
            if record:
                rows.append(ended())
            head = content.find(_GAP)
            length = step - len(_MAGIC) - head - 2 * len(_GAP)
            record = (file, base + at, content[:head].decode("utf-8", "replace"), length,
                      [content[head + len(_GAP):]])
            expected = at + step
        elif record:
            record[4].append(_MAGIC + content)
        elif not (block == 0 and at < 0):
            rows.append((file, base + at, None, None, _MAGIC + content))
        held += len(content)
        if held > 8 << 20:
            yield flushed()
            rows, held = [], 0
    if record:
        rows.append(ended())
    if rows:
        yield flushed()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records under ``folder``: file, offset, head (header text) and payload (bytes)."""
    entries, size = block_entries(spark, folder)
    all_pieces = pieces(spark, folder)
    if size <= broadcast_limit(spark):  # measured when it was written
        placed = all_pieces.join(F.broadcast(entries), ["file", "block"])
    else:
        placed = (all_pieces.join(entries.hint("merge"), ["file", "block"])
                  .repartition("file", "block").sortWithinPartitions("file", "block", "seq"))
    found = placed.select("file", "block", "value", "base", "entry").mapInArrow(
        _records, "file string, at long, head string, length long, body binary")
    found = found.select("*", (F.octet_length("body") < F.col("length")).alias("cut"))
    whole = found.where("head is not null and not cut").select(
        "file", F.col("at").alias("offset"), "head", F.col("body").alias("payload"))
    # payloads that go on in the next blocks: few, so written apart
    loose = materialize(found.where("head is null or cut"))
    owner = F.last(F.when(F.col("head").isNotNull(), F.col("at")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("at"))
    joined = (loose.withColumn("offset", owner).where("offset is not null")
              .groupBy("file", "offset")
              .agg(F.max("head").alias("head"), F.max("length").alias("length"),
                   F.sort_array(F.collect_list(F.struct("at", "body"))).alias("parts")))
    body = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["body"]))
    mended = joined.select("file", "offset", "head",
                           F.substring(body, F.lit(1), F.col("length").cast("int")).alias("payload"))
    return whole.unionByName(mended)


def header_field(name: str) -> Column:
    """Value of a header line, or null."""
    value = F.regexp_extract("head", f"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(F.col("head").rlike(f"(?:^|\r\n){name}: "), value)


def page_number(name: str) -> Column:
    """The page id in a record id, or null."""
    digits = F.regexp_extract(header_field(name), r"<urn:page:(-?\d+)>", 1)
    return F.when(digits != "", digits.cast("long"))


def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    """Write the pages as archives, read these back, and tell of each record."""
    place = new_path(spark)
    write_archives(table(spark, folder, "pages"), place)
    response = F.col("record_type") == "response"
    found = read_archives(spark, place).select(
        page_number("WARC-Record-ID").alias("page_id"),
        header_field("WARC-Type").alias("record_type"),
        page_number("WARC-Refers-To").alias("refers_to"),
        header_field("WARC-Payload-Digest").alias("stated"),
        header_field("WARC-Payload-Length").cast("long").alias("stated_bytes"),
        "payload")
    return found.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long"))
        .otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload"))
        .otherwise(F.regexp_replace("stated", "^sha1:", "")).alias("payload_digest"),
        "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
                 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM r
"""

"""Readers for field files and literal tables.

What the files are and what their first lines say is found by tasks; the driver gets one
row per distinct header, and the names of files only where several headers occur.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.functions.text import blank_to_null
from haulframe.operators.joins import attach, tagged_union, union_all
from haulframe.operators.ordered import row_positions

ROW_SEQ = "row_seq"
# Longest header line, files that the driver opens at a time where tasks cannot, and what a
# block of a packed file can be at most larger than the file it is a copy of.
HEADER_BYTES = 1 << 20
OPEN_FILES = 16
MOST_PACKED = 1 << 12
# Lines that one task can number (the low bits of Spark's row numbers).
LINES_OF_TASK = 1 << 33


class UnknownHeader(ValueError):
    """A file whose first line names none of the expected columns, or names one twice."""


def listed_files(spark: SparkSession, path: str | Sequence[str], pattern: str) -> DataFrame:
    """(path, file, length) of the matching files; ``file`` is the path as rows carry it.

    Only the listing is read, by tasks where there are many folders.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("_metadata.file_path").alias("file"), "length")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Hadoop writes it, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest)}")


def _reachable(path: str) -> bool:
    """Whether Python can open files of this store."""
    try:
        _store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, line) of the files of each batch; no more than the first line is read."""
    for batch in batches:
        lines = []
        for path in batch.column(0).to_pylist():
            store, place = _store(path)
            with store.open_input_stream(place, compression="detect", buffer_size=1 << 16) as stream:
                read, end = b"", -1
                while end < 0 and len(read) < HEADER_BYTES and (more := stream.read(1 << 14)):
                    read += more
                    end = read.find(b"\n")
            line = read[:end] if end >= 0 else read
            lines.append(line.decode("utf-8", "replace") if read else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lines, pa.string())], names=["path", "line"])


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, or None if it is empty, read by the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        line = jvm.org.apache.hadoop.io.Text()
        size = jvm.org.apache.hadoop.util.LineReader(plain).readLine(line, HEADER_BYTES)
        return line.toString() if size else None
    finally:
        stream.close()


def first_lines(files: DataFrame) -> DataFrame:
    """(path, line) of each file, the line missing where the file is empty.

    Tasks open the files.  In a store that only the JVM reaches, the driver does.
    """
    one = files.select("path").first()
    if one is None or _reachable(one.path):
        return files.select("path").mapInArrow(_first_lines, "path string, line string")
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").collect()]
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), paths))
    return spark.createDataFrame(list(zip(paths, lines)), "path string, line string")


def header_names(line: str) -> list[str]:
    """Column names of a header line, quoted or not."""
    return next(csv.reader([line.rstrip("\r")]))


def _plain(name: str) -> str:
    return name.lstrip("\ufeff").strip().casefold()


def header_groups(
    lines: DataFrame, expected: Sequence[str]
) -> dict[tuple[str, ...], list[str] | None]:
    """Files per header, or None for all files if there is one header only.

    A header that names no expected column, or one of them twice, is an error that
    names a file; an empty file has no rows and no group.
    """
    known = {_plain(n) for n in expected}
    found = lines.groupBy("line").agg(F.min("path").alias("path")).orderBy("path").collect()
    if not found:
        raise FileNotFoundError("no file matches")
    by_names: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        if row.line is None:
            continue
        names = tuple(header_names(row.line))
        wanted = [n for n in map(_plain, names) if n in known]
        if not wanted or len(set(wanted)) < len(wanted):
            raise UnknownHeader(
                f"{row.path}: header {row.line[:200]!r}, expected some of {expected}")
        by_names.setdefault(names, []).append(row.line)
    if len(found) == 1 and by_names:
        return dict.fromkeys(by_names)
    return {names: sorted(r.path for r in lines.filter(F.col("line").isin(own)).collect())
            for names, own in by_names.items()}


def _rows_of(
    spark: SparkSession,
    names: Sequence[str],
    load: Sequence[str] | str,
    schema: T.StructType,
    aliases: dict[str, str],
    pattern: str | None = None,
    base: str | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Rows of files that share a header, by the columns of ``schema``.

    ``tag`` is a column that folders below ``base`` are named by.
    """
    # every column is text; Spark compares these names with the header of each file
    checked = all(n.strip() for n in names) and len({_plain(n) for n in names}) == len(names)
    raw_names = names if checked else [f"_c{i}" for i in range(len(names))]
    reader = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in raw_names]))
        .option("header", True)
        .option("enforceSchema", not checked)
    )
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if base is not None:
        reader = reader.option("basePath", base)
    raw = reader.csv(load)
    renamed = {_plain(k): _plain(v) for k, v in aliases.items()}
    place = {renamed.get(_plain(n), _plain(n)): raw_names[i] for i, n in enumerate(names)}
    columns = []
    for f in schema.fields:
        at = place.get(_plain(f.name))
        value = F.lit(None) if at is None else blank_to_null(F.col(f"`{at}`"))
        cast = value.cast(f.dataType) if at is None else value.try_cast(f.dataType)
        columns.append(cast.alias(f.name))
    tags = [] if tag is None else [F.col(f"`{tag}`")]
    return raw.select(
        *columns, *tags, F.col("_metadata.file_path").alias("__file"),
        _line_order().alias("__line"),
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    pattern: str = "*.csv",
    aliases: dict[str, str] | None = None,
    same_header: bool = False,
    tag: str | None = None,
) -> DataFrame:
    """Read all matching files by column *name* into one schema.

    Files may order or omit columns differently and write names in another case;
    an omitted column is NULL, unreadable numbers are NULL, and ``""`` and ``NA``
    are NULL.  ``aliases`` maps a file's column name to the schema's.  ``row_seq``
    is a number that keeps the order of lines, file by file in path order.  The
    first line of each file is read for its names, by tasks; a file that names no column
    of the schema is an error.  With ``same_header`` all files have the schema's
    columns in its order; no first line is read, and Spark raises an error at a
    file that has not.  ``tag`` names a column whose value stands in the names of the
    folders below ``path`` (``year=2021``); a filter on it opens the files of those folders
    only.
    """
    return _read(spark, path, schema, pattern, aliases, same_header, tag).drop("__file")


def _read(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    pattern: str = "*.csv",
    aliases: dict[str, str] | None = None,
    same_header: bool = False,
    tag: str | None = None,
) -> DataFrame:
    """``read_csv`` with the file of each row in ``__file``."""
    aliases = aliases or {}
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    files = listed_files(spark, path, pattern)
    base = path if tag is not None else None
    if same_header:
        groups = {tuple(schema.names): None}
        aliases = {}
    else:
        try:
            groups = header_groups(first_lines(files), [*schema.names, *aliases])
        except FileNotFoundError:
            raise FileNotFoundError(f"no file matches {pattern} in {path}") from None
    parts = [
        _rows_of(spark, names, path if own is None else own, schema, aliases,
                 pattern if own is None else None, base, tag)
        for names, own in groups.items()
    ]
    tags = [] if tag is None else [tag]
    if not parts:
        fields = [*schema.fields, *(T.StructField(t, T.StringType()) for t in tags)]
        return spark.createDataFrame([], T.StructType(fields)).withColumns(
            {ROW_SEQ: F.lit(None).cast("long"), "__file": F.lit(None).cast("string")}
        )
    # room for the line numbers of one file
    packed = F.when(F.max(F.col("path").rlike(r"\.(gz|bz2|zst)$")), MOST_PACKED).otherwise(1)
    room = files.agg((F.max("length") * packed + LINES_OF_TASK).alias("__room"))
    ranked = row_positions(files.select("path", "file"), [], ["path"], "__rank")
    # one row
    ranks = ranked.join(F.broadcast(room)).select(
        F.col("file").alias("__file"), ((F.col("__rank") - 1) * F.col("__room")).alias("__base"))
    return attach(union_all(*parts), ranks, ["__file"]).select(
        *schema.names, *tags, (F.col("__base") + F.col("__line")).alias(ROW_SEQ), "__file"
    )


def _line_order() -> Column:
    """A number that grows line by line within one file.

    A block of a file starts at a byte offset, and a task reads fewer lines
    before the end of a block than the block has bytes; offset plus line
    number in the task therefore never overlaps with the next block.
    """
    line_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(LINES_OF_TASK - 1))
    return F.col("_metadata.file_block_start") + line_in_task


def _same_form(path: str | Column) -> str | Column:
    """A qualified path with one slash after its scheme, as stores write it differently."""
    if isinstance(path, str):
        return re.sub(r"^(\w+):/+", r"\1:/", path)
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def read_tagged(
    spark: SparkSession,
    paths: dict,
    schema: str | T.StructType,
    tag: str = "year",
    **options,
) -> DataFrame:
    """Read the folders of all keys in one go and write each one's key into a column.

    Folders that bear the key in their name are better read by ``read_csv`` with ``tag``.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    starts = {}
    for key, folder in paths.items():
        place = jvm.org.apache.hadoop.fs.Path(folder)
        whole = place.getFileSystem(conf).makeQualified(place).toUri().toString()
        starts[key] = _same_form(whole) + "/"
    if any(a.startswith(b) for i, a in starts.items() for j, b in starts.items() if i != j):
        # folders within each other: a file has several keys
        return tagged_union(
            {k: read_csv(spark, p, schema, **options) for k, p in paths.items()}, tag)
    file, value = _same_form(F.col("__file")), F
    for key, start in starts.items():
        value = value.when(F.startswith(file, F.lit(start)), F.lit(key))
    rows = _read(spark, list(paths.values()), schema, **options)
    return rows.withColumn(tag, value).drop("__file")


def literal_table(
    spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType
) -> DataFrame:
    """A small table written out in code."""
    return spark.createDataFrame(list(rows), schema)

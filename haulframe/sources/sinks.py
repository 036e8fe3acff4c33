"""Writers.  Sinks are folders written in parallel by the executors.

``write_one_csv`` joins such parts into one file, byte by byte in the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, missing values written as NA."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(
        path
    )


def write_one_csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """One CSV file with one header, its rows in the given order.

    Tasks write sorted parts beside the file; their bytes are then strung together behind
    the header, and the result takes its name when it is whole.  No task and no driver
    holds the table.  After a failure neither parts nor a partial file are left, and a
    file that was there before is as it was.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    parts = hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    whole = hadoop.fs.Path(parts, "whole")
    try:
        rows = df.orderBy(*order) if order else df
        body = hadoop.fs.Path(parts, "body")
        rows.write.option("header", False).option("nullValue", "NA").csv(body.toString())
        header = hadoop.fs.Path(parts, "header")
        names = spark.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))])
        names.coalesce(1).write.option("header", False).csv(header.toString())
        out = store.create(whole)
        try:
            for folder in (header, body):
                found = store.globStatus(hadoop.fs.Path(folder, "part-*")) or []
                # part numbers follow the order of the rows
                for part in sorted((f.getPath() for f in found), key=lambda p: p.getName()):
                    stream = store.open(part)
                    try:
                        hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                    finally:
                        stream.close()
        finally:
            out.close()
        # a store that renames in one step commits in one step
        files = hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(store.makeQualified(whole), store.makeQualified(place), options)
    finally:
        store.delete(parts, True)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, split into folders by the ``by`` columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(test: DataFrame, path: str) -> None:
    """One-row test result as a structured report."""
    write_csv(test, path)

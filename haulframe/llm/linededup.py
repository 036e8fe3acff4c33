"""Lines that many documents share, counted by levelled sorted runs of line hashes.

The key of a line is the line without white space at both ends, A-Z in lower case.
Documents arrive in batches.  A batch is counted (documents per key), loses by a merge
anti-join the keys that the runs already hold as settled (in enough documents, so more
counts change nothing), and is added as a sorted run of level 0.  When a level has
``fanout`` runs they are merged into one run of the next level.  The runs left at the
end give the keys whose lines go.

A run is a bucketed table: keys dealt by hash into as many buckets as every other run,
one sorted file a bucket.  So a batch is shuffled once, when it is counted; the
anti-joins and the merges read the buckets of the runs as they lie.

A null or empty text is one empty line; empty keys never go, so such lines stay.  All
lines dropped gives an empty text.  A text of any length is split whole.  A row is a
document, whatever its id: rows that repeat, or lack an id, count each, and equal ones get
the same result.  An empty table gives an empty table.  Further columns of the input
are kept, but for those that bear the name of an output column.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from haulframe.llm.common import ascii_lower, bounded, by_row, row_key
from haulframe.sources.scratch import materialize, new_path

# White space that does not count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

#: A key in at least so many documents loses its lines.
DOCUMENTS = 10
#: Batches the documents come in, and runs of a level that are merged into one.
BATCHES, FANOUT = 4, 2
#: Lines for which a run has one more bucket, up to the session's shuffle partitions.
BUCKET_LINES = 250_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, id: str, text: str, batches: int) -> tuple[DataFrame, int]:
    """Row, its key, position, 128-bit hash and batch of each line that has a key; their number.

    Written once, so that the numbers of the rows are the same for every reader.
    """
    rows = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    lines = rows.select(
        "row", "k1", "k2", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    keyed = lines.select("row", "k1", "k2", "pos", key.alias("key")).where("key <> ''")
    lower = keyed.withColumn("key", ascii_lower(F.col("key")))
    hashed = lower.select(
        "row", "k1", "k2", "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"))
    seen = Observation()
    path = new_path(docs.sparkSession)
    hashed.observe(seen, F.count("*").alias("n")).write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(hashed.schema).parquet(path), seen.get["n"] or 0


class LevelledRuns:
    """Levels of sorted runs (h1, h2, n); level i+1 holds merged runs of level i."""

    def __init__(self, spark: SparkSession, enough: int, fanout: int, buckets: int):
        self.spark, self.enough, self.fanout, self.buckets = spark, enough, fanout, buckets
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def write(self, counts: DataFrame) -> str:
        """Write counts that are dealt by key as a run, and return its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        (counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", new_path(self.spark)).saveAsTable(name))
        return name

    def counted(self, batch: DataFrame) -> DataFrame:
        """Documents of each key of a batch that no run holds as settled, dealt by key."""
        # the documents of a line are counted by (line, document) first: no hot key
        fresh = batch.groupBy("h1", "h2").agg(F.count_distinct("row").alias("n"))
        # written, or the anti-joins would move below the counting, to all lines of a hot key
        fresh = materialize(fresh).repartition(self.buckets, "h1", "h2")
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("n") >= self.enough).select("h1", "h2")
            fresh = fresh.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        return fresh

    def add(self, batch: DataFrame) -> None:
        """Count a batch of lines and keep it as a run."""
        self.levels[0].append(self.write(self.counted(batch)))
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                done = self.levels[i]
                self.levels[i + 1].append(self.write(self.merged(done)))
                self.levels[i] = []
                self.forget(done)

    def merged(self, runs: list[str]) -> DataFrame:
        """One count per key over several runs, bucket by bucket."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            named = b.withColumnRenamed("n", "more").hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            return a.join(named, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"))

        return reduce(both, [self.spark.table(run) for run in runs])

    def frequent(self) -> DataFrame:
        """Keys in enough documents."""
        return self.merged(self.runs()).where(F.col("n") >= self.enough).select("h1", "h2")

    def forget(self, runs: list[str]) -> None:
        """Take the names of runs out of the catalog; the files go with the scratch folder."""
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def drop_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text",
                      documents: int = DOCUMENTS, batches: int = BATCHES,
                      fanout: int = FANOUT) -> DataFrame:
    """All rows and columns with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    lines, n = line_table(docs, id, text, batches)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LevelledRuns(spark, documents, fanout, max(1, min(-(-n // BUCKET_LINES), most)))
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    # a very common line is marked where it lies, by a copy of the keys if they are few
    frequent = bounded(runs.frequent())
    runs.forget(runs.runs())
    doomed = lines.join(frequent, ["h1", "h2"], "left_semi")
    dropped = doomed.groupBy("k1", "k2").agg(F.collect_set("pos").alias("__dropped"))
    added = {"kept_text", "n_lines", "n_dropped"}
    kept = [c for c in docs.columns if c.lower() not in added]
    wide = by_row(docs, id, text, dropped.hint("shuffle_hash"), "left").withColumn(
        "__lines", split_lines(F.col(text)))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(every, F.col("__dropped")),
                       lambda i: F.element_at("__lines", i + 1))
    none = F.col("__dropped").isNull()
    return wide.select(
        *[f"`{c}`" for c in kept],
        F.when(none, F.coalesce(F.col(text), F.lit("")))
        .otherwise(F.array_join(left, "\n")).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """Lines before, lines dropped and the digest of what stays."""
    return drop_shared_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, r, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, row_number() OVER () AS r,
               string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

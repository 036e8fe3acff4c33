"""How far the sources of a language differ in their words, from counts merged as columns.

A term is a run of letters and non-ASCII characters, A-Z in lower case.  Tasks count terms
with Arrow alone: lower, split by pattern, encode as a dictionary, group by hash.  What a
task has counted is merged until it grows beyond a bound, then sent on; a document lies in
one batch, so numbers of documents add up like numbers of occurrences.  The merged counts
of the terms kept (those in enough documents of their language) are dealt in tiles: a
share of a language's terms for two blocks of its sources.  A tile is a matrix of shares
per term and source, and gives for every two sources the sum of their divergences over its
terms; the sums of the tiles add up.  A tile holds so many terms and sources at most,
whatever the languages, sources and terms.

The share of a term in a group of N occurrences, with V terms kept, is in parts of a
billion p = 1 + floor(10**9 (count + 2) / (N + 2 V)), the divergence of two shares
floor((p - q)**2 / (p + q)).  Integers and decimals only, so no order of summing matters.

Null texts, languages and sources are empty ones.  Every (language, source) that occurs is
a group, even without terms.  Repeated rows count each, a text of any length counts whole,
an empty table gives an empty table, further columns are ignored.  Of equal divergences the
item that is smaller in UTF-8 comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulframe.llm.common import bounded, slices, utf8
from haulframe.sources.scratch import materialize

#: Documents of its language that hold a term, ranks of the terms that are told.
IN_DOCUMENTS, RANKS = 10, 10
#: Bytes of text counted at once, rows of counts that a task merges before it sends them on.
COUNTED_BYTES, MERGED_ROWS = 4 << 20, 1 << 20
#: Terms and sources of a tile.
TILE_TERMS, TILE_SOURCES = 4096, 64
#: What lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_KEYS = ["lang", "source", "term"]


def _merged(parts: list[pa.Table]) -> pa.Table:
    """Counts of equal keys added up."""
    added = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate(
        [("n", "sum"), ("docs", "sum")])
    return added.rename_columns([*_KEYS, "n", "docs"])


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each term by language and source, from a slice of rows.

    The empty term stands for the group itself, with nothing counted.
    """
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    many = len(sources.dictionary)
    values, number = np.unique(
        np.asarray(langs.indices).astype(np.int64) * many + np.asarray(sources.indices),
        return_inverse=True)
    lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    coded = lists.flatten().dictionary_encode()
    one = pa.table({"row": pc.list_parent_indices(lists), "code": coded.indices}).group_by(
        ["row", "code"], use_threads=False).aggregate([([], "count_all")])
    counts = pa.table({
        "group": number[np.asarray(one.column("row"))], "code": one.column("code"),
        "n": one.column("count_all")}).group_by(["group", "code"], use_threads=False).aggregate(
            [("n", "sum"), ("n", "count")])
    blank = np.asarray(pc.equal(coded.dictionary, ""))[np.asarray(counts.column("code"))]
    counts = counts.filter(pa.array(~blank))
    group = np.concatenate([np.asarray(counts.column("group")), np.arange(len(values))])
    none = np.zeros(len(values), np.int64)
    return pa.table({
        "lang": langs.dictionary.take(pa.array(values[group] // many)),
        "source": sources.dictionary.take(pa.array(values[group] % many)),
        "term": pa.concat_arrays([
            coded.dictionary.take(counts.column("code").combine_chunks()),
            pa.array([""] * len(values), coded.dictionary.type)]),
        "n": np.concatenate([np.asarray(counts.column("n_sum")), none]),
        "docs": np.concatenate([np.asarray(counts.column("n_count")), none])})


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang",
                source: str = "source", counted_bytes: int = COUNTED_BYTES,
                merged_rows: int = MERGED_ROWS) -> DataFrame:
    """(lang, source, term, n, docs), partial: the counts of equal keys add up.

    Each group has a row of the empty term.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n)
                         for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            _, at = utf8(batch.column("text"))
            for low, high in slices(at, counted_bytes):
                part = batch.slice(low, high - low)
                held.append(_counted(*(part.column(c) for c in ("lang", "source", "text"))))
                rows += len(held[-1])
                if rows > merged_rows:
                    held = [_merged(held)]
                    rows = len(held[0])
                    # little is saved by holding counts that hardly merge any more
                    if rows > merged_rows // 2:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from _merged(held).to_batches()

    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Parts of a billion, as an integer; exact at any size of the counts."""
    above = F.lit(10**9).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _divergence(p: Column, q: Column) -> Column:
    """Of two shares, each at most 10**9 + 1: the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile(block: int):
    """Of a tile, the sums of the divergences of the sources in block a with those in block b.

    Rows without a term hold the shares of terms that a source lacks, of all sources of
    the two blocks; the other rows the shares of terms that it has.
    """
    def sums(table: pa.Table) -> pa.Table:
        lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
        number, share = (np.asarray(table.column(c)) for c in ("number", "p"))
        words = table.column("term").combine_chunks().dictionary_encode()
        code = np.asarray(words.indices.fill_null(-1))
        sides = []
        for inside in (number // block == a, number // block == b):
            plain, own = inside & (code < 0), inside & (code >= 0)
            order = np.argsort(number[plain])
            sources = number[plain][order]
            matrix = np.tile(share[plain][order][:, None], (1, len(words.dictionary)))
            matrix[np.searchsorted(sources, number[own]), code[own]] = share[own]
            sides.append((sources, matrix))
        (left, p), (right, q) = sides
        found = np.zeros((len(left), len(right)), np.int64)
        for i, one in enumerate(p):
            gap = q - one
            found[i] = (gap * gap // (q + one)).sum(axis=1)
        return pa.table({
            "lang": pa.array([lang] * found.size, pa.string()),
            "x": np.repeat(left, len(right)), "y": np.tile(right, len(left)),
            "f": found.reshape(-1),
            "terms": np.full(found.size, len(words.dictionary), np.int64)})

    return sums


def source_divergences(docs: DataFrame, text: str = "text", lang: str = "lang",
                       source: str = "source", in_documents: int = IN_DOCUMENTS,
                       ranks: int = RANKS, tile_terms: int = TILE_TERMS,
                       tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others.

    Part ``pair`` ranks all other sources of the language by their divergence over all
    terms; part ``term`` the ``ranks`` terms that the source has more often than its
    language and that differ most.
    """
    counts = materialize(term_counts(docs, text, lang, source).groupBy("lang", "source", "term")
                         .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = materialize(terms.where(F.col("docs") >= in_documents).drop("docs"))
    own = materialize(counts.drop("docs").join(bounded(kept), ["lang", "term"]))
    by_lang = kept.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(
        totals, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c)
                            for c in ("total", "terms", "lang_total")],
        # numbers of a language's sources: one row per group, of sources not of rows
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .cast("long").alias("number"))
    groups = bounded(groups)
    shares = own.join(groups, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("terms")))

    q = _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    over = shares.withColumn("q", q).where("n > 0 and p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    # tiles: every two blocks of sources of a language, every share of its terms
    sized = groups.where("terms > 0").withColumns({
        "block": F.expr(f"number div {tile_sources}"),
        "shards": F.expr(f"1 + terms div {tile_terms}"),
        "p0": _share(zero, F.col("total"), F.col("terms"))})
    last = Window.partitionBy("lang")
    sized = bounded(sized.withColumn("blocks", F.max("block").over(last) + 1)
                    .select("lang", "source", "number", "block", "blocks", "shards", "p0"))
    # the tiles of a block: with itself, with those before, with those after
    tiles = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: F.struct(
        F.least("block", k).alias("a"), F.greatest("block", k).alias("b")))
    spread = sized.withColumn("tile", F.explode(tiles))
    base = spread.select(
        "lang", "tile.a", "tile.b", F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"),
        "number", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    present = shares.select("lang", "source", "term", "p").join(sized, ["lang", "source"]).select(
        "*", F.explode(tiles).alias("tile")).select(
        "lang", "tile.a", "tile.b", F.pmod(F.xxhash64("term"), "shards").alias("shard"),
        "number", "term", "p")
    sums = base.unionByName(present).groupBy("lang", "a", "b", "shard").applyInArrow(
        _tile(tile_sources), "lang string, x long, y long, f long, terms long")
    # a tile of two blocks stands for both directions
    both = sums.where(f"x div {tile_sources} <> y div {tile_sources}").select(
        "lang", F.col("y").alias("x"), F.col("x").alias("y"), "f", "terms").union(sums)
    met = both.where("x <> y").groupBy("lang", "x", "y").agg(
        F.sum("f").alias("f"), F.sum("terms").alias("met"))
    mine = groups.select("lang", "source", F.col("number").alias("x"), "terms",
                         F.col("total").alias("total_x"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("y"),
                          F.col("total").alias("total_y"))
    # every two sources of a language are rows of the result
    pairs = mine.join(other, "lang").where("x <> y").join(met, ["lang", "x", "y"], "left")
    rest = _divergence(_share(zero, F.col("total_x"), F.col("terms")),
                       _share(zero, F.col("total_y"), F.col("terms")))
    value = F.when(F.col("terms") == 0, zero).otherwise(
        F.col("f") + (F.col("terms") - F.col("met")) * rest)
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                           value.alias("value")).withColumn("rank", F.row_number().over(far))
    return by_pair.unionByName(by_term)


def divergence_report(docs: DataFrame) -> DataFrame:
    """The parts ``pair`` and ``term`` for every source of every language."""
    return source_divergences(docs)


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
occurring AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM occurring GROUP BY lang, term
         HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM occurring
        SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sized AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(sum(o.n), 0)::HUGEINT AS total
          FROM groups g LEFT JOIN langs l USING (lang) LEFT JOIN own o USING (lang, source)
          GROUP BY g.lang, g.source, l.v),
shares AS (SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n,
                  1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (s.total + 2 * s.v) AS p,
                  1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
           FROM sized s JOIN kept k USING (lang) JOIN langs l USING (lang)
           LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item,
                 sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source
          GROUP BY a.lang, a.source, b.source),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                     coalesce(p.value, 0)::BIGINT AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source
                               AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item,
                 (((p - q) * (p - q)) // (p + q))::BIGINT AS value
          FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""

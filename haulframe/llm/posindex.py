"""Benchmark passages in documents, found with a distributed positional inverted index.

The words of all documents are counted for the words of the benchmark.  Of each distinct
window of the items the two rarest words that documents have are its seeds.  The index
holds the postings (document, position) of the seed words.  The list of the first seed,
adjusted by the distance of the two in the window, is intersected with that of the second:
where both lie as in the window, all words of the window are compared, which leaves the
exact matches; where the second lies at most ``slop`` words off, and is another word of
the document, the item is near: a proximity match.

Windows of the same words are one, and so are seeds of the same words and distance, so a
text that repeats a word gives no more rows for an item that repeats it too.  Work grows
with the postings and with what is found.

A text is split into words after A-Z are put in lower case.  Null and empty texts have
no words and are not hit; items without words match nothing; an item shorter than a
window is one window.  A window without a word that documents have is not near; one with
some is near by those.  A text of any length is read whole.  Repeated documents each get
their row; repeated items each count under their id.  Ties between rare words go to the
first.  Empty tables give rows without hits, or no rows.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulframe.llm.common import ascii_lower, bounded, by_row, row_key
from haulframe.sources.scratch import materialize

#: Consecutive words of an item that make a match.
WINDOW = 10
#: Words by which the second seed of a near window may be off.
SLOP = 5
#: Positions that are looked up together for a seed that may be off.
CELL = 64
# Fixed value: the characters between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)
    # only the first and the last part can be empty
    return F.filter(parts, lambda w: w != "")


def hashed(word: Column) -> Column:
    return F.xxhash64(word)


def item_windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(item, w1, w2, terms): the windows of each item with a 128-bit hash of their words."""
    numbered = items.select(F.col(f"`{id}`").alias("item"), F.transform(
        words(F.col(f"`{text}`")), hashed).alias("all")).where(F.size("all") > 0)
    # two steps, so that the words are split once
    numbered = materialize(numbered.distinct())
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    spread = numbered.select("item", "all", F.explode(starts).alias("start"))
    terms = spread.select("item", F.slice("all", F.col("start") + 1, window).alias("terms"))
    return materialize(terms.select(
        "item", *window_key(F.col("terms")), "terms").dropDuplicates(["item", "w1", "w2"]))


def window_key(terms: Column) -> list[Column]:
    return [F.xxhash64(terms).alias("w1"), F.xxhash64(F.lit(7), terms).alias("w2")]


def repeated_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(k1, k2) of rows that are there more than once."""
    keys = docs.select(*row_key(F.col(id), F.col(text)))
    return keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(
        "k1", "k2", F.lit(True).alias("many"))


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """How often each benchmark word occurs in all documents."""
    tokens = docs.select(F.explode(words(F.col(text))).alias("word")).select(
        hashed(F.col("word")).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """(k1, k2, pos, term) of the given words in all documents; one of rows that repeat."""
    keyed = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text")).join(
        bounded(repeated_rows(docs, id, text)), ["k1", "k2"], "left")
    found = keyed.select("k1", "k2", "many", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    found = found.select("k1", "k2", "many", "pos", hashed(F.col("word")).alias("term")).join(
        terms, "term")
    found = materialize(found)
    return found.where("many is null").drop("many").unionByName(
        found.where("many").drop("many").distinct())


def window_seeds(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest words of each window that documents have.

    (w1, w2, k, whole, pair, term, place, term2, delta): whole windows have no other words;
    ``pair`` is a hash of the two words and of their distance.
    """
    distinct = windows.select("w1", "w2", "terms").dropDuplicates(["w1", "w2"])
    places = distinct.select("w1", "w2", F.posexplode("terms").alias("place", "term"))
    rated = places.join(bounded(counts), "term", "left")
    # a window has few words
    sorted_words = F.sort_array(F.collect_list(F.struct("n", "place", "term")))
    live = rated.groupBy("w1", "w2").agg(F.count("*").cast("int").alias("k"), sorted_words.alias("all"))
    live = live.withColumn("live", F.filter("all", lambda x: x["n"].isNotNull()))
    two = live.where(F.size("live") > 0).select(
        "w1", "w2", "k", (F.size("live") == F.col("k")).alias("whole"),
        F.element_at("live", 1).alias("a"),
        F.element_at("live", F.least(F.size("live"), F.lit(2))).alias("b"))
    seeds = two.select("w1", "w2", "k", "whole", F.col("a.term").alias("term"),
                       F.col("a.place").alias("place"), F.col("b.term").alias("term2"),
                       (F.col("b.place") - F.col("a.place")).alias("delta"))
    return seeds.withColumn("pair", F.xxhash64("term", "term2", "delta"))


class PositionalIndex:
    """Postings of the seed words of a benchmark over all documents."""

    def __init__(self, docs: DataFrame, items: DataFrame, id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", window: int = WINDOW,
                 slop: int = SLOP):
        self.docs, self.id, self.text = docs, id, text
        self.windows = item_windows(items, item_id, text, window)
        terms = self.windows.select(F.explode("terms").alias("term")).distinct()
        counts = materialize(term_counts(docs, text, bounded(terms)))
        self.seeds = materialize(window_seeds(self.windows, counts))
        seed_terms = self.seeds.select("term").union(self.seeds.select(F.col("term2")))
        self.postings = postings(docs, id, text, bounded(seed_terms.distinct()))
        self.met = materialize(self.meetings(slop))

    def meetings(self, slop: int) -> DataFrame:
        """(k1, k2, pair, pos, exact): first seeds whose second seed lies near enough."""
        pairs = bounded(self.seeds.select("pair", "term", "term2", "delta").distinct())
        wanted = (F.col("pos") + F.col("delta")).alias("wanted")
        first = self.postings.join(pairs, "term").select(
            "k1", "k2", "pair", "pos", "term2", "delta", wanted)
        ends = [F.floor((F.col("wanted") + off) / CELL) for off in (-slop, slop)]
        first = first.withColumn("cell", F.explode(F.sequence(*ends)))
        second = self.postings.select("k1", "k2", F.col("term").alias("term2"),
                                      F.col("pos").alias("pos2"),
                                      F.floor(F.col("pos") / CELL).alias("cell"))
        both = first.join(second, ["k1", "k2", "term2", "cell"]).where(
            (F.abs(F.col("pos2") - F.col("wanted")) <= slop)
            & ((F.col("pos2") != F.col("pos")) | (F.col("delta") == 0)))
        return both.select("k1", "k2", "pair", "pos",
                           (F.col("pos2") == F.col("wanted")).alias("exact"))

    def near(self) -> DataFrame:
        """(k1, k2, item): documents with the seeds of a window of the item near each other."""
        of_pair = self.seeds.join(self.windows.select("w1", "w2", "item"), ["w1", "w2"])
        of_pair = of_pair.select("pair", "item").distinct()
        found = self.met.select("k1", "k2", "pair").distinct()
        return found.join(bounded(of_pair), "pair").select("k1", "k2", "item").distinct()

    def candidates(self) -> DataFrame:
        """(k1, k2, start, k, w1, w2): places of a document with both seeds of a window."""
        seeds = self.seeds.where("whole").select("pair", "place", "k", "w1", "w2")
        found = self.met.where("exact").drop("exact").join(bounded(seeds), "pair")
        start = (F.col("pos") - F.col("place")).alias("start")
        return found.select("k1", "k2", start, "k", "w1", "w2").where("start >= 0").distinct()

    def phrases(self) -> DataFrame:
        """(k1, k2, start, k, w1, w2): exact matches of windows, all words compared."""
        lists = self.candidates().groupBy("k1", "k2").agg(
            F.collect_list(F.struct("start", "k", "w1", "w2")).alias("places"))
        texts = self.docs.select(
            *row_key(F.col(self.id), F.col(self.text)), F.col(self.text).alias("text"))
        read = texts.join(bounded(lists), ["k1", "k2"]).select(
            "k1", "k2", "places", F.transform(words(F.col("text")), hashed).alias("terms"))
        # the words of a document with candidates are split and hashed once, and written
        held = materialize(read).dropDuplicates(["k1", "k2"])

        def same(place: Column) -> Column:
            own = F.slice("terms", place["start"] + 1, place["k"])
            w1, w2 = window_key(own)
            return (w1 == place["w1"]) & (w2 == place["w2"])

        matches = held.select("k1", "k2", F.explode(F.filter("places", same)).alias("place"))
        return matches.select("k1", "k2", "place.*")

    def of_items(self, phrases: DataFrame) -> DataFrame:
        """(k1, k2, item) of exact matches."""
        found = phrases.select("k1", "k2", "w1", "w2").distinct()
        items = self.windows.select("w1", "w2", "item")
        return found.join(bounded(items), ["w1", "w2"]).select("k1", "k2", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """All rows and columns with n_words, n_hit, item_ids, near_ids (arrays) and contaminated."""
    index = PositionalIndex(docs, items, id, text, item_id, window, slop)
    phrases = materialize(index.phrases())
    # hit words of a document: its matches in order, each beyond the ends of those before
    by_doc = Window.partitionBy("k1", "k2").orderBy("first", "last")
    before = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = phrases.select("k1", "k2", F.col("start").alias("first"),
                           (F.col("start") + F.col("k") - 1).alias("last")).distinct()
    spans = spans.withColumn("before", before)
    fresh = F.col("last") - F.greatest(F.col("first"), F.coalesce("before", F.lit(-1)) + 1) + 1
    hits = spans.groupBy("k1", "k2").agg(F.sum(F.greatest(fresh, F.lit(0))).alias("__hit"))

    def listed(found: DataFrame, name: str) -> DataFrame:
        ids = found.select("k1", "k2", F.col("item").cast("string").alias("item")).distinct()
        return ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias(name))

    named = listed(index.of_items(phrases), "__ids")
    found = hits.join(named, ["k1", "k2"], "left").join(
        listed(index.near(), "__near"), ["k1", "k2"], "full")
    added = {"n_words", "n_hit", "item_ids", "near_ids", "contaminated"}
    kept = [c for c in docs.columns if c.lower() not in added]
    counted = docs.withColumn("__words", F.size(words(F.col(text))).cast("long"))
    none = F.array().cast("array<string>")
    return by_row(counted, id, text, bounded(found), "left").select(
        *[f"`{c}`" for c in kept], F.col("__words").alias("n_words"),
        F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__ids", none).alias("item_ids"),
        F.coalesce("__near", none).alias("near_ids"),
        (F.coalesce("__hit", F.lit(0)) > 0).alias("contaminated"))


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Words, hit words and items of each document, and the items near it."""
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated", F.size("near_ids").cast("long").alias("n_near"))


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(list_slice(w, s + 1, s + least(len(w), 10)), ' ') AS words
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), places AS (
  SELECT d.doc_id, k.k, s,
         array_to_string(list_slice(d.w, s + 1, s + k.k), ' ') AS words
  FROM d, (SELECT DISTINCT k FROM windows) k, unnest(range(0, len(d.w) - k.k + 1)) AS u(s)
), found AS (
  SELECT p.doc_id, p.s, p.k, i.item_id FROM places p JOIN windows i USING (k, words)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
), counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word
), places_of AS (
  SELECT item_id, s, u.place, w[u.place + 1] AS word
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0),
       unnest(range(s, s + least(len(w), 10))) AS u(place)
), rare AS (
  SELECT p.*, row_number() OVER (PARTITION BY item_id, s ORDER BY n, place) AS rank
  FROM places_of p JOIN counts USING (word)
), seeds AS (
  SELECT DISTINCT item_id, a.word AS word1, coalesce(z.word, a.word) AS word2,
         coalesce(z.place, a.place) - a.place AS delta
  FROM (SELECT * FROM rare WHERE rank = 1) a
  LEFT JOIN (SELECT item_id, s, place, word FROM rare WHERE rank = 2) z USING (item_id, s)
), held AS (
  SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)
  WHERE w[p] IN (SELECT word1 FROM seeds UNION SELECT word2 FROM seeds)
), pairs AS (SELECT DISTINCT word1, word2, delta FROM seeds
), close AS (
  SELECT DISTINCT x.doc_id, word1, word2, delta
  FROM pairs JOIN held x ON x.word = word1 JOIN held y ON y.doc_id = x.doc_id AND y.word = word2
  WHERE abs(y.p - x.p - delta) <= 5 AND (y.p <> x.p OR delta = 0)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM close JOIN seeds USING (word1, word2, delta) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       h.n_hit IS NOT NULL AS contaminated, coalesce(near.n_near, 0) AS n_near
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
LEFT JOIN near USING (doc_id)
"""

"""Near-duplicate documents by DartMinHash signatures, a banded join and exact checks.

Documents are sets of word shingles (words in lower case, five to a shingle).  Equal
sets are one node from here on, so copies cost nothing further.  A node gets a
signature of hashed darts, and a hash per band of it; nodes that share a band are
candidates.  A band's nodes are tied to its smallest node only, so a band with
thousands of nodes gives as many pairs, not their square; the connected candidates form
a family.  A family too large for one task, as the pages of a template make it, is cut
apart without loss: sets of a similarity of 0.8 or more share an element among the rarest
tenth to fifth of theirs, so members that share none, not even by others, part.  The
members of a family are then compared exactly with each other, in blocks of bounded size by like
number of shingles: first inside each block, then one member for each class so far, in
blocks again while that ties classes, then block against block where different classes
are left.  Pairs of a similarity of 0.8 or more are links; a task passes on as many
links as tie its members, not all pairs.  The classes are the connected components of
the links.

With 30 bands of 5 a pair at 0.8 shares no band with a chance of 7 in a million.  The
weights of the signature are those of the elements: one each here, as the similarity is
that of sets; ``dart.signatures`` takes any weights.

Null, empty and blank texts have no shingles: they are alike only if the texts are
equal (null and empty are).  Texts of fewer than five words are one shingle.  A text of
any length is read whole.  The class id is the smallest id of the class; rows without
an id are classed, but lend none.  An id under several texts is classed once a text: texts
are found by a key of id and text, not by the id.  Repeated rows each get their row.  An empty table
gives an empty table.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulframe.llm import dart
from haulframe.llm.common import bounded, row_key, slices, small_batches
from haulframe.llm.components import components
from haulframe.llm.shingles import lowered, shingles
from haulframe.sources.scratch import materialize

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands of the signature and coordinates of a band.
BANDS, PER_BAND = 30, 5
#: Members of a family that are compared in one piece.
BLOCK = 256
#: Bytes of text that a task hashes at once.
HASHED_BYTES = 1 << 18
#: Columns of the membership matrix at a time.
COLUMNS = 4_096
#: Members that stand for classes are compared again while one in so many finds a link.
FEWER = 8


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def node_table(docs: DataFrame, id: str, text: str, words: int, bands: int,
               per_band: int) -> DataFrame:
    """(doc_id, k1, k2, node, size, bands): node is a hash of the set; no bands for empty sets."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                         *row_key(F.col(id), F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch.column("text"))
            for low, high in slices(offsets, HASHED_BYTES):
                at = offsets[low:high + 1] - offsets[low]
                raw, n = data[offsets[low]:offsets[high]], high - low
                element, owner = shingles(raw, at, words)
                size = np.bincount(owner, minlength=n)
                node = np.zeros(n, np.uint64)
                np.add.at(node, owner, dart.seeded(element, 40))
                for i in np.flatnonzero(size == 0):
                    rest = np.frombuffer(raw[at[i]:at[i + 1]].tobytes(), np.uint8)
                    weights = dart.seeded(np.arange(len(rest), dtype=np.uint64), 41)
                    node[i] = (rest.astype(np.uint64) * weights).sum(dtype=np.uint64)
                node = dart.seeded(node + size.astype(np.uint64), 42)
                rows = dart.signatures(element, np.ones(len(element)), owner, n, bands * per_band)
                hashes = dart.band_hashes(rows, bands)[size > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(low, n) for c in ("doc_id", "k1", "k2")),
                    _signed(node), pa.array(size),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             _signed(hashes.reshape(-1))),
                ], names=["doc_id", "k1", "k2", "node", "size", "bands"])

    return source.mapInArrow(
        run, "doc_id long, k1 long, k2 long, node long, size long, bands array<long>")


def distinct_nodes(found: DataFrame) -> DataFrame:
    """(node, rep, size, k1, k2, many): smallest id, key of a row, whether rows repeat the key."""
    rows = found.groupBy("node", "k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.count("*").alias("n"))
    nodes = rows.groupBy("node").agg(F.min("rep").alias("rep"), F.min("size").alias("size"),
                                     F.min(F.struct("k1", "k2", "n")).alias("row"))
    return nodes.select("node", "rep", "size", "row.k1", "row.k2", (F.col("row.n") > 1).alias("many"))


def candidate_families(nodes: DataFrame) -> DataFrame:
    """(node, component) of nodes that share bands, over any chain of shared bands."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    pivots = (bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
              .where("n > 1").select("band", "pivot"))
    return components(few_ties(bands.join(pivots, "band").where("node <> pivot")))


def few_ties(ties: DataFrame) -> DataFrame:
    """(a, b) that connect what (node, pivot) connects, with nodes tied to several pivots.

    A node is tied to the smallest of its pivots and these are tied to each other: few pairs,
    as like nodes share their pivots.
    """
    least = F.min("pivot").over(Window.partitionBy("node"))
    ties = ties.select("node", "pivot", least.alias("least"))
    return ties.select("node", "least").union(ties.select("pivot", "least")).toDF(
        "a", "b").distinct()


def sized_members(families: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, k1, k2, many, size, family, large): the members, and whether one task is too few."""
    members = families.join(nodes.select("node", "size", "k1", "k2", "many"), "node")
    totals = families.groupBy("component").agg((F.count("*") > BLOCK).alias("large"))
    return members.join(bounded(totals), "component").withColumnRenamed("component", "family")


def member_texts(docs: DataFrame, members: DataFrame, id: str, text: str) -> DataFrame:
    """Members with a text of their set, one row each, written once."""
    source = docs.select(*row_key(F.col(id), F.col(text)), F.col(text).alias("text"))
    wanted = bounded(members)
    texts = materialize(source.join(wanted, ["k1", "k2"]).drop("k1", "k2"))
    once = texts.where("many").dropDuplicates(["node"])
    return texts.where("not many").unionByName(once).drop("many")


def element_table(texts: DataFrame, words: int) -> DataFrame:
    """(family, node, size, element): the shingles of each member, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch.column("text"))
            for low, high in slices(offsets, HASHED_BYTES):
                at = offsets[low:high + 1] - offsets[low]
                element, owner = shingles(data[offsets[low]:offsets[high]], at, words)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low).take(rows)
                       for c in ("family", "node", "size")), _signed(element)],
                    names=["family", "node", "size", "element"])

    return texts.select("family", "node", "size", "text").mapInArrow(
        run, "family long, node long, size long, element long")


def parted_families(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, part of the family) of the members that may be similar to another one.

    Elements are ordered by the number of members that have them, the rarest first.  Of two
    similar sets, with n elements and with n or more, the first one in that order that they
    share is among the first n - ceil(2 s n / (1 + s)) + 1 of the smaller set and among the
    first m - ceil(s m) + 1 of the larger one (of m elements), s being the similarity.
    """
    # an element of a family by one number: tables of such keys are copied in little memory.
    # Elements that shared a number would be ordered and tied together, which loses nothing
    at = F.xxhash64("family", "element").alias("at")
    elements = materialize(element_table(texts, words).select("family", "node", "size", at))
    shared = elements.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    known = elements.join(bounded(shared), "at", "left")
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "at")

    def first(share: float):
        # a little lower, should the product be off in its last place
        return F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1

    place = F.row_number().over(order)
    early = known.withColumn("place", place).where(F.col("place") <= first(similarity)).where(
        "n > 1").select("family", "at", "node",
                        (F.col("place") <= first(2 * similarity / (1 + similarity))).alias("short"))
    # members with the same early elements are tied to one of them, which stands for them
    lists = early.groupBy("family", "node").agg(
        F.sort_array(F.collect_list(F.struct("at", "short"))).alias("early"))
    key = ["family", "h1", "h2"]
    keyed = materialize(lists.withColumns(
        {"h1": F.xxhash64("early"), "h2": F.xxhash64(F.lit(7), "early")}))
    ones = keyed.groupBy(*key).agg(F.min("node").alias("one"))
    keyed = materialize(keyed.join(bounded(ones), key))
    same = keyed.where("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    early = keyed.where("node = one").select("family", "node", F.inline("early"))
    pivots = early.groupBy("at").agg(
        F.min(F.when(F.col("short"), F.col("node"))).alias("pivot"), F.count("*").alias("n"))
    pivots = pivots.where("n > 1 and pivot is not null").drop("n")
    ties = early.join(bounded(pivots), "at").where("node <> pivot")
    return components(same.union(few_ties(ties)))


def placed_members(texts: DataFrame, similarity: float) -> DataFrame:
    """The members with like, part, large: the block of each.

    A family that fits is one block.  In a larger one, members of like size (those that can
    be similar differ by one size class at most) are spread over blocks by hash.
    """
    like = F.floor(F.log("size") / F.log(F.lit(1 / similarity))).cast("int")
    members = texts.select("node", "family", like.alias("like"))
    per_class = members.groupBy("family", "like").agg(F.count("*").alias("n"))
    sizes = per_class.withColumn("total", F.sum("n").over(Window.partitionBy("family")))
    small = F.col("total") <= BLOCK
    placed = texts.withColumn("like", like).join(bounded(sizes), ["family", "like"])
    return placed.select(
        "node", "family", "text",
        F.when(small, -1).otherwise(F.col("like")).alias("like"),
        F.when(small, 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
        .cast("int").alias("part"), (F.col("total") > BLOCK).alias("large"))


def shared_counts(element: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Elements in common of each two of n sets."""
    _, column = np.unique(element, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((n, min(COLUMNS, width - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    return shared


def tying_links(known: np.ndarray, element: np.ndarray, owner: np.ndarray,
                similarity: float) -> list[tuple[int, int]]:
    """Links that tie classes with similar members; ``known`` is the class of each so far.

    Classes that belong together are each tied to the smallest of them.
    """
    n = len(known)
    size = np.bincount(owner, minlength=n).astype(np.float64)
    shared = shared_counts(element, owner, n).astype(np.float64)
    union = size[:, None] + size[None, :] - shared
    # shared / union >= similarity, with whole numbers on the left
    alike = (shared >= similarity * union - 1e-9) & (union > 0)
    classes, label = np.unique(known, return_inverse=True)
    for i, j in zip(*np.nonzero(np.triu(alike, 1) & (label[:, None] != label[None, :]))):
        if label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    merged = np.zeros(len(classes), np.int64)
    merged[np.searchsorted(classes, known)] = label
    return [(int(c), int(classes[m])) for c, m in zip(classes, merged) if classes[m] != c]


def _compared(groups: list[str], words: int, similarity: float):
    """A function over rows sorted by the group columns: links of the classes in each group."""

    def links(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = lowered(whole.column("text"))
        element, owner = shingles(data, offsets, words)
        node = np.asarray(whole.column("node"))
        known = np.asarray(whole.column("known"))
        keys = np.stack([np.asarray(whole.column(g), dtype=np.int64) for g in groups])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        found = []
        for low, high in zip([0, *new], [*new, len(node)]):
            # should a node come twice, its first row counts
            _, first = np.unique(node[low:high], return_index=True)
            if len(first) < 2:
                continue
            a, b = np.searchsorted(owner, [low, high])
            renamed = np.full(high - low, -1)
            renamed[first] = np.arange(len(first))
            own = renamed[owner[a:b] - low]
            found += tying_links(known[low + first], element[a:b][own >= 0], own[own >= 0],
                                 similarity)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()),
             pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * BLOCK:
                continue
            # the last group may go on in the next batch
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([np.asarray(whole.column(g), dtype=np.int64) for g in groups])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if not len(new):
                continue
            for low in _group_starts(new):
                part = whole.slice(low[0], low[1] - low[0])
                yield from links(part.to_batches())
            rest = whole.slice(int(new[-1]))
            held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield from links(held)

    return run


def _group_starts(new: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of whole groups, of some 2 * BLOCK rows each, up to the last start."""
    out, low = [], 0
    for at in new.tolist():
        if at - low >= 2 * BLOCK or at == new[-1]:
            out.append((low, at))
            low = at
    return out


def _grouped(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.repartition(*groups).sortWithinPartitions(*groups)


def compared(rows: DataFrame, groups: list[str], words: int, similarity: float) -> DataFrame:
    """(a, b): classes of each group (``known``) that are merged into smaller ones."""
    sent = _grouped(rows.select(*groups, "node", "text", "known"), groups)
    return materialize(sent.mapInArrow(_compared(groups, words, similarity), "a long, b long"))


def relabelled(labelled: DataFrame, merged: DataFrame) -> DataFrame:
    """The members with the classes that theirs are merged into, if any: (a, b)."""
    into = merged.select(F.col("a").alias("known"), F.col("b").alias("into"))
    return materialize(labelled.join(bounded(into), "known", "left").select(
        "family", "like", "part", "node", F.coalesce("into", "known").alias("known")))


def family_classes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component) of members that are not the smallest of their class.

    Inside blocks, and where one member stands for a class, each class is in one block only,
    so what comes back are the classes.  Blocks against blocks may merge in chains.
    """
    block = ["family", "like", "part"]
    alone = texts.withColumn("known", F.col("node"))
    small = compared(alone.where("not large"), block, words, similarity)
    done = small.select(F.col("a").alias("node"), F.col("b").alias("component"))
    large = materialize(texts.where("large").select(*block, "node", "text"))
    if large.isEmpty():
        return done
    labelled = large.select(*block, "node").withColumn("known", F.col("node"))
    labelled = relabelled(labelled, compared(
        large.withColumn("known", F.col("node")), block, words, similarity))
    while True:
        ones = labelled.where("node = known").select("family", "like", "node", "known")
        many = ones.groupBy("family", "like").agg(F.count("*").alias("n")).where("n > 1")
        dealt = materialize(ones.join(bounded(many), ["family", "like"]).select(
            "family", "like", "node", "known",
            F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("part")))
        found = compared(large.select("node", "text").join(bounded(dealt), "node"), block,
                         words, similarity)
        labelled = relabelled(labelled, found)
        # classes that are hardly tied any more are left to the blocks
        if found.count() * FEWER <= dealt.count():
            break
    across = across_blocks(large, labelled, words, similarity)
    if not across.isEmpty():
        labelled = relabelled(labelled, components(across).select(
            F.col("node").alias("a"), F.col("component").alias("b")))
    return done.union(labelled.where("node <> known").select(
        "node", F.col("known").alias("component")))


def across_blocks(large: DataFrame, labelled: DataFrame, words: int,
                  similarity: float) -> DataFrame:
    """Links between classes, from blocks of a family whose members are not all of one class."""
    block = ["family", "like", "part"]
    blocks = labelled.groupBy(*block).agg(F.min("known").alias("low"), F.max("known").alias("high"))
    other = blocks.select("family", *[F.col(c).alias(f"{c}2") for c in ("like", "part", "low", "high")])
    ordered = F.expr("like2 > like or (like2 = like and part2 > part)")
    # blocks whose members can be similar and are not all of one class already
    pairs = blocks.join(other, "family").where(ordered & F.expr(
        "like2 <= like + 1 and (low <> high or low2 <> high2 or low <> low2)"))
    pairs = materialize(pairs.select(
        *block, "like2", "part2", F.xxhash64(*block, "like2", "part2").alias("pair")))
    sides = pairs.select(*block, "pair").union(
        pairs.select("family", F.col("like2"), F.col("part2"), "pair"))
    members = large.join(labelled.select("node", "known"), "node").join(sides, block)
    return compared(members, ["pair"], words, similarity)


def classed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                 per_band: int = PER_BAND) -> DataFrame:
    """(doc_id, k1, k2, component, class_id, n_shingles) of each row; the keys are ``row_key``.

    Classes that share their smallest id are told apart by the component.
    """
    with small_batches(docs.sparkSession):
        found = materialize(node_table(docs, id, text, words, bands, per_band))
        nodes = materialize(distinct_nodes(found))
        # a node's bands are those of the row that lends its key: no key is hot
        banded = found.where("size > 0").join(nodes.select("k1", "k2"), ["k1", "k2"])
        families = candidate_families(banded.select("node", "bands"))
        texts = member_texts(docs, sized_members(families, nodes), id, text)
        small, large = texts.where("not large"), texts.where("large")
        if not large.isEmpty():
            parts = parted_families(large, words, similarity)
            small = small.unionByName(large.drop("family").join(bounded(parts), "node")
                                      .withColumnRenamed("component", "family"))
        texts = placed_members(materialize(small.drop("large")), similarity)
        linked = family_classes(texts, words, similarity)
        classed = nodes.join(linked, "node", "left").select(
            "node", "rep", F.coalesce("component", "node").alias("component"))
        least = classed.groupBy("component").agg(F.min("rep").alias("class_id"))
        classes = classed.join(least, "component").select("node", "component", "class_id")
        return found.join(classes, "node").select(
            "doc_id", "k1", "k2", "component", "class_id", F.col("size").alias("n_shingles"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text",
                    words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                    per_band: int = PER_BAND) -> DataFrame:
    """(doc_id, class_id, n_shingles) of each row: rows of a class are near-duplicates."""
    rows = classed_rows(docs, id, text, words, similarity, bands, per_band)
    return rows.select("doc_id", "class_id", "n_shingles")

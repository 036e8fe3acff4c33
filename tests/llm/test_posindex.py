import random
from collections import Counter, defaultdict

from haulframe.llm import posindex
from tests.llm.helpers import empty_docs, odd_docs, sha

ITEMS = [
    (1, "a b c d e f g h i j k l m"), (2, "Short ITEM é"), (3, None), (4, "..."),
    (10, "the the the the the the the the the the the"), (2, "Short ITEM é"),
    (5, "zz yy xx ww vv uu tt ss rr qq"),
]
DOCS = [
    (0, "pre a b c d e f g h i j k post"), (1, "a b c d e f g h i"), (2, None), (3, ""),
    (4, "short,item É and short item é!"), (5, "the " * 14), (6, "c d e f g h i j k l m"),
    (7, "x a b c d e f g h i j k l m a b c d e f g h i j"), (None, "short item é"),
    (0, "pre a b c d e f g h i j k post"), (8, "qq ss rr tt uu vv ww xx yy zz"),
    (9, "w " * 5000 + "a b c d e f g h i j"),
]


def split(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = (text or "").translate(str.maketrans(upper, upper.lower()))
    return "".join(c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in text).split()


def near_items(docs, items, size=10, slop=5):
    """For each document the items with the two rarest words of a window near each other."""
    counts = Counter(w for _, text in docs for w in split(text))
    pairs = defaultdict(set)
    for item, passage in items:
        w = split(passage)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            live = sorted((counts[x], p, x) for p, x in enumerate(w[s:s + size]) if counts[x])
            if live:
                (_, p, a), (_, q, b) = live[0], live[:2][-1]
                pairs[a, b, q - p].add(item)
    out = []
    for _, text in docs:
        places = defaultdict(list)
        for p, x in enumerate(split(text)):
            places[x].append(p)
        out.append({i for (a, b, delta), named in pairs.items()
                    if any(abs(q - p - delta) <= slop and (p != q or delta == 0)
                           for p in places[a] for q in places[b]) for i in named})
    return out


def brute(docs, items, size=10):
    near = near_items(docs, items, size)
    out = []
    for (id, text), close in zip(docs, near):
        words, hit, named = split(text), set(), set()
        for item, passage in items:
            w = split(passage)
            k = min(size, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for p in range(len(words) - k + 1):
                    if words[p:p + k] == w[s:s + k]:
                        hit.update(range(p, p + k))
                        named.add(str(item))
        out.append((id, len(words), len(hit), len(named), sha(",".join(sorted(named))), bool(hit),
                    len(close)))
    return out


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS],
                                 "doc_id long, text string, n_hit int, k1 int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS],
                                  "item_id long, text string, term string")
    return docs, items


def test_equals_brute_force(spark):
    docs, items = frames(spark)
    got = posindex.contamination_report(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(DOCS, ITEMS), key=str)
    wide = posindex.contamination(docs, items)
    assert wide.columns == ["doc_id", "text", "k1", "n_words", "n_hit", "item_ids", "near_ids",
                            "contaminated"]
    assert wide.count() == len(DOCS)


def test_proximity(spark):
    docs, items = frames(spark)
    index = posindex.PositionalIndex(docs, items, slop=20)
    near = {r.item for r in index.near().collect()}
    exact = {r.item for r in index.of_items(index.phrases()).collect()}
    assert 5 in near and 5 not in exact  # the words are there, in another order
    assert exact <= near
    # an item with a word that no document has is near by its other words
    changed = spark.createDataFrame([(7, "short qqqqq é"), (8, "nowhere at all")],
                                    "item_id long, text string")
    got = posindex.contamination(docs, changed).collect()
    assert {r.doc_id for r in got if r.near_ids == ["7"]} == {4, None}
    assert not any(r.contaminated for r in got)


def test_words_that_repeat_give_no_product(spark):
    items = spark.createDataFrame([(1, "la " * 200), (2, "la lu " * 60)], "item_id long, text string")
    rows = []
    for n in (2_000, 4_000):
        docs = spark.createDataFrame([(1, "la " * n), (2, "la lu " * (n // 2))],
                                     "doc_id long, text string")
        index = posindex.PositionalIndex(docs, items)
        rows.append(index.met.count() + index.candidates().count() + index.phrases().count())
    assert rows[1] <= 2.1 * rows[0] < 200_000
    got = {r.doc_id: r for r in posindex.contamination(docs, items).collect()}
    assert got[1].item_ids == ["1"] and got[2].item_ids == ["2"]
    assert got[1].n_hit == got[2].n_hit == 4_000


def test_random_texts_by_brute_force(spark):
    random.seed(9)
    words = "a b c d e f g H é 1 2".split()
    items = [(i, " ".join(random.choices(words, k=random.randint(0, 14)))) for i in range(12)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, "x " + items[i][1] + " y " + items[-i - 1][1]) for i in range(12)]
    docs += docs[:5] * 2
    got = posindex.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_odd_and_empty_tables(spark):
    docs, items = frames(spark)
    assert posindex.contamination_report(odd_docs(spark), items).count() == odd_docs(spark).count()
    assert posindex.contamination_report(empty_docs(spark), items).collect() == []
    none = posindex.contamination_report(docs, items.where("false")).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_no_python_in_the_plan(spark):
    docs, items = frames(spark)
    plan = posindex.contamination_report(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haulframe.llm import divergence
from tests.llm.helpers import SCHEMA, empty_docs, odd_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_contract(rows, in_documents=10, ranks=10):
    lower = {c: c + 32 for c in range(65, 91)}
    groups, docs = defaultdict(Counter), Counter()
    for _, text, lang, source, _ in rows:
        terms = TERM.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, term), n in docs.items():
        if n >= in_documents:
            kept[lang].add(term)
    langs = defaultdict(Counter)
    for (lang, _), counts in groups.items():
        langs[lang].update(counts)

    def shares(lang, counts):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + int(Fraction(10**9 * (counts[t] + 2), total + 2 * len(kept[lang])))
                for t in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for (lang, source), counts in groups.items():
        p, q = shares(lang, counts), shares(lang, langs[lang])
        pairs = [(sum(f(p[t], r[t]) for t in p), other)
                 for l, other in groups if l == lang and other != source
                 for r in [shares(l, groups[l, other])]]
        terms = [(f(p[t], q[t]), t) for t in p if counts[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1)
                    for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def worded(seed=6):
    random.seed(seed)
    words = ["Ab", "aB", "x", "é", "É", "it's", "one1two", "z　z", "日本", "zz", "q-r"]
    rows = []
    for i in range(300):
        source = f"s{min(int(random.expovariate(0.4)), 6)}"
        bag = words[:4 + i % 7] + [f"rare{chr(97 + i % 26)}"]
        rows.append((i, " ".join(random.choices(bag, k=i % 40)), random.choice(["en", "fr", None]),
                     source, None))
    # no term in ten documents; groups without any term
    rows += [(1000 + i, f"w{chr(97 + i)}", "xx", f"s{i % 3}", None) for i in range(9)]
    rows += [(2000, "", "en", "silent", None), (2001, None, "en", None, None),
             (2002, "1 2 3", "yy", "only", None), (2003, "Ab " * 30_000, "en", "s0", None)]
    return rows + rows[:20]


@pytest.mark.parametrize("tiles", [(divergence.TILE_TERMS, divergence.TILE_SOURCES), (3, 2)])
def test_parts_by_brute_force(spark, tiles):
    rows = worded() + odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.source_divergences(docs, tile_terms=tiles[0], tile_sources=tiles[1])
    assert sorted(map(tuple, got.collect())) == by_contract(rows)


def test_other_thresholds(spark):
    rows = worded(7)
    got = divergence.source_divergences(spark.createDataFrame(rows, SCHEMA), in_documents=1, ranks=3)
    assert sorted(map(tuple, got.collect())) == by_contract(rows, 1, 3)


def test_counts_of_many_slices_add_up(spark):
    rows = worded(8)
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = divergence.term_counts(docs, counted_bytes=500, merged_rows=60).groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    want, held = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        terms = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        want.update((lang or "", t) for t in terms)
        held.update((lang or "", t) for t in set(terms))
    assert {(r.lang, r.term): (r.n, r.docs) for r in counts if r.term} == {
        k: (want[k], held[k]) for k in want}


def test_shares_of_huge_counts_are_exact(spark):
    rows = [(10**16 + 7, 3 * 10**17 + 1, 10**9 + 3), (0, 0, 1), (5, 5, 1), (2**53 + 1, 2**60, 7)]
    df = spark.createDataFrame(rows, "n long, total long, v long").select(
        divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "n", "total", "v")
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v)


def test_empty_table_and_clashing_columns(spark):
    assert divergence.divergence_report(empty_docs(spark)).collect() == []
    rows = worded(9)
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.withColumns({"term": F.lit("t"), "n": F.lit(1), "a.b": F.lit(2)})
    assert sorted(map(tuple, divergence.divergence_report(more).collect())) == by_contract(rows)

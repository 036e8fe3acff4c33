import os
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haulframe.llm import periods
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, odd_rows, sha

FOLDER = "/root/testdata/sf0.001"


def every_run(words, times, shortest):
    """All periods one by one, all stretches of equal words a period apart."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i:i + size]
            if size >= max(shortest, times * q) and not any(
                    part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_contract(id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(id).encode())
    if id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = every_run(words, 4, 6)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (-1 if id is None else id, len(found), *top,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_those_of_all_periods():
    random.seed(8)
    for _ in range(3000):
        letters = "abcdefgh"[:random.choice([1, 2, 3, 5])]
        words = [random.choice(letters).encode() for _ in range(random.randint(0, 60))]
        if words and random.random() < 0.5:
            a, p = random.randrange(len(words)), random.randint(1, 6)
            words = words[:a] + [words[a:a + p][i % len(words[a:a + p])]
                                 for i in range(len(words) - a)]
        times, shortest = random.choice([2, 3, 4]), random.choice([2, 6])
        assert periods.runs(words, times, shortest) == every_run(words, times, shortest)


def test_nested_overlapping_and_long_runs():
    inner = [b"x"] * 7 + [b"y"]
    words = inner * 5 + [b"z"] + [b"a", b"b"] * 2000
    assert periods.runs(words) == every_run(words, 4, 6)
    assert periods.runs([b"a"] * 5) == [] and periods.runs([b"a"] * 6) == [(0, 6, 1)]
    # a fourth period that ends a word early does not count
    assert periods.runs([b"a", b"b", b"c"] * 3 + [b"a", b"b"]) == []


def test_strongest_of_equal_exponents():
    assert periods.strongest([(9, 16, 4), (3, 8, 2), (3, 4, 1)]) == (3, 4, 1)
    assert periods.strongest([(0, 3 * 10**15 + 1, 3), (5, 10**15, 1)]) == (0, 3 * 10**15 + 1, 3)
    assert periods.strongest([]) is None


def loops(seed=3):
    random.seed(seed)
    rows = []
    for i in range(400):
        words = random.choices(["la", "le", "lo", "li", "Lo", "l a", "é"], k=random.randint(0, 80))
        if i % 3 == 0:
            words = words[:5] + words[5:7] * 9 + words[:5]
        joints = random.choices([" ", "\n", "\t\r", "\x0b\x0c", "  "], k=len(words) + 1)
        rows.append((i, "".join(j + w for j, w in zip(joints, [*words, ""])), "en", "s", None))
    return rows


def test_report_by_brute_force(spark):
    rows = odd_rows() + loops()
    got = periods.period_report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((by_contract(r[0], r[1]) for r in rows), key=repr)
    assert sorted(((-1 if g[0] is None else g[0], *g[1:]) for g in got), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
def test_report_of_the_shared_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted((by_contract(r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = [tuple(g) for g in periods.period_report(docs).collect()]
    assert sorted(got, key=repr) == want
    assert any(g[1] for g in got)


def test_further_and_clashing_columns(spark):
    docs = odd_docs(spark).withColumns(
        {"RUNS": F.lit("x"), "a.b": F.lit(1), "words": F.lit(2), "h": F.lit(3)})
    rows = periods.periodic_runs(docs, keep_text=True)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "words", "h",
                            "n_words", "runs", "strongest", "collapsed"]
    for row in rows.collect():
        assert row.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
        assert row["a.b"] == 1 and row.h == 3
    assert periods.period_report(docs).count() == docs.count()


def test_empty_table(spark):
    assert periods.period_report(empty_docs(spark)).collect() == []

import random
from collections import defaultdict

import numpy as np
import pytest

from haulframe.llm import dart, neardup
from haulframe.llm.components import components
from tests.llm.helpers import empty_docs, odd_docs, odd_rows


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else None


def classes(rows):
    """Class of each row by its place: smallest id of its connected component."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                same = a is None and b is None and (rows[i][1] or "") == (rows[j][1] or "")
            else:
                same = len(a & b) / len(a | b) >= 0.8
            if same:
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least[top(i)].append(id)
    return sorted(((id, min(least[top(i)], default=None)) for i, (id, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2, 256])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    random.seed(block)
    rows = []
    for _ in range(6):
        words = ["".join(random.choices("abcdef", k=5)) for _ in range(random.randint(30, 90))]
        for _ in range(12):
            own = list(words)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = "other"
            rows.append((len(rows), " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == classes(rows)


def template_rows(n, changed=10):
    """Texts of one template of 60 words, each with words of its own; no two are alike."""
    random.seed(n)
    words = ["".join(random.choices("abcdef", k=5)) for _ in range(60)]
    return [(i, " ".join(f"own{i}x{j}" if j % (60 // changed) == 3 else w
                         for j, w in enumerate(words))) for i in range(n)]


def test_work_grows_with_the_texts_of_a_template(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    plain, sent = neardup.compared, []

    def counted(rows, groups, words, similarity):
        sent.append(rows.count())
        return plain(rows, groups, words, similarity)

    monkeypatch.setattr(neardup, "compared", counted)
    totals = []
    for n in (400, 800):
        # half of the words shared: most texts are candidates, none is a copy
        rows = template_rows(n, changed=3)
        sent.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert all(r.doc_id == r.class_id for r in got.collect())
        totals.append(sum(sent))
    assert totals[1] <= 2 * max(totals[0], 1) + 32


def test_work_grows_with_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    plain, sent = neardup.compared, []

    def counted(rows, groups, words, similarity):
        sent.append(rows.count())
        return plain(rows, groups, words, similarity)

    monkeypatch.setattr(neardup, "compared", counted)
    totals = []
    for n in (200, 400):
        random.seed(n)
        words = ["".join(random.choices("abcdef", k=5)) for _ in range(120)]
        rows = [(i, " ".join(f"own{i}" if j == 2 else w for j, w in enumerate(words)))
                for i in range(n)]
        sent.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.class_id for r in got.collect()} == {0}
        totals.append(sum(sent))
    assert n < totals[1] <= 2.2 * totals[0]


def test_large_families_with_chains_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    random.seed(21)
    words = ["".join(random.choices("abcdef", k=5)) for _ in range(80)]
    rows = []
    for i in range(60):  # a chain: neighbours are alike, far ones are not
        rows.append((i, " ".join(f"w{j}" if j < i else w for j, w in enumerate(words))))
    for i in range(60):  # strangers that share half
        rows.append((i + 100, " ".join(words[:40] + [f"s{i}q{j}" for j in range(i % 30 + 5)])))
    for i in range(30):  # some of them in pairs
        rows.append((i + 200, rows[60 + i][1] + " end"))
    random.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == classes(rows)


def test_odd_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = neardup.near_duplicates(odd_docs(spark)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == classes(rows)
    assert neardup.near_duplicates(empty_docs(spark)).collect() == []


def unkeyed_rows():
    """Near copies without an id, one of them a link between two ids; ids under two texts."""
    random.seed(11)
    rows = []
    for k in range(8):
        words = ["".join(random.choices("abcdef", k=5)) for _ in range(60)]

        def text(*changed):
            return " ".join("other" if i in changed else w for i, w in enumerate(words))

        # the first and the last are alike by the row in the middle only
        rows += [(100 + 2 * k, text(0, 59)), (None, text(0)), (101 + 2 * k, text(0, 30))]
        rows += [(None, text(0))] * 3 + [(7, text(59)), (8, text(15, 45))]
        rows += [(9, "own " * k + " ".join(words[::-1]))] * 2
    return rows


def test_rows_without_an_id_and_ids_under_several_texts(spark):
    rows = unkeyed_rows()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == classes(rows)


def test_signatures_estimate_weighted_similarity():
    random = np.random.default_rng(2)
    agree = []
    for _ in range(30):
        element = random.integers(0, 2**63, 150, dtype=np.uint64)
        a = random.random(150) * 9
        b = a * random.choice([1.0, 0.5, 2.0], 150)
        rows = dart.signatures(np.tile(element, 2), np.concatenate([a, b]),
                               np.repeat([0, 1], 150), 2, 150)
        agree.append((rows[0] == rows[1]).mean()
                     - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree)) < 0.02


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {
        **{i: 0 for i in range(41)}, 100: 100, 101: 100}

from collections import defaultdict

import pytest

from haulframe.llm import linededup
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, sha

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(line):
    return line.strip(linededup.BLANKS).translate(str.maketrans(UPPER, UPPER.lower()))


def brute(rows, documents):
    seen = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[key(line)].add(n)
    gone = {k for k, v in seen.items() if k and len(v) >= documents}
    out = []
    for id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ROWS = [
    (0, "Shared line\nown 0\n\nÉTÉ"), (1, " shared LINE\t\nown 1"), (2, "shared line\nshared line"),
    (3, None), (4, ""), (5, "\n\n"), (6, "été\nown 6"), (7, "ÉTÉ\nx"), (8, "Été"),
    (2, "shared line\nshared line"), (9, "\x0bx\x0c\r"), (None, "x"), (10, "y" * 20000 + "\nx"),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 3)])
def test_equals_brute_force(spark, batches, fanout):
    docs = spark.createDataFrame(
        [(i, t, 1, 2, 3, 4) for i, t in ROWS],
        "doc_id long, text string, k1 int, pos int, n_lines int, h1 int")
    got = linededup.drop_shared_lines(docs, documents=3, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "k1", "pos", "h1", "kept_text", "n_lines", "n_dropped"]
    plain = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert plain == sorted(brute(ROWS, 3), key=str)


def test_odd_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = linededup.line_report(odd_docs(spark)).collect()
    want = [(i, n, d, sha(t)) for i, t, n, d in brute(rows, 10)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert linededup.line_report(empty_docs(spark)).collect() == []


def test_repeated_rows_and_rows_without_an_id_count_each(spark):
    for rows in ([(None, "shared\nown")] * 12, [(i, "shared") for i in range(9)] + [(3, "shared")],
                 [(1, "shared")] * 10, [(1, "shared\nshared")] * 9):
        got = linededup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        want = sorted(brute(rows, 10), key=str)
        assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()),
                      key=str) == want


def test_runs_are_read_as_they_lie(spark):
    docs = spark.createDataFrame([(i, f"a\nb{i}\nc{i % 3}") for i in range(50)],
                                 "doc_id long, text string")
    lines, n = linededup.line_table(docs, "doc_id", "text", 4)
    assert n == 150
    runs = linededup.LevelledRuns(spark, 10, 3, 4)
    for batch in (0, 1):
        runs.add(lines.where(f"batch = {batch}"))
    joined = runs.counted(lines.where("batch = 2"))._jdf.queryExecution().toString()
    merged = runs.merged(runs.runs())._jdf.queryExecution().toString()
    # the counts of the batch are dealt by key once; nothing moves for the two runs
    plan = joined[joined.index("== Physical Plan"):]
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
    assert "Exchange" not in merged[merged.index("== Physical Plan"):]
    names = runs.runs()
    runs.forget(names)
    assert not {t.name for t in spark.catalog.listTables()} & set(names)


def test_no_python_in_the_plan(spark):
    plan = linededup.line_report(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

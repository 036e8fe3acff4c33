import random
from collections import Counter

import pytest

from haulframe.llm import suffixes
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, sha


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((len(t), sum(gone), runs, sha(kept)))
    return out


def result(docs, **how):
    rows = suffixes.remove_repeats(docs, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept)))
                   for r in rows), key=str)


def wanted(rows, length):
    found = brute([(t or "").encode() for _, t in rows], length)
    return sorted(((id, *f) for (id, _), f in zip(rows, found)), key=str)


@pytest.mark.parametrize(("length", "gram", "bucket"), [(40, 12, 3_000), (30, 20, 600), (40, 12, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, length, gram, bucket):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    random.seed(length + bucket)
    base = ["".join(random.choices("abé ", k=random.randint(20, 300))) for _ in range(8)]

    def piece():
        kind = random.random()
        if kind < 0.4:
            return "".join(random.choices("abcdefgh é", k=random.randint(0, 50)))
        if kind < 0.8:
            own = random.choice(base)
            at = random.randint(0, len(own))
            return own[at:at + random.randint(5, 120)]
        return random.choice("xy") * random.randint(1, 70)

    rows = [(i, "".join(piece() for _ in range(random.randint(0, 5)))) for i in range(90)]
    rows += [(90, None), (91, ""), rows[5], (None, base[0])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows],
                                 "doc_id long, text string, k1 int, n_spans int")
    assert result(docs, length=length, gram=gram) == wanted(rows, length)


def test_odd_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert result(odd_docs(spark).select("doc_id", "text")) == wanted(rows, suffixes.LENGTH)
    assert suffixes.repeat_report(empty_docs(spark)).collect() == []


def test_multikey_order_is_that_of_bytes():
    random.seed(1)
    strings = [bytes(random.choices(b"\0ab", k=random.randint(0, 30))) for _ in range(3_000)]
    order = suffixes.multikey_order(strings, 32)
    assert [strings[i] for i in order] == sorted(strings)


def test_equal_rows_send_each_context_once(spark, monkeypatch):
    random.seed(5)
    text = "".join(random.choices("abcdefghij ", k=3_000))
    near = text[:1_400] + "#" + text[1_400:]
    rows = [(i, text) for i in range(1_000)] + [(7, text)] * 2 + [(2_000, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = suffixes.context_texts

    def counted(*args):
        found = plain(*args)
        seen.append((found.count(), found.select("g", "c").distinct().count()))
        return found

    monkeypatch.setattr(suffixes, "context_texts", counted)
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert seen[0][0] == seen[0][1] < 40
    assert all(got[i].n_removed == 3_000 for i in range(1_000))
    assert (got[2_000].n_bytes, got[2_000].n_removed) == (3_001, 3_000)


def test_further_and_clashing_columns(spark):
    docs = odd_docs(spark)
    more = docs.selectExpr("*", "1 AS `a.b`", "'x' AS N_SPANS", "2 AS row", "3 AS k1")
    out = suffixes.remove_repeats(more)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "a.b", "row", "k1",
                           "kept", "n_bytes", "n_removed", "n_spans"]
    assert out.count() == docs.count()
    report = suffixes.remove_repeats(more, digest=True).collect()
    assert sorted(r.kept_sha256 for r in report) == sorted(sha(bytes(r.kept)) for r in out.collect())

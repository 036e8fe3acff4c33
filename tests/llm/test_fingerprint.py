from collections import Counter

import numpy as np
import pytest

from haulframe.llm import fingerprint
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, sha


def counted(text):
    digest, _ = fingerprint.parts(*fingerprint._laid([text]))
    return Counter(digest.tolist())


def jaccard(a, b):
    a, b = counted(a), counted(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_equals_brute_force(spark, coalesce):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesce)
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()),
                  key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    got = fingerprint.version_fingerprints(odd_docs(spark)).collect()
    spark.conf.unset(key)
    want = []
    for i, (id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = fingerprint.edited(text, after)
        want.append((id, len(text), sha(changed), round(jaccard(text, changed), 9),
                     round(jaccard(text, after), 9)))
    plain = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
             for r in got]
    assert sorted(plain, key=str) == sorted(want, key=str)
    by_text = {}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(set(map(str, map(sorted, (
        counted(t).items() for t in by_text)))))


def test_peeling_recovers_what_differs_and_retries_larger():
    random = np.random.default_rng(3)
    left = [random.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 5, 400, 3000)]
    right = [np.concatenate([x[: len(x) // 2], random.integers(0, 2**63, 7, dtype=np.uint64)])
             for x in left]

    def laid(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    digest, owner, sign = fingerprint.differences(laid(left), laid(right), len(left))
    for i, (a, b) in enumerate(zip(left, right)):
        mine = owner == i
        assert set(digest[mine & (sign > 0)]) == set(a) - set(b)
        assert set(digest[mine & (sign < 0)]) == set(b) - set(a)
    small = fingerprint.sketch(*laid(left[3:]), 1).minus(fingerprint.sketch(*laid(right[3:]), 1))
    assert not small.peel()[3][0]  # 24 cells cannot hold thousands


def test_texts_without_blanks_are_alike_where_they_are():
    random = np.random.default_rng(6)
    han = "".join(map(chr, random.integers(0x4E00, 0x9FA5, 900)))
    other = "".join(map(chr, random.integers(0x4E00, 0x9FA5, 900)))
    code = "".join(random.choice(list("abcdefghijklmnop0123456789+/"), 3_000))
    got = fingerprint.compare_versions([han, code, "a" * 5_000, "é" * 3_000], [other] * 4)
    assert min(got["near_edited"][:2]) > 0.4 and min(got["near_edited"]) > 0.1
    assert max(got["near_next"]) == 0
    # an insertion near the start leaves the rest alike
    changed = fingerprint.compare_versions([han], [han[:40] + "x" + han[40:]])
    assert changed["near_next"][0] > 0.85, changed["near_next"]


def test_long_words_are_cut_at_code_points():
    text = "kurz " + "é日😀" * 200 + " ende " + "x" * 1_000
    raw = np.frombuffer(text.encode(), np.uint8)
    begins, ends = fingerprint.words(raw)
    begins, ends = fingerprint.shortened(begins, ends, raw, fingerprint.SpanHash(raw))
    pieces = [raw[a:b].tobytes().decode() for a, b in zip(begins, ends)]
    assert "".join(pieces) == "".join(text.split()) and pieces[0] == "kurz"
    assert max(len(p.encode()) for p in pieces) <= fingerprint.MOST_BYTES + 8


def test_empty_table(spark):
    assert fingerprint.version_fingerprints(empty_docs(spark)).collect() == []

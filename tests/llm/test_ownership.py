import re

from haulframe.llm import ownership
from tests.llm.helpers import empty_docs, odd_docs, sha

TEXTS = [
    (0, 'a password=hunter2hunter2 b', "s0"),
    (1, "TOKEN : 'abcdefgh12345678' AKIAABCDEFGHIJKL AKIASHORT", "s1"),
    (2, "x " + "0123456789abcdef" * 2 + " y api_key=\"" + "f" * 32 + '"', "s2"),
    (3, None, "s3"), (4, "", None), (5, "ſecret=abcdefghijkl toKen=abcdefghijkl", "s5"),
    (6, "key q7Wm3Zr9Tx2Lp8Vb5Nd4 here", "s6"), (7, "sample A1b2C3d4E5f6G7h8I9j0 used", "s7"),
    (8, "sample A1b2C3d4E5f6G7h8I9j0 used", "s8"), (None, "secret:zzzzzzzzz", "s9"),
    (10, "password=short passwd=longenough1 secret = longenough2 apikey:longenough3", "s9"),
    (0, 'a password=hunter2hunter2 b', "s0"),
]


def brute(text):
    """The base spans, straight from their patterns."""
    text, out = text or "", []
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                       for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    spans = sorted((m.start(), order[k], k, m.end()) for k, m in out)
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans), [k for _, _, k, _ in spans]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    got = ownership.secret_report(docs).collect()
    want = []
    for id, text, _ in TEXTS:
        joined, kinds = brute(text)
        want.append((id, *(kinds.count(k) for k in ("assign", "access", "hex")), sha(joined)))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("bare"))
        assert sha(base) == r.base_sha256


def test_bare_words_need_a_single_owner(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans for r in ownership.secret_report(docs).collect()}
    assert spans[6] == "bare:4:24"
    assert spans[7] == spans[8] == ""


def test_odd_rows_and_empty_table(spark):
    rows = ownership.secret_report(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    assert ownership.secret_report(empty_docs(spark)).collect() == []

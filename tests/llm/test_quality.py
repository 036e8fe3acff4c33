import math
import os
import random
import re
import zlib

import pytest
import regex

from haulframe.llm import quality
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, odd_rows

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    random.seed(8)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(random.choices("abcdefgh", k=random.randint(2, 9))) for _ in range(60)]
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_scores_and_folds(spark):
    docs, labels = corpus(spark)
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == int(r.doc_id % 3 > 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 3 > 0}


BLANK = r"[ \t\n\x0b\f\r]"


def plain_statistics(text):
    """The statistics in plain Python, in the order of the names."""
    text = text or ""
    chars, some = len(text), max(len(text), 1)
    words = re.split(BLANK + "+", text.strip(" "))
    lines = text.split("\n")

    def count(pattern):
        return len(regex.findall(pattern.replace(r"\s", BLANK[1:-1]), text))

    symbol_words = len(regex.findall(
        rf"(?<![^{BLANK[1:-1]}])[^\p{{L}}\p{{N}}{BLANK[1:-1]}]+(?![^{BLANK[1:-1]}])", text))
    stops = len(regex.findall(rf"[.!?](?![^{BLANK[1:-1]}])", text))
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    return [
        chars, 0 if text.strip(" ") == "" else len(words), chars / n_words,
        len(text.encode()) / some, len(set(words)) / n_words, count(r"\p{Lu}") / some,
        len(re.findall("[0-9]", text)) / some, count(r"[^\p{L}\p{N}\s.,;:'()-]") / some,
        symbol_words / n_words, stops / n_words, text.count(",") / n_words, len(lines),
        chars / n_lines, len(set(lines)) / n_lines, max(map(len, lines)) / some,
    ]


def test_statistics_and_scores_by_plain_rescoring(spark):
    docs, labels = corpus(spark)
    random.seed(17)
    odd = ["".join(random.choices("aB ,.!?;é😀ÉЖ1२\n\t\u3000#-_'(", k=random.randint(0, 80)))
           for _ in range(300)]
    more = [(1000 + i, t, None, None, None) for i, t in enumerate([*odd, None, "", "   ", "\n \n"])]
    docs = docs.union(spark.createDataFrame(more, SCHEMA))
    stats = quality.text_statistics(docs, "doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.id: [r[n] for n in quality.NAMES] for r in stats.collect()}
    for id, text in texts.items():
        assert rows[id] == pytest.approx(plain_statistics(text)), (id, text)
    model = quality.train(stats, labels, "doc_id", "quality")
    assert 0 < len(model.rules) < 200
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    for id, text in texts.items():
        own = plain_statistics(text)
        total = model.intercept + sum(
            w for rule, w in model.rules
            if all(low < rows[id][i] <= high for i, low, high in rule.bounds))
        assert got[id].score == pytest.approx(1 / (1 + math.exp(-total)))
        assert got[id].predicted == int(got[id].score >= 0.3) and len(own) == 15


def test_held_out_labels_have_no_influence(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a = {r.doc_id: r.score for r in quality.quality_report(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_report(docs, turned).collect()}
    assert a == b


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], LABELS)
    got = quality.quality_report(docs, none).collect()
    assert len(got) == len(odd_rows()) and all(abs(r.score - 0.5) < 1e-9 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    _, labels = corpus(spark)
    odd = labels.union(spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 0, 0)], LABELS))
    scored = quality.quality_report(docs, odd).collect()
    assert len(scored) == len(odd_rows())
    twice = [r.score for r in scored if r.doc_id == 3]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert quality.quality_report(empty_docs(spark), labels).collect() == []
    assert quality.keep_good(empty_docs(spark), labels).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95

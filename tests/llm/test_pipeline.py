import glob
import os

import public_tokenizers
import pytest
import tiktoken
import base64

import corpus_pipeline
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, sha
from tests.llm.test_linededup import brute as drop_lines
from tests.llm.test_neardup import shingle_set
from tests.llm.test_posindex import brute as contaminated
from haulframe.llm import quality
from haulframe.sources import scratch

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")


def keep_first(rows):
    kept, sets = [], [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][1] == rows[j][1] if a is None or b is None else (
                len(a & b) / len(a | b) >= 0.8)
            if same:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    for i, (id, text) in enumerate(rows):
        if id == min(r[0] for r, g in zip(rows, group) if g == group[i]):
            kept.append((id, text))
    return kept


def test_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.quality_report(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = keep_first([(id, text) for id, text, _, _ in drop_lines(rows, 10)])
    rows = [r for r, mark in zip(rows, contaminated(rows, items)) if not mark[5]]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    want = [(id, len(ids := peer.encode_ordinary(t)), sha(" ".join(map(str, ids))), sha(t))
            for id, t in rows]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, empty_docs(spark), FOLDER).collect() == []


def test_further_columns_of_any_name_stay(spark):
    docs = odd_docs(spark).selectExpr("*", "1 AS `a.b`", "2 AS k1", "3 AS component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_scratch_of_a_stage_goes_with_the_next(spark):
    seen = set(glob.glob(f"{scratch.scratch_dir(spark)}/haulframe/*/*"))
    rows = corpus_pipeline.run(spark, FOLDER)
    left = set(glob.glob(f"{scratch.scratch_dir(spark)}/haulframe/*/*")) - seen
    assert len(left) == 1 and rows.count() > 0


def test_one_of_each_group_stays(spark):
    kept = corpus_pipeline.near_dedup(spark, odd_docs(spark), FOLDER).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) == 1 and ids.count(0) == 1 and ids.count(None) == 1
    assert 27 not in ids and 28 not in ids


def test_unlike_texts_under_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (7, b + " end"), (9, a + " end"), (9, c), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [
        ("7", "a"), ("7", "b"), ("9", "c"), ("None", "c"), ("None", "c")]

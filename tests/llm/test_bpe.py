import base64
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from haulframe.llm import bpe
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, sha

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_ids_and_offsets_equal_those_of_the_library(spark, peer):
    random.seed(2)
    alphabet = list("ab'stredvlm'  \n\t 　.,!12é٣😀’'ll")
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["=" * 3000, "a" * 2000, " " * 500, "'s's''s 's", "x'll've 'RE", None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string")
    for row in bpe.encode(docs, "text", PATH).collect():
        text = texts[row.doc_id] or ""
        ids = peer.encode_ordinary(text)
        assert list(row.ids) == ids
        sizes = [len(peer.decode_single_token_bytes(i)) for i in ids]
        assert list(row.offsets) == [0, *itertools.accumulate(sizes)][:len(ids)]


def test_round_trip_and_digests_of_odd_rows(spark, peer):
    rows = odd_rows()
    got = bpe.token_digests(odd_docs(spark), PATH).collect()
    want = sorted((-1 if r[0] is None else r[0], len(ids := peer.encode_ordinary(r[1] or "")),
                   sha(" ".join(map(str, ids))), sha(r[1] or "")) for r in rows)
    assert want == sorted((-1 if g[0] is None else g[0], *g[1:]) for g in got)


def test_decoding_gives_the_text_back(spark):
    coded = bpe.encode(odd_docs(spark), "text", PATH, keep_text=True)
    for row in bpe.decode(coded, "ids", PATH).collect():
        assert bytes(row.decoded) == (row.text or "").encode()


def test_decoding_follows_the_offsets(spark):
    row = bpe.round_trip(spark.createDataFrame([("one two three",)], "text string"), "text",
                         PATH).collect()[0]
    assert bytes(row.decoded) == b"one two three" and list(row.offsets) == [0, 3, 7]
    token, counts = np.array(row.ids, np.int64), np.array([3])
    moved = bpe.decoded_lists(token, counts, PATH, np.array([10, 6, 0]))
    assert moved.to_pylist() == [b" three two" + b"one"]


def test_further_and_clashing_columns(spark):
    docs = odd_docs(spark).selectExpr("*", "1 AS `a.b`", "2 AS IDS", "3 AS __text")
    coded = bpe.encode(docs, "text", PATH, keep_text=True)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__text",
                             "ids", "offsets"]
    for row in bpe.decode(coded, "ids", PATH).collect():
        assert bytes(row.decoded) == (row.text or "").encode() and row["a.b"] == 1
    assert bpe.round_trip(docs, "text", PATH).columns[-4:] == ["__text", "ids", "offsets", "decoded"]


def test_empty_table(spark):
    assert bpe.token_digests(empty_docs(spark), PATH).collect() == []

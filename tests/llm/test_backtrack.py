import random
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulframe.llm import backtrack
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, sha

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def peer():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return library


def strange_texts() -> list[str | None]:
    random.seed(4)
    alphabet = [*"ab'stredvlm'  \n\t 　.,!12é٣😀’'ll", "<|endoftext|>", "Ᲊ", "࢏",
                "\U00010940", "thing", " a", "\r\n", "\x1c", "\x85", "\0"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(random.choices("aestin", k=300)) for _ in range(100)]
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(map(chr, random.choices(points, k=60))) for _ in range(500)]
    texts += ["=" * 3000, "a" * 20_000, " " * 500, "ab" * 5000, "aaab" * 3000, None, "",
              "<|endoftext|>", "  <|endoftext|><|endoftext|> a  <|endoftext|>", "<|endoftext|"]
    return texts


def test_ids_and_offsets_equal_those_of_the_library(spark, peer):
    texts = strange_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in backtrack.encode(docs, "text", PATH).collect():
        text = texts[row.doc_id] or ""
        want = peer.encode(text, add_special_tokens=False)
        assert list(row.ids) == want.ids
        sizes = [len(backtrack.vocabulary(PATH).bytes[i]) for i in want.ids]
        assert list(row.offsets) == np.cumsum([0, *sizes])[:-1].tolist()
        assert sum(sizes) == len(text.encode())


def test_every_code_point_is_cut_as_the_library_cuts_it(peer):
    words = backtrack.vocabulary(PATH)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}  " for c in points[k:k + 500])
             for k in range(0, len(points), 500)]
    ids, counts = words.encode(texts)
    ends = np.cumsum(counts)
    for end, n, want in zip(ends, counts, peer.encode_batch(texts, add_special_tokens=False)):
        assert ids[end - n:end].tolist() == want.ids


def test_decoding_any_ids_equals_the_library(spark, peer):
    random.seed(5)
    rows = [(i, [random.randrange(-1, 50_300) for _ in range(random.randint(0, 9))])
            for i in range(500)] + [(500, None), (501, [None, 65, None]), (502, [50_256, 220])]
    docs = spark.createDataFrame(rows, "id long, ids array<int>")
    for row in backtrack.decode(docs, "ids", PATH).collect():
        known = [i for i in row.ids or [] if i is not None and i >= 0]
        assert row.decoded == peer.decode(known, skip_special_tokens=False)


def test_digests_of_odd_rows(spark, peer):
    got = backtrack.backtrack_report(odd_docs(spark), PATH).collect()
    want = []
    for id, text, *_ in odd_rows():
        ids = peer.encode(text or "", add_special_tokens=False).ids
        want.append((-1 if id is None else id, len(ids),
                     sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")))
    assert sorted(want) == sorted((-1 if g[0] is None else g[0], *g[1:]) for g in got)


def test_further_and_clashing_columns(spark):
    docs = odd_docs(spark).withColumns({"ids": F.lit("x"), "a.b": F.lit(1), "__text": F.lit(2),
                                        "DECODED": F.lit(3)})
    coded = backtrack.encode(docs, "text", PATH, keep_text=True)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__text",
                             "DECODED", "ids", "offsets"]
    back = backtrack.decode(coded, "ids", PATH)
    assert back.columns[-1] == "decoded" and "DECODED" not in back.columns
    for row in back.collect():
        assert row.decoded == (row.text or "") and row["a.b"] == 1 and row["__text"] == 2


def test_empty_table(spark):
    assert backtrack.backtrack_report(empty_docs(spark), PATH).collect() == []
    assert backtrack.encode(empty_docs(spark), "text", PATH).collect() == []


def test_a_worker_that_forgets_gives_the_same(monkeypatch):
    words = backtrack.vocabulary(PATH)
    texts = strange_texts()
    ids, counts = words.encode(texts)
    monkeypatch.setattr(backtrack, "PIECES", 50)
    monkeypatch.setattr(backtrack, "CACHED", 200)
    monkeypatch.setattr(backtrack, "CACHED_PAIRS", 100)
    again, counts_again = words.encode(texts)
    assert ids.tolist() == again.tolist() and counts.tolist() == counts_again.tolist()

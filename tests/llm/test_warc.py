import random

import pytest

from haulframe.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, block int"


def pages(spark, n=60):
    random.seed(4)
    rows = []
    for i in range(n):
        kind = random.random()
        if kind < 0.3:
            html = "".join(
                f"WARC/1.1\r\nContent-Length: {random.randint(0, 900)}\r\n\r\n"
                + "y" * random.randint(0, 200) for _ in range(random.randint(1, 5)))
        elif kind < 0.4:
            html = None
        elif kind < 0.5:
            html = "WARC/1.1\r\n" * random.randint(1, 60)
        elif kind < 0.7:
            html = "same" * 300
        else:
            html = "é" * random.randint(0, 2000)
        rows.append((i, f"http://a/{i}\r\nx" if i % 7 else None, html, "z", i))
    rows += [rows[0], (None, "u", "same" * 300, None, None)]
    return rows


@pytest.mark.parametrize("limit", ["67108864", "0"])
def test_payloads_survive_magic_lines_and_block_ends(spark, tmp_path, limit):
    rows = pages(spark)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
            "haulframe.broadcast.bytes")
    old = [spark.conf.get(k, None) for k in keys]
    try:
        for k, v in zip(keys, ("4000", "1", limit)):
            spark.conf.set(k, v)
        folder = str(tmp_path / "w")
        warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(2), folder)
        got = warc.read_archives(spark, folder).select(
            warc.page_number("WARC-Record-ID").alias("id"), "payload",
            warc.header_field("WARC-Type").alias("type"),
            warc.page_number("WARC-Refers-To").alias("refers")).collect()
    finally:
        for k, v in zip(keys, old):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == len(rows)
    want = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        if r.type == "response":
            assert bytes(r.payload) == want[r.id]
        else:
            assert want[r.id] == want[r.refers] and r.refers > r.id and bytes(r.payload) == b""
    copies = [r for r in got if want[r.id] == b"same" * 300 and r.id is not None]
    assert sum(r.type == "response" for r in copies) == 1


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(spark, folder).collect() == []

import base64
import hashlib
import os
import random

import pytest

from trawl.llm import warc
from trawl.llm.cluster import new_path

PAGES = "page_id bigint, url string, html string, record string, chunk int, size string, key string"


def rows():
    rng = random.Random(1)
    out = [(i, f"http://x/{i}", "<p>" + "".join(rng.choice("abcé\r\n") for _ in range(rng.randrange(0, 400))), "r", 1, "s", "k") for i in range(40)]
    same = "<b>same</b>"
    out += [(100 + i, "u", same, "r", 1, "s", "k") for i in range(5)] + [(103, "u", same, "r", 1, "s", "k"), (104, "u", same, "r", 1, "s", "k"), (104, "u", same, "r", 1, "s", "k")]
    out += [(200, None, None, "r", 1, "s", "k"), (201, "u", "", "r", 1, "s", "k"), (None, "u", "no id", "r", 1, "s", "k"), (None, "u", same, "r", 1, "s", "k"), (300, "a b\r\nX: y", "long" * 5000, "r", 1, "s", "k"), (300, "u", "other text, same id", "r", 1, "s", "k")]
    return out


def expected(rows, least):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    top, out, used = {}, [], set()
    for page, body in payloads:
        top[body] = page if body not in top or top[body] is None else top[body] if page is None else max(page, top[body])
    for page, body in payloads:
        first = len(body) < least or page == top[body] and body not in used
        if first and len(body) >= least:
            used.add(body)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[body]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [warc.CHUNK, 7])
@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, chunk, least):
    path = new_path(spark, "w")
    warc.write_records(spark.createDataFrame(rows(), PAGES).repartition(3), path, least=least, chunk=chunk)
    got = sorted(map(tuple, warc.read_records(warc.read_chunks(spark, path)).collect()), key=str)
    assert got == expected(rows(), least)


def test_no_chunk_is_larger_than_asked(spark):
    table = warc.record_table(spark.createDataFrame(rows(), PAGES), "page_id", "html", "url", chunk=50)
    assert table.where("octet_length(data) > 54 or (chunk > 0) != (header is null)").count() == 0


def test_damage_and_gaps_show():
    head = warc.header("urn:page:1:k", "u", None, warc.base32_sha1(hashlib.sha1(b"abcdef").digest()), 6)
    chunks = list(warc.record_chunks(head, memoryview(b"abcdef"), 4))
    take = lambda cs: [warc.RecordReader.take(reader, "r", *c[:4], memoryview(c[4])) for reader in [warc.RecordReader()] for c in cs]
    assert take(chunks)[-1] == (1, 6, warc.base32_sha1(hashlib.sha1(b"abcdef").digest()), "response", None)
    assert len(chunks) == 2
    for damaged in ([chunks[1]], [chunks[0], chunks[0]], [(0, False, *chunks[0][2:4], b"abcX"), chunks[1]], [chunks[0], (*chunks[1][:4], b"eX\r\n\r\n")], [chunks[0], (*chunks[1][:4], b"ef\r\n\r")]):
        with pytest.raises(ValueError):
            take(damaged)


def test_exported_files_parse(spark, tmp_path):
    table = warc.record_table(spark.createDataFrame(rows(), PAGES), "page_id", "html", "url", chunk=64)
    from trawl.llm.cluster import staged

    warc.export_warc(staged(table, "w"), str(tmp_path), 2)
    n = 0
    for name in os.listdir(tmp_path):
        raw = (tmp_path / name).read_bytes()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = warc.parse_header(head + b"\r\n\r\n")
            size = int(fields["content-length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            if fields["warc-type"] == "response":
                assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(rest[:size]).digest()).decode()
            raw, n = rest[size + 4 :], n + 1
    assert n == len(rows())


def test_empty_table(spark):
    assert warc.archive_digest(spark.createDataFrame([], PAGES)).count() == 0

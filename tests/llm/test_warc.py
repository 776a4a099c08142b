import base64
import gzip
import hashlib

import pytest

from mensura.llm import warc
from mensura.llm.files import new_folder, opened, written

PAGES = [
    (5, "http://a/", "<p>one</p>"), (3, "http://b/?q=é x\r\nEvil: 1", "<p>one</p>"), (7, None, None), (8, "http://c/", ""), (9, "u", "WARC/1.1\r\n\r\n" * 3),
    (3, "http://b/", "<p>one</p>"), (None, "http://n/", "<p>one</p>"), (None, "http://n/", "<p>only none</p>"), (10, "big", "x" * 3_000_000),
] + [(100 + i, f"http://p/{i}", f"<p>{i % 7}</p>") for i in range(50)]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'?' AS digest", "1 AS first", "'x' AS row", "'y' AS text")


def brute(rows):
    digests = [base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows]
    first = {}
    for (p, _, _), d in zip(rows, digests):
        first[d] = p if first.get(d) is None else first[d] if p is None else min(first[d], p)
    out = [(p, len((h or "").encode()), d, "response" if p == first[d] else "revisit", None if p == first[d] else first[d]) for (p, _, h), d in zip(rows, digests)]
    return sorted(out, key=repr)




def test_pages_come_back_from_normalised_archives(spark):
    source, target = new_folder(spark, "test-warc"), new_folder(spark, "test-warc")
    files = warc.write_monolithic(pages(spark).repartition(3), source)
    names = warc.normalise(spark, source, files, target)
    assert names == files
    assert sorted((tuple(r) for r in warc.read_pages(spark, target, names).collect()), key=repr) == brute(PAGES)
    store, at = opened(target)
    for name in names:
        with store.open_input_file(f"{at}/{name}") as f:
            whole = f.read()
            index = warc.index_of(store, f"{at}/{name}")
            assert sum(n for _, n, _, _ in index) == len(whole)
            for offset, length, kind, record in reversed(index):  # any record on its own
                headers, _ = warc.read_record(f, offset, length)
                assert (headers[b"warc-type"].decode(), headers[b"warc-record-id"].decode()) == (kind, record)
        with opened(source)[0].open_input_file(f"{opened(source)[1]}/{name}") as f:
            assert gzip.decompress(f.read()) == gzip.decompress(whole)  # the same records


def test_archives_of_several_members_and_broken_ones(spark):
    source, target = new_folder(spark, "test-warc"), new_folder(spark, "test-warc")
    one = warc.record(1, "http://a", b"<p>", warc.digest_of(b"<p>"), 3, 1)
    two = warc.record(2, "http://b", b"<p>", warc.digest_of(b"<p>"), 3, 1)
    with written(source, "two.warc.gz") as f:
        f.write(gzip.compress(one) + gzip.compress(two))
    assert warc.normalise(spark, source, ["two.warc.gz"], target) == ["two.warc.gz"]
    got = sorted(tuple(r) for r in warc.read_pages(spark, target, ["two.warc.gz"]).collect())
    assert got == [(1, 3, warc.digest_of(b"<p>"), "response", None), (2, 3, warc.digest_of(b"<p>"), "revisit", 1)]
    import io
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(one[:-20])))
    headers, block, _ = next(warc.records(io.BytesIO(one)))
    with pytest.raises(ValueError):
        warc.described(headers, block + b"!")


def test_empty_table(spark):
    folder = new_folder(spark, "test-warc")
    assert warc.write_monolithic(pages(spark).limit(0), folder) == []
    assert warc.read_pages(spark, folder, warc.normalise(spark, folder, [], folder)).collect() == []

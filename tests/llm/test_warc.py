"""WARC archives: an exact round trip, records by a parser of our own, and the merge against sorting."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from daybook.llm import warc
from daybook.llm.common import Scratch

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    common, long_ = "<p>copy</p>" * 20, "é" * 60
    out = [(k, f"https://www.Host{k % 3}.example.com:443/a/{k % 5}?q=1#f", rng.choice([common, common, f"<p>{k}</p>" * 30, long_, "short", "x" * 99, "y" * 100])) for k in range(200)]
    out += [(200, None, common), (201, "no scheme", None), (202, "http://u@h.org", ""), (203, "http://a b\r\nX: y/ü%41", "line\r\n\r\nWARC/1.1\r\n\r\n" * 9), (None, "http://n.org/", "nobody's " * 30), (None, None, "nobody's " * 30), (204, "http://big.org", "long text " * 300_000)]
    return out + [out[0], out[0], out[3], (0, "http://other.org/", out[0][2]), (None, None, None)]


def want(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] is None, rows[k][1] or ""))
    first, out = {}, []
    for k in order:
        page, _, html = rows[k]
        p = (html or "").encode()
        digest = hashlib.sha256(p).hexdigest()
        if len(p) >= 100 and digest in first:
            out.append((page, len(p), digest, "revisit", first[digest]))
        else:
            first[digest] = page
            out.append((page, len(p), digest, "response", None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_archive_pages(spark, rows, parts, monkeypatch):
    monkeypatch.setattr(warc, "partitions", lambda spark: parts)
    found = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(7))
    got = found.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == want(rows)
    assert sorted((r.url or "" for r in got)) == sorted(u or "" for _, u, _ in rows)
    keys = [(r.url_key.encode(), r.captured) for r in got]
    assert keys == sorted(keys) or parts > 1
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("payload", "first", "digest", "n", "run", "nth", "key", "captured", "records")})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in warc.archive_pages(clash).collect()), key=repr) == want(rows)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_warc_files(spark, rows, tmp_path, monkeypatch):
    index = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path))
    files = list(tmp_path.glob("*.warc.gz"))
    whole = {f.name: gzip.decompress(f.read_bytes()) for f in files}
    assert sum(data.count(b"WARC-Record-ID: ") for data in whole.values()) == len(rows)
    for r in index.where("page_id < 30 OR page_id > 199").collect():
        packed = (tmp_path / r.run).read_bytes()[r.offset : r.offset + r.length]
        fields, block = warc.parsed(gzip.decompress(packed))
        head, _, payload = block.partition(b"\r\n\r\n")
        assert fields["warc-type"] == r.record_type and head.startswith(b"HTTP/1.1 200 OK")
        if r.record_type == "response":
            assert hashlib.sha256(payload).hexdigest() == r.payload_digest and len(payload) == r.payload_bytes
        else:
            assert not payload and fields["warc-profile"].endswith("identical-payload-digest") and fields["warc-refers-to"].split(":")[2] == str("" if r.refers_to is None else r.refers_to)


def test_a_large_task_writes_several_archives(spark, rows, tmp_path, monkeypatch):
    batches = warc.captures(spark.createDataFrame(rows, SCHEMA)).withColumn("first", F.lit(None).cast("struct<page_id: bigint, url: string>")).toArrow().to_batches()
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    (made,) = warc._write(batches, f"file://{tmp_path}")
    assert made.num_rows > 3 and sum(made.column("records").to_pylist()) == len(rows)
    back = [r for batch in warc._read([made], f"file://{tmp_path}") for r in batch.to_pylist()]
    assert len(back) == len(rows)
    for run in made.column("archive").to_pylist():
        own = [(r["url_key"], r["captured"], r["offset"]) for r in back if r["run"] == run]
        assert own == sorted(own)


def test_a_damaged_archive_is_not_taken(spark, rows, tmp_path):
    batches = warc.captures(spark.createDataFrame(rows[:5], SCHEMA)).withColumn("first", F.lit(None).cast("struct<page_id: bigint, url: string>")).toArrow().to_batches()
    (made,) = warc._write(batches, f"file://{tmp_path}")
    file = tmp_path / made.column("archive")[0].as_py()
    whole = file.read_bytes()
    file.write_bytes(whole[:-20])
    with pytest.raises(ValueError, match="ends within"):
        list(warc._read([made], f"file://{tmp_path}"))
    file.write_bytes(gzip.compress(gzip.decompress(whole).replace(b"copy", b"COPY", 1).replace(b"<p>0", b"<P>0", 1).replace(b"\xc3\xa9", b"\xc3\xaa", 1).replace(b"short", b"SHORT", 1).replace(b"xxx", b"xXx", 1).replace(b"yyy", b"yYy", 1)))
    with pytest.raises(ValueError):
        list(warc._read([made], f"file://{tmp_path}"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randint(0, 40))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_runs_merge_in_one_order(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "partitions", lambda spark: 6)
    scratch = Scratch(spark, "warc")
    judged = warc.judged(warc.captures(spark.createDataFrame(rows, SCHEMA).repartition(9)), scratch)
    archives = warc.write_archives(judged.repartition(9), f"file://{scratch.root}/files", scratch)
    runs = warc.read_archives(archives, f"file://{scratch.root}/files", scratch)
    assert runs.select("run").distinct().count() > 4
    by_range = warc.merge_runs(runs).select("url_key", "captured", "run", "nth", F.spark_partition_id().alias("p")).collect()
    found = [tuple(r)[:4] for r in sorted(by_range, key=lambda r: r.p)]
    assert found == sorted(found) and len(found) == len(rows)


def test_url_keys():
    assert warc.url_key("https://www.Example.COM:443/A?b#c") == "com,example)/a?b"
    assert warc.url_key("http://user:pw@a.b.org:8080") == "org,b,a:8080)/"
    assert warc.url_key("http://h.org?x=/y") == "org,h)/?x=/y" and warc.url_key(None) == ""

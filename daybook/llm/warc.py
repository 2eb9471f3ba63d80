"""WARC archives of pages: records written by tasks, read back, and indexed by merging sorted runs.

Pages are written as gzip members of a record each, files of a task each; a payload that another page holds too is written once and
revisited by the others. Reading an archive gives its captures, sorted by URL key and timestamp: a run, as long as one archive. The
index is an external merge of all runs: runs are written, dealt into ranges of keys, and a task merges its slices of them by a loser
tree. So captures of an URL stand next to each other in the order of their times, over all ranges.

A task holds a record of an archive and the short rows of its range; the driver reads a count.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, partitions

#: Payloads of so many bytes at least are written once (fixed value of the contract).
LEAST_BYTES = 100
#: Bytes after which a task begins another archive; level of compression; bytes that are read at a time.
ARCHIVE_BYTES, LEVEL, CHUNK = 1 << 30, 3, 1 << 20
#: Pages bear no time: they count as captured so many seconds after this, by their page_id (whole days of a year at most).
SINCE, YEAR = 1704067200, 365 * 86400
#: Fixed values of the WARC format.
VERSION, SAME_PAYLOAD = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RUN = "run string, nth long, url_key binary, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, offset long, length long"


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, captured) of `pages` (page_id, url, html); null html is empty."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    second = SINCE + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(YEAR))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), second.cast("long").alias("captured"))


def copied(rows: DataFrame) -> DataFrame:
    """(payload_digest, first, n): of payloads that several captures have, the first one by page_id and url (nulls last), with how many
    rows are equal to it, and how many have the payload."""
    once = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest", "page_id", "url").agg(F.count("*").alias("equal"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "equal")
    return once.groupBy("payload_digest").agg(F.min(order).alias("first"), F.sum("equal").alias("n")).where("n > 1").withColumnRenamed("payload_digest", "digest")


def judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The captures with `first`, what they revisit (null: a response), and without payload where they do.

    Payloads that very many captures share, more than a share of a task's, are so few that they are broadcast: four times the tasks at
    most. The others meet by a shuffle. Of rows equal to a payload's first, one is the response: they are summed and made anew.
    """
    copies = scratch.table(copied(rows), "copies")
    total, twice = copies.agg(F.sum("n"), F.max("first.equal")).first()
    if total is None:
        return rows.withColumn("first", F.lit(None).cast("struct<page_id: bigint, url: string>"))
    share = -(-total // (4 * partitions(rows.sparkSession)))
    often = F.broadcast(copies.where(F.col("n") > share).select("digest", F.col("first").alias("often")))
    rows = rows.join(often, rows.payload_digest == often.digest, "left").drop("digest")
    key = F.when(F.col("often").isNull() & (F.col("payload_bytes") >= LEAST_BYTES), F.col("payload_digest"))
    rows = rows.withColumn("key", F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    rest = copies.where(F.col("n") <= share)
    rows = rows.join(rest, F.col("key") == F.col("digest"), "left").withColumn("first", F.coalesce("often", "first")).drop("digest", "key", "often", "n")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    target = F.struct(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"))
    columns = [c for c in rows.columns if c not in ("payload", "first")]
    made = lambda df, revisits: df.select(*columns, F.when(~revisits, F.col("payload")).alias("payload"), F.when(revisits, target).alias("first"))
    if twice == 1:
        return made(rows, F.col("first").isNotNull() & ~is_first)
    again = F.col("first").isNotNull() & is_first & (F.col("first.equal") > 1)
    equal = rows.where(again).groupBy(*columns).agg(F.first("payload").alias("payload"), F.first("first").alias("first"))
    equal = equal.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("first.equal"))))
    return made(rows.where(~again), F.col("first").isNotNull() & ~is_first).unionByName(made(equal, F.col("k") > 1))


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    name = hashlib.sha256(f"{url}\n{digest}".encode()).hexdigest()[:16]
    return f"<urn:daybook:{'' if page_id is None else page_id}:{name}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(page_id, url, captured, digest, size, payload, first) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record of `first` (page_id, url)."""
    headers = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    block = "\r\n".join(headers).encode() + END + (payload if first is None else b"")
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, url, digest),
        "WARC-Date": datetime.fromtimestamp(captured, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~|^{}\\\"<>`")
    if first is not None:
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": _record_id(first["page_id"], first["url"], digest)}
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields.items())])
    return head.encode() + END + block + END


def _write(batches, folder: str):
    """Archives of a task's captures: their names carry a random part, so that another attempt's files are never taken for them."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    out, name, size, n = None, "", 0, 0
    names, records = [], []

    def close():
        out.close()
        names.append(name)
        records.append(n)

    for batch in batches:
        for row in batch.to_pylist():
            if out is None or size >= ARCHIVE_BYTES:
                if out is not None:
                    close()
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            made = packer.compress(record(row["page_id"], row["url"], row["captured"], row["payload_digest"], row["payload_bytes"], row["payload"], row["first"])) + packer.flush()
            out.write(made)
            size, n = size + len(made), n + 1
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64())], ["archive", "records"])


def write_archives(rows: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """(archive, records): the archives that the tasks wrote into `folder`. The table tells which attempts count."""
    return scratch.table(rows.mapInArrow(partial(_write, folder=folder), "archive string, records long"), "archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of a stream, one at a time."""
    offset, rest = 0, b""
    while rest or (rest := stream.read(CHUNK)):
        unpacker, parts, length = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError(f"the archive ends within the record at {offset}")
            parts.append(unpacker.decompress(rest))
            length += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        yield offset, length, b"".join(parts)
        offset += length


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by lower-case name, and its block."""
    head, _, rest = data.partition(END)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + len(END) or rest[size:] != END:
        raise ValueError(f"{fields['warc-record-id']}: its block is not {size} bytes long")
    return fields, rest[:size]


def url_key(url: str | None) -> str:
    """An URL as its host's labels from the last to the first, then path and query, in lower case, without scheme, user, www and port 80
    or 443: what archives sort by."""
    if url is None:
        return ""
    scheme, mark, rest = url.partition("://")
    rest = (rest if mark else scheme).split("#", 1)[0]
    cut = re.search("[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    host = host.rpartition("@")[2].lower().removeprefix("www.")
    host, _, port = host.partition(":")
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{'' if port in ('', '80', '443') else ':' + port}){path if path.startswith('/') else '/' + path}".lower()


def _read(batches, folder: str):
    """Each archive's captures, sorted: a run."""
    system, path = fs.FileSystem.from_uri(folder)
    schema = pa.schema([("run", pa.string()), ("nth", pa.int64()), ("url_key", pa.binary()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            run = []
            with system.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                for offset, length, data in members(stream):
                    fields, block = parsed(data)
                    http, _, payload = block.partition(END)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}, {offset}: the payload isn't what its digest tells")
                    size = len(payload) if fields["warc-type"] == "response" else int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    target = fields.get("warc-target-uri")
                    url = None if target is None else unquote(target)
                    refers = fields.get("warc-refers-to")
                    run.append((url_key(url).encode(), fields["warc-date"], offset, _page_of(fields["warc-record-id"]), fields["warc-type"], refers and _page_of(refers), size, digest, url, length))
            run.sort(key=lambda r: r[:3])
            rows = [{"run": archive, "nth": k, "url_key": r[0], "captured": r[1], "page_id": r[3], "record_type": r[4], "refers_to": r[5], "payload_bytes": r[6], "payload_digest": r[7], "url": r[8], "offset": r[2], "length": r[9]} for k, r in enumerate(run)]
            yield from pa.Table.from_pylist(rows, schema).to_batches()


def read_archives(archives: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """RUN rows: what the archives hold, each checked against its digest. An archive is read by one task, a record at a time."""
    count = max(1, archives.count())
    return scratch.table(archives.select("archive").repartition(count).mapInArrow(partial(_read, folder=folder), RUN), "runs")


class LoserTree:
    """The smallest head of k sorted runs, each time after one comparison a level: inner nodes hold the losers of their last matches."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers: list[int | None] = [None] * len(self.runs)
        self.winner: int | None = None
        for leaf in range(len(self.runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        """Up from a leaf: losers stay, winners go on; the first to come to a node waits there."""
        node = (leaf + len(self.runs)) >> 1
        while node:
            other = self.losers[node]
            if other is None:
                self.losers[node] = leaf
                return
            if self._beats(other, leaf):
                self.losers[node], leaf = leaf, other
            node >>= 1
        self.winner = leaf

    def __iter__(self):
        while self.winner is not None and self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf]
            self.heads[leaf] = next(self.runs[leaf], None)
            self._play_again(leaf)

    def _play_again(self, leaf: int) -> None:
        node = (leaf + len(self.runs)) >> 1
        while node:
            other = self.losers[node]
            if self._beats(other, leaf):
                self.losers[node], leaf = leaf, other
            node >>= 1
        self.winner = leaf


def _merged(batches):
    """A range's slices of runs, which come one after the other, each in order, as one sorted row of captures."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found)
    keys, times, runs = (rows.column(c).to_pylist() for c in ("url_key", "captured", "run"))
    begins = [k for k in range(len(runs)) if not k or runs[k] != runs[k - 1]]
    slices = [range(a, b) for a, b in zip(begins, [*begins[1:], len(runs)], strict=True)]
    order = [k for _, _, _, k in LoserTree(((keys[k], times[k], runs[k], k) for k in part) for part in slices)]
    yield from rows.take(pa.array(order)).combine_chunks().to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index: all captures in order of URL key, timestamp, archive and place, in ranges of about equally many; one URL's captures
    may fill many ranges."""
    n = partitions(runs.sparkSession)
    ranges = runs.repartitionByRange(n, "url_key", "captured", "run", "nth").sortWithinPartitions("run", "nth")
    return ranges.mapInArrow(_merged, RUN)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per page: what an index of its archive tells, in the index's order: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, captured, run (the archive), offset, length, url.

    Archives go to `folder`, any place that pyarrow's file systems reach; without one they are removed once they are read back. Null html
    is an empty payload; a null url has none in its record and an empty key. Of equal payloads of at least LEAST_BYTES the one with the
    least page_id is the response (of equal page_ids the least url, nulls last; of equal rows any one), the others revisit it. Repeated
    rows are records each. Other columns are not read; no pages give no archives and no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    into = folder or f"{scratch.root}/files"
    into = into if "://" in into or re.match("[a-z0-9]+:/", into) else f"file://{into}"
    archives = write_archives(judged(captures(pages), scratch), into, scratch)
    runs = read_archives(archives, into, scratch)
    if folder is None:
        scratch.drop("files")
    index = merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.decode("url_key", "UTF-8").alias("url_key"), "captured", "run", "offset", "length", "url")
    return scratch.result(index)


SQL = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS first
  FROM pages
)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN nth > 1 AND strlen(p) >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN nth > 1 AND strlen(p) >= 100 THEN first END AS refers_to
FROM payloads
"""

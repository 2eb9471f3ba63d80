"""Suffix-array dedup: bytes in strings of LENGTH that also start elsewhere, from a common-prefix interval tree.

A sparse suffix array: of any LEAST bytes, the GRAM-byte string with the least hash is an anchor, chosen by the content alone, so
equal strings hold the same anchor at the same offset. Anchors met once can't be repeats. The suffixes at the others are sorted
within their family (equal anchors), the common prefixes of neighbours give the tree of intervals by one stack scan, and in every
interval the diversity of what stands to the left tells how far each occurrence extends with any other. All bytes are compared;
hashes only bring candidates together. A string of LENGTH is found at the anchor of its first LEAST bytes.

The same intervals give passages: strings of LEAST bytes that another row holds too. Over fifty words are that long where a word
has four letters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, buckets_for
from .kernels import U64, Hasher, as_bytes, chunks, pieces, sliding_minimum

LENGTH, LEAST, GRAM = 400, 256, 32
#: Bytes before an anchor that a string whose first LEAST bytes hold it can reach.
BEFORE = LEAST - GRAM
#: Low bits of an anchor's rank that hold its place in a chunk: no Arrow string is longer.
PLACE = 31
#: A family of more places is dealt by content: of LEAST equal bytes x lie before the anchor, so for the STRIDE that x is in its
#: contexts meet those that share all bytes that any such x gives, LEAST - STRIDE + 1 of them.
HOT, STRIDE = 4096, 56
#: Families of so many contexts are compared pair by pair.
FEW = 4


def anchors(texts: list[bytes]):
    """For each chunk: (place in `texts`, offset, hash) of the anchors of every text of LEAST bytes or more."""
    for low, high in chunks(texts):
        buffer = np.frombuffer(b"\n".join(texts[low:high]) + b"\n", np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[low:high]])])
        if len(buffer) <= LEAST:
            continue
        if len(buffer) >> PLACE:
            raise ValueError(f"a text of {len(buffer)} bytes is too long")
        grams = Hasher(buffer).windows(GRAM)
        ranks = grams & ~U64((1 << PLACE) - 1) | np.arange(len(grams), dtype=U64)
        least = sliding_minimum(ranks, BEFORE + 1) & U64((1 << PLACE) - 1)
        at = least[np.flatnonzero(np.diff(least, prepend=least[:1] + U64(1)))].astype(np.int64)
        doc = np.searchsorted(offsets, at, side="right") - 1
        ends = offsets[doc + 1] - 1
        keep = (at + GRAM <= ends) & (ends - offsets[doc] >= LEAST)
        at, doc = at[keep], doc[keep]
        yield low + doc, at - offsets[doc], grams[at].view(np.int64)


def _anchors(batches):
    """The anchors of every text, once for each text that a task meets."""
    met: set[tuple[int, int]] = set()
    for batch in pieces(batches):
        u, v = batch.column("u"), batch.column("v")
        names = list(zip(u.to_pylist(), v.to_pylist(), strict=True))
        texts = [b"" if name in met or met.add(name) else text for name, text in zip(names, as_bytes(batch.column("text")), strict=True)]
        for doc, place, gram in anchors(texts):
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(gram), u.take(take), v.take(take), pa.array(place)], ["gram", "u", "v", "at"])


_MEMBER = np.dtype([("u", np.int64), ("v", np.int64), ("at", np.int64)])


def _keys(gram: int, hot: bool, before: bytes, after: bytes):
    """The families in which a context meets others."""
    if not hot:
        yield gram
        return
    for x in range(0, BEFORE + 1, STRIDE):
        y = max(GRAM, LEAST - x - STRIDE + 1)
        if len(before) >= x and len(after) >= y:
            shared = b"%d %d " % (gram, x) + before[:x] + after[:y]
            yield int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)


def _contexts(batches, buckets: int):
    """Each anchor's bytes from it on, and those before it from near to far, with its places; equal contexts of a batch are one row."""
    rows: dict[tuple[int, bytes, bytes], list] = {}
    held = 0
    for batch in pieces(batches):
        for text, u, v, places in zip(as_bytes(batch.column("text")), batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("places").to_pylist(), strict=True):
            for place in places:
                at, gram = place["at"], place["gram"]
                before, after = text[max(0, at - BEFORE) : at][::-1], text[at : at + LENGTH]
                for key in _keys(gram, place["hot"], before, after):
                    rows.setdefault((key, before, after), []).append((u, v, at))
                held += 1
            if held >= 1 << 14:
                yield _context_batch(rows, buckets)
                rows, held = {}, 0
    if rows:
        yield _context_batch(rows, buckets)


def _context_batch(rows: dict, buckets: int) -> pa.RecordBatch:
    keys = [k[0] for k in rows]
    columns = ([k % buckets for k in keys], keys, [k[1] for k in rows], [k[2] for k in rows], [np.array(m, _MEMBER).tobytes() for m in rows.values()])
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "key", "before", "after", "members"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(prefixes: list[int]):
    """(low, high, length) of every interval of suffixes that share `length` > 0; prefixes[k]: of suffix k with k - 1."""
    stack: list[tuple[int, int]] = []  # (length, low)
    for k in range(1, len(prefixes) + 1):
        now = prefixes[k] if k < len(prefixes) else 0
        low = k - 1
        while stack and stack[-1][0] > now:
            length, low = stack.pop()
            yield low, k - 1, length
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, low))


class _LeftOrder:
    """The contexts' reversed left sides in order, with range minima of their neighbours' common lengths."""

    def __init__(self, befores: list[bytes]):
        order = sorted(range(len(befores)), key=befores.__getitem__)
        self.rank = np.empty(len(befores), np.int64)
        self.rank[order] = np.arange(len(befores))
        shared = [0] + [common(befores[a], befores[b]) for a, b in zip(order, order[1:], strict=False)]
        self.levels = [np.array(shared)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def furthest(self, low: int, high: int, of: np.ndarray) -> np.ndarray:
        """For each of low..high, how many bytes to the left it shares with some other of them that isn't `of` the same."""
        ranks = self.rank[low : high + 1]
        order = np.argsort(ranks)
        ranks, of = ranks[order], of[low : high + 1][order]
        edges = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        run = np.searchsorted(edges, np.arange(len(of)), side="right") - 1
        best = np.zeros(len(of), np.int64)
        for here, there in ((run > 0, edges[run] - 1), (run < len(edges) - 1, np.append(edges[1:], 0)[run])):
            here = np.flatnonzero(here)
            first, last = np.minimum(ranks[here], ranks[there[here]]) + 1, np.maximum(ranks[here], ranks[there[here]]) + 1
            level = np.frexp(last - first)[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                shared = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k))])
                best[here[at]] = np.maximum(best[here[at]], shared)
        out = np.empty(len(of), np.int64)
        out[order] = best
        return out


def family(contexts: list[tuple[bytes, bytes]], copies: list[int], texts: list[int] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For each distinct context (bytes before, reversed; bytes after): how far its repeats of LENGTH reach to either side, and how
    far its matches of LEAST bytes with other texts do. `copies`: places that have it; `texts`: the text of each, or one of its own
    below zero where several have it. Without `texts` each context is taken to be of another text.
    """
    n = len(contexts)
    texts = list(range(n)) if texts is None else texts
    reach = [(len(b), len(a)) if c > 1 and len(a) + len(b) >= LENGTH else (0, 0) for (b, a), c in zip(contexts, copies, strict=True)]
    match = [(len(b), len(a)) if t < 0 and len(a) + len(b) >= LEAST else (0, 0) for (b, a), t in zip(contexts, texts, strict=True)]
    if n <= FEW:
        for i in range(n):
            for j in range(i):
                x, y = common(contexts[i][0], contexts[j][0]), common(contexts[i][1], contexts[j][1])
                for out, fits in ((reach, x + y >= LENGTH), (match, x + y >= LEAST and texts[i] != texts[j])):
                    for k in (i, j) if fits else ():
                        out[k] = (max(out[k][0], x), max(out[k][1], y))
        return reach, match
    texts_ = np.array(texts)
    order = sorted(range(n), key=lambda k: contexts[k][1])
    befores, afters = [contexts[k][0] for k in order], [contexts[k][1] for k in order]
    prefixes = [0] + [common(a, b) for a, b in zip(afters, afters[1:], strict=False)]
    left, single, of = _LeftOrder(befores), np.arange(n), texts_[order]
    out = np.array([reach[k] for k in order])
    shared = np.array([match[k] for k in order])
    for low, high, length in intervals(prefixes):
        if length + BEFORE < LEAST:
            continue
        for most, apart, into in ((LENGTH, single, out), (LEAST, of, shared)):
            if length + BEFORE < most or (apart[low : high + 1] == apart[low]).all():
                continue
            best = left.furthest(low, high, apart)
            at = np.flatnonzero(best + length >= most)
            into[low + at, 0] = np.maximum(into[low + at, 0], best[at])
            into[low + at, 1] = np.maximum(into[low + at, 1], length)
    for k, x, y in zip(order, out.tolist(), shared.tolist(), strict=True):
        reach[k], match[k] = tuple(x), tuple(y)
    return reach, match


SPANS = "u long, v long, start long, end long, passage boolean"


def _families(table: pa.Table) -> pa.Table:
    """Of one bucket of families: the spans that are repeated, and the passages that another text holds."""
    keys = table.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
    before, after, members = (table.column(x).to_pylist() for x in ("before", "after", "members"))
    single: list[tuple[bytes, int, int, bool]] = []
    found: list[np.ndarray] = [np.empty((0, 5), np.int64)]
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        own: dict[tuple[bytes, bytes], bytes] = {}
        for k in order[low:high].tolist():
            context = (before[k], after[k])
            own[context] = own.get(context, b"") + members[k]
        if len(own) == 1 and len(next(iter(own.values()))) == _MEMBER.itemsize:
            continue
        names: dict[bytes, int] = {}
        places, copies, texts = [], [], []
        for k, m in enumerate(own.values()):
            one = len(m) == _MEMBER.itemsize
            p = None if one else np.unique(np.frombuffer(m, _MEMBER))
            same = one or len(np.unique(p[["u", "v"]])) == 1
            places.append(p)
            copies.append(1 if one else len(p))
            texts.append(names.setdefault(m[:16], k) if same else -1 - k)
        for m, p, r, t in zip(own.values(), places, *family(list(own), copies, texts), strict=True):
            for (x, y), passage in ((r, False), (t, True)):
                if y and p is None:
                    single.append((m, x, y, passage))
                elif y:
                    found.append(np.stack([p["u"], p["v"], p["at"] - x, p["at"] + y, np.full(len(p), passage)], 1))
    if single:
        p = np.frombuffer(b"".join(m for m, *_ in single), _MEMBER)
        x, y, passage = (np.array(c, np.int64) for c in zip(*(s[1:] for s in single), strict=True))
        found.append(np.stack([p["u"], p["v"], p["at"] - x, p["at"] + y, passage], 1))
    rows = np.concatenate(found)
    columns = [pa.array(rows[:, k]) for k in range(4)]
    return pa.table([*columns, pa.array(rows[:, 4] == 1)], names=["u", "v", "start", "end", "passage"])


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(text: bytes, spans: list[list[int]], whole_characters: bool = False) -> bytes:
    """What is left without the spans; with whole_characters, bytes of a character that a span only begins in or ends in stay."""
    kept, at = [], 0
    for start, end in spans:
        if whole_characters:
            while start < end and text[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept)


CUT = "u long, v long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept string"


def _cuts(batches, texts: bool):
    """What is cut from each text. With `texts`, passages go too, and what is left of the text is given."""
    for batch in pieces(batches):
        rows: list[list] = [[] for _ in range(6)]
        for text, copies, found in zip(as_bytes(batch.column("text")), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = [(s["start"], s["end"]) for s in found or () if not s["passage"]]
            passages = [(s["start"], s["end"]) for s in found or () if s["passage"]]
            if copies > 1:
                spans += [(0, len(text))] * (len(text) >= LENGTH)
                passages += [(0, len(text))] * (len(text) >= LEAST)
            every, passages, spans = merged(spans + passages), merged(passages), merged(spans)
            kept = cut(text, spans)
            edited = cut(text, every, True).decode() if texts and every else None
            values = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in passages), edited)
            for out, value in zip(rows, values, strict=True):
                out.append(value)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("u"), batch.column("v"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
            ["u", "v", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"],
        )


def _named(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.withColumns({"u": F.xxhash64(text), "v": F.xxhash64(F.lit("v"), text)})


def _cut_texts(named: DataFrame, scratch: Scratch, texts: bool) -> DataFrame:
    """For every distinct text, named by 128 bits, what is cut from it. Copies are read once."""
    buckets = 4 * buckets_for(named)  # contexts are several times the text
    rows = named.select("u", "v", F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.table(rows.mapInArrow(_anchors, "gram long, u long, v long, at long"), "anchors")
    place = F.xxhash64("u", "v", "at")
    often = found.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n")).where("x != y")
    # written, so that the join's sides come straight from shuffles and Spark can split a frequent anchor's partition
    often = scratch.table(often.select("gram", (F.col("n") > HOT).alias("hot")), "often")
    scratch.release()
    # written too: where the contexts are shuffled, neither the anchors nor their shuffles are on disk any more
    places = found.join(often, "gram").groupBy("u", "v").agg(F.collect_set(F.struct("at", "gram", "hot")).alias("places"))
    places = scratch.table(places, "places")
    for name in ("anchors", "often"):
        scratch.drop(name)
    scratch.release()
    once = lambda: rows.groupBy("u", "v").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    contexts = once().join(places, ["u", "v"]).mapInArrow(lambda batches: _contexts(batches, buckets), "bucket int, key long, before binary, after binary, members binary")
    spans = scratch.table(contexts.groupBy("bucket").applyInArrow(_families, SPANS), "spans")
    scratch.drop("places")
    scratch.release()
    spans = spans.groupBy("u", "v").agg(F.collect_set(F.struct("start", "end", "passage")).alias("spans"))
    return once().join(spans, ["u", "v"], "left").mapInArrow(lambda batches: _cuts(batches, texts), CUT)


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what is left, and
    n_passage_bytes, the bytes in strings of LEAST bytes that another row holds too.

    Removed is each byte of a string of LENGTH bytes that also starts elsewhere, in the same or another row, judged on the whole
    input. Null text is empty. Texts under LENGTH bytes keep all. A repeated row counts as another document. Passages change nothing
    of what is removed. Other columns are not read; no documents give no rows.
    """
    scratch = Scratch(documents.sparkSession, "suffix")
    named = _named(documents.select("doc_id", "text"))
    cuts = scratch.result(_cut_texts(named, scratch, False).drop("kept"))
    return named.select("doc_id", "u", "v").join(cuts, ["u", "v"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeated strings of LENGTH bytes and passages cut from `text` (to whole characters), and n_chars counted
    anew where something was cut."""
    scratch = Scratch(documents.sparkSession, "suffix")
    cuts = scratch.result(_cut_texts(_named(documents.select("text")), scratch, True).where("kept IS NOT NULL").select("u", "v", "kept"))
    out = documents.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in documents.columns)))
    out = _named(out.select("__row", F.col("__row.text").alias("text"))).join(cuts, ["u", "v"], "left")
    new = {"text": F.coalesce("kept", "text"), "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("__row.n_chars")) if "n_chars" in documents.columns else None}
    kinds = dict(documents.dtypes)
    return out.select(*(new[c].cast(kinds[c]).alias(c) if c in new else F.col("__row")[c].alias(c) for c in documents.columns))


SQL = r"""
WITH b AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM b WHERE length(h) >= 800)),
again AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
fresh AS (SELECT row, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 400 THEN 0 ELSE 1 END AS f FROM again),
spans AS (SELECT row, min(p) AS a, max(p) + 400 AS z FROM (SELECT row, p, sum(f) OVER (PARTITION BY row ORDER BY p) AS k FROM fresh) GROUP BY row, k),
gaps AS (SELECT row, z AS a, lead(a) OVER (PARTITION BY row ORDER BY a) AS z FROM (SELECT row, a, z FROM spans UNION ALL SELECT row, -1, 0 FROM b)),
kept AS (SELECT g.row, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps g JOIN b ON b.row = g.row GROUP BY 1),
n AS (SELECT row, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY 1),
pw AS (SELECT row, p, md5(substr(h, 2 * p + 1, 512)) AS m FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 255)) AS p FROM b WHERE length(h) >= 512)),
held AS (SELECT row, p FROM (SELECT row, p, min(row) OVER (PARTITION BY m) AS x, max(row) OVER (PARTITION BY m) AS y FROM pw) WHERE x < y),
steps AS (SELECT row, least(256, coalesce(lead(p) OVER (PARTITION BY row ORDER BY p) - p, 256)) AS c FROM held),
passages AS (SELECT row, sum(c) AS bytes FROM steps GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256,
  CAST(coalesce(bytes, 0) AS BIGINT) AS n_passage_bytes
FROM b JOIN kept ON kept.row = b.row LEFT JOIN n ON n.row = b.row LEFT JOIN passages ON passages.row = b.row
"""

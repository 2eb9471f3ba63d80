"""LM scoring: context-tree weighting over bytes, beside a smoothed count of words.

Each byte is eight binary decisions; a decision's context tree looks back DEPTH bytes. Every node has Krichevsky-Trofimov counts,
and the tree weighting mixes the estimates of all depths. A gram is a byte with the DEPTH bytes before it. All training texts' grams
are counted, and meet in buckets by the two bytes before theirs: a bucket holds whole subtrees, so it weighs all its nodes from
depth 2 on. What the nodes above need are sums by one byte of context, at most 2^16 rows. The model grows with the corpus.

Words and grams: the commonest, chosen on a sample for routing only, are known to all tasks (words with their counts, grams with
their probabilities). All others travel packed to their bucket, where each text's share of the sums is found.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, buckets_for
from .kernels import CHUNK, U64, Words, as_bytes, chunks, mix, pieces

#: Bytes of context, and how many of them the nodes have that a bucket doesn't weigh itself.
DEPTH, TOP = 5, 2
#: Words and grams known to all tasks, chosen on one text in SAMPLE: this changes how work is dealt, not a result.
HEAD, GRAMS, SAMPLE = 1 << 16, 1 << 19, 32
#: Places of the table of known grams; a gram whose place is taken is dealt like the others.
SLOTS = 21
FOLDS, HELD = 7, 2
END = b"\xff"
PACK = 1 << 20


def _token_hashes(texts: list[bytes]):
    """For each chunk: its texts' range, hashes of all words, and where each text's begin."""
    for low, high in chunks(texts):
        words = Words(texts[low:high])
        yield low, high, words.hashes(), words.first


def _grams(texts: list[bytes]):
    """In steps of about CHUNK bytes: the texts of some segments, their grams, and where each segment's begin.

    A gram's highest byte is the one before, the next the one before that, and so on; its lowest is the byte itself. Before a text
    stand zeros, after it an end mark. Long texts come in several segments.
    """
    docs, held, parts = [], 0, []

    def made():
        lengths = np.array([len(p) - DEPTH for p in parts])
        buffer = np.frombuffer(b"".join(parts), np.uint8).astype(U64)
        code = buffer[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            code |= buffer[DEPTH - k : len(buffer) - k] << U64(8 * (DEPTH + 1 - k))
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(np.arange(len(parts)) * DEPTH, lengths)
        return np.array(docs), code[at], starts

    for d, text in enumerate(texts):
        text = b"\0" * DEPTH + text + END
        for low in range(0, len(text) - DEPTH, CHUNK):
            docs.append(d)
            parts.append(text[low : low + CHUNK + DEPTH])
            held += len(parts[-1])
            if held >= CHUNK:
                yield made()
                docs, held, parts = [], 0, []
    if parts:
        yield made()


def _lowered(batch) -> list[bytes]:
    return [t.lower() for t in as_bytes(batch.column("text"))]  # bytes.lower() changes A-Z alone


class Tally:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self):
        self.keys, self.counts, self.waiting = np.empty(0, U64), np.empty(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) >= PACK:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.keys, self.counts = total(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
            self.waiting = []


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def total(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = _edges(keys)
    return keys[edges], np.add.reduceat(values[order], edges)


def _sample(batches):
    """Over some training texts: (0, word, n) and (1, gram, n)."""
    words, grams = Tally(), Tally()
    for batch in pieces(batches):
        texts = _lowered(batch)
        for _, _, hashes, _ in _token_hashes(texts):
            words.add(hashes)
        for _, codes, _ in _grams(texts):
            grams.add(codes)
    for kind, tally in enumerate((words, grams)):
        tally.merge()
        for k in range(0, len(tally.keys), PACK):
            keys = pa.array(tally.keys[k : k + PACK].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), keys, pa.array(tally.counts[k : k + PACK])], ["kind", "key", "n"])


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams >> U64(8 * (DEPTH + 1 - TOP))) % U64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int):
    """Each bucket that has rows, with their places."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _packed_grams(grams: np.ndarray, counts: np.ndarray) -> bytes:
    return np.int64(len(grams)).tobytes() + grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].tobytes() + counts.astype(np.int64).tobytes()


def _unpacked_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int(np.frombuffer(blob, np.int64, 1)[0]), DEPTH + 1
    grams = np.zeros((n, 8), np.uint8)
    grams[:, :width] = np.frombuffer(blob, np.uint8, n * width, 8).reshape(n, width)
    return grams.reshape(-1).view("<u8").astype(U64), np.frombuffer(blob[8 + n * width :], np.int64, n)


def _places(head: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(head):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return at, head[at] == hashes


def slots(grams: np.ndarray) -> np.ndarray:
    """A table with each known gram in the place of its hash; the first of several keeps it. Free places are all ones."""
    table = np.full(1 << SLOTS, ~U64(0), U64)
    at = (mix(grams) >> U64(64 - SLOTS)).astype(np.int64)
    _, first = np.unique(at, return_index=True)
    table[at[first]] = grams[first]
    return table


def _slot(table: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (mix(grams) >> U64(64 - SLOTS)).astype(np.int64)
    return at, table[at] == grams


COUNTS = "kind int, key long, n long, bucket int, blob binary"


def _counts(kind: int, keys=(), n=(), buckets=(), blobs=()) -> pa.RecordBatch:
    size = max(len(keys), len(buckets))
    columns = [pa.array(np.full(size, kind, np.int32))]
    for values, type_ in ((keys, pa.int64()), (n, pa.int64()), (buckets, pa.int32()), (blobs, pa.binary())):
        columns.append(pa.array(values, type_) if len(values) else pa.nulls(size, type_))
    return pa.RecordBatch.from_arrays(columns, ["kind", "key", "n", "bucket", "blob"])


def _count(batches, head, buckets: int):
    """Over training texts: (0, place in head, count), (1, bucket, its grams and counts), (2, 0, texts)."""
    known = head.value[0]
    words, grams, n = np.zeros(len(known) + 1, np.int64), Tally(), 0

    def packed():
        grams.merge()
        parts = [(b, _packed_grams(grams.keys[at], grams.counts[at])) for b, at in _by_bucket(_bucket_of(grams.keys, buckets), buckets)]
        if parts:
            yield _counts(1, buckets=[b for b, _ in parts], blobs=[x for _, x in parts])

    for batch in pieces(batches):
        texts = _lowered(batch)
        n += len(texts)
        for _, _, hashes, _ in _token_hashes(texts):
            at, found = _places(known, hashes)
            words += np.bincount(at[found], minlength=len(words))
        for _, codes, _ in _grams(texts):
            grams.add(codes)
        if len(grams.keys) >= 4 * PACK:
            yield from packed()
            grams = Tally()
    yield from packed()
    at = np.flatnonzero(words)
    yield _counts(0, at, words[at])
    yield _counts(2, [0], [n])


def _tails(batches, head, buckets: int):
    """What isn't known to all tasks, packed by bucket: words (buckets from 0), and grams (from `buckets` on), each with the text (by
    place in a list of text ids), count, and whether it trains."""
    known, table = head.value[0], slots(head.value[1])

    def packed(found, ids, held, grams: bool):
        keys, owners, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = _bucket_of(keys, buckets) if grams else ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        for b, at in _by_bucket(bucket, buckets):
            docs, place = np.unique(owners[at], return_inverse=True)
            start = np.array([len(at), len(docs)], np.int64).tobytes()
            yield b + buckets * grams, start + keys[at].tobytes() + place.astype(np.uint32).tobytes() + counts[at].tobytes() + ids[docs].tobytes() + held[docs].astype(np.uint8).tobytes()

    def per_text(keys, doc):
        key, n = np.unique(keys, return_counts=True)
        return key, np.full(len(key), doc, np.int32), n.astype(np.uint32)

    for batch in pieces(batches):
        ids = batch.column("uid").to_numpy()
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        words, grams, texts = [], [], _lowered(batch)
        for low, high, hashes, first in _token_hashes(texts):
            _, found = _places(known, hashes)
            for d in range(high - low):
                own = hashes[first[d] : first[d + 1]][~found[first[d] : first[d + 1]]]
                if len(own):
                    words.append(per_text(own, low + d))
        for docs, codes, starts in _grams(texts):
            rest = ~_slot(table, codes)[1]
            codes, edges = codes[rest], np.append(np.concatenate([[0], np.cumsum(rest)])[starts], rest.sum())
            for d, a, z in zip(docs.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z > a:
                    grams.append(per_text(codes[a:z], d))
        rows = [x for found, which in ((words, False), (grams, True)) if found for x in packed(found, ids, held, which)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _unpacked_tails(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Key, text, count and held_out of packed rows, sorted by key and text."""
    keys, owner, counts, held = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
    for blob in blobs:
        n, docs = np.frombuffer(blob, np.int64, 2)
        keys.append(np.frombuffer(blob, U64, n, 16))
        place = np.frombuffer(blob, np.uint32, n, 16 + 8 * n)
        counts.append(np.frombuffer(blob, np.uint32, n, 16 + 12 * n))
        owner.append(np.frombuffer(blob, np.int64, docs, 16 + 16 * n)[place])
        held.append(np.frombuffer(blob, np.uint8, docs, 16 + 16 * n + 8 * docs)[place])
    keys, owner, counts, held = (np.concatenate(x) for x in (keys, owner, counts, held))
    order = np.lexsort((owner, keys))
    return keys[order], owner[order], counts[order].astype(np.int64), held[order]


SHARES = "group int, blob binary, tokens long, words long, grams binary"


def _shares(uid: np.ndarray, sums: list[np.ndarray], groups: int, tokens: int = 0, words: int = 0, grams: bytes | None = None) -> pa.Table:
    """The texts' sums, packed by group of texts, and a row without group for the rest."""
    names, blobs = [None], [None]
    for g, at in _by_bucket((uid.view(U64) >> U64(32)) * U64(groups) >> U64(32), groups):
        names.append(g)
        blobs.append(uid[at].tobytes() + b"".join(s[at].tobytes() for s in sums))
    rest = [None] * (len(names) - 1)
    columns = [pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array([tokens, *rest], pa.int64()), pa.array([words, *rest], pa.int64()), pa.array([grams, *rest], pa.binary())]
    return pa.table(columns, names=["group", "blob", "tokens", "words", "grams"])


def _first_of_text(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows that repeat a text teach each time, but its sums are taken once."""
    return np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]


def _word_bucket(blobs: list[bytes], groups: int) -> pa.Table:
    """Of one bucket of words: each text's sum of n * log10(c + 1) and of known tokens; all training tokens and words."""
    words, owner, counts, held = _unpacked_tails(blobs)
    edges = _edges(words)
    c = np.add.reduceat(np.where(held == 1, 0, counts), edges)
    own = np.repeat(c, np.diff(np.append(edges, len(words))))
    once = _first_of_text(words, owner)
    uid, place = np.unique(owner[once], return_inverse=True)
    logs = np.bincount(place, counts[once] * np.log10(own[once] + 1.0), len(uid))
    known = np.bincount(place, np.where(own[once] > 0, counts[once], 0), len(uid))
    return _shares(uid, [logs, known, np.zeros(len(uid))], groups, int(c.sum()), int((c > 0).sum()))


def _text_sums(table: pa.Table) -> pa.Table:
    """Of one group of texts: the sums over all buckets."""
    uid, sums = [], []
    for blob in table.column("blob").to_pylist():
        n = len(blob) // 32
        uid.append(np.frombuffer(blob, np.int64, n))
        sums.append(np.frombuffer(blob, np.float64, 3 * n, 8 * n).reshape(3, n))
    found, place = np.unique(np.concatenate(uid), return_inverse=True)
    logs, known, score = (np.bincount(place, x, len(found)) for x in np.concatenate(sums, 1))
    return pa.table({"uid": found, "tail_total": logs, "tail_known": known.astype(np.int64), "tail_score": score})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence; x > 0."""
    back = np.zeros_like(x)
    for k in range(8):
        back += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives any sequence of so many zeros and ones."""
    out = np.zeros(zeros.shape)
    at = (zeros + ones) > 0
    a, b = zeros[at].astype(float), ones[at].astype(float)
    out[at] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _stop(log_here: np.ndarray, log_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior weight of stopping at a node, and the log of its weighted probability."""
    return 1 / (1 + np.exp(np.clip(log_below - log_here, -700, 700))), np.logaddexp(log_here, log_below) - np.log(2)


_LEVELS = np.arange(8, dtype=U64)


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the nodes (1 to 255) of its eight decisions, and the decisions."""
    byte = byte.astype(U64)[..., None]
    return (byte | U64(256)) >> (U64(8) - _LEVELS), (byte >> (U64(7) - _LEVELS)) & U64(1)


class Subtrees:
    """All nodes from depth DEPTH down to TOP that some grams' counts reach.

    A node's key is its context's bytes, the nearest highest, and then the place in the tree of a byte's bits. At each depth: sorted
    keys, estimates, and the posterior weight of stopping there. `top`: keys at depth TOP - 1 with zeros, ones and the sum of the
    logarithms of the weighted probabilities of their children.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        node, bit = _nodes(grams & U64(255))
        keys = ((grams & ~U64(255))[:, None] | node).ravel()
        ones = (bit.astype(np.int64) * counts[:, None]).ravel()
        keys, both = total(keys, np.stack([np.repeat(counts, 8) - ones, ones], 1))
        zeros, ones = both[:, 0], both[:, 1]
        below = np.zeros(len(keys))
        self.depths = []
        for depth in range(DEPTH, TOP - 1, -1):
            here = log_block(zeros, ones)
            stop, weighted = (np.ones(len(keys)), here) if depth == DEPTH else _stop(here, below)
            self.depths.append((keys, _estimate(zeros, ones), stop))
            cut = U64(8 * (DEPTH - depth + 2))  # the byte that is furthest away
            parent = (keys >> cut << cut) | (keys & U64(255))
            order = np.argsort(parent, kind="stable")
            parent = parent[order]
            edges = _edges(parent)
            keys = parent[edges]
            zeros, ones, below = (np.add.reduceat(x[order], edges) if len(edges) else x for x in (zeros, ones, weighted))
        self.top = keys, zeros, ones, below

    def mixed(self, grams: np.ndarray) -> np.ndarray:
        """For every gram and decision: the probability of a one, mixed from depth DEPTH down to TOP."""
        node, _ = _nodes(grams & U64(255))
        out = np.full(node.shape, 0.5)
        for k, (keys, estimate, stop) in enumerate(self.depths):
            if not len(keys):
                continue
            cut = U64(8 * (k + 1))
            wanted = (grams >> cut << cut)[:, None] | node
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            here = keys[at] == wanted
            out = np.where(here, stop[at] * estimate[at] + (1 - stop[at]) * out, 0.5)
        return out


def top_tables(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (byte before, node): what the depths under TOP add to the probability of a one, and the weight they leave to the rest."""
    at = (keys >> U64(8 * DEPTH - 8) & U64(0xFF00) | keys & U64(255)).astype(np.int64)
    z, o, below_ = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
    z[at], o[at], below_[at] = zeros, ones, below
    stop, weighted = _stop(log_block(z, o), below_)
    z0, o0, w0 = (x.reshape(256, 256).sum(0) for x in (z, o, weighted))
    stop0 = np.tile(_stop(log_block(z0, o0), w0)[0], 256)
    return stop0 * np.tile(_estimate(z0, o0), 256) + (1 - stop0) * stop * _estimate(z, o), (1 - stop0) * (1 - stop)


def log10_of(grams: np.ndarray, trees: Subtrees, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of every gram's byte after the bytes before it."""
    node, bit = _nodes(grams & U64(255))
    at = ((grams >> U64(8 * DEPTH))[:, None] << U64(8) | node).astype(np.int64)
    one = top[0][at] + top[1][at] * trees.mixed(grams)
    return np.log10(np.where(bit == 1, one, 1 - one)).sum(1)


TREE = "bucket int, blob binary, key long, zeros long, ones long, below double"


def _merged(table: pa.Table) -> pa.Table:
    """Of one bucket: all its grams and counts in one row, and rows with what the nodes above need."""
    parts = [_unpacked_grams(b) for b in table.column("blob").to_pylist()]
    grams, counts = total(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    keys, zeros, ones, below = Subtrees(grams, counts).top
    first = {"bucket": [table.column("bucket")[0].as_py()], "blob": [_packed_grams(grams, counts)]}
    rest = {"key": keys.view(np.int64), "zeros": zeros, "ones": ones, "below": below}
    names = {"bucket": pa.int32(), "blob": pa.binary(), "key": pa.int64(), "zeros": pa.int64(), "ones": pa.int64(), "below": pa.float64()}
    whole = [pa.table([pa.array(x[n], t) if n in x else pa.nulls(size, t) for n, t in names.items()], names=list(names)) for x, size in ((first, 1), (rest, len(keys)))]
    return pa.concat_tables(whole)


def _score_bucket(table: pa.Table, groups: int, buckets: int, head, top) -> pa.Table:
    """One bucket of words, or of grams: each text's sums, and the probabilities of the known grams that fall into it."""
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
    counted = np.array(table.column("counted").to_pylist(), bool)
    if bucket < buckets:
        return _word_bucket(blobs, groups)
    none = np.empty(0, np.int64)
    grams, counts = _unpacked_grams(blobs[np.flatnonzero(counted)[0]]) if counted.any() else (none.view(U64), none)
    trees = Subtrees(grams, counts)
    known = head.value[1][_bucket_of(head.value[1], buckets) == bucket - buckets]
    keys, owner, n, _ = _unpacked_tails([b for b, c in zip(blobs, counted.tolist(), strict=True) if not c])
    wanted, at = np.unique(np.concatenate([known, keys]), return_inverse=True)
    logs = np.concatenate([log10_of(wanted[k : k + CHUNK // 8], trees, top) for k in range(0, len(wanted), CHUNK // 8)] or [np.empty(0)])
    once = _first_of_text(keys, owner)
    uid, place = np.unique(owner[once], return_inverse=True)
    score = np.bincount(place, n[once] * logs[at[len(known) :][once]], len(uid))
    zero = np.zeros(len(uid))
    return _shares(uid, [zero, zero, score], groups, grams=known.tobytes() + logs[at[: len(known)]].tobytes())


def _head(some: DataFrame, kind: int, most: int) -> np.ndarray:
    rows = some.where(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most)
    keys = rows.select("key").mapInArrow(_as_blobs, "blob binary").toLocalIterator()
    return np.frombuffer(b"".join(r.blob for r in keys), np.int64).view(U64)


def _as_blobs(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("key").to_numpy().tobytes()], pa.binary())], ["blob"])


def lm_score(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is log10 of the model's probability of the text's bytes (A-Z as a-z) and its end; bits_per_byte its code length over the
    bytes and the end. Null texts are empty. A null doc_id trains. Repeated rows each teach, and score alike. Without training texts
    every estimate is a half and every base probability one.
    """
    spark = documents.sparkSession
    scratch, context = Scratch(spark, "lm"), spark.sparkContext
    buckets = buckets_for(documents)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    docs = documents.select("doc_id", "text", held.alias("held_out"), F.xxhash64("doc_id", "text").alias("uid"))
    training = docs.where("NOT held_out").select("text", "uid")
    some = scratch.table(training.where(F.pmod("uid", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sample, "kind int, key long, n long"), "sample")
    head = context.broadcast((np.sort(_head(some, 0, HEAD)), _head(some, 1, GRAMS)))

    counted = scratch.table(training.select("text").mapInArrow(partial(_count, head=head, buckets=buckets), COUNTS), "counts")
    tree = scratch.table(counted.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(_merged, TREE), "tree")
    above = tree.where("blob IS NULL").groupBy("key").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below"))).collect()  # 2^16 rows at most
    columns = [np.array([r[k] for r in above], t) for k, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
    top = top_tables(columns[0].view(U64), *columns[1:])
    head_counts = np.zeros(len(head.value[0]) + 1, np.int64)
    texts = 0
    for row in counted.where("kind <> 1").groupBy("kind", "key").agg(F.sum("n").alias("n")).toLocalIterator():
        if row.kind == 0:
            head_counts[row.key] = row.n
        else:
            texts = row.n

    packed = docs.mapInArrow(partial(_tails, head=head, buckets=buckets), "bucket int, blob binary").withColumn("counted", F.lit(False))
    merged = tree.where("blob IS NOT NULL").select((F.col("bucket") + buckets).alias("bucket"), "blob", F.lit(True).alias("counted"))
    scoring = partial(_score_bucket, groups=buckets, buckets=buckets, head=head, top=top)
    tails = scratch.table(packed.union(merged).groupBy("bucket").applyInArrow(lambda bucket: scoring(bucket), SHARES), "tails")
    rest = tails.agg(F.sum("tokens"), F.sum("words")).first()
    train = int(head_counts.sum()) + texts + int(rest[0] or 0)
    distinct = int((head_counts > 0).sum()) + int(texts > 0) + int(rest[1] or 0)
    shares = tails.where("group IS NOT NULL").select("group", "blob").groupBy("group").applyInArrow(_text_sums, "uid long, tail_total double, tail_known long, tail_score double")
    table = slots(head.value[1])
    values = np.zeros(len(table), np.float32)
    for row in tails.where("grams IS NOT NULL").select("grams").toLocalIterator():
        n = len(row.grams) // 16
        at, here = _slot(table, np.frombuffer(row.grams, U64, n))
        values[at[here]] = np.frombuffer(row.grams, np.float64, n, 8 * n)[here]
    known_grams = context.broadcast((table, values))
    words_known = head.value[0]

    def score(batches):
        (table, values), logs = known_grams.value, np.log10(head_counts + 1.0)
        for batch in pieces(batches):
            texts_ = _lowered(batch)
            n, known, total_, model = np.zeros(len(texts_), np.int64), np.zeros(len(texts_), np.int64), np.zeros(len(texts_)), np.zeros(len(texts_))
            for low, high, hashes, first in _token_hashes(texts_):
                at, found = _places(words_known, hashes)
                n[low:high] = np.diff(first)
                for out, value in ((total_, np.where(found, logs[at], 0.0)), (known, found & (head_counts[at] > 0))):
                    sums = np.concatenate([[0], np.cumsum(value)])
                    out[low:high] = sums[first[1:]] - sums[first[:-1]]
            for docs_, codes, starts in _grams(texts_):
                at, here = _slot(table, codes)
                np.add.at(model, docs_, np.add.reduceat(np.where(here, values[at], np.float32(0)).astype(np.float64), starts))
            size = pa.array([len(t) + 1 for t in texts_], pa.int64())
            columns = [batch.column("doc_id"), batch.column("uid"), batch.column("held_out"), *map(pa.array, (n, known, total_, model)), size]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "held_out", "words", "known", "total", "model", "size"])

    scored = docs.mapInArrow(score, "doc_id long, uid long, held_out boolean, words long, known long, total double, model double, size long")
    each = scored.join(shares, "uid", "left").withColumn("n_tokens", F.col("words") + 1).withColumn("score", F.col("model") + F.coalesce("tail_score", F.lit(0.0)))
    end = float(np.log10(texts + 1.0))
    base = F.col("total") + F.coalesce("tail_total", F.lit(0.0)) + end - F.col("n_tokens") * float(np.log10(train + distinct + 1.0))
    return scratch.result(
        each.select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(texts > 0)).alias("n_known"),
            F.lit(train).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            "score",
            (-F.col("score") * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
        )
    )


#: The base columns, which SQL can express; the remainder of a crc32 is worked out bit by bit.
SQL_BASE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w,
    coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: xor((CASE WHEN x < 0 THEN a ELSE xor(a, x) END) >> 1, CASE WHEN (CASE WHEN x < 0 THEN a ELSE xor(a, x) END) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 7 = 2, false) AS held_out
  FROM documents
), t AS (SELECT row, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT row, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base FROM t LEFT JOIN c USING (token), n GROUP BY 1)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 6) AS base_score FROM d JOIN s ON s.row = d.row, n
"""

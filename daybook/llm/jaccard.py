"""N-gram Jaccard join by PartEnum signatures, exact at a similarity of 3/4, with connected components.

Sets A and B of distinct shingles are similar if they differ in at most (|A| + |B|) / 7 shingles. Sizes are dealt into bands; a set
signs its own band, and the next one if a partner may lie there. In a band of sizes up to r similar sets differ in at most
k = 2r / 7 shingles. The shingle domain is dealt into 3 (k + 1) parts, and each part's content gives a signature. At most k parts
differ, so of any k + 1 signatures of a set a similar one has at least one; and if all sets keep their first k + 1 in one and the
same order, they share one of those. The order puts parts that hold frequent shingles alone last, so a passage that many documents
hold brings hardly any set into a large group. Any order gives the same links.

Sets of up to SINGLE shingles take each shingle as a part. For larger ones a similar pair would be missed only if every shared
shingle fell into a part with a differing one: three shared ones for each differing one, among over 50 parts.

Equal sets are one class. Signatures travel packed, and meet in buckets. Groups of up to SMALL classes give their pairs. Larger
ones first give a star around their least class. Then, where a group still holds several components, its classes try the ones of
other components that sizes and parity sketches don't rule out (a sketch's bits that differ are at most the shingles that differ):
all of them where they are few, else each class's nearest, in rounds; a last round tries all that is left. A family of near copies
has many groups of nearly the same classes: groups with one least class are tried together, so that a pair is tried once for all of
them. No class leaves a group for the group's size: very large ones are dealt into blocks, and the last round takes all pairs of
blocks. Every pair is verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, buckets_for
from .graph import components
from .kernels import U64, Words, as_bytes, chunks, mix, pieces, shingles

#: A group of classes with one signature gives all its pairs up to this size: a constant number for each member.
SMALL = 8
#: Larger groups are dealt into blocks of about so many classes: the rounds look within each block, the last one takes every
#: pair of blocks, each in a task of its own.
BLOCK = 2048
#: Other components that a class tries in a round, the nearest first. A group with no more pairs than classes tries all of them.
TRIES = 2
#: A class tries its nearest in one of so many groups that are tried alone, picked by hash: large families share many groups.
ACTIVE = 4
#: Groups with one least class are tried together if all their classes are at most so many times the largest one's.
ALIKE = 2
#: The rounds end when under one in FEW of the pairs tried is a link; the last round tries what is left.
FEW = 50
#: A side of at most so many rows (24 bytes each) may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Shingles known as frequent, counted on one text in SAMPLE, and the count from which a signature skips the buckets: this changes
#: how work is dealt, never a result.
FREQUENT, SAMPLE, HEAVY = 1 << 17, 4, 64
#: Signatures held at a time, and shingles that are signed at a time.
PACK, STEP = 1 << 19, 1 << 16
#: Sets of up to so many shingles have each shingle as a part.
SINGLE = 64

BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(max(BOUNDS[-1] + 1, BOUNDS[-1] * 8 // 5))


def plan(n: int) -> list[tuple[int, int, int]]:
    """For a set of n shingles: (band, parts, most differing shingles) of each band it signs."""
    out, band = [], bisect_right(BOUNDS, n) - 1
    first = band
    while band == first or 4 * n >= 3 * BOUNDS[band]:
        most = BOUNDS[band + 1] - 1
        differ = (n + min(most, 4 * n // 3)) // 7
        if differ:  # otherwise only equal sets are similar
            out.append((band, (1 << 32) - 1 if most <= SINGLE else 3 * (2 * most // 7 + 1), differ))
        band += 1
    return out


def signatures(flat: np.ndarray, sizes: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, count) of some sets of distinct 64-bit shingles, one after another in `flat`.

    `often` are the frequent shingles, sorted, and `counts` how often they were seen. A signature counts as its rarest shingle.
    """
    jobs = [(d, *job) for d, n in enumerate(sizes.tolist()) if n for job in plan(n)]
    if not jobs:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64)
    seen = np.zeros(len(flat), np.int64)
    if len(often):
        place = np.minimum(np.searchsorted(often, flat), len(often) - 1)
        seen = np.where(often[place] == flat, counts[place], 0)
    owner, band, parts, differ = (np.array(x, np.int64) for x in zip(*jobs, strict=True))
    tag = mix(band.astype(U64) + U64(0x9E3779B97F4A7C15))
    starts, lengths = (np.cumsum(sizes) - sizes)[owner], sizes[owner]
    job = np.repeat(np.arange(len(jobs)), lengths)
    at = np.arange(len(job)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[job]
    mixed = mix(flat[at] ^ tag[job])
    key = job.astype(U64) << U64(32) | (mixed >> U64(32)) * parts.astype(U64)[job] >> U64(32)
    order = np.argsort(key)
    key = key[order]
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] ^ U64(1)))
    job = (key[edges] >> U64(32)).astype(np.int64)
    signs = mix(np.add.reduceat(mixed[order], edges) ^ mix((key[edges] & U64(0xFFFFFFFF)) + tag[job]))
    seen = np.minimum.reduceat(seen[at[order]], edges)
    order = np.lexsort((np.minimum(seen, 0xFFFF).astype(U64) << U64(48) | signs >> U64(16), job))
    rank = np.arange(len(job)) - np.searchsorted(job, job)  # the order keeps the jobs in theirs
    kept = order[rank <= differ[job]]
    return owner[job[kept]], signs[kept], seen[kept]


def parity(elements: np.ndarray) -> bytes:
    """One bit for every residue of the shingles: whether an odd number has it. Halves xored give the sketch of half the size."""
    bits = max(64, 1 << (2 * max(len(elements), 1) - 1).bit_length())
    counts = np.bincount((elements & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def fold(sketch: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(sketch, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def sets(texts: list[bytes]):
    """The distinct shingles of each text, sorted; A-Z count as a-z."""
    for low, high in chunks(texts):
        words = Words([t.lower() for t in texts[low:high]])
        hashes = words.hashes()
        for d in range(high - low):
            yield np.unique(shingles(hashes[words.first[d] : words.first[d + 1]]))


def identities(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    sizes = np.array([len(e) for e in found], np.int64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(np.concatenate([*found, np.empty(0, U64)]) ^ U64(salt)), dtype=U64)])
        ends = np.cumsum(sizes)
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


PACKED = "bucket int, kind int, blob binary, doc_id long, text_hash long, n long, c1 long, c2 long, parity binary, a long, b long"
FOUND = "kind int, doc_id long, text_hash long, n long, c1 long, c2 long, parity binary, a long, b long"


def _batch(fields: dict, names: list[str], kinds: list[pa.DataType], n: int) -> pa.RecordBatch:
    arrays = [pa.array(fields[x], k) if x in fields else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


_KINDS = {"bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary(), "parity": pa.binary()}
_packed = [x.split()[0] for x in PACKED.split(", ")]
_found = [x.split()[0] for x in FOUND.split(", ")]
_packed_kinds = [_KINDS.get(x, pa.int64()) for x in _packed]
_found_kinds = [_KINDS.get(x, pa.int64()) for x in _found]


def _pack(buckets: int, signs: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: 40 bits of every signature, and the classes with how many of them each has."""
    bucket = (signs >> U64(40)) % U64(buckets)
    by = np.lexsort((owners, bucket))
    signs, owner, bucket = signs[by] & U64((1 << 40) - 1), owners[by], bucket[by]
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + U64(1)))
    ids, blobs = [], []
    for low, high in zip(edges, [*edges[1:], len(bucket)], strict=True):
        own, s = owner[low:high], signs[low:high]
        runs = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
        counts = np.diff(np.append(runs, len(own))).astype(np.uint32)
        head = np.array([len(s), len(runs)], np.int64).tobytes()
        blobs.append(head + s.astype(np.uint32).tobytes() + (s >> U64(32)).astype(np.uint8).tobytes() + own[runs].tobytes() + counts.tobytes())
        ids.append(int(bucket[low]))
    return _batch({"bucket": ids, "kind": [1] * len(ids), "blob": blobs}, _packed, _packed_kinds, len(ids))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, runs = np.frombuffer(blob, np.int64, 2)
    low = np.frombuffer(blob, np.uint32, n, 16)
    high = np.frombuffer(blob, np.uint8, n, 16 + 4 * n)
    own = np.frombuffer(blob, np.int64, runs, 16 + 5 * n)
    counts = np.frombuffer(blob, np.uint32, runs, 16 + 5 * n + 8 * runs)
    return low.astype(U64) | high.astype(U64) << U64(32), np.repeat(own, counts)


def _steps(found: list[np.ndarray]):
    """The sets in steps of about STEP shingles: from, to, and those between one after another with their sizes."""
    low = held = 0
    for k, elements in enumerate(found, 1):
        held += len(elements)
        if held >= STEP or k == len(found):
            yield low, k, np.concatenate(found[low:k]), np.array([len(e) for e in found[low:k]], np.int64)
            low, held = k, 0


def _names(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    c1, c2 = identities(found)
    return c1, c2, list(zip(c1.tolist(), c2.tolist(), strict=True))


def _seen_twice(batches):
    """Shingles that two classes of a task's texts have, with how many do."""
    met: set[tuple[int, int]] = set()
    held: list[np.ndarray] = []

    def counted():
        shingle, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    for batch in pieces(batches):
        found = list(sets(as_bytes(batch.column("text"))))
        held += [e for e, name in zip(found, _names(found)[2], strict=True) if name not in met and not met.add(name)]
        if sum(map(len, held)) >= PACK:
            yield counted()
            held = []
    if held:
        yield counted()


def _sign(batches, buckets: int, frequent):
    """Rows of kind 0 for documents; of kind 1 for packed signatures, once for each class that a task meets; of kind 2 for
    frequent signatures (a) and the class that has them (b)."""
    often, counts = frequent.value
    met: set[tuple[int, int]] = set()
    signs, owners, held = [], [], 0
    for batch in pieces(batches):
        found = list(sets(as_bytes(batch.column("text"))))
        c1, c2, names = _names(found)
        new = [k for k in range(len(found)) if len(found[k]) and names[k] not in met and not met.add(names[k])]
        classes = c1[np.array(new, np.int64)]
        for low, high, flat, sizes in _steps([found[k] for k in new]):
            owner, sign, seen = signatures(flat, sizes, often, counts)
            owner, heavy = classes[low:high][owner], seen >= HEAVY
            signs.append(sign[~heavy])
            owners.append(owner[~heavy])
            held += len(signs[-1])
            if heavy.any():
                where = (mix(owner[heavy].view(U64)) % U64(buckets)).astype(np.int32)
                yield _batch({"bucket": where, "kind": np.full(len(where), 2, np.int32), "a": sign[heavy].view(np.int64), "b": owner[heavy]}, _packed, _packed_kinds, len(where))
        if held >= PACK:
            yield _pack(buckets, np.concatenate(signs), np.concatenate(owners))
            signs, owners, held = [], [], 0
        n, doc, fresh = len(found), batch.column("doc_id"), set(new)
        where = mix(np.array([0 if x is None else x for x in doc.to_pylist()], np.int64).view(U64) + np.arange(n, dtype=U64)) % U64(buckets)
        rows = {"n": [len(e) for e in found], "c1": c1, "c2": c2, "parity": [parity(found[k]) if k in fresh else None for k in range(n)]}
        yield _batch({"bucket": where.astype(np.int32), "kind": [0] * n, "doc_id": doc, "text_hash": batch.column("text_hash")} | rows, _packed, _packed_kinds, n)
    if held:
        yield _pack(buckets, np.concatenate(signs), np.concatenate(owners))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _group(table: pa.Table) -> pa.Table:
    """One bucket: rows of documents and frequent signatures pass; signatures give pairs (kind 1), and the members of larger
    groups (kind 2)."""
    kinds, bucket = table.column("kind").to_numpy(), table.column("bucket")[0].as_py()
    rows = table.filter(pa.array(kinds != 1))
    out = [pa.table([rows.column(x).combine_chunks() for x in _found], names=_found)]
    blobs = table.column("blob").filter(pa.array(kinds == 1)).to_pylist()
    if blobs:
        parts = [_unpack(b) for b in blobs]
        sign, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(sign, kind="stable")
        sign, own = sign[order], own[order]
        same = sign[1:] == sign[:-1]
        many = np.zeros(len(sign), bool)
        many[1:] |= same
        many[:-1] |= same
        sign, own = _distinct(sign[many], own[many])
        edges = np.flatnonzero(np.diff(sign, prepend=sign[:1] + U64(1)))
        size = np.diff(np.append(edges, len(sign)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in range(2, SMALL + 1):
            members = own[edges[size == m][:, None] + np.arange(m)]
            one, two = np.triu_indices(m, 1)
            a.append(members[:, one].ravel())
            b.append(members[:, two].ravel())
        large = np.repeat(size > SMALL, size)
        a, b = _distinct(np.concatenate(a), np.concatenate(b))
        named = sign[large] | U64(bucket) << U64(40)
        for kind, x, y in ((1, a, b), (2, named.view(np.int64), own[large])):
            out.append(pa.Table.from_batches([_batch({"kind": np.full(len(x), kind, np.int32), "a": x, "b": y}, _found, _found_kinds, len(x))]))
    return pa.concat_tables(out)


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def _possible(batches):
    """Pairs that sizes and sketches don't rule out."""
    for batch in batches:
        n, m = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
        keep = _near(n, m)
        pa_, pb = batch.column("parity_a"), batch.column("parity_b")
        for k in np.flatnonzero(keep):
            x, y = pa_[k].as_py(), pb[k].as_py()
            size = min(len(x), len(y))
            keep[k] = 7 * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= n[k] + m[k]
        yield batch.filter(pa.array(keep)).select(["a", "b"])


TRIED = "task long, a struct<c1:bigint,c2:bigint>, b struct<c1:bigint,c2:bigint>"


def _held(signs: pa.ListArray) -> tuple[int, np.ndarray]:
    """How many signatures there are, and a bit for each that a class has."""
    sizes = np.diff(signs.offsets.to_numpy())
    known, place = np.unique(signs.flatten().to_numpy(), return_inverse=True)
    bits = np.zeros((len(sizes), (len(known) + 7) // 8), np.uint8)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), place >> 3), (1 << (place & 7)).astype(np.uint8))
    return len(known), bits


def _across(table: pa.Table, every: bool) -> pa.Table:
    """Of large groups that are tried together, or of a pair of their blocks, pairs that share a group and are of different
    components, and that sizes and sketches don't rule out: all if `every` is asked for or they are few, else each class's nearest.

    Groups with pairs left give a row without classes too: the others needn't be tried again. So do those of more than one block,
    since pairs across blocks are only tried in the last round.
    """
    block, other_block = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    several, side = table.column("blocks")[0].as_py() > 1, table.column("block").to_numpy()
    n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
    sketches = table.column("parity").to_pylist()
    task, node = table.column("task")[0].as_py(), table.column("node").combine_chunks()
    signs, groups = _held(table.column("signs").combine_chunks())
    order = np.argsort(n, kind="stable")
    n, label, node, side, groups = n[order], label[order], node.take(pa.array(order)), side[order], groups[order]
    sketches = [sketches[k] for k in order]
    one, two, all_ = [], [], True
    close: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(n))]  # by label, the nearest class and its share
    low = 0
    while low < len(n):  # blocks of one sketch size, against all that are as large and near enough
        size = len(sketches[low])
        high = low
        while high < len(n) and len(sketches[high]) == size and high - low < 1024:
            high += 1
        end = int(np.searchsorted(n, n[high - 1] * 4 // 3 + 1, side="right"))
        own = np.stack([fold(s, size) for s in sketches[low:high]])
        for k in range(low, end, 1024):
            top = min(k + 1024, end)
            other = np.stack([fold(s, size) for s in sketches[k:top]])
            for i in range(low, high):
                j = np.arange(max(k, i + 1), top)
                j = j[(label[j] != label[i]) & _near(n[j], n[i])]
                if block != other_block:
                    j = j[side[j] != side[i]]
                if not len(j):
                    continue
                bits = np.bitwise_count(own[i - low] ^ other[j - k]).sum(1, dtype=np.int64)
                near = (7 * bits <= n[j] + n[i]) & ((groups[j] & groups[i]).any(1) if signs > 1 else True)
                j, share = j[near], (bits / (n[j] + n[i]))[near]
                if all_:
                    one.extend([i] * len(j))
                    two.extend(j.tolist())
                    all_ = every or len(one) <= len(n)
                if not every:
                    first = np.argsort(share, kind="stable")[: 4 * TRIES]
                    for x, part in zip(j[first].tolist(), share[first].tolist(), strict=True):
                        for here, there in ((i, x), (x, i)):
                            if part < close[here].get(label[there], (np.inf, 0))[0]:
                                close[here][label[there]] = (part, there)
        low = high
    if not all_:
        active = np.arange(len(n))
        if signs == 1:
            active = np.flatnonzero(mix(node.field("c1").to_numpy().view(U64) ^ U64(task & (1 << 64) - 1)) % U64(ACTIVE) == 0)
        nearest = [(i, x) for i in active.tolist() for _, x in sorted(close[i].values())[:TRIES]]
        one, two = [x[0] for x in nearest], [x[1] for x in nearest]
    mark = [None] * (not all_ or (several and not every))
    one, two = pa.array([*one, *mark], pa.int64()), pa.array([*two, *mark], pa.int64())
    return pa.table({"task": pa.array([task] * len(one), pa.int64()), "a": node.take(one), "b": node.take(two)})


def _trying(every: bool):
    return lambda group: _across(group, every)


def _dealt(rows: DataFrame, every: bool) -> DataFrame:
    """Members (with task, blocks, block) as the calls (task, i, j) want them: each block alone, or with every other too."""
    if not every:
        return rows.withColumns({"i": F.col("block"), "j": F.col("block")})
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def _elements(batches):
    for batch in pieces(batches):
        found = list(sets(as_bytes(batch.column("text"))))
        node = pa.StructArray.from_arrays([pa.array(x) for x in identities(found)], ["c1", "c2"])
        yield pa.RecordBatch.from_arrays([node, pa.array([e.tobytes() for e in found], pa.binary())], ["node", "elements"])


def _verified(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


NODE = "struct<c1:bigint,c2:bigint>"


def _together(now: DataFrame, apart: DataFrame) -> DataFrame:
    """(sign, task, size): the large groups that are tried together, named by one of them, and how many classes they have."""
    every = now.select("least", "node").distinct().groupBy("least").agg(F.count("*").alias("size"))
    alike = apart.groupBy("least").agg(F.max("m").alias("most"), F.min("sign").alias("task")).join(every, "least").where(F.col("size") <= ALIKE * F.col("most"))
    return apart.join(alike, "least", "left").select("sign", F.coalesce("task", "sign").alias("task"), F.coalesce("size", "m").alias("size"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class _Verifier:
    """Verifies pairs on whole sets. A class's set is made once, from the text of the document that stands for it."""

    def __init__(self, documents: DataFrame, classes: DataFrame, scratch: Scratch):
        self.documents, self.classes, self.scratch, self.sets, self.round = documents, classes, scratch, None, 0

    def links(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), a written table."""
        self.round += 1
        few = pairs.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        wanted = self.classes.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
        if self.sets is not None:
            wanted = wanted.join(_small(self.sets.select("node")), "node", "left_anti")
        wanted = self.scratch.table(wanted.select("rep"), f"wanted-{self.round}")
        if not wanted.isEmpty():
            same = self.documents.doc_id.eqNullSafe(wanted["rep.doc_id"]) & (self.documents.text_hash == wanted["rep.text_hash"])
            texts = self.documents.join(_small(wanted), same, "left_semi").select("text")
            more = self.scratch.table(texts.mapInArrow(_elements, f"node {NODE}, elements binary").dropDuplicates(["node"]), f"sets-{self.round}")
            self.sets = more if self.sets is None else self.sets.union(more)
        left = self.sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        whole = left.join(F.broadcast(pairs) if few else pairs, "a").join(right, "b").select("a", "b", "x", "y")
        return self.scratch.table(whole.mapInArrow(_verified, f"a {NODE}, b {NODE}"), f"links-{self.round}")


def _frequent(documents: DataFrame):
    """The shingles that a part of the texts shows to be frequent: at most FREQUENT numbers and their counts, for all tasks."""
    some = documents.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_seen_twice, "shingle long, n long")
    most = some.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    rows = [(r.shingle, r.n) for r in most.toLocalIterator()]
    shingle, n = np.array([r[0] for r in rows], np.int64).view(U64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(shingle)
    return documents.sparkSession.sparkContext.broadcast((shingle[order], n[order]))


def _linked(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, text_hash, n, component_id, kept (the document that stands for the component), n_links."""
    buckets = buckets_for(documents)
    documents = documents.select("doc_id", "text").withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    packed = documents.mapInArrow(partial(_sign, buckets=buckets, frequent=_frequent(documents)), PACKED)
    found = scratch.table(packed.groupBy("bucket").applyInArrow(_group, FOUND), "found")
    rows = found.where("kind = 0").select("doc_id", "text_hash", "n", "c1", "c2", "parity")
    node = F.struct("c1", "c2").alias("node")
    classes = (
        rows.where("n > 0")
        .groupBy("c1", "c2", "n")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), F.max("parity").alias("parity"))
    )
    classes = scratch.table(classes.select(node, "c1", "n", "rep", "parity"), "classes")
    side = lambda x: classes.select(F.col("c1").alias(f"c_{x}"), F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    members = found.where("kind = 2").select(F.col("a").alias("sign"), F.col("b").alias("c1"))
    groups = scratch.table(members.groupBy("sign").agg(F.count("*").alias("m"), F.min("c1").alias("c_a")).where("m > 1"), "groups")
    groups_ = _small(groups)
    stars = members.join(groups_.select("sign", "c_a"), "sign").where("c1 <> c_a").select("c_a", F.col("c1").alias("c_b"))
    pairs = found.where("kind = 1").select(F.col("a").alias("c_a"), F.col("b").alias("c_b")).union(stars).distinct()
    pairs = scratch.table(pairs, "candidates")
    pairs = side("a").join(_small(pairs), "c_a").join(side("b"), "c_b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    pairs = scratch.table(pairs.mapInArrow(_possible, f"a {NODE}, b {NODE}"), "pairs")
    verifier = _Verifier(documents, classes, scratch)
    links = pairs if pairs.isEmpty() else verifier.links(pairs)
    labels = scratch.table(components(links, scratch, "star"), "labels-0")

    if not groups.isEmpty():
        def labelled(rows: DataFrame) -> DataFrame:
            named = rows.join(_small(labels).withColumn("label", F.xxhash64("label")), "node", "left")
            return named.withColumn("label", F.coalesce("label", F.xxhash64("node")))

        large = classes.select("c1", "node").join(_small(scratch.table(members, "members")), "c1").join(groups_.select("sign"), "sign")
        large = scratch.table(labelled(large.select("sign", "node")), "large")
        apart = large.groupBy("sign").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node.c1").alias("least"), F.count("*").alias("m"))
        apart = scratch.table(apart.where("x != y").select("sign", "least", "m"), "apart")
        large = large.select("sign", "node").join(_small(apart.select("sign", "least")), "sign")
        tasks = _small(scratch.table(_together(large, apart), "tasks"))
        met = large.join(tasks, "sign").groupBy("task", "node").agg(F.first("size").alias("size"), F.collect_list("sign").alias("signs"))
        blocks = F.ceil(F.col("size") / BLOCK)
        live = scratch.table(met.select("task", "node", "signs", blocks.alias("blocks"), F.pmod(F.col("node.c1"), blocks).alias("block")), "live")
        k, every = 0, False
        while not live.isEmpty():
            k += 1
            now = scratch.table(labelled(live), f"now-{k}")
            apart = scratch.table(now.groupBy("task").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("task"), f"apart-{k}")
            if apart.isEmpty():
                break
            facts = classes.select("node", "n", "parity").join(_small(now.join(_small(apart), "task", "left_semi")), "node")
            found_ = scratch.table(_dealt(facts, every).groupBy("task", "i", "j").applyInArrow(_trying(every), TRIED), f"trying-{k}")
            left = scratch.table(found_.where("a IS NULL").select("task").distinct(), f"left-{k}")
            live = scratch.table(live.join(_small(left), "task", "left_semi"), f"live-{k}")
            tried = scratch.table(found_.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"tried-{k}")
            more = tried if tried.isEmpty() else verifier.links(tried)
            joined = more.count()
            if joined:
                links = links.union(more)
                labels = scratch.table(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b")), scratch, f"round-{k}"), f"labels-{k}")
            if every:
                break
            every = FEW * joined <= tried.count()  # the rounds only spare the last one work: it tries all that is left
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = scratch.table(links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links")), "degree")
    placed = classes.select("node", "rep").join(_small(labels), "node", "left").join(_small(degree), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy("label").agg(F.min("rep.doc_id").alias("component_id"), F.min("rep").alias("kept"))
    placed = placed.join(least, "label").select(F.col("node.c1").alias("c1"), F.col("node.c2").alias("c2"), "component_id", "kept", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    filled = rows.where("n > 0").select("doc_id", "text_hash", "n", "c1", "c2").join(placed, ["c1", "c2"])
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    empty = rows.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), own.alias("kept"), F.lit(0).cast("long").alias("n_links"))
    columns = ("doc_id", "text_hash", "n", "component_id", "kept", "n_links")
    return filled.select(*columns).union(empty.select(*columns))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), n_links.

    n_links counts the verified links of a document's class to classes of other sets. Inside families of over SMALL classes it is
    a lower bound: members already in one component aren't compared again. Null, empty and wordless texts have an empty set, link
    with nothing, and are their own component. Repeated rows and copies are one class and so one component. A component whose
    documents all lack a doc_id has none either. Other columns are not read; no documents give no rows.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    return scratch.result(_linked(documents, scratch).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """Of each component one document, unchanged: the one with the least doc_id (null ones last), then the least hash of its text.

    Documents are told apart by doc_id and text, so unlike texts under one doc_id are judged each by itself. Of rows that repeat
    both, one stays, the one with the least hash of all columns. Every empty or wordless text is a component of its own.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    linked = _linked(documents, scratch)
    own = (F.col("kept.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("kept.text_hash") == F.col("text_hash"))
    told = scratch.result(linked.groupBy("doc_id", "text_hash").agg(F.max(own).alias("stays"), F.count("*").alias("times")))
    hash_ = F.coalesce(F.xxhash64("text"), F.lit(0))
    out = documents.withColumns({"__id": F.col("doc_id"), "__hash": hash_})

    def those(condition: str) -> DataFrame:
        return told.where(condition).select(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__as"))

    def same(side: DataFrame):
        return out["__id"].eqNullSafe(side["__of"]) & (out["__hash"] == side["__as"])

    gone = _small(those("NOT stays OR times > 1"))
    once = out.join(gone, same(gone), "left_anti")
    again = those("stays AND times > 1")
    if not again.isEmpty():
        again = _small(again)
        order = Window.partitionBy("__id", "__hash").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns)))
        again = out.join(again, same(again), "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
        once = once.unionByName(again)
    return once.select(*(F.col(f"`{c}`") for c in documents.columns))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
items AS (SELECT doc_id, unnest(s) AS x FROM shingled),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), degree AS (SELECT a AS doc_id, count(*) AS n FROM edges GROUP BY 1)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(min(r.other) AS BIGINT) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY 1, 2
"""

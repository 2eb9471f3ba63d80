"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled training rows; each covariance is shrunk towards the pooled one
and its diagonal. A score is the logistic of the log-density difference, from Mahalanobis distances with cached Cholesky factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch
from .kernels import SPACED, Hasher, Words, as_bytes, chunks, pieces, shingles

#: Predicted 1 at this score; share of every fifth document (by crc32 of doc_id) held out of training.
CUT, FOLDS = 0.3, 5
#: Shrinkage of a class covariance towards the pooled one, then towards the diagonal; and a floor under every variance.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.1, 1e-3

_KINDS = {
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "stop": b".,;:",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "line": b"\n",
    "other": b"@/=_~^\\{}[]()\"'`+-",
}
_TABLES = {}
for _name, _bytes in _KINDS.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True
FEATURES = ("words", "word_length", *_KINDS, "distinct", "commonest", "repeated_lines", "repeated_runs")


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text: counts and shares, drawn out by logarithms. Empty texts: zero shares."""
    out = np.zeros((len(texts), len(FEATURES)))
    for low, high in chunks(texts):
        words = Words(texts[low:high], SPACED)
        hashes = Hasher(words.buffer)
        each = hashes.spans(words.starts, words.ends)
        lengths = np.maximum(np.diff(words.offsets) - 1, 1)
        counts = np.diff(words.first)
        shares = {}
        for name, table in _TABLES.items():
            sums = np.concatenate([[0], np.cumsum(table[words.buffer], dtype=np.int64)])
            ends = np.maximum(words.offsets[1:] - 1, words.offsets[:-1])
            shares[name] = (sums[ends] - sums[words.offsets[:-1]]) / lengths
        breaks = np.flatnonzero(words.buffer == 10)
        starts = np.concatenate([[0], breaks[:-1] + 1])
        lines, line_first = hashes.spans(starts, breaks), np.searchsorted(starts, words.offsets)
        filled = breaks > starts
        rows = out[low:high]
        rows[:, 0] = np.log1p(counts)
        inside = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        rows[:, 1] = np.log1p((inside[words.first[1:]] - inside[words.first[:-1]]) / np.maximum(counts, 1))
        for k, name in enumerate(_KINDS, 2):
            rows[:, k] = np.log(shares[name] + 0.002)
        at = 2 + len(_KINDS)
        for d in range(high - low):
            own = each[words.first[d] : words.first[d + 1]]
            if not len(own):
                rows[d, at] = rows[d, at + 1] = rows[d, at + 2] = rows[d, at + 3] = 0
                continue
            _, often = np.unique(own, return_counts=True)
            rows[d, at] = np.log(len(often) / len(own))
            rows[d, at + 1] = np.log(often.max() / len(own))
            mine = lines[line_first[d] : line_first[d + 1]][filled[line_first[d] : line_first[d + 1]]]
            rows[d, at + 2] = np.log(1.01 - len(np.unique(mine)) / max(len(mine), 1))
            runs = shingles(own)
            rows[d, at + 3] = np.log(1.01 - len(np.unique(runs)) / len(runs))
    return out


def _map_statistics(batches):
    for batch in pieces(batches):
        values = statistics(as_bytes(batch.column("text")))
        flat = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), flat], ["doc_id", "held_out", "x"])


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): a null doc_id is never held out, and never labelled."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return documents.select("doc_id", held.alias("held_out"), "text").mapInArrow(_map_statistics, "doc_id long, held_out boolean, x array<double>")


def fit(rows: DataFrame, labels: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For class 0 and 1: log prior less half the log determinant, mean, Cholesky factor of the inverse's side.

    The sums go to the driver: 2 * (1 + d + d * d) numbers, 422 for 14 features, whatever the corpus. Without rows of a class, its
    density is the other's, so every score is a half.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    known = rows.where("NOT held_out").join(marks, "doc_id").select("quality", "x")
    d = len(FEATURES)
    same = (0.0, np.zeros(d), np.eye(d))

    def sums(values) -> dict[int, np.ndarray]:
        """Each class's sums of an array, a number for each place."""
        out: dict[int, dict[int, float]] = {0: {}, 1: {}}
        for row in known.select("quality", F.posexplode(values).alias("k", "v")).groupBy("quality", "k").agg(F.sum("v").alias("v")).toLocalIterator():
            out[int(row.quality)][row.k] = row.v
        return {c: np.array([v for _, v in sorted(x.items())]) for c, x in out.items()}

    first = sums(F.concat(F.array(F.lit(1.0)), F.col("x")))
    if not len(first[0]) or not len(first[1]):
        return [same, same]
    n = {c: t[0] for c, t in first.items()}
    mean = {c: t[1:] / n[c] for c, t in first.items()}
    # second moments about the means, so that nothing cancels
    about = F.when(F.col("quality") == 1, F.array(*map(F.lit, mean[1].tolist()))).otherwise(F.array(*map(F.lit, mean[0].tolist())))
    off = F.zip_with("x", about, lambda x, m: x - m)
    second = sums(F.flatten(F.transform(off, lambda a: F.transform(off, lambda b: a * b))))
    own = {c: t.reshape(d, d) / n[c] for c, t in second.items()}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    out = []
    for c in (0, 1):
        mixed = (1 - TO_POOLED) * own[c] + TO_POOLED * pooled
        mixed = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        out.append((np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(factor)).sum(), mean[c], np.linalg.inv(factor)))
    return out


def quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted.

    Only rows that aren't held out teach. Null and empty texts are scored by their (zero) statistics. Repeated rows score alike.
    Other columns are not read; no documents give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "classifier")
    rows = scratch.table(document_statistics(documents), "statistics")
    model = fit(rows, labels)

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            log = [prior - 0.5 * (((x - mean) @ whiten.T) ** 2).sum(1) for prior, mean, whiten in model]
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return scratch.result(rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))

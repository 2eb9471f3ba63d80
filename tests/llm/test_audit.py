"""The filter audit against a loop over all orders, and its transform against its definition."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from daybook.llm import audit

SCHEMA = "doc_id long, text string, lang string, source string"


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        bad = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i]
        yield i, lang or "", {f for f, b in zip("ABCDE", bad) if b}


def by_loop(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    failed = list(failures(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in failed}:
        own = [(i, bad) for i, p, bad in failed if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in bad for _, bad in own)
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(bad == {f} for _, bad in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return sorted((*key, *x, shapley[key[0], key[1][key[2] - 1]]) for key, x in out.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    long_ = " ".join(f"word{k}" for k in range(150))
    texts = [None, "", long_, long_ + " #", long_.upper(), "one two", "same " * 120, "SAME " * 120, long_ + " " * 3 + "x", "é" * 99 + " A", "\t\n\x0b word", " ".join(map(str, range(40_000)))]
    out = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for k in range(80)]
    return out + [out[3], out[3], (None, long_, "en", "s"), (None, None, None, None), (500, texts[-1], "fr", "s")]


def test_filter_audit(spark, rows):
    labels = [(k, k % 2, k % 3 == 0 and 1 or None) for k in range(0, 90, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = by_loop(rows, labels)
    assert sorted(map(tuple, audit.filter_audit(docs, marks).collect())) == want
    clashing = docs.withColumns({n: F.lit("x") for n in ("part", "mask", "n", "good", "toxic", "first", "digest", "quality", "step", "kept")})
    assert sorted(map(tuple, audit.filter_audit(clashing.repartition(5), marks.withColumn("text", F.lit(1)).union(marks.withColumn("text", F.lit(2)))).collect())) == want
    assert audit.filter_audit(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in audit.filter_audit(docs, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("filters", ["A", "XY", "QRST"])
def test_audit_of_any_filters(spark, filters):
    rng = random.Random(5)
    cells = [(part, m, rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 3)) for part in ("a", None) for m in range(1 << len(filters)) if rng.random() < 0.6]
    cells += [("a", 0, 1, 1, 1), (None, 1, 2, 1, 0)]
    found = audit.audit(spark.createDataFrame(cells, "part string, mask int, n long, good long, toxic long"), filters).collect()
    assert len(found) == 2 * len(filters) * len(list(permutations(filters)))
    for r in found:
        early = {filters.index(f) for f in r.filter_order[: r.step - 1]}
        k = filters.index(r.filter_order[r.step - 1])
        own = [c for c in cells if c[0] == r.part]
        gone = [c for c in own if c[1] >> k & 1 and not any(c[1] >> e & 1 for e in early)]
        assert (r.removed, r.good_lost, r.toxic_lost) == tuple(sum(c[j] for c in gone) for j in (2, 3, 4))
        assert r.redundant == sum(c[2] for c in own if c[1] >> k & 1) - r.removed
        assert r.unique_fails == sum(c[2] for c in own if c[1] == 1 << k)
        assert r.shapley == sum(x.removed for x in found if x.part == r.part and x.filter_order[x.step - 1] == filters[k])


def test_audit_refuses_what_it_cannot_order(spark):
    none = spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    for filters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            audit.audit(none, filters)

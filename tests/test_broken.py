"""Reasons of broken links in their order, and the closest name against difflib over all names."""

from __future__ import annotations

import difflib
import random

from daybook.operators import broken

NAMES = "key string, name string, title string, note_id long"


def test_reasons(spark):
    targets = ["secret", "bad", "template", "skipped", "elsewhere", "sam", "2024-05-01", "2024-02-30", "jane ro", "anna", "abc", "nobody", "both"]
    lost = spark.createDataFrame([(t, k, 0, None) for k, t in enumerate(targets)], "target string, entries int, notes int, last date")
    tracked = spark.createDataFrame([("secret", "s.md", "private", None), ("bad", "b.md", "error", "no date"), ("both", "z.md", "error", None)], "key string, path string, status string, error_message string")
    files = spark.createDataFrame([("template", ".t/template.md", "hidden"), ("skipped", "skipped.md", "ignored"), ("elsewhere", "x/elsewhere.md", "outside"), ("both", "a.md", "outside"), ("elsewhere", "y/elsewhere.md", "hidden")], "key string, path string, state string")
    shared = spark.createDataFrame([("sam", ["Sam Roe", "Sam Poe"]), ("both", ["A", "B"])], "key string, titles array<string>")
    names = spark.createDataFrame([("jane roe", "Jane Roe", "Jane Roe", 4), ("ann", "Ann", "Annabel Lee", 5), ("abcd", "Abcd", "Abcd", 6)], NAMES)
    found = {r.target: r for r in broken.diagnose(lost, tracked, files, shared, names).collect()}
    want = ["private", "errored", "hidden", "ignored", "outside", "shared_alias", "no_entry", "not_a_date", "typo", "typo", "missing", "missing", "errored"]
    assert {t: found[t].reason for t in targets} == dict(zip(targets, want, strict=True)) and set(want) == set(broken.REASONS)
    assert (found["jane ro"].like, found["jane ro"].like_id) == ("Jane Roe", 4) and found["anna"].like == "Annabel Lee"
    assert found["bad"].path == "b.md" and "no date" in found["bad"].why and found["elsewhere"].path == "x/elsewhere.md"
    assert "Sam Poe and Sam Roe" in found["sam"].why and "[[Jane Roe]]" in found["jane ro"].fix and all(r.why and r.fix for r in found.values())


def test_closest_is_difflibs(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("abcde", k=rng.randint(2, 12))) for _ in range(150)})
    lost = set()
    for n in rng.sample(names, 80):
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(n) + 1)
            n = rng.choice([n[:k] + rng.choice("abcde") + n[k:], n[:k] + n[k + 1 :], n[:k] + "x" + n[k + 1 :]])
        lost.add(n)
    lost -= set(names) | {""}
    want = {t: m[0] for t in lost if len(t) >= 4 and (m := difflib.get_close_matches(t, [n for n in names if len(n) >= 3], n=1, cutoff=broken.LIKENESS))}
    found = broken.closest(spark.createDataFrame([(t,) for t in lost], "target string"), spark.createDataFrame([(n,) for n in names], "key string"))
    assert {r.target: r.like_key for r in found.collect()} == want and len(want) > 20

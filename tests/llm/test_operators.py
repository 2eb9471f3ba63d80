"""The corpus operators against brute force, over rows that a corpus really holds: nulls, empty and long texts, copies, ties."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import chat, classifier, decontam, graph, jaccard, kernels, licenses, lm, mixing, quality, suffix, urls
from daybook.llm.common import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "an the re on in er ti és ou ñó ing st"


def prose(rng: random.Random, n: int) -> str:
    parts = SYLLABLES.split()
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, passage = prose(rng, 300), prose(rng, 120)
    edited = base.split(" ")
    for k in (20, 150, 151):
        edited[k] = "CHANGED"
    texts = [
        None, "", " \n\t", "One", "one two three four", "One  two three\nfour", base, base, " ".join(edited), base.upper(), prose(rng, 200) + passage + prose(rng, 40), passage + prose(rng, 300), prose(rng, 5000),
        "Released under the MIT License. CC BY-NC 4.0 and cc\nby; GNU General Public License. All Rights Reserved, all rights reserved", "spam " * 400, "same line\n" * 30, "a" * 1500, "###$$$ %%% &&& !!!", "x\0y ΣΑΣ É", prose(rng, 90), prose(rng, 90),
    ]
    sources = ["b", "a", None, "a", "é", "b", "a", "b", "c", "b", "b"]
    out = [(k, t, "en", sources[k % len(sources)], len(t or "")) for k, t in enumerate(texts)]
    out += [(40 + k, prose(rng, rng.randint(1, 60)), None, "c", 0) for k in range(30)]
    return out + [out[6], (None, "null id text of some words here " * 3, "en", "a", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    marks = [(i, int(len(t or "") > 30 and "spam" not in t and "###" not in t), 0) for i, t, *_ in rows if i is not None and i % 3 != 1]
    return spark.createDataFrame([*marks, marks[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    names = "u v h run words n_words score spans hash held_out uid kind label node a b target size taken x shingles kept level"
    return docs.withColumns({n: F.lit(n) for n in names.split()})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_spans_hash_alike_wherever_they_stand():
    words = kernels.Words([b"one two  three", b"", b"three two one", b"two"])
    h = words.hashes()
    assert list(words.first) == [0, 3, 3, 6, 7]
    assert h[0] == h[5] and h[1] == h[4] == h[6] and h[2] == h[3] and len(set(h.tolist())) == 3


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 337):
        assert kernels.sliding_minimum(values, width).tolist() == [min(values[k : k + width]) for k in range(500 - width + 1)]


def licence_rows(rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t, *_ in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        hits = [(p, label) for phrase, label in phrases.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in hits]
        yield i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(docs, rows, none, clashing):
    found = licenses.license_scan(docs)
    assert by_id(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(licence_rows(rows), key=repr)
    full = found.where("doc_id = 13").first()
    assert set(full.labels.split(",")) >= {"cc-by", "cc-by-nc", "gpl", "mit", "reserved"} and full.score == 1.0
    assert found.where("doc_id = 0").first().score == 0.0
    assert licenses.license_scan(none).count() == 0
    assert licenses.license_scan(clashing).count() == len(rows)


def scanned(text, templates):
    """Labels and score by looking for every phrase of every template at every word."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    at = lambda phrase: [p for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    labels, score, n = set(), 0.0, 0
    for t in templates:
        whole = t.text.split()
        origin = [next(p for p in range(len(whole)) if whole[p : p + len(k.split())] == k.split()) for k in t.keys]
        for place in at(t.keys[0]):
            start = place - origin[0]
            if all(any(abs(p - (start + o)) <= licenses.SLACK for p in at(k)) for k, o in zip(t.keys[1:], origin[1:], strict=True)):
                labels.add(t.label)
                score = max(score, sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(whole)) / len(whole))
                n += 1
    return ",".join(sorted(labels)), round(score, 9), n


def test_license_scan_equals_a_search_for_every_phrase(spark):
    """Whole notices, cut, shifted, mixed with each other and with the words of phrases in another order."""
    rng = random.Random(41)
    texts = [None, "", "license " * 500, "cc by cc by-nc, CC BY SA 4.0 by cc"]
    for t in licenses.TEMPLATES:
        words = t.text.split()
        for _ in range(3):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(["Acme", "2024", *words]))
            low = rng.randint(0, len(own) // 3) if rng.random() < 0.5 else 0
            other = rng.choice(licenses.TEMPLATES).text.split()
            parts = [prose(rng, 5), rng.choice([", ", "\n"]).join(own[low:]).title(), " ".join(other[: rng.randint(0, len(other))]), "".join(rng.sample(words, min(4, len(words))))]
            texts.append(" ".join(parts[: rng.randint(2, 4)]))
    texts.append((prose(rng, 20_000) + " " + licenses.TEMPLATES[4].text + " ") * 2)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.labels, round(r.score, 9), len(r.matches)) for r in licenses.license_scan(frame).collect()}
    assert found == {i: scanned(t, licenses.TEMPLATES) for i, t in enumerate(texts)}
    assert len({labels for labels, *_ in found.values()}) > 15


def signals(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_and_reject(docs, labels, rows, none, clashing):
    found = quality.quality_rules(docs, labels).collect()
    assert sorted((r[:6] for r in found), key=repr) == sorted(((i, *signals(t)) for i, t, *_ in rows), key=repr)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).count() == len(rows)
    kept = quality.keep_quality(clashing, labels)
    assert kept.columns == clashing.columns
    assert by_id(kept.select("doc_id")) == sorted(((r.doc_id,) for r in found if r.kept), key=repr)


def test_quality_score_is_the_log_ratio_of_hashed_ngrams(spark, docs, labels):
    """The same numbers by plain counting over Spark's own buckets."""
    from pyspark.sql import functions as F

    from daybook.llm.common import spaced_words

    grams = quality.hashed(docs.select("doc_id", "text", spaced_words(F.col("text")).alias("__words"))).select("doc_id", "text", quality._grams().alias("g")).collect()
    trusted_ids = {r.doc_id for r in labels.where("quality = 1").collect() if r.doc_id is not None}
    every, trusted = Counter(), Counter()
    for r in grams:
        every.update(r.g)
        if r.doc_id in trusted_ids:
            trusted.update(r.g)
    half = lambda c, k: sum(n for g, n in c.items() if (g >= quality.BUCKETS) == k)
    totals = {k: (half(trusted, k), half(every, k)) for k in (False, True)}

    def weight(g):
        t, a = totals[g >= quality.BUCKETS]
        return math.log((trusted[g] + quality.PRIOR * t / a) / (t / a * (every[g] + quality.PRIOR)))

    want = sorted((repr(r.doc_id), round(sum(map(weight, r.g)) / max(len(r.g), 1), 9)) for r in grams)
    got = sorted((repr(r.doc_id), round(r.score, 9)) for r in quality.quality_rules(docs, labels).collect())
    assert got == want


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def component_rows(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def test_jaccard_join(docs, rows, none, clashing):
    found = jaccard.jaccard_join(docs)
    assert by_id(found.drop("n_links")) == component_rows([r[:2] for r in rows])
    assert jaccard.jaccard_join(none).count() == 0
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns
    want = {r[0] for r in component_rows([r[:2] for r in rows]) if r[0] is None or r[0] == r[2]}
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(want)


def test_jaccard_join_of_a_large_family(spark, monkeypatch):
    """Near copies of near copies: stars and rounds must find the components that all pairs give."""
    rng = random.Random(8)
    base = prose(rng, 100).split()
    texts, now = [], list(base)
    for k in range(60):
        own = list(base if k % 2 else now)
        for _ in range(rng.randint(1, 7)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        now = own if k % 3 == 0 else now
        texts.append((k, " ".join(own)))
    texts += [(100 + k, " ".join(base[:12]) + " " + prose(rng, 60)) for k in range(20)]
    found = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert by_id(found.drop("n_links")) == component_rows(texts)


def test_jaccard_join_of_texts_that_hold_a_common_passage(spark):
    """A class stays in a very large group though few of its signatures are in such groups."""
    rng = random.Random(11)
    fresh = iter(range(10**9))
    passage = [f"p{k}" for k in range(93)]  # 89 shingles
    with_own = lambda n: " ".join([*passage, *(f"o{next(fresh)}" for _ in range(n))])
    texts = [(k, with_own(rng.randint(8, 12))) for k in range(1200)]
    texts += [(2000 + k, with_own(2)) for k in range(3)] + [(3000 + k, with_own(27)) for k in range(12)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in texts}
    for i in range(3000, 3012):
        assert all(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(2000, 2003))
        assert found[i] == found[2000] == 0, i


@pytest.mark.parametrize("seed", [7, 11])
def test_jaccard_join_of_a_family_at_the_edge_of_a_band(spark, seed):
    """700 copies with a word of their own, and 300 shorter ones that are similar to exactly one of them."""
    r = random.Random(seed)
    core = [f"c{k}x{r.randrange(10**6)}" for k in range(153)]
    texts = [(i, " ".join([*core, f"u{i}"])) for i in range(700)]
    for t in range(300):
        w = [*core, f"u{t}"]
        while True:
            p = sorted(r.sample(range(15, len(w) - 10), 3))
            if p[1] - p[0] >= 5 and p[2] - p[1] >= 5:
                break
        for k in p:
            w[k] = f"a{t}_{k}"
        texts.append((1000 + t, " ".join(w[10:])))
    found = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


@pytest.mark.parametrize(("tries", "few", "small"), [(0, 1, 2), (1, 10**9, 2), (1, 1, 3)])
def test_jaccard_join_in_rounds(spark, monkeypatch, tries, few, small):
    """Few pairs a group, early and late last rounds: the components are the same."""
    for name, value_ in (("TRIES", tries), ("FEW", few), ("SMALL", small), ("BROADCAST_ROWS", 3), ("BLOCK", 9), ("SAMPLE", 1), ("HEAVY", 3)):
        monkeypatch.setattr(jaccard, name, value_)
    monkeypatch.setattr(graph, "TASK", 0)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts, now = [], list(base)
    for k in range(50):
        own = list(now)
        for _ in range(rng.randint(2, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        now = own if k % 4 == 0 else now
        texts.append((k, " ".join(own)))
    found = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert by_id(found.drop("n_links")) == component_rows(texts)


def test_keep_one_tells_texts_of_one_doc_id_apart(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 50) for _ in range(3))
    texts = [(1, a, 1), (1, b, 2), (2, a, 3), (None, b, 4), (None, c, 5), (3, None, 6), (3, None, 6), (4, "", 7), (5, a, 8), (1, a, 1)]
    kept = jaccard.keep_one(spark.createDataFrame(texts, "doc_id long, text string, n long"))
    assert by_id(kept) == sorted([(1, a, 1), (1, b, 2), (None, c, 5), (3, None, 6), (4, "", 7)], key=repr)
    assert jaccard.keep_one(kept.limit(0)).count() == 0


def test_jaccard_join_takes_pairs_across_blocks(spark, monkeypatch):
    """The last round alone, and blocks of a few classes: all pairs of a group are still tried."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = random.Random(12)
    base = prose(rng, 100).split()
    texts = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        texts.append((k, " ".join(own)))
    found = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert by_id(found.drop("n_links")) == component_rows(texts)


def test_partenum_gives_similar_sets_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 60, 99, 150, 400]:
        for _ in range(40):
            whole = rng.integers(0, 1 << 62, n).astype(np.uint64)
            gone = n // 4
            for other in (whole[gone:], np.concatenate([whole[n // 7 :], rng.integers(0, 1 << 62, n // 8).astype(np.uint64)])):
                both, union = len(np.intersect1d(whole, other)), len(np.union1d(whole, other))
                if len(other) and 75 * union <= 100 * both < 100 * union:  # equal sets are one class
                    for frequent in (0, 3, 10**6):  # whatever the order, the first signatures of both have one in common
                        assert np.intersect1d(signs(whole, frequent), signs(other, frequent)).size, (n, len(other))


def signs(elements, frequent):
    """The signatures that a set keeps where every `frequent`-th shingle counts as often seen."""
    flat = np.unique(elements)
    often = flat[flat % np.uint64(frequent) < 1] if 0 < frequent < 10**6 else flat if frequent else flat[:0]
    return jaccard.signatures(flat, np.array([len(flat)]), often, (often % np.uint64(7)).astype(np.int64) + 1)[1]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((30, 30), (100, 140), (300, 299)):
        x, y = (np.unique(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (n, m))
        y[: n // 2] = x[: n // 2]
        a, b = jaccard.parity(x), jaccard.parity(y)
        size = min(len(a), len(b))
        assert np.bitwise_count(jaccard.fold(a, size) ^ jaccard.fold(b, size)).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("task", [0, 10**6])
def test_components(spark, monkeypatch, task):
    monkeypatch.setattr(graph, "TASK", task)
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert {r.node: r.label for r in found} == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_decontamination(spark, docs, rows, none, clashing):
    rng = random.Random(6)
    words = [r[1] for r in rows if r[0] == 12][0].split()
    items = [(1, " ".join(words[50:90])), (2, " ".join(words[200:260] + prose(rng, 10).split())), (3, " ".join(words[300:320]) + " " + prose(rng, 40)), (4, "ONE"), (5, None), (6, ""), (1, " ".join(words[50:90])), (None, "a b c d e f g"), (7, "a b c"), (8, prose(rng, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, *_ in rows:
        own = shingle_set((t or "").lower())
        for k, x in items:
            item = shingle_set((x or "").lower())
            if k is not None and item and 100 * len(own & item) >= 75 * len(item):
                want.add((i, k, len(item), len(own & item)))
    found = decontam.contaminated(docs, bench)
    assert {r[:4] for r in found.collect()} == want and len(want) >= 3
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    clean = decontam.keep_clean(clashing, bench)
    assert clean.columns == clashing.columns
    held = [not any(k is not None and x and shingle_set(x.lower()) and 100 * len(shingle_set((t or "").lower()) & shingle_set(x.lower())) >= 75 * len(shingle_set(x.lower())) for k, x in items) for _, t, *_ in rows]
    assert clean.count() == sum(held)


def test_decontamination_tells_texts_apart(spark):
    """Null doc_ids, and one doc_id on several texts: each is judged by itself."""
    item = "one two three four five six seven eight"
    texts = [(None, item), (None, "a clean text"), (None, f"x {item}"), (1, item), (1, "another clean text"), (2, None)]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted((repr(r.doc_id), r.n_shared) for r in decontam.contaminated(frame, bench).collect()) == [("1", 4), ("None", 4), ("None", 4)]
    assert by_id(decontam.keep_clean(frame, bench)) == sorted([(None, "a clean text"), (1, "another clean text"), (2, None)], key=repr)


def test_mixing(docs, rows, none, clashing):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, total = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= share
    source, taken = {}, Counter()
    for i, _, _, s, _ in rows:
        source[i] = s
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s])
        taken[s] += r.taken
    for s in names:
        assert taken[s] == math.floor(target[s] + 0.5)
    assert len(found) == len(rows)
    assert by_id(mixing.mix(docs)) == sorted((tuple(r) for r in found), key=repr) == by_id(mixing.mix(clashing))
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).first().taken == 0


def repeat_rows(texts, length, passage):
    def covered(wide, counted):
        for k, t in enumerate(texts):
            gone = [False] * len(t)
            for p in range(len(t) - wide + 1):
                if counted(t[p : p + wide], k):
                    gone[p : p + wide] = [True] * wide
            yield t, gone

    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    owners = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - passage + 1):
            owners.setdefault(t[p : p + passage], set()).add(k)
    shared = covered(passage, lambda x, k: len(owners[x]) > 1)
    for (t, gone), (_, also) in zip(covered(length, lambda x, k: seen[x] > 1), shared, strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), sum(also)


def test_mixing_joins_every_block_to_its_slot(spark, monkeypatch):
    """Blocks and slots by a plain loop, over sources from a few words to many."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "RUN", 37)
    rng = random.Random(17)
    texts = [(k if k % 9 else None, " ".join(["w"] * rng.randint(0, 40)), f"s{min(rng.randrange(30), 11)}") for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    scratch = Scratch(spark, "test")
    rows, blocks = mixing.mix_blocks(docs, scratch)
    rows, blocks = rows.collect(), blocks.collect()
    plan = {r.place: (r.source_size, r.target, r.spent) for r in rows}
    uptos, upto = [], 0.0
    for place in sorted(plan):
        upto += plan[place][1]
        uptos.append(upto)
    count = sum(math.ceil(p[2] / 16) for p in plan.values())
    own = {place: [] for place in plan}
    for slot in range(count):
        point = (slot + 0.5) * mixing.GOLDEN
        u = (point - math.floor(point)) * uptos[-1]
        own[next(p for p, x in zip(sorted(plan), uptos, strict=True) if x > u)].append(slot)
    want = Counter()
    for r in rows:
        for again in range(2):
            for w in range(r.start + again * r.source_size, min(r.start + again * r.source_size + r.size, r.spent)):
                k = w // 16
                want[r.row, k, own[r.place][k] if k < len(own[r.place]) else count + k * len(plan) + r.place - 1] += 1
    assert Counter({(b.row, b.block, b.slot): b.words for b in blocks}) == want
    for place, (_, _, spent) in plan.items():
        assert abs(len(own[place]) - spent / 16) <= 4 and sum(n for (r, _, _), n in want.items() if rows[[x.row for x in rows].index(r)].place == place) == spent


def test_mixing_spends_a_small_source_beside_a_huge_one(spark):
    """A source of 300 words beside 10**8 gets its share to the word."""
    shares = mixing.targets(spark.createDataFrame([("a", 10**8), ("b", 300), ("c", 5000)], "source string, size long"))
    assert all(r.target <= 2 * r.source_size for r in shares.collect()) and shares.where("place = 2").first().target > 0


def test_suffix_dedup(docs, rows, none, clashing):
    found = suffix.suffix_dedup(docs)
    want = [(r[0], *x) for r, x in zip(rows, repeat_rows([(r[1] or "").encode() for r in rows], suffix.LENGTH, suffix.LEAST), strict=True)]
    assert by_id(found) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) >= 6
    assert suffix.suffix_dedup(none).count() == 0
    edited = suffix.remove_repeats(clashing)
    assert edited.columns == clashing.columns and edited.count() == len(rows)
    assert edited.where("doc_id = 12").first().text == [r[1] for r in rows if r[0] == 12][0]
    assert edited.where("doc_id = 0").first().text is None


def test_intervals_are_all_groups_of_equal_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        suffixes = sorted("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(2, 12)))
        prefixes = [0] + [suffix.common(a.encode(), b.encode()) for a, b in zip(suffixes, suffixes[1:])]
        want = set()
        for low in range(len(suffixes)):
            for high in range(low + 1, len(suffixes)):
                length = min(prefixes[low + 1 : high + 1])
                if length and (low == 0 or prefixes[low] < length) and (high + 1 == len(suffixes) or prefixes[high + 1] < length):
                    want.add((low, high, length))
        assert set(suffix.intervals(prefixes)) == want


def test_family_reach_is_that_of_all_pairs():
    rng = random.Random(9)
    for _ in range(100):
        contexts = [("b" * rng.choice([0, 100, 200, 224]) + rng.choice("ab"), "a" * rng.choice([32, 64, 160, 399]) + rng.choice("bc")) for _ in range(8)]
        contexts = list(dict.fromkeys((b.encode()[: suffix.BEFORE], a.encode()) for b, a in contexts))
        texts = [rng.randrange(3) for _ in contexts]
        wants = []
        for least, apart in ((suffix.LENGTH, range(len(contexts))), (suffix.LEAST, texts)):
            want = []
            for k, (b, a) in enumerate(contexts):
                pairs = [(suffix.common(b, y), suffix.common(a, x)) for j, (y, x) in enumerate(contexts) if apart[j] != apart[k]]
                good = [(p, q) for p, q in pairs if p + q >= least]
                want.append((max((p for p, _ in good), default=0), max((q for _, q in good), default=0)))
            wants.append(want)
        assert suffix.family(contexts, [1] * len(contexts), texts) == tuple(wants)


def test_suffix_dedup_of_frequent_anchors(spark, monkeypatch):
    """Families dealt by content, and passages of all lengths around the limits, in texts and across them."""
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "FEW", 2)
    rng = random.Random(21)
    passage = prose(rng, 200)
    texts = []
    for k in range(40):
        low = rng.randrange(0, 300)
        part = passage[low : low + rng.choice([100, 250, 256, 257, 399, 400, 401, 700])]
        texts.append(prose(rng, rng.randint(0, 30)) + part + prose(rng, rng.randint(0, 30)) + (part if k % 5 == 0 else ""))
    texts += [texts[3], texts[3], passage[:300], passage[:300]]
    want = [(k, *x) for k, x in enumerate(repeat_rows([t.encode() for t in texts], suffix.LENGTH, suffix.LEAST))]
    found = suffix.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert by_id(found) == sorted(want, key=repr)


def test_cut_keeps_whole_characters():
    text = "éaéaéa"
    assert suffix.cut(text.encode(), [[2, 3]], True).decode() == "ééaéa"
    assert suffix.cut(text.encode(), [[1, 4]], True).decode() == "ééaéa"
    for start in range(len(text.encode())):
        for end in range(start, len(text.encode()) + 1):
            suffix.cut(text.encode(), [[start, end]], True).decode()


def test_url_filter(spark):
    cases = [
        (1, "https://www.Example.com/en/7?x", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        (2, "http://a.com/en/1#x", "a.com", "/en/1", "com/en/", "block"),
        (3, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "block"),
        (4, "http://example.net/de/80", "example.net", "/de/80", "example.net/de/8", "block"),
        (5, None, "", "", None, "allow"),
        (6, "no scheme", "", "", None, "allow"),
        (7, "x://org?y/es/", "org", "", None, "allow"),
        (8, "http://com.example/en/", "com.example", "/en/", None, "allow"),
        (9, "http://é.org/es/", "é.org", "/es/", "org/es/", "block"),
        (None, "http://b.com/en/", "b.com", "/en/", "com/en/", "block"),
        (1, "https://www.Example.com/en/7?x", "www.example.com", "/en/7", "example.com/en/7", "allow"),
    ]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([c[:2] for c in cases], "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2), "open": F.lit(3), "salt": F.lit(4)})
    assert by_id(urls.url_filter(pages)) == sorted(((c[0], *c[2:]) for c in cases), key=repr)
    assert urls.url_filter(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.url_filter(pages, ()).collect()} == {"allow"}


def test_url_filter_of_shuffled_pages(spark):
    """Pages are numbered once: what a shuffle deals out anew in every branch of a plan gets the same rules."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", F.col("html"))
    pages = pages.union(pages.select(F.col("page_id") + 1000, F.concat("url", F.lit("/en/7")), "html"))
    want = sorted(map(tuple, urls.url_filter(pages).collect()))
    some = pages.withColumn("extra", F.rand(1))
    for shuffled in (pages.repartition(5), pages.repartition(7, "url"), pages.distinct(), some.orderBy("extra"), some.repartition(3).union(some.limit(0)), pages.repartition(4).cache()):
        assert sorted(map(tuple, urls.url_filter(shuffled).collect())) == want


def test_url_filter_of_random_rules(spark, monkeypatch):
    """Nested hosts and paths, many rules, hot hosts in several ranges, very long urls: against a search of every rule."""
    monkeypatch.setattr(urls, "PAGES", 7)
    rng = random.Random(51)
    label = lambda: rng.choice(["a", "b", "com", "x-y", "é"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, n)))
    rules = [urls.Rule(rng.choice(["block", "allow"]), host(3), path(4)) for _ in range(150)]
    rules += [urls.Rule("block", "com", ""), urls.Rule("allow", "com", ""), urls.Rule("block", "com", "/" + "a" * 500)]
    pages = [(k, f"http://{host(4).upper()}{path(8)}{rng.choice(['', '?q/a', '#a'])}") for k in range(400)]
    pages += [(900, "http://a.com/" + "a" * 100_000), (901, "http://" + "a." * 300 + "com/ab"), (902, None), (903, "com/ab"), (904, "http://"), (905, "http://com")] + pages[:3]
    want = []
    for k, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        own = re.match("[^/?#]*", rest)[0]
        where, what = own.translate(LOWER), re.match("[^?#]*", rest[len(own) :])[0]
        fits = [r for r in rules if (where == r.host or where.endswith("." + r.host)) and what.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.name, r.verdict), default=None)
        want.append((k, where, what, best.name if best else None, best.verdict if best else "allow"))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    assert by_id(urls.url_filter(frame, tuple(rules))) == sorted(want, key=repr)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert by_id(urls.url_filter(frame, table)) == sorted(want, key=repr)


def test_lm_score(docs, rows, none, clashing):
    found = lm.lm_score(docs).collect()
    train = Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*WORD.findall((t or "").translate(LOWER)), "\0end"])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t, *_ in rows:
        tokens = [*WORD.findall((t or "").translate(LOWER)), "\0end"]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(train[x] > 0 for x in tokens), n, round(base, 6)))
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in found)
    assert lm.lm_score(none).count() == 0 and lm.lm_score(clashing).count() == len(rows)


class ContextTree:
    """Context-tree weighting by its definition: a dictionary of counts for every context and node, and recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for text in texts:
            for context, byte in self.symbols(text):
                for node, bit in self.decisions(byte):
                    for d in range(depth + 1):
                        self.counts[context[:d], node, bit] += 1
                        if d < depth:
                            self.children.setdefault((context[:d], node), set()).add(context[: d + 1])
        self.weighted = {}

    def symbols(self, text):
        whole = b"\0" * self.depth + text + b"\xff"
        for k in range(self.depth, len(whole)):
            yield whole[k - self.depth : k][::-1], whole[k]

    def decisions(self, byte):
        return [((256 | byte) >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]

    def estimate(self, context, node):
        a, b = self.counts[context, node, 0], self.counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(self, context, node):
        if (context, node) not in self.weighted:
            here = self.estimate(context, node)
            if len(context) < self.depth:
                below = sum(self.log_weighted(c, node) for c in self.children.get((context, node), ()))
                here = np.logaddexp(here, below) - math.log(2)
            self.weighted[context, node] = here
        return self.weighted[context, node]

    def one(self, context, node, d=0):
        """Probability of a one, from the node at depth d on."""
        own = context[:d]
        a, b = self.counts[own, node, 0], self.counts[own, node, 1]
        here = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return here
        stop = math.exp(self.estimate(own, node) - math.log(2) - self.log_weighted(own, node))
        return stop * here + (1 - stop) * self.one(context, node, d + 1)

    def log10(self, text):
        out = 0.0
        for context, byte in self.symbols(text):
            for node, bit in self.decisions(byte):
                p = self.one(context, node)
                out += math.log10(p if bit else 1 - p)
        return out


@pytest.mark.parametrize(("grams", "pack"), [(1 << 19, 1 << 20), (40, 300)])
def test_lm_score_is_context_tree_weighting(spark, monkeypatch, grams, pack):
    """The score of whole texts by the definition: known and unknown bytes, long texts in segments, copies, empty texts."""
    for name, value_ in (("GRAMS", grams), ("PACK", pack), ("SAMPLE", 1), ("CHUNK", 700)):
        monkeypatch.setattr(lm, name, value_)
    rng = random.Random(23)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(40)] + [None, "", "ÉÉ\0x", prose(rng, 600), "zzzz qqqq !!!"]
    texts += [texts[0], texts[1].upper()]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[5])]
    tree = ContextTree([(t or "").encode().lower() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], lm.DEPTH)
    found = lm.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((repr(r.doc_id), round(r.score, 3)) for r in found)
    assert got == sorted((repr(i), round(tree.log10((t or "").encode().lower()), 3)) for i, t in rows)


def test_lm_estimator_by_its_definition():
    log = 0.0
    zeros = ones = 0
    for bit in (0, 0, 1, 0, 1):
        log += math.log(((zeros, ones)[bit] + 0.5) / (zeros + ones + 1))
        zeros, ones = zeros + (bit == 0), ones + (bit == 1)
    assert math.isclose(lm.log_block(np.array([3]), np.array([2]))[0], log, abs_tol=1e-9)


def test_quality_classifier(docs, labels, rows, none, clashing):
    found = classifier.quality_classifier(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert classifier.quality_classifier(none, labels).count() == 0
    assert {r.score for r in classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.quality_classifier(clashing, labels).count() == len(rows)


def test_quality_classifier_is_a_shrunk_quadratic_discriminant(spark, docs, labels, rows):
    """The same scores from plain NumPy over all labelled training rows, and none of it where labels have one class."""
    x = {i: classifier.statistics([(t or "").encode()])[0] for i, t, *_ in rows}
    marks = {(r.doc_id, r.quality) for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    data = {c: np.array([x[i] for i, *_ in rows if not held(i) and (i, c) in marks]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in data.items()}
    pooled = sum(len(data[c]) * cov[c] for c in (0, 1)) / sum(map(len, data.values()))
    logs = {}
    for c in (0, 1):
        mixed = (1 - classifier.TO_POOLED) * cov[c] + classifier.TO_POOLED * pooled
        mixed = (1 - classifier.TO_DIAGONAL) * mixed + classifier.TO_DIAGONAL * np.diag(np.diag(mixed)) + classifier.FLOOR * np.eye(len(mixed))
        mean, inverse = data[c].mean(0), np.linalg.inv(mixed)
        logs[c] = {i: math.log(len(data[c])) - 0.5 * np.linalg.slogdet(mixed)[1] - 0.5 * (v - mean) @ inverse @ (v - mean) for i, v in x.items()}
    found = {r.doc_id: r.score for r in classifier.quality_classifier(docs, labels).collect()}
    for i, score in found.items():
        assert math.isclose(score, 1 / (1 + math.exp(min(logs[0][i] - logs[1][i], 700))), rel_tol=1e-6, abs_tol=1e-9)
    assert {r.score for r in classifier.quality_classifier(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_quality_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    found = classifier.quality_classifier(spark.read.parquet(f"{folder}/documents.parquet"), marks).where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.9


CALLS = {"content": "looking", "tool_calls": [{"id": "b", "name": "calculator", "arguments": {"expression": "1+1"}, "after": ["a"]}, {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}]}


def test_chat_formatting(spark):
    turns = [
        (1, 0, "user", 'Say "hi" é\n'),
        (1, 1, "assistant", json.dumps(CALLS)),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "found"}'),
        (1, 3, "tool", '{"tool_call_id": "zz", "content": "?"}'),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"limit": "many"}}, {"id": "c", "name": "nothing", "arguments": {}}, {"id": "d", "name": "calculator", "arguments": {"expression": "2", "more": 1}}]})),
        (2, 1, "tool", '{"tool_call_id": "a", "content": "late"}'),
        (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "search", "arguments": {"query": "q"}, "after": ["y"]}, {"id": "y", "name": "search", "arguments": {"query": "q"}, "after": ["x", "nobody"]}]})),
        (4, 0, None, None), (4, 1, "user", ""), (4, 2, "user", "{broken"), (None, None, "user", "lost"), (1, 0, "user", 'Say "hi" é\n'),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in chat.format_chats(frame).collect()}
    assert chat.format_chats(frame).count() == len(turns)
    assert json.loads(found[1, 0].message) == {"content": 'Say "hi" é\n', "role": "user", "turn": 0}
    made = found[1, 1]
    assert (made.kind, made.n_calls, made.n_answered, made.n_valid, made.level) == ("calls", 2, 1, 2, 1)
    calls = json.loads(made.message)["tool_calls"]
    assert [c["id"] for c in calls] == ["a", "b"] and [c["status"] for c in calls] == ["ok", "unanswered"]
    assert '"arguments":{"limit":3,"query":"x"}' in made.message
    assert (found[1, 2].kind, found[1, 2].level) == ("result", 0) and found[1, 3].kind == "orphan_result"
    assert [c["status"] for c in json.loads(found[2, 0].message)["tool_calls"]] == ["invalid", "unknown_tool", "invalid"]
    assert found[3, 0].level is None
    assert json.loads(found[4, 0].message) == {"content": None, "role": None, "turn": 0} and found[4, 2].kind == "plain"
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_levels_are_the_longest_waits(spark):
    """Random graphs of calls: chains, diamonds, cycles and what waits behind them, repeated edges and ids that name nothing."""
    rng = random.Random(31)
    rows, want = [], {}
    for conv in range(25):
        n = rng.randint(1, 14)
        after = {k: [rng.randrange(n) if rng.random() < 0.15 else rng.randrange(max(k, 1)) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] for k in range(n)}
        after = {k: [o for o in a if o != k or rng.random() < 0.2] for k, a in after.items()}
        level = {}
        for _ in range(n):
            for k, a in after.items():
                if k not in level and all(o in level for o in a):
                    level[k] = max((level[o] + 1 for o in a), default=0)
        rows += [(conv, str(k), [*map(str, a), "nobody"]) for k, a in after.items()]
        want |= {(conv, str(k)): x for k, x in level.items()}
    rows += [(99, str(k), [str(k - 1)]) for k in range(70)]
    want |= {(99, str(k)): k for k in range(70)}
    frame = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in chat.levels(frame, Scratch(spark, "test")).collect()} == want


def test_chat_formatting_of_long_texts_and_ties(spark):
    """Very long content and arguments, results of one id at one turn, a call repeated under one id."""
    long_ = "é\n" * 200_000
    turns = [
        (1, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": long_}}, {"id": "a", "name": "search", "arguments": {"query": "again"}}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "x"})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "y"})), (1, 2, "user", long_),
        (None, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q"}}]})), (None, 1, "tool", '{"tool_call_id": "a"}'),
    ]
    found = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(turns)
    made = json.loads(next(r.message for r in found if r.conv_id == 1 and r.turn == 0))["tool_calls"]
    assert made[0]["arguments"]["query"] == long_ and [c["status"] for c in made] == ["ok", "unanswered"]
    assert [r.kind for r in found if r.conv_id is None] == ["calls", "orphan_result"] or [r.kind for r in found if r.conv_id is None] == ["orphan_result", "calls"]
    assert json.loads(next(r.message for r in found if r.turn == 2))["content"] == long_


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from daybook.llm import common

    session = lambda master, folder=None: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId=master)
    )
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_folder(session(master))
    assert common.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[2]")) == common.shared_folder(session("local[2]"))


def test_chat_formatting_of_no_rows_and_clashing_columns(spark):
    rows = [("c", 0, "user", "hi"), ("c", 1, "assistant", None), (None, None, None, None), ("c", 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    want = by_id(chat.format_chats(df))
    assert len(want) == 4 and chat.format_chats(df.limit(0)).count() == 0
    assert by_id(chat.format_chats(df.withColumns({n: F.lit("x") for n in ("parsed", "calls", "id", "level", "kind", "message", "n_calls", "row", "place", "name")}))) == want

"""The stored full-text index against a scan of the texts, through random changes and random expressions."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from daybook.operators import fulltext, search
from daybook.operators.fulltext import Both, Either, FullText, Not, Words, parse, query_tokens

VOCABULARY = "an ant bee beehive béé cat cats dog do don't 7 70 ñandú zoo".split()


def text_of(rng):
    return rng.choice([None, "", " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 12)))])


def expression(rng, depth=0):
    pick = rng.random()
    if depth > 2 or pick < 0.4:
        word = rng.choice(VOCABULARY)
        return rng.choice([word, word[:2] + "*", f'"{word} {rng.choice(VOCABULARY)}"', f'"{word} {rng.choice(VOCABULARY)[:1]}"*'])
    if pick < 0.6:
        return f"({expression(rng, depth + 1)} OR {expression(rng, depth + 1)})"
    if pick < 0.8:
        return f"({expression(rng, depth + 1)} {rng.choice(['', 'AND'])} {expression(rng, depth + 1)})"
    return f"NOT {expression(rng, depth + 1)}"


def fits(tree, text):
    words = query_tokens(text or "")
    if isinstance(tree, Words):
        n = len(tree.words)
        same = lambda own: own[:-1] == list(tree.words[:-1]) and (own[-1].startswith(tree.words[-1]) if tree.beginning else own[-1] == tree.words[-1])
        return any(same(words[k : k + n]) for k in range(len(words) - n + 1))
    if isinstance(tree, Not):
        return not fits(tree.part, text)
    return (all if isinstance(tree, Both) else any)(fits(p, text) for p in tree.parts)


def ids(df):
    found = [r.doc_id for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_search_after_changes_is_a_search_of_the_texts_there_are(spark, tmp_path):
    rng = random.Random(7)
    folder = str(tmp_path)
    texts = {k: text_of(rng) for k in range(60)}
    index = FullText(spark, folder).apply(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for round_ in range(4):
        changed = {rng.randrange(80): text_of(rng) for _ in range(15)}
        gone = {rng.randrange(80) for _ in range(6)}
        index.apply(spark.createDataFrame(list(changed.items()), "doc_id long, text string"), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        texts = {k: t for k, t in texts.items() if k not in gone} | changed
        if round_ == 2:
            index.merge()
            assert len(index.segments) == 1
        assert (index.docs, index.words) == (len(texts), sum(len(query_tokens(t or "")) for t in texts.values()))
        for _ in range(6):
            e = expression(rng)
            assert ids(index.match(e)) == {k for k, t in texts.items() if fits(parse(e), t)}, e
    later = FullText(spark, folder)
    assert (later.number, later.segments) == (index.number, index.segments) and ids(later.match("ant OR bee OR NOT ant")) == set(texts)
    queries = spark.createDataFrame([(1, "ant"), (1, "bee"), (2, "dog")], "query_id int, term string")
    from daybook.operators import search

    again = search.bm25(spark.createDataFrame(list(texts.items()), "doc_id long, text string").na.fill("", "text"), queries, 5)
    assert sorted(map(tuple, later.bm25(queries, 5).collect())) == sorted(map(tuple, again.collect()))


def test_a_change_touches_its_own_terms_alone(spark, tmp_path):
    index = FullText(spark, str(tmp_path)).apply(spark.createDataFrame([(k, "zebra yak") for k in range(20)] + [(50, "apple")], "doc_id long, text string"))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    index.apply(spark.createDataFrame([(50, "apricot")], "doc_id long, text string"))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert {p.parent.name for p in (tmp_path / "postings/2").rglob("*.parquet")} == {"head=a"}
    assert ids(index.match("apple")) == set() and ids(index.match("ap*")) == {50}
    plan = index.match("zebra")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [head" in plan.replace("isnotnull(head", "[head") or "head#" in plan
    read = index.postings([Words(("zebra",))]).inputFiles()
    assert read and {re.search("head=([^/]*)", f)[1] for f in index._read("postings", "segment int, term string, doc_id long, positions array<int>, length int, head string", index.segments).where("head = 'z'").inputFiles()} >= {"z"}


def test_an_interrupted_change_is_not_seen(spark, tmp_path, monkeypatch):
    index = FullText(spark, str(tmp_path)).apply(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    monkeypatch.setattr(FullText, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        FullText(spark, str(tmp_path)).apply(spark.createDataFrame([(2, "two")], "doc_id long, text string"))
    monkeypatch.undo()
    again = FullText(spark, str(tmp_path))
    assert again.segments == index.segments and ids(again.match("one OR two")) == {1}
    again.apply(spark.createDataFrame([(3, "two")], "doc_id long, text string"))
    assert ids(again.match("two")) == {3}
    with pytest.raises(ValueError, match="twice"):
        again.apply(spark.createDataFrame([(4, "a"), (4, "b")], "doc_id long, text string"))
    assert ids(FullText(spark, str(tmp_path)).match("NOT zzz")) == {1, 3}


def test_an_empty_index(spark, tmp_path):
    index = FullText(spark, str(tmp_path))
    assert index.match("a").count() == 0 and index.match("NOT a").count() == 0 and index.match("...").count() == 0
    index.apply(gone=spark.createDataFrame([(5,)], "doc_id long"))
    assert index.match("NOT a").count() == 0 and index.docs == 0


def test_expressions():
    a, b, c = (Words((w,)) for w in "abc")
    assert parse("a b OR c") == Either((Both((a, b)), c)) and parse("a AND (b OR NOT c)") == Both((a, Either((b, Not(c)))))
    assert parse('"A b"') == Words(("a", "b")) and parse('"a b"*') == Words(("a", "b"), True) and parse("bee-hive") == Words(("bee", "hive"))
    assert parse("caf*") == Words(("caf",), True) and parse("... a") == a and parse("...") is None and parse("or") == Words(("or",))
    for wrong in ("(a", "a)", "a OR", "AND a", "NOT", '"a', "a AND OR b", ""):
        with pytest.raises(ValueError):
            parse(wrong)


def test_texts_are_dealt_and_postings_are_not(spark, tmp_path, monkeypatch):
    """No shuffle of postings where a change is written; texts without words count, with a length of 0."""
    plans, write = [], FullText._write_postings

    def noting(self, number, placed):
        plans.append(placed._jdf.queryExecution().optimizedPlan().toString())
        write(self, number, placed)

    monkeypatch.setattr(FullText, "_write_postings", noting)
    index = FullText(spark, str(tmp_path / "dealt")).apply(spark.createDataFrame([(1, "one two one"), (2, None), (3, "...")], "doc_id long, text string"))
    assert "MapInArrow" in plans[0] and "Repartition" not in plans[0].split("MapInArrow")[0]
    assert (index.docs, index.words) == (3, 3)
    assert sorted((r.doc_id, r.length) for r in index.live_texts().collect()) == [(1, 3), (2, 0), (3, 0)]


def test_texts_are_taken_apart_once(spark, tmp_path, monkeypatch):
    """Lengths are read from where postings were written; postings come in the order of their files, cut where many words are reached."""
    plans, write = [], FullText._write_texts

    def noting(self, number, texts):
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
        write(self, number, texts)

    monkeypatch.setattr(FullText, "_write_texts", noting)
    monkeypatch.setattr(search, "AT_ONCE", 3)
    texts = {3: "öl öl an other", 1: None, 2: "pan other", 5: " ... ", 4: "7 öl"}
    index = FullText(spark, str(tmp_path)).apply(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    index.apply(spark.createDataFrame([(2, "öl")], "doc_id long, text string"), spark.createDataFrame([(4,)], "doc_id long"))
    assert not any("split(" in p for p in plans)
    assert sorted((r.doc_id, r.length, r.segment) for r in index.live_texts().collect()) == [(1, 0, 1), (2, 1, 2), (3, 4, 1), (5, 0, 1)]
    assert ids(index.match('"öl an" OR NOT other*')) == {1, 2, 3, 5} and ids(index.merge().match("öl")) == {2, 3}
    assert {r.term for r in index._read("postings", fulltext.POSTINGS, index.segments).collect()} == {"ol", "an", "other"}
    monkeypatch.setattr(search, "AT_ONCE", 100)
    batch = pa.RecordBatch.from_pydict({"doc_id": [9, 8, 7, 6], "terms": [["pan", "œl", "pan"], ["other", "œl", "1"], [], ["œl"]]})
    own, rows = ([tuple(r.values()) for r in b.to_pylist()] for b in fulltext._placed([batch]))
    assert own == [("1", " ", 8, [], 3), ("other", " ", 6, [], 1), ("other", " ", 7, [], 0), ("other", " ", 9, [], 3)]
    assert rows == [("1", "1", 8, [2], 3), ("o", "other", 8, [0], 3), ("other", "œl", 6, [0], 1), ("other", "œl", 8, [1], 3), ("other", "œl", 9, [1], 3), ("p", "pan", 9, [0, 2], 3)]

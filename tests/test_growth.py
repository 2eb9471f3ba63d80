"""What a query makes on its way grows with its input: no pairs where none are asked for, no shuffle of pairs, no frame an event."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pyarrow as pa

from daybook.functions import text
from daybook.llm import jaccard, suffix
from daybook.operators import broken, links, lookups, search, stats
from daybook.streaming.debounce import Debounce

KEYS = "key string, entry_id long"


def tree(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reverse_day_links_make_no_pairs(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 5, 1)), (2, dt.date(2024, 5, 1)), (None, dt.date(2024, 5, 2))], "entry_id long, entry_date date")
    written = spark.createDataFrame([(1, "2024-05-01"), (3, "2024-05-01"), (3, "trip"), (4, "trip"), (5, "2024-05-02"), (6, "other"), (None, "trip")], "entry_id long, target string")
    found = lookups.reverse_day_links(written, days, spark.createDataFrame([("trip", 2), ("other", 9)], KEYS))
    assert sorted(r.entry_id for r in found.collect()) == [3, 4]
    assert "Join Inner" not in tree(found)


def test_day_links_are_not_shuffled_as_pairs(spark):
    """An entry_id of two dates, names of files that say the same as dates, repeated rows and nulls: each pair once."""
    a, b = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    entries = spark.createDataFrame([(1, a), (2, a), (2, a), (3, a), (3, b), (4, None), (None, b)], "entry_id long, entry_date date")
    written = spark.createDataFrame([(1, "2024-05-01"), (1, "2024-05-01"), (7, "2024-05-01"), (7, "2024-05-02"), (7, "two"), (8, "two"), (8, "zwei"), (9, None), (None, "two")], "entry_id long, target string")
    found = links.day_links(written, entries, spark.createDataFrame([("two", 2), ("zwei", 2), (None, 4)], KEYS))
    want = [(1, 2), (1, 3), (7, 1), (7, 2), (7, 3), (8, 2)]
    assert sorted(map(tuple, found.collect())) == want
    assert tree(found).startswith("Union")


def test_day_links_shuffle_links_of_days_alone(spark, monkeypatch):
    """As lists, in blocks of a day's links and entries, by as many tasks as pairs need; of links that name no day none is shuffled."""
    a, b, far = dt.date(2024, 5, 1), dt.date(2024, 5, 2), dt.date(31, 1, 2)
    days = [(k, a) for k in range(20)] + [(k, b) for k in range(20, 30)] + [(30, a), (30, b), (31, far)]
    said = [(k, t) for k in range(25, 60) for t in ("2024-05-01", "2024-05-02", "0031-01-02", "31-01-02", "2024-5-1", " 2024-05-01", "2024-02-30", f"supplier#{k}")] + [(70, "2024-05-01"), (61, "n")]
    entries, written = spark.createDataFrame(days, "entry_id long, entry_date date"), spark.createDataFrame(said, "entry_id long, target string")
    files, of = spark.createDataFrame([("n", 1), ("2024-05-01", 2), ("2024-05-01", 25)], KEYS), spark.createDataFrame([(k,) for k in range(62)], "entry_id long")
    names = {(d.isoformat(), k) for k, d in days} | {("n", 1), ("2024-05-01", 2), ("2024-05-01", 25)}
    want = sorted({(e, k) for e, t in said for name, k in names if t == name and e < 62 and e != k})
    assert sorted(map(tuple, links.day_links(written, entries, files, of).collect())) == want
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "LIST", 4)
    monkeypatch.setattr(links, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(links, "LISTED_AT_ONCE", 50)
    found = links.day_links(written, entries, files, of)
    assert sorted(map(tuple, found.collect())) == want
    tasks = -(-sum(n * m for n, m in ((36, 21), (35, 11), (35, 1))) // 100)
    dealt = [x for x in tree(found).splitlines() if "RepartitionByExpression" in x and "l#" in x and "e#" in x]
    assert len(dealt) == 4 and all(x.endswith(f", {tasks}") for x in dealt), (tasks, dealt)
    lists = [pa.RecordBatch.from_pydict({"entry_id": [3, 1, 2], "day": [b, a, b]}), pa.RecordBatch.from_pydict({"entry_id": [9, 8, 7, 6], "day": [b, b, b, a]})]
    assert [tuple(r.values()) for x in links._listed(lists) for r in x.to_pylist()] == [(a, [1, 6]), (b, [3, 2, 9, 8]), (b, [7])]
    none = links.day_links(written, entries.limit(0), files.limit(0))
    assert none.count() == 0


def test_lost_targets_meet_names_alone(spark):
    """Targets that are alike among themselves, and names too, aren't tried with each other."""
    lost = spark.createDataFrame([(f"x{k}-nowhere",) for k in range(40)] + [("rde ring",), ("red rings",)], "key string")
    names = spark.createDataFrame([("red ring",), ("red rink",), ("hot bolt",)], "key string")
    found = {(r.a, r.b): r.distance for r in links.near_keys(lost, 0.7, 3, names).collect()}
    assert found == {("rde ring", "red ring"): 2, ("red rings", "red ring"): 1, ("red rings", "red rink"): 2}
    best = broken.closest(lost.withColumnRenamed("key", "target"), names)
    assert sorted(map(tuple, best.collect())) == [("rde ring", "red ring"), ("red rings", "red ring")]


class _Handle:
    """State of one path, as a processor sees it."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.discard(at)

    def update(self, value):
        self.value = value


def test_debounce_gives_a_frame_a_path():
    start = pd.Timestamp("2024-05-01")
    micros = [0, 45_000_000, 45_000_900, 90_000_100, 300_000_000, 344_999_999, 400_000_000]  # quiet to the microsecond
    rows = pd.DataFrame({"path": "p", "kind": "change", "ts": [start + pd.Timedelta(m, "us") for m in micros], "event_id": range(7), "attempts": 0, "again": False})
    handle, processor = _Handle(), Debounce(45, True)
    processor.init(handle)
    first = list(processor.handleInputRows(("p",), iter([rows.iloc[[5, 2, 0]], rows.iloc[[3, 1, 4]]]), None))
    assert len(first) == 1 and list(first[0].event_id) == [0, 3]
    assert len(handle.timers) == 1 and handle.value[2] == 5
    late = rows.iloc[[6, 4]].assign(again=[False, True])
    second = list(processor.handleInputRows(("p",), iter([late]), None))
    assert [list(x.event_id) for x in second] == [[5]] and handle.value[2] == 6 and len(handle.timers) == 1
    assert list(processor.handleInputRows(("p",), iter([rows.iloc[:3]]), None)) == [] and handle.value[2] == 6


def test_a_texts_terms_are_counted_where_it_is_read(spark, monkeypatch):
    """In pieces of few words, over empty texts: no shuffle before the postings, and the sums of a text where its hits are."""
    monkeypatch.setattr(search, "AT_ONCE", 3)
    texts = ["b a b", "", None, "c c c c c", "a", "Été a été"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = search.by_term(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("a", 0, [1], 3), ("a", 4, [0], 1), ("a", 5, [1], 3), ("b", 0, [0, 2], 3), ("c", 3, [0, 1, 2, 3, 4], 5), ("ete", 5, [0, 2], 3)]
    assert sorted(map(tuple, found.collect())) == want
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9], "terms": [["x", "y", "x"], [], ["y"]]})
    pieces = [tuple(r.values()) for b in search._by_term([batch.slice(1), batch]) for r in b.to_pylist()]
    assert pieces == [("y", 9, [0], 1), ("x", 7, [0, 2], 3), ("y", 7, [1], 3), ("y", 9, [0], 1)]
    twice = docs.union(docs.where("doc_id = 0"))
    queries = spark.createDataFrame([(k, t) for k in range(50) for t in "abc"], "query_id long, term string")
    scored = search.scores(twice, queries)
    assert {r.doc_id for r in scored.collect()} == {0, 3, 4, 5} and scored.count() == 200
    shuffles = [x for x in scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "hashpartitioning(query_id" in x]
    assert not [x for x in shuffles if "doc_id" in x]


def test_best_sentences_stem_only_words_that_may_match(monkeypatch):
    """A text without the question's stems isn't cut into words; in another a word is stemmed once, however often it stands there."""
    stemmed, stem = [], text.stem
    monkeypatch.setattr(text, "stem", lambda w: stemmed.append(w) or stem(w))
    said = "# hiked\nWe ate. We hiked and HIKED to an inn, hikers! Then we hiked home. Two hikes."
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["Nothing of it here.", None, said]})
    (found,) = search._best([batch], {"hik": 0.5, "hom": 1.0}, 280)
    assert [tuple(r.values()) for r in found.to_pylist()] == [(1, "", 0.0), (2, "", 0.0), (3, "Then we hiked home.", 1.5)]
    assert sorted(stemmed) == ["hiked", "hikers", "hikes", "home"]


def test_words_among_gives_the_terms():
    """Letters whose case folds to others or to several, closing sigmas, stems that begin alike, short words and stop words."""
    rng, letters = random.Random(5), "aAsSßſςσΣİıﬁŉ'-_ .9éɈͅΐǰẞeEdDnNgGlLyY\n"
    for _ in range(2000):
        asked = "".join(rng.choice(letters) for _ in range(8)) + " running the add"
        whole = "".join(rng.choice(letters) for _ in range(40)) + rng.choice([" runs", asked.upper(), asked + "ing", " the ads adding"])
        stems = text.terms(asked)
        words = text.words_among(whole, stems)
        assert set(words.values()) == text.terms(whole) & stems
        assert all(text.stems_of(s, words) == text.terms(s) & stems for s in text.sentences(whole))


def test_property_keys_deal_their_rows_first(spark):
    properties = spark.createDataFrame([(1, "Kind", "x"), (2, "kind", "x"), (2, "kind", "y"), (None, "size", None)], "note_id long, key string, value string")
    found = stats.property_keys(properties)
    assert sorted(map(tuple, found.collect())) == [("kind", "Kind", 2, 2), ("size", "size", 0, 0)]
    assert "RepartitionByExpression" in tree(found)


def test_groups_of_two_notes_are_found_without_their_notes(spark):
    entries = spark.createDataFrame([(k, 4.0) for k in range(4)], "entry_id long, mood_score double")
    entities = spark.createDataFrame([(k, 1 + k % 2) for k in range(4)], "entry_id long, note_id long")
    properties = spark.createDataFrame([(1, "kind", "x"), (2, "kind", "x"), (2, "kind", "x"), (1, "kind", "one"), (1, "kind", "one"), (None, "kind", "one")], "note_id long, key string, value string")
    found = stats.group_mood(entries, entities, properties, 1)
    assert [(r.key, r.value, r.n) for r in found.collect()] == [("kind", "x", 4)]
    assert "distinct note_id" not in tree(found)


def test_note_pairs_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """More rows make more tasks, whatever the size of the shuffle; rows that say the same are one, and nulls pair with nothing."""
    rows = [(e, n) for e in range(20) for n in (1, 2, 2, 3 + e)] + [(0, 9), (1, 9), (None, 1), (None, 2), (5, None)]
    entities = spark.createDataFrame(rows, "entry_id long, note_id long")
    assert [tuple(r) for r in links.note_pairs(entities, 4).collect()] == [(1, 2, 20)]
    monkeypatch.setattr(links, "PAIRED_AT_ONCE", 10)
    found = links.note_pairs(entities)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 20), (1, 9, 3), (2, 9, 3)]
    dealt = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 2 and all("hashpartitioning(entry_id" in x and ", 9)" in x for x in dealt)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[1].count("Exchange hash") == 3


def test_near_copies_are_tried_once_for_all_their_groups(spark, monkeypatch):
    """A family of near copies has dozens of groups of the same classes: each pair is tried in one call, not in one for each group."""
    tried, write = [], jaccard.Scratch.table

    def counting(self, df, name):
        out = write(self, df, name)
        if name.startswith("trying-"):
            pairs = out.where("a IS NOT NULL").select("a", "b")
            tried.append((pairs.count(), pairs.distinct().count()))
        return out

    monkeypatch.setattr(jaccard.Scratch, "table", counting)
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for k in range(40):  # any two differ in one shingle too many to be a link, which sketches don't show
        own = [f"w{k}", *base[1:]]
        for place in rng.sample(range(5, 145), 2):
            own[place] = f"w{k}-{place}"
        texts.append((k, " ".join(own)))
    found = jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found.count() == len(texts) and tried
    assert sum(n for n, _ in tried) <= 3 * sum(n for _, n in tried), tried


def test_anchors_are_gone_where_contexts_are_shuffled(spark, monkeypatch):
    """The disk holds the places of repeated anchors then, not all anchors with the shuffles that led to the places."""
    there, write = [], suffix.Scratch.table

    def noting(self, df, name):
        there.extend(sorted(self.names) if name == "spans" else ())
        return write(self, df, name)

    monkeypatch.setattr(suffix.Scratch, "table", noting)
    same = " ".join(f"w{k}" for k in range(120))
    rows = [(1, same), (2, "before " + same), (3, "alone"), (4, None)]
    found = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: len(same), 2: len(same), 3: 0, 4: 0}
    assert there == ["places"]

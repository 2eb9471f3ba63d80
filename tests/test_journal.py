"""Operators on small tables with known answers, the Markdown reader, and streams."""

from __future__ import annotations

import datetime as dt
import json

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from daybook import schema
from daybook.functions import periods, text, vectors
from daybook.operators import analytics, answer, export, filters, incremental, links, lookups, model, privacy, profile, search, sequences, stats, themes
from daybook.plans import catalog
from daybook.sources import markdown, vault
from daybook.streaming import events

DATA = "/root/testdata/sf0.001"
D = dt.date


def entries_of(spark, rows):
    return spark.createDataFrame([(k, d, m, 3) for k, (d, m) in enumerate(rows, 1)], "entry_id long, entry_date date, mood_score double, word_count long")


def rows(df):
    return [tuple(r) for r in df.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- the registered queries against their SQL ---


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 8)
    return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=repr)
    found = catalog.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(([plain(x) for x in r] for r in found.select(*columns).collect()), key=repr) == want


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 10


# --- sequences and statistics ---


def test_streaks(spark):
    days = [D(2024, 1, d) for d in (1, 2, 3, 10, 11)]
    found = sequences.writing_stats(entries_of(spark, [(d, None) for d in days]), []).first().asDict()
    assert found == {"entries": 5, "words": 15, "days": 5, "longest": 3, "longest_end": D(2024, 1, 3), "current": 2, "avg_words": 3.0}
    same = sequences.streaks(entries_of(spark, [(D(2024, 1, 1), None)] * 3).select(F.col("entry_date").alias("day")).distinct(), [])
    assert same.first().longest == 1


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=25))
def test_streaks_equal_a_loop(spark, days):
    found = sequences.streaks(spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(d),) for d in days], "day date"), []).first()
    best = run = 0
    for d in sorted(days):
        run = run + 1 if d - 1 in days else 1
        best = max(best, run)
    assert (found.longest, found.current, found.days) == (best, run, len(days))


def test_even_sample_keeps_both_ends(spark):
    many = entries_of(spark, [(D(2024, 1, 1) + dt.timedelta(k), None) for k in range(23)])
    for n in (2, 5, 9):
        kept = sorted(r.entry_id - 1 for r in sequences.even_sample(many.withColumn("y", F.lit(1)), ["y"], n).collect())
        assert kept == [round(k * 22 / (n - 1)) for k in range(n)]
    assert [r.entry_id for r in sequences.even_sample(many.withColumn("y", F.lit(1)), ["y"], 1).collect()] == [23]


def test_lapsed(spark):
    dates = [D(2022, m, 1) for m in range(2, 8)]
    e = [(d, "Jun") for d in dates] + [(d, "Office") for d in dates] + [(D(2023, 1, 5), "Jun")] + [(D(2024, m, 1), "John") for m in range(3, 9)]
    ids = {"Jun": 1, "Office": 2, "John": 3}
    entities = spark.createDataFrame([(k, ids[n]) for k, (_, n) in enumerate(e, 1)], "entry_id long, note_id long")
    found = stats.lapsed_notes(entries_of(spark, [(d, None) for d, _ in e]), entities, 5, "2024-03-01")
    assert sorted(rows(found)) == [(1, 7, D(2023, 1, 5), 2022, 6), (2, 6, D(2022, 7, 1), 2022, 6)]


def test_metric_split_is_at_the_upper_median(spark):
    e = entries_of(spark, [(D(2024, 1, k), m) for k, m in enumerate((3.0, 4.0, 6.0, 7.0), 1)])
    metrics = spark.createDataFrame([(1, "s", 5.0), (2, "s", 6.0), (3, "s", 8.0), (4, "s", 7.5), (1, "ran", 1.0), (2, "ran", 0.0)], "entry_id long, key string, value double")
    found = {r.key: r for r in stats.metric_mood_split(e, metrics).collect()}
    assert (found["s"].median, found["s"].n_low, found["s"].mood_low, found["s"].n_high, found["s"].mood_high) == (7.5, 2, 3.5, 2, 6.5)
    assert (found["ran"].mood_high, found["ran"].mood_low) == (3.0, 4.0)
    assert {r.key: r.yes_no for r in stats.metric_yes_no(metrics).collect()} == {"s": False, "ran": True}


def test_property_groups_keep_empty_ones(spark):
    e = entries_of(spark, [(D(2024, 1, 1), 8.0), (D(2024, 1, 2), 8.0), (D(2024, 1, 3), 4.0), (D(2024, 1, 4), 4.0)])
    entities = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (3, 1), (4, 4)], "entry_id long, note_id long")
    properties = spark.createDataFrame([(1, "Rel", "Friend"), (1, "Rel", "School"), (2, "rel", "Family"), (3, "Rel", "Family"), (4, "Region", "North")], "note_id long, key string, value string")
    found = {r.value: (r.notes, r.entries, r.avg_mood) for r in stats.property_groups(e, entities, properties, "rel").collect()}
    assert found == {"Family": (2, 2, 8.0), "Friend": (1, 1, 4.0), "School": (1, 1, 4.0)}
    later = stats.property_groups(filters.in_range(e, D(2024, 1, 3)), entities, properties, "rel")
    assert {r.value: r.entries for r in later.collect()} == {"Family": 0, "Friend": 1, "School": 1}


def test_filters_combine_and_empty_groups_match_nothing(spark):
    e = entries_of(spark, [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.0)])
    tags = spark.createDataFrame([(1, "a"), (2, "a")], "entry_id long, tag string")
    entities = spark.createDataFrame([(2, 9)], "entry_id long, note_id long")
    nobody = entities.limit(0)
    assert filters.EntryFilter().apply(e).count() == 2
    assert [r.entry_id for r in filters.EntryFilter(tag="A", notes=entities).apply(e, tags, entities).collect()] == [2]
    assert filters.EntryFilter(group=nobody).apply(e, tags, entities).count() == 0
    assert filters.candidates(e, filters.EntryFilter(tag="a"), nobody, tags, entities).count() == 2
    assert filters.candidates(e, filters.EntryFilter(notes=nobody), None, tags, entities).count() == 0


def test_negative_limits_are_none(spark):
    e = entries_of(spark, [(D(2024, 1, k), float(k)) for k in range(1, 8)])
    assert sequences.by_mood(e, -1, True).count() == 7 and sequences.by_mood(e, 2, False).first().mood_score == 1.0


def test_member_stats_order_ties_by_first_appearance(spark):
    e = entries_of(spark, [(D(2024, 1, 15), 4.0), (D(2024, 1, 16), 8.0), (D(2024, 2, 20), 6.0)])
    tags = spark.createDataFrame([(1, "work"), (2, "work"), (2, "friends"), (3, "rest")], "entry_id long, tag string")
    found = {r.period: tuple(r)[1:] for r in stats.member_stats(e, tags, "month").collect()}
    assert found == {"2024-01": (2, 6.0, "work,friends"), "2024-02": (1, 6.0, "rest")}
    year = stats.member_stats(entries_of(spark, [(D(2023, 1, k), 2.0) for k in (1, 2, 3)] + [(D(2023, 2, 1), 8.0)]), tags, "year").first()
    assert (year.avg_mood, year.entry_count) == (3.5, 4)


# --- links ---


def test_linked_with_and_note_pairs(spark):
    john, jane, bear = 1, 2, 3
    entities = spark.createDataFrame([(1, john), (1, jane), (2, john), (2, jane), (2, bear), (3, john), (3, bear), (4, jane)], "entry_id long, note_id long")
    assert sorted(rows(links.linked_with(entities, john))) == [(jane, 2), (bear, 2)]
    assert sorted(rows(links.note_pairs(entities, 1))) == [(1, 2, 2), (1, 3, 2), (2, 3, 1)]
    nodes, edges = links.note_map(entities, 2, 1)
    assert sorted(rows(nodes)) == [(1, 3), (2, 3)] and rows(edges) == [(1, 2, 2)]


def test_learned_names(spark):
    use = [(1, 7, "Johnny"), (2, 7, "johnny"), (3, 7, "Johnny"), (1, 8, "Once"), (1, 9, "Both"), (2, 10, "Both"), (1, 7, "he"), (2, 7, "he"), (4, 5, "Mom's"), (5, 5, "Mom")]
    labels = spark.createDataFrame(use, "entry_id long, note_id long, label string")
    names = spark.createDataFrame([(1, "known", "Known")], "note_id long, key string, name string")
    found = {r.name: r.entries for r in links.learned_names(labels, names).collect()}
    assert found == {"Johnny": 3, "Mom": 2}


def test_the_longest_name_wins(spark):
    texts = spark.createDataFrame([(1, "Lunch with John Lee. Then work."), (2, "Saw JOHN at the shop"), (3, "Johnstown trip")], "text_id long, text string")
    names = spark.createDataFrame([(1, "John"), (2, "John Lee"), (3, "ab")], "note_id long, key string")
    assert sorted((r.text_id, r.note_id) for r in links.names_in(texts, names).collect()) == [(1, 2), (2, 1)]


def test_find_notes_by_tier(spark):
    titles = spark.createDataFrame([("john doe", 1), ("bear mountain", 2)], "key string, note_id long")
    names = spark.createDataFrame([(1, "john", "John"), (1, "john doe", "John Doe"), (2, "bear mountain", "Bear Mountain")], "note_id long, key string, name string")
    assert rows(links.find_notes(names, titles, "John Doe")) == [(1, 1)]
    assert rows(links.find_notes(names, titles, "john")) == [(1, 2)]
    assert rows(links.find_notes(names, titles, "mountain")) == [(2, 3)]


# --- search and themes ---


def test_a_filter_finds_what_ranks_low(spark):
    docs = spark.createDataFrame([(k, "hike " * 5 + "long way up the hill") for k in range(60)] + [(99, "a short hike among many other words that matter more")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "hike")], "query_id long, term string")
    assert 99 not in [r.doc_id for r in search.bm25(docs, asked, 10).collect()]
    only = docs.where("doc_id = 99").select("doc_id")
    assert [r.doc_id for r in search.bm25(docs, asked, 10, only).collect()] == [99]


def test_nearest_and_fusion(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(8)], "vec_id long, embedding array<float>")
    origin = spark.createDataFrame([([0.4, 0.0],)], "embedding array<float>")
    assert [r.vec_id for r in search.nearest(v, origin, 2).collect()] == [0, 1]
    ranks = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 3, 2)], "list int, doc_id long, rank int")
    found = search.fuse(ranks, 10).collect()
    assert [r.doc_id for r in found] == [2, 1, 3] and abs(found[0].score - (1 / 62 + 1 / 61)) < 1e-8


def test_best_sentence(spark):
    docs = spark.createDataFrame([(1, "We ate lunch. We hiked a glacier today. Lunch again."), (2, "Lunch was fine."), (3, "# glacier\nnothing")], "doc_id long, text string")
    found = {r.doc_id: r.sentence for r in search.best_sentences(docs, "hiking lunch glacier").collect()}
    assert found == {1: "We hiked a glacier today.", 2: "Lunch was fine."}
    assert text.stem("hiked") == text.stem("hiking") == text.stem("hikes")


def test_rerank_falls_back(spark):
    found = spark.createDataFrame([(1, "a", 1), (2, "bbb", 2)], "doc_id long, passage string, rank int")
    assert [r.doc_id for r in search.rerank(found, lambda p: [len(x) for x in p], 2).collect()] == [2, 1]
    assert [r.doc_id for r in search.rerank(found, lambda p: 1 / 0, 2).collect()] == [1, 2]


def test_themes_find_pure_groups(spark):
    import random

    rng = random.Random(1)
    v = [(10 * g + k, [(1.0 if c == g else 0.0) + rng.gauss(0, 0.05) for c in range(8)]) for g in range(3) for k in range(10)]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    found = {r.vec_id: r.theme for r in themes.group(frame, 3).collect()}
    assert [len({found[10 * g + k] for k in range(10)}) for g in range(3)] == [1, 1, 1] and len(set(found.values())) == 3
    assert found == {r.vec_id: r.theme for r in themes.group(frame, 3).collect()}
    with pytest.raises(ValueError):
        themes.group(frame.limit(19))


# --- composite analytics, privacy, increments, export ---


def test_changes(spark):
    first = entries_of(spark, [(D(2024, 1, k), 4.0) for k in range(1, 5)])
    second = first.select((F.col("entry_id") + 100).alias("entry_id"), "entry_date", "mood_score", "word_count").union(entries_of(spark, [(D(2024, 2, k), 7.0) for k in range(1, 5)]).withColumn("entry_id", F.col("entry_id") + 200))
    names = [(k, "work") for k in range(1, 5)] + [(101, "work"), (102, "work")] + [(k, "office") for k in range(1, 5)] + [(k, "jane") for k in (101, 102, 103, 104, 201)]
    counts = analytics.compare_counts(first, second, spark.createDataFrame(names, "entry_id long, name string"), "name")
    assert {r.name: r.change for r in analytics.changes(counts, "name").collect()} == {"work": "falling", "office": "gone", "jane": "new"}


def test_insights(spark):
    moods = [3.0] * 3 + [9.0] * 3 + [6.0] * 4
    e = entries_of(spark, [(D(2024, 1, 1) + dt.timedelta(k), m) for k, m in enumerate(moods)])
    tags = spark.createDataFrame([(k, t) for k in range(1, 11) for t in (["work"] if k < 4 else ["friends", "outdoors"] if k < 7 else ["misc"])], "entry_id long, tag string")
    entities = spark.createDataFrame([(4, 1), (5, 1), (6, 1)], "entry_id long, note_id long")
    notes = spark.createDataFrame([(1, "John", "people")], "note_id long, title string, kind string")
    none = spark.createDataFrame([], "note_id long, key string, value string")
    metrics = spark.createDataFrame([], "entry_id long, key string, value double")
    found = {(r.kind, r.name): r.magnitude for r in analytics.insights(e, tags, entities, notes, none, metrics).collect()}
    assert found[("tag", "work")] == -3.0 and found[("tag", "friends")] == 3.0 and ("tag", "misc") not in found
    assert found[("note", "John/people")] == 3.0 and ("together", "friends+outdoors") in found and not any(k == "weekday" for k, _ in found)


def test_withheld_rows_take_their_digests_along(spark):
    e = entries_of(spark, [(D(2024, 1, 1), 1.0), (D(2024, 2, 1), 2.0)])
    digests = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 31), "x"), (D(2024, 2, 1), D(2024, 2, 29), "y"), (D(2024, 1, 1), D(2024, 12, 31), "z")], "first_day date, last_day date, summary string")
    out = privacy.withheld_entries(spark.createDataFrame([(1, "Therapy")], "entry_id long, tag string"), ["therapy"])
    view = privacy.withhold({"entries": e, "digests": digests}, out, spark.createDataFrame([], "note_id long"))
    assert [r.entry_id for r in view["entries"].collect()] == [2] and [r.summary for r in view["digests"].collect()] == ["y"]


def test_an_empty_walk_drops_nothing(spark):
    files = spark.createDataFrame([("a.md", "1", "indexed", "entry"), ("b.md", "2", "error", "entry")], "path string, content_hash string, status string, kind string")
    listing = spark.createDataFrame([("a.md", "9", "entry"), ("c.md", "3", "entry")], "path string, content_hash string, kind string")
    assert dict(rows(incremental.plan(listing, files))) == {"a.md": "changed", "b.md": "vanished", "c.md": "new"}
    assert rows(incremental.plan(listing.limit(0), files)) == []


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    once = incremental.upsert(old, new, ["k"])
    assert sorted(rows(once)) == sorted(rows(incremental.upsert(once, new, ["k"]))) == [(1, "a"), (2, "d"), (3, "e")]


def test_csv_guards_formulas(spark, tmp_path):
    e = entries_of(spark, [(D(2024, 1, 1), 5.0)])
    out = export.csv_rows(e, spark.createDataFrame([(1, "=cmd"), (1, "b")], "entry_id long, tag string"), spark.createDataFrame([(1, "tags", 2.0)], "entry_id long, key string, value double"), ["tags", "sleep"])
    assert out.columns[-2:] == ["tags_metric", "sleep"] and out.first().tags == "'=cmd; b"
    export.write_csv(out, str(tmp_path / "x"))
    assert json.loads(export.json_lines(out).first().value)["entry_id"] == 1
    with pytest.raises(ValueError):
        export.safe_path("/vault/out.csv", "/vault")


# --- functions ---


@pytest.mark.parametrize(
    ("raw", "want"),
    [("7", 7), ("7,5", 7.5), ("-2", -2), ("7h", 7), ("30 min", 30), ("8k", 8000), ("7:30", 7.5), ("7:20", 7.33), ("true", 1), ("Yes", 1), ("false", 0), ("6-7", None), ("tired", None), ("2024-01-15", None), ("", None), (None, None)],
)
def test_metric_value(spark, raw, want):
    assert value(spark, text.metric_value(F.lit(raw).cast("string"))) == want


def test_mood_scale(spark):
    assert [value(spark, text.mood_scale(F.lit(x))) for x in ("20", "0")] == [10.0, 1.0]
    assert [value(spark, text.mood_scale(F.lit(x), 1, 5)) for x in ("1", "3", "5")] == [1.0, 5.5, 10.0]
    assert value(spark, text.mood_scale(F.lit("3/5"), 0)) == 6.4


def test_periods():
    assert periods.months_before(D(2024, 3, 31), 1) == D(2024, 2, 29) and periods.months_before(D(2024, 5, 31), 12) == D(2023, 5, 31)
    assert periods.parse("2024-3") == ("month", "2024-03") and periods.parse("2024-w3") == ("week", "2024-W03")
    assert periods.previous("month", D(2024, 1, 1)) == "2023-12" and periods.previous("week", D(2024, 1, 1)) == "2023-W52"
    assert periods.bounds("week", "2025-W01") == (D(2024, 12, 30), D(2025, 1, 5))
    assert periods.title("range", "2024-03-02..2024-03-11") == "2 to 11 March 2024"
    assert periods.title("week", "2024-W10") == "Week 10 of 2024" and periods.months_before(D(2024, 1, 31), 2) == D(2023, 11, 30)
    for months in range(40):
        assert periods.months_before(D(2024, 12, 1), months) == D(2024 - (months // 12), 12 - months % 12, 1)
    for bad in ("2024-13", "soon", "2024-01-01..2024-12-31", "2024-01-05..2024-01-02"):
        with pytest.raises(ValueError):
            periods.parse(bad)


@pytest.mark.parametrize(
    ("question", "want"),
    [("What on 2024-01-15?", D(2024, 1, 15)), ("January 15, 2024", D(2024, 1, 15)), ("on March 3rd", D(2024, 3, 3)), ("yesterday?", D(2024, 6, 14)), ("since March 3rd", None), ("December 20", D(2023, 12, 20)), ("nothing", None), ("3 March", D(2024, 3, 3))],
)
def test_explicit_day(question, want):
    assert periods.explicit_day(question, D(2024, 6, 15)) == want


def test_link_columns(spark):
    note = F.lit("With [[Folder/John Doe.md|Johnny]] at [[Bear Mountain#Top]], ![[a.PNG]] and ![x](pic%20one.jpg) ![y](http://z/w.png) #Fun #12 a#b %%#no%%")
    assert value(spark, text.link_keys(note)) == ["john doe", "bear mountain"]
    assert [tuple(x) for x in value(spark, text.link_labels(note))] == [("john doe", "Johnny")]
    assert [tuple(x) for x in value(spark, text.link_anchors(note))] == [("bear mountain", "Top")]
    assert value(spark, text.image_names(note)) == ["a.PNG", "pic one.jpg"]
    assert value(spark, text.literal_tags(text.strip_comments(note))) == ["fun"]
    assert value(spark, text.final_tags(F.array(F.lit("#Work"), F.lit("x")), F.array(F.lit("job")), {"job": "work"}, ("x",))) == ["work"]
    with pytest.raises(ValueError):
        text.resolve_merges({"a": "b", "b": "a"})


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.l2(a, b)) == 5.0 and value(spark, vectors.unit(a)) == [0.6, 0.8] and value(spark, vectors.unit(b)) is None


# --- Markdown, vault, models, answers ---

PLAIN = "Went hiking with [[Jane Roe|Jane]] at [[High Lake]].\n\n- [x] pack\n- [ ] call\n\nTalked about the [[garden]]. #hiking #friends\n"


def test_markdown_entries():
    found = markdown.entries("2024-01-15.md", PLAIN)[0]
    assert found["entry_date"] == D(2024, 1, 15) and found["tags"] == ["hiking", "friends"]
    assert found["links"] == ["jane roe", "high lake", "garden"] and "- pack" in found["raw_text"] and "with Jane at High Lake." in found["raw_text"]
    head = markdown.entries("x.md", "---\ndate: 2024-01-16\nmood: tired\ntags: [work, b]\nprivate: yes\n---\nLong day #work")[0]
    assert head["entry_date"] == D(2024, 1, 16) and head["tags"] == ["work", "b"] and head["private"]
    both = markdown.entries("log.md", "# Log\n\n## 2024-02-01\n\nOne.\n\n## 2024-02-02\n\nTwo.\n")
    assert [(e["entry_date"].day, e["raw_text"]) for e in both] == [(1, "One."), (2, "Two.")]
    assert markdown.entries("undated.md", "no day here") == [] and markdown.header("---\nopen: 1\ntext")[0] == {}


def test_keys_of_links_and_titles_meet(spark):
    for name in ("Straße", "ΟΔΟΣ", "Ödön", "İz", "plain"):
        assert value(spark, text.folded(F.lit(name))) == markdown.link_key(name) == value(spark, text.link_key(F.lit(name))) == name.casefold()
    assert markdown.link_key("a/B.md#x|y") == "b" and markdown.link_key("p.PNG") is None and markdown.link_key("#top") is None


def test_near_keys_lose_no_pair(spark):
    import random

    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(120)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.7, 0.8):
        found = {(r.a, r.b): r.distance for r in links.near_keys(spark.createDataFrame([(w,) for w in words], "key string"), least).collect()}
        long_ = sorted(w for w in words if len(w) >= 4)
        want = {(a, b): d for i, a in enumerate(long_) for b in long_[i + 1 :] if (d := distance(a, b)) <= int((1 - least) * max(len(a), len(b)) + 1e-9)}
        assert found == want and len(want) > 20


def test_similar_tags(spark):
    tags = spark.createDataFrame([(t,) for t in "hike hikes city cities run running photo photography colour color walk work Hike bus".split()], "tag string")
    found = {(r.a, r.b): r.why for r in links.similar_tags(tags).collect()}
    assert found == {("hike", "hikes"): "prefix", ("cities", "city"): "plural", ("photo", "photography"): "prefix", ("color", "colour"): "letters"} | {("hike", "hikes"): found["hike", "hikes"]}


def test_clean_gives_places_in_the_clean_text():
    words, places = markdown.clean("a [[X|y]] b ![[p.png]] [[Z#H]] [[Q#^id]]")
    assert words == "a y b  Z > H Q" and [(words[k:], key) for k, key in places][0] == ("y b  Z > H Q", "x")


def test_sections():
    long = "word " * 60
    note = f"intro\n# Morning\n{long}\n# Short\nx\n# Work\n{long}\n```\n# code\n```\n"
    assert [s[0] for s in markdown.sections(note)] == ["Morning", "Work"]
    assert markdown.sections("# One\n" + long) == []
    assert markdown.find_section("# A\nx\n## B\ny\n# C\nz", "A#B") == "## B\ny"
    assert markdown.find_section("one\ntwo ^id\n\nthree", "^id") == "one\ntwo"


def test_vault(spark, tmp_path):
    (tmp_path / "Links/People").mkdir(parents=True)
    (tmp_path / "2024-01-15.md").write_text(PLAIN)
    (tmp_path / "2024-01-16.md").write_text("secret #private")
    (tmp_path / "skip.md").write_text("2024-01-01 x")
    (tmp_path / "Links/People/Jane Roe.md").write_text("---\naliases:\n  - Jane\nRelation: Friend\n---\nKeeps bees, see [[High Lake]]. ![[j.jpg]]")
    rules = markdown.Rules(private_tags=("private",), ignore=("skip.md",))
    files = vault.listing(spark, str(tmp_path), rules)
    assert {r.path: r.kind for r in files.collect()} == {"2024-01-15.md": None, "2024-01-16.md": None, "Links/People/Jane Roe.md": "people"}
    e, n = vault.entries(files, rules), vault.notes(files, rules)
    assert [r.path for r in e.collect()] == ["2024-01-15.md"]
    one = n.first()
    assert (one.title, one.aliases, one.properties) == ("Jane Roe", ["Jane"], {"Relation": ["Friend"]})
    tables = vault.child_tables(e, n)
    targets = links.link_targets(tables["titles"], tables["note_names"])
    assert links.resolve(tables["entry_links"], targets).count() == 1
    assert {r.key for r in tables["note_names"].collect()} == {"jane roe", "jane"}


def test_models_are_remembered(spark):
    class Failing(model.Offline):
        def complete(self, prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return super().complete(prompt)

    prompts = spark.createDataFrame([(1, "One. Two."), (2, "bad")], "id long, prompt string")
    found = {r.id: r for r in model.call(prompts, Failing(), "text").collect()}
    assert json.loads(found[1].value)["summary"] == "One." and found[2].error == "no"
    memo = model.remember(schema.empty(spark, "memo"), model.call(prompts.where("id = 1"), Failing(), "text"), "text", "offline")
    assert memo.count() == 1
    again = model.call(prompts, Failing(), "text", memo)
    assert again.where("value IS NOT NULL").count() == 1
    assert model.readings(spark.createDataFrame([(1, "A day.")], "entry_id long, raw_text string")).first().summary == "A day."
    assert model.digests(spark.createDataFrame([(1, D(2024, 1, 2), "b."), (1, D(2024, 1, 1), "a.")], "period_id long, day date, line string")).first().summary == "a."


def test_answers(spark):
    plan = answer.route("How often did I hike in 2024-03?", D(2024, 6, 1))
    assert plan.intent == "aggregate" and (plan.since, plan.until) == (D(2024, 3, 1), D(2024, 3, 31))
    assert answer.Plan(since=D(2024, 2, 1), until=D(2024, 1, 1)).since == D(2024, 1, 1)
    assert answer.fit(["aaa", "bbbbbb", "cc"], 5) == ["aaa", "cc"]
    assert answer.digest_kind(D(2024, 1, 1), D(2024, 1, 5)) is None and answer.digest_kind(D(2023, 1, 1), D(2024, 12, 31)) == "year"
    for pieces, want in ((("a<th", "ink>no</thi", "nk>b", "<", "c"), "ab<c"), (("<THINK>a</THINK>b",), "b"), (("x<Think>y", "z"), "x"), (("1 < 2 <thi",), "1 < 2 <thi"), ((), "")):
        assert "".join(answer.without_thoughts(pieces)) == want
    e = spark.createDataFrame([(1, D(2024, 3, 1), "a hike up"), (2, D(2024, 4, 1), "a hike down"), (3, D(2024, 3, 2), "home")], "entry_id long, entry_date date, text string")
    assert [r.entry_id for r in answer.retrieve(answer.route("the hike in 2024-03", D(2024, 6, 1)), e).collect()] == [1]
    day = answer.route("did I hike on 2024-03-02?", D(2024, 6, 1))
    assert [r.entry_id for r in answer.retrieve(day, e).collect()] == [3]
    found = answer.retrieve(answer.Plan(keywords=["hike"]), e)
    assert [r.entry_id for r in answer.with_day(found, e, D(2024, 3, 2)).collect()][0] == 3 and answer.with_day(found, e, D(2024, 3, 1)).count() == 2
    assert answer.cited("on 2024-03-01 and 2024-99-99", [D(2024, 3, 1), D(2024, 3, 2)]) == [D(2024, 3, 1)]


def test_schemas(spark):
    for name in schema.TABLES:
        assert schema.empty(spark, name).columns == [c for c, _ in schema.fields(name)]


# --- streams ---


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    stream = events.read_events(spark, folder, batch.schema)
    query = events.tumbling(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted((r.start, r.event_type, r.n, r.cents) for r in events.tumbling(batch).collect())
    assert sorted((r.start, r.event_type, r.n, r.cents) for r in spark.table("tumbled").collect()) == want


def test_batches_are_applied_once(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        events.apply_batches(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(rows(events.applied(spark, str(tmp_path / "out"), ["k"]))) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    events.apply_batches(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(rows(events.applied(spark, str(tmp_path / "out"), ["k"]))) == [(1, "a"), (2, "c"), (3, "d")]
    events.compact(spark, str(tmp_path / "out"), ["k"], str(tmp_path / "base"))
    assert sorted(rows(events.applied(spark, str(tmp_path / "base"), ["k"]))) == [(1, "a"), (2, "c"), (3, "d")]


# --- lookups, profile, themes' later steps, answers ---


def test_snippets_and_globs(spark):
    long_ = "word " * 50
    docs = [(1, "One. Two with Key in it! Three"), (2, f"{long_}key {long_}"), (3, "none"), (4, None), (5, "key")]
    found = {r.k: r.s for r in spark.createDataFrame(docs, "k int, t string").select("k", lookups.snippet(F.col("t"), F.lit("key")).alias("s")).collect()}
    assert found[1] == "Two with Key in it!" and found[3] is None and found[4] is None and found[5] == "key"
    assert found[2].startswith("key word") and found[2].endswith("…") and len(found[2]) <= 160
    paths = spark.createDataFrame([(p,) for p in ("a.md", "x/a.md", "x/y/a.md", "x/ab.md")], "path string")
    for pattern, want in (("*.md", {"a.md"}), ("**/a.md", {"a.md", "x/a.md", "x/y/a.md"}), ("x/*.md", {"x/a.md", "x/ab.md"}), ("x/a?.md", {"x/ab.md"})):
        assert {r.path for r in lookups.glob_match(paths, pattern).collect()} == want
    assert lookups.date_format("YYYY-MM-DD [at] HH") == "%Y-%m-%d at %H"


def test_targeted_runs_and_queues(spark):
    listing = spark.createDataFrame([("n/a.md", "h", "note"), ("e/1.md", "h", None), ("e/2.md", "h", None), ("f.md", "h", None)], "path string, content_hash string, kind string")
    assert {r.path for r in incremental.targeted(listing, ["e/", "f.md"]).collect()} == {"e/1.md", "e/2.md", "f.md"}
    files = spark.createDataFrame([("e/1.md", "h", "indexed", None)], "path string, content_hash string, status string, kind string")
    todo = incremental.plan(listing, files)
    assert [r.path for r in incremental.backfill_order(todo, listing).collect()] == ["n/a.md", "e/2.md", "f.md"]
    parts_ = spark.createDataFrame([("e/2.md", 3, 1), ("e/1.md", 5, 5)], "path string, sections int, photos int")
    assert rows(incremental.call_counts(todo, parts_)) == [(1, 6)]
    now = dt.datetime(2024, 1, 1, 12)
    waiting = spark.createDataFrame([("a", "modify", now, 0)], "path string, kind string, ts timestamp, attempts int")
    failed = spark.createDataFrame([("a", "delete", 0), ("b", "modify", 2)], "path string, kind string, attempts int")
    queue = {r.path: (r.kind, r.attempts, r.ts) for r in incremental.requeue(waiting, failed, now).collect()}
    assert queue["a"][0] == "modify" and queue["b"][:2] == ("modify", 3) and (queue["b"][2] - queue["a"][2]).total_seconds() == 120
    assert {r.path for r in incremental.expand_delete(files, "e", listing.where("path <> 'e/1.md'")).collect()} == {"e/1.md"}
    assert incremental.expand_delete(files, "e", listing.limit(0)).count() == 0
    assert incremental.due(None, now) and not incremental.due(now, now) and not incremental.due(None, now, waiting=1)


def test_meta_and_settings(spark):
    meta = spark.createDataFrame([("a", "1")], "key string, value string")
    meta = incremental.set_meta(meta, "embed_model", "m/8")
    assert incremental.get_meta(meta, "embed_model") == "m/8" and incremental.get_meta(meta, "none") is None
    incremental.check_model(meta, "m", 8)
    with pytest.raises(ValueError):
        incremental.check_model(meta, "m", 9)
    meta = incremental.set_meta(meta, "settings.photos", incremental.fingerprint({"on": True}))
    assert incremental.changed_settings(meta, {"photos": {"on": True}, "links": {}}) == ["links"]


def test_profile_is_folded_in_batches(spark):
    entries = spark.createDataFrame([("h1", D(2024, 1, 1)), ("h2", D(2024, 1, 2))], "text_hash string, entry_date date")
    found = spark.createDataFrame([("h1", D(2024, 1, 1), "c", "Likes tea"), ("h1", D(2024, 1, 1), "c", "likes TEA "), ("h2", D(2024, 1, 3), "c", "wrong day"), ("h2", D(2024, 1, 2), "c", "Runs")], "text_hash string, entry_date date, category string, fact string")
    facts = profile.add_facts(found.limit(0).withColumn("folded", F.lit(False)), found, entries)
    assert facts.count() == 2 and profile.add_facts(facts, found, entries).count() == 2
    calls = []
    text_, facts = profile.fold(facts, "", lambda p, f: calls.append(f) or (p + "+".join(f)), 1)
    assert len(calls) == 2 and facts.where("folded").count() == 2 and not profile.needs_update(facts).first().needed
    assert profile.prune(facts, entries.where("text_hash = 'h2'")).count() == 1


def test_themes_are_kept_and_named(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    middles = np.eye(4)[:3]
    vectors = [(k, [float(x) for x in middles[k % 3] + rng.normal(0, 0.05, 4)]) for k in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    placed = themes.group(frame, 3)
    found = {r.vec_id: r.theme for r in placed.collect()}
    for a in range(60):
        assert found[a] == found[a % 3]
    assert len(set(found.values())) == 3
    themes.persist(placed, frame, str(tmp_path))
    kept = spark.read.parquet(str(tmp_path / "themes"))
    assert kept.count() == 3 and all(len(r.named_from) == 8 and len(r.centroid) == 4 for r in kept.collect())
    entries = spark.createDataFrame([(k, D(2024, 1, 1 + k % 20), f"summary {k}") for k in range(60)], "entry_id long, entry_date date, summary string")
    tags = spark.createDataFrame([(k, f"tag{k % 3}") for k in range(60)], "entry_id long, name string")
    names = {r.theme: r.name for r in themes.named(placed, tags, tags, entries, lambda prompt: '"Walks."' if int(prompt.split()[1]) % 3 == 0 else 1 / 0).collect()}
    assert "Walks" in names.values() and sum(n.startswith("tag") for n in names.values()) == 2


def test_models_retry_and_check_replies(spark):
    class Flaky:
        name = "flaky"

        def __init__(self):
            self.calls = 0

        def complete(self, prompt):
            self.calls += 1
            if self.calls < 3:
                raise ConnectionError
            return '{"mood": "high"}' if "usable" not in prompt else '{"mood": 7}'

    client = model.Retrying(Flaky(), pause=0)
    assert model.structured(client, "x", {"mood": int}) == {"mood": 7}
    with pytest.raises(ValueError):
        model.structured(model.Offline(), "x", {"mood": int})
    with pytest.raises(ConnectionError):
        model.Retrying(Flaky(), attempts=2, pause=0).complete("x")
    notes = spark.createDataFrame([(1, "a  short\nnote"), (2, "Long one. " * 60)], "note_id long, raw_text string")
    assert {r.note_id: r.summary for r in model.note_summaries(notes).collect()} == {1: "a short note", 2: "Long one."}
    vectors_ = model.embeddings(spark.createDataFrame([(1, "s", "text")], "id long, summary string, text string"))
    assert len(vectors_.first().embedding) == 8
    photos = spark.createDataFrame([(1, k, f"p{k}", 10**8 if k == 0 else 10) for k in range(7)], "entry_id long, place int, path string, bytes long")
    assert [r.path for r in model.photos_to_describe(photos).orderBy("path").collect()] == ["p1", "p2", "p3", "p4"]


def test_functions_in_sql(spark):
    names = model.register(spark)
    row = spark.sql("SELECT week_key(DATE '2024-12-30') AS w, month_key(DATE '2024-12-30') AS m, round(vec_distance_cosine(array(1D, 0D), array(0D, 2D)), 6) AS d, word_stem('hiking') AS s, text_sentences('A b. C!') AS t").first()
    assert (row.w, row.m, row.d, row.s, row.t) == ("2025-W01", "2024-12", 1.0, "hik", ["A b.", "C!"]) and len(names) == 7


def test_answers_from_context_to_sources(spark):
    entries = spark.createDataFrame([(1, D(2024, 3, 1), "A hike up Bear Mountain.", "Hiked."), (2, D(2024, 3, 2), "home", "Rest.")], "entry_id long, entry_date date, text string, summary string")
    notes = spark.createDataFrame([("Bear Mountain", "A hill."), ("Other", "x")], "title string, summary string")

    class Model:
        name, seen = "m", []

        def complete(self, prompt):
            self.seen.append(prompt)
            return "<think>hm</think>INSUFFICIENT" if "Hiked." in prompt and "A hike up" not in prompt else "You hiked bear mountain on 2024-03-01."

    stage, said = answer.answer("Where did I hike in 2024-03?", entries, Model(), D(2024, 6, 1), notes=notes)
    assert stage == "precise" and said.endswith("Sources: 2024-03-01, Bear Mountain")
    assert answer.answer("what happened in 2020?", entries, Model(), D(2024, 6, 1))[0] == "none"
    digests = spark.createDataFrame([("week", f"2024-W{k:02d}", f"w{k}", D(2024, 1, 1) + dt.timedelta(7 * k)) for k in range(1, 16)], "period_type string, period_key string, summary string, last_day date")
    plan = answer.Plan(since=D(2024, 1, 1), until=D(2024, 2, 25))
    assert [r.summary for r in answer.digests_for(plan, digests).collect()] == [f"w{k}" for k in range(1, 8)]
    assert "(2024-W01) w1" in answer.summary_context(plan, entries, digests, notes)
    assert answer.rewritten("and then?", [], None) == "and then?"
    assert answer.listed("1. One\n- Two\n\n* One") == ["One", "Two"]
    assert answer.prompts_context(entries, D(2024, 3, 14), 12).count() == 1


def test_headers_images_and_app_settings(spark, tmp_path):
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian/daily-notes.json").write_text('{"format": "YYYY/DD.MM.YYYY", "template": "T/day"}')
    (tmp_path / ".obsidian/app.json").write_text('{"userIgnoreFilters": ["Old/"]}')
    assert vault.app_settings(str(tmp_path))["ignore"] == ["Old/"] and vault.app_settings(str(tmp_path / "none")) == {}
    assert [a.split(":")[0] for a in vault.advice(str(tmp_path), markdown.Rules())] == ["daily notes are named YYYY/DD.MM.YYYY", "T/day is no daily note", "Old/ is no daily note"]
    files = spark.createDataFrame([("a.md", "---\nmood: 3\n---\nbody\n---\nmore: 4\n---"), ("b.md", "no header"), ("c.md", None)], "path string, text string")
    assert {r.path: r.frontmatter for r in vault.headers(files).collect()} == {"a.md": {"mood": ["3"]}, "b.md": {}, "c.md": {}}
    found = spark.createDataFrame([("x/y/p.png",), ("z/p.png",), (".trash/q.png",), ("img/q.PNG",)], "path string")
    names = spark.createDataFrame([("p.png",), ("x/y/p.png",), ("q.png",), ("none.png",)], "name string")
    assert {r.name: r.path for r in vault.images(names, found).collect()} == {"p.png": "z/p.png", "x/y/p.png": "x/y/p.png", "q.png": "img/q.PNG"}
    assert value(spark, text.relative_path(F.lit("/v/a/b.md"), "/v")) == "a/b.md" and value(spark, text.relative_path(F.lit("/w/b.md"), "/v")) is None
    assert value(spark, text.app_url("My Vault", F.lit("a b/ü.md"))) == "obsidian://open?vault=My%20Vault&file=a%20b%2F%C3%BC"

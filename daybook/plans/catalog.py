"""The registered queries of the journal operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.periods import day_key, month_key, months_between, week_key, year_key
from ..operators import analytics, export, filters, incremental, links, lookups, privacy, search, sequences, stats, themes
from ..sources.journal import Journal
from ..streaming import events as streams
from .registry import NOTE, QUESTION, SINCE, UNTIL, avg, oracle_sql, queries, query, with_views

# --- statistics of entries ---


@query("monthly_mood", f"SELECT strftime(entry_date, '%Y-%m') AS month, {avg('mood_score')} AS avg_mood, count(*) AS entry_count FROM entries GROUP BY 1", "entries")
def _(j):
    return stats.monthly_mood(j.entries)


@query(
    "monthly_mood_for_note_kind",
    f"SELECT strftime(entry_date, '%Y-%m') AS month, {avg('mood_score')} AS avg_mood, count(*) AS entry_count FROM entries WHERE entry_id IN (SELECT entry_id FROM entry_entities JOIN notes USING (note_id) WHERE kind = 'promo') GROUP BY 1",
    "entries", "notes", "entry_entities",
)
def _(j):
    of = filters.EntryFilter(notes=j.notes.where("kind = 'promo'"))
    return stats.monthly_mood(of.apply(j.entries, j.entry_tags, j.entry_entities))


@query(
    "filtered_entries",
    f"SELECT entry_id, entry_date FROM entries WHERE entry_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' AND entry_id IN (SELECT entry_id FROM entry_tags WHERE tag = 'r') AND entry_id IN (SELECT entry_id FROM entry_entities JOIN property_values USING (note_id) WHERE key = 'brand' AND lower(value) = 'brand#4')",
    "entries", "entry_tags", "entry_entities", "property_values",
)
def _(j):
    of = filters.EntryFilter(tag="R", group=filters.group_members(j.property_values, "Brand", "brand#4"))
    return of.apply(filters.in_range(j.entries, SINCE, UNTIL), j.entry_tags, j.entry_entities).select("entry_id", "entry_date")


@query("candidate_ids", "SELECT entry_id FROM entries WHERE entry_id IN (SELECT entry_id FROM entry_tags WHERE tag = 'a')", "entries", "entry_tags")
def _(j):
    nobody = j.notes.where("note_id < 0")
    return filters.candidates(j.entries, filters.EntryFilter(tag="a"), nobody, j.entry_tags, j.entry_entities).select("entry_id")


@query("overall_mood", f"SELECT {avg('mood_score')} AS avg_mood, count(mood_score) AS n FROM entries", "entries")
def _(j):
    return stats.overall_mood(j.entries)


@query("weekday_mood", f"SELECT CAST(dayofweek(entry_date) AS INTEGER) AS weekday, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries WHERE mood_score IS NOT NULL GROUP BY 1", "entries")
def _(j):
    return stats.weekday_mood(j.entries)


@query("month_of_year_mood", f"SELECT CAST(month(entry_date) AS INTEGER) AS month, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries WHERE mood_score IS NOT NULL GROUP BY 1", "entries")
def _(j):
    return stats.month_of_year_mood(j.entries)


@query("date_bounds", "SELECT min(entry_date) AS first_date, max(entry_date) AS last_date FROM entries", "entries")
def _(j):
    return stats.date_bounds(j.entries)


@query("entries_in_range", f"SELECT entry_id, entry_date, mood_score FROM entries WHERE entry_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'", "entries")
def _(j):
    return filters.in_range(j.entries, SINCE, UNTIL).select("entry_id", "entry_date", "mood_score")


@query("tag_mood", f"SELECT tag, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries JOIN entry_tags USING (entry_id) WHERE mood_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 3", "entries", "entry_tags")
def _(j):
    return stats.tag_mood(j.entries, j.entry_tags)


@query("note_mood", f"SELECT title, kind, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries JOIN entry_entities USING (entry_id) JOIN notes USING (note_id) WHERE mood_score IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3", "entries", "entry_entities", "notes")
def _(j):
    return stats.note_mood(j.entries, j.entry_entities, j.notes)


@query(
    "group_mood",
    f", g AS (SELECT DISTINCT key, value, entry_id FROM property_values JOIN entry_entities USING (note_id)), big AS (SELECT key, value FROM property_values GROUP BY 1, 2 HAVING count(DISTINCT note_id) >= 2) SELECT key, value, count(*) AS n, {avg('mood_score')} AS avg_mood FROM g JOIN big USING (key, value) JOIN entries USING (entry_id) WHERE mood_score IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    "entries", "entry_entities", "property_values",
)
def _(j):
    return stats.group_mood(j.entries, j.entry_entities, j.property_values)


@query(
    "property_groups",
    f", g AS (SELECT DISTINCT value, entry_id FROM property_values JOIN entry_entities USING (note_id) WHERE key = 'brand'), f AS (SELECT value, count(*) AS entries, {avg('mood_score')} AS avg_mood, min(entry_date) AS first_date, max(entry_date) AS last_date FROM g JOIN entries USING (entry_id) WHERE entry_date BETWEEN DATE '1997-01-01' AND DATE '1997-01-03' GROUP BY 1) SELECT p.value, p.notes, coalesce(f.entries, 0) AS entries, f.avg_mood, f.first_date, f.last_date FROM (SELECT value, count(DISTINCT note_id) AS notes FROM property_values WHERE key = 'brand' GROUP BY 1) p LEFT JOIN f ON f.value = p.value",
    "entries", "entry_entities", "property_values",
)
def _(j):
    return stats.property_groups(filters.in_range(j.entries, "1997-01-01", "1997-01-03"), j.entry_entities, j.property_values, "Brand")


@query("property_keys", "SELECT lower(key) AS key, min(key) AS name, count(DISTINCT note_id) AS notes, count(DISTINCT value) AS n_values FROM property_values GROUP BY 1", "property_values")
def _(j):
    return stats.property_keys(j.property_values)


@query("property_listing", "SELECT a.note_id, a.key, a.value, b.notes FROM property_values a JOIN (SELECT key, value, count(DISTINCT note_id) AS notes FROM property_values GROUP BY 1, 2) b ON a.key = b.key AND a.value = b.value", "property_values")
def _(j):
    shared = j.property_values.groupBy("key", "value").agg(F.countDistinct("note_id").alias("notes"))
    return j.property_values.join(shared, ["key", "value"]).select("note_id", "key", "value", "notes")


@query("tag_stats", f"SELECT tag, count(*) AS n, {avg('mood_score')} AS avg_mood, count(mood_score) AS scored, min(entry_date) AS first_date, max(entry_date) AS last_date FROM entry_tags JOIN entries USING (entry_id) GROUP BY 1", "entries", "entry_tags")
def _(j):
    return stats.tag_stats(j.entries, j.entry_tags)


@query("top_tags", "SELECT tag, count(*) AS n FROM entry_tags JOIN entries USING (entry_id) GROUP BY 1 ORDER BY n DESC, tag LIMIT 5", "entries", "entry_tags")
def _(j):
    return stats.top_tags(j.entries, j.entry_tags, 5)


@query("top_notes", "SELECT title, kind, count(*) AS n, min(note_id) AS note_id FROM entry_entities JOIN entries USING (entry_id) JOIN notes USING (note_id) GROUP BY 1, 2 ORDER BY n DESC, title, kind LIMIT 20", "entries", "entry_entities", "notes")
def _(j):
    return stats.top_notes(j.entries, j.entry_entities, j.notes, 20)


@query("kinds", "SELECT kind, count(*) AS n FROM notes GROUP BY 1", "notes")
def _(j):
    return stats.kinds(j.notes)


@query("mention_stats", "SELECT note_id, count(*) AS mentions, min(entry_date) AS first_date, max(entry_date) AS last_date FROM entry_entities JOIN entries USING (entry_id) GROUP BY 1", "entries", "entry_entities")
def _(j):
    return stats.mention_stats(j.entries, j.entry_entities)


@query("mentions_by_year", "SELECT note_id, CAST(year(entry_date) AS INTEGER) AS year, count(*) AS n FROM entry_entities JOIN entries USING (entry_id) GROUP BY 1, 2", "entries", "entry_entities")
def _(j):
    return stats.mentions_by_year(j.entries, j.entry_entities)


@query("notes_from_entries", f"SELECT note_id, count(*) AS n FROM entry_entities WHERE entry_id IN (SELECT entry_id FROM entries WHERE entry_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}') GROUP BY 1 ORDER BY n DESC, note_id LIMIT 25", "entries", "entry_entities")
def _(j):
    return stats.notes_from_entries(j.entry_entities, filters.in_range(j.entries, SINCE, UNTIL), 25)


@query(
    "lapsed_notes",
    ", y AS (SELECT note_id, year(entry_date) AS year, count(*) AS n, max(entry_date) AS last FROM entry_entities JOIN entries USING (entry_id) GROUP BY 1, 2) SELECT note_id, CAST(sum(n) AS BIGINT) AS links, max(last) AS last_date, CAST(arg_max(year, n * 10000 + year) AS INTEGER) AS busiest_year, CAST(max(n) AS BIGINT) AS busiest_links FROM y GROUP BY 1 HAVING sum(n) >= 5 AND max(last) < DATE '2001-01-01'",
    "entries", "entry_entities",
)
def _(j):
    return stats.lapsed_notes(j.entries, j.entry_entities, 5, "2001-01-01")


@query(
    "first_linked_in",
    "SELECT note_id, min(entry_date) AS first_date, CAST(count(*) FILTER (entry_date <= DATE '1996-12-31') AS BIGINT) AS n FROM entry_entities JOIN entries USING (entry_id) GROUP BY 1 HAVING min(entry_date) BETWEEN DATE '1995-06-01' AND DATE '1996-12-31'",
    "entries", "entry_entities",
)
def _(j):
    return stats.first_linked_in(j.entries, j.entry_entities, "1995-06-01", "1996-12-31")


@query("cache_stats", "SELECT 'entries' AS name, count(*) AS n FROM entries UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'links', count(*) FROM entry_entities UNION ALL SELECT 'tags', count(DISTINCT tag) FROM entry_tags UNION ALL SELECT 'metrics', count(*) FROM entry_metrics", "entries", "notes", "entry_entities", "entry_tags", "entry_metrics")
def _(j):
    return stats.cache_stats({"entries": j.entries, "notes": j.notes, "links": j.entry_entities, "tags": j.entry_tags.select("tag").distinct(), "metrics": j.entry_metrics})


# --- metrics ---


@query("metric_summary", f"SELECT key, count(*) AS n, min(value) AS least, max(value) AS most, {avg('value')} AS average, min(entry_date) AS first_date, max(entry_date) AS last_date FROM entry_metrics JOIN entries USING (entry_id) GROUP BY 1", "entries", "entry_metrics")
def _(j):
    return stats.metric_summary(j.entries, j.entry_metrics)


@query("monthly_metric", f"SELECT strftime(entry_date, '%Y-%m') AS month, {avg('value')} AS average, count(*) AS n FROM entry_metrics JOIN entries USING (entry_id) WHERE key = 'quantity' GROUP BY 1", "entries", "entry_metrics")
def _(j):
    return stats.monthly_metric(j.entries, j.entry_metrics, "quantity")


@query("monthly_mood_with_metric", f"SELECT strftime(entry_date, '%Y-%m') AS month, {avg('mood_score')} AS avg_mood, count(*) AS entry_count FROM entries WHERE entry_id IN (SELECT entry_id FROM entry_metrics WHERE key = 'lines') GROUP BY 1", "entries", "entry_metrics")
def _(j):
    return stats.monthly_mood(j.entries.join(j.entry_metrics.where("key = 'lines'"), "entry_id", "left_semi"))


@query("metric_days", f"SELECT entry_date, {avg('value')} AS value, min(entry_id) AS entry_id FROM entry_metrics JOIN entries USING (entry_id) WHERE key = 'quantity' GROUP BY 1", "entries", "entry_metrics")
def _(j):
    return stats.metric_days(j.entries, j.entry_metrics, "quantity")


@query("metric_averages", f"SELECT key, {avg('value')} AS average, count(*) AS n FROM entry_metrics JOIN entries USING (entry_id) WHERE entry_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY 1", "entries", "entry_metrics")
def _(j):
    return stats.metric_summary(filters.in_range(j.entries, SINCE, UNTIL), j.entry_metrics).select("key", "average", "n")


@query("entries_by_metric", "SELECT entry_id, entry_date, value FROM entry_metrics JOIN entries USING (entry_id) WHERE key = 'quantity' ORDER BY value DESC, entry_date, entry_id LIMIT 30", "entries", "entry_metrics")
def _(j):
    return stats.entries_by_metric(j.entries, j.entry_metrics, "quantity", 30)


@query("metric_yes_no", "SELECT key, bool_and(value IN (0, 1)) AS yes_no FROM entry_metrics GROUP BY 1", "entry_metrics")
def _(j):
    return stats.metric_yes_no(j.entry_metrics)


@query("metric_mood_pairs", "SELECT entry_id, value, mood_score FROM entry_metrics JOIN entries USING (entry_id) WHERE key = 'lines' AND mood_score IS NOT NULL", "entries", "entry_metrics")
def _(j):
    return j.entry_metrics.where("key = 'lines'").join(stats.scored(j.entries), "entry_id").select("entry_id", "value", "mood_score")


SPLIT = f""", p AS (SELECT key, value, mood_score FROM entry_metrics JOIN entries USING (entry_id) WHERE mood_score IS NOT NULL),
m AS (SELECT key, list_sort(list(value))[count(*) // 2 + 1] AS median FROM p GROUP BY 1),
split AS (SELECT key, median, count(*) FILTER (value < median) AS n_low, {avg("CASE WHEN value < median THEN mood_score END")} AS mood_low,
  count(*) FILTER (value >= median) AS n_high, {avg("CASE WHEN value >= median THEN mood_score END")} AS mood_high FROM p JOIN m USING (key) GROUP BY 1, 2)"""


@query("metric_mood_split", SPLIT + " SELECT * FROM split", "entries", "entry_metrics")
def _(j):
    return stats.metric_mood_split(j.entries, j.entry_metrics)


# --- order and sequence ---


@query("best_days", "SELECT entry_id, entry_date, mood_score FROM entries WHERE mood_score IS NOT NULL ORDER BY mood_score DESC, entry_date, entry_id LIMIT 20", "entries")
def _(j):
    return sequences.by_mood(j.entries, 20, True).select("entry_id", "entry_date", "mood_score")


@query("hardest_days", "SELECT entry_id, entry_date, mood_score FROM entries WHERE mood_score IS NOT NULL ORDER BY mood_score, entry_date, entry_id LIMIT 20", "entries")
def _(j):
    return sequences.by_mood(j.entries, 20, False).select("entry_id", "entry_date", "mood_score")


@query("best_days_per_month", "SELECT month, entry_id, rank FROM (SELECT strftime(entry_date, '%Y-%m') AS month, entry_id, CAST(row_number() OVER (PARTITION BY strftime(entry_date, '%Y-%m') ORDER BY mood_score DESC, entry_date, entry_id) AS INTEGER) AS rank FROM entries WHERE mood_score IS NOT NULL) WHERE rank <= 3", "entries")
def _(j):
    return sequences.best_per(j.entries.withColumn("month", month_key(F.col("entry_date"))), ["month"], 3).select("month", "entry_id", "rank")


@query("browse_page", "SELECT entry_id, entry_date FROM entries WHERE entry_id IN (SELECT entry_id FROM entry_tags WHERE tag = 'n') ORDER BY entry_date DESC, entry_id DESC LIMIT 50 OFFSET 100", "entries", "entry_tags")
def _(j):
    return sequences.page(filters.EntryFilter(tag="n").apply(j.entries, j.entry_tags), 50, 100).select("entry_id", "entry_date")


@query("browse_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def _(j):
    return j.table("documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id")


@query("on_this_day", "SELECT entry_id, entry_date FROM entries WHERE strftime(entry_date, '%m-%d') = '03-14'", "entries")
def _(j):
    return sequences.on_month_day(j.entries, "03-14").select("entry_id", "entry_date")


STREAK = """, r AS (SELECT {by} day, CAST(epoch(day) AS BIGINT) // 86400 - row_number() OVER ({part} ORDER BY day) AS island FROM days),
runs AS (SELECT {by} min(day) AS first, max(day) AS last, count(*) AS days FROM r GROUP BY {by} island)
SELECT {by} CAST(sum(days) AS BIGINT) AS days, CAST(max(days) AS BIGINT) AS longest, CAST(arg_max(last, days * 100000 - CAST(epoch(first) AS BIGINT) // 86400) AS DATE) AS longest_end,
CAST(arg_max(days, last) AS BIGINT) AS current FROM runs {group}"""


@query("writing_streaks_per_user", STREAK.format(by="user_id,", part="PARTITION BY user_id", group="GROUP BY user_id").replace(", r AS", ", days AS (SELECT * FROM user_days), r AS", 1), "user_days")
def _(j):
    return sequences.streaks(j.user_days, ["user_id"])


@query("writing_streaks", STREAK.format(by="", part="", group="").replace(", r AS", ", days AS (SELECT DISTINCT entry_date AS day FROM entries), r AS", 1), "entries")
def _(j):
    days = j.entries.select(F.col("entry_date").alias("day")).distinct()
    return sequences.streaks(days, [])


@query(
    "writing_stats_per_author",
    ", d AS (SELECT DISTINCT author, entry_date AS day FROM entries), r AS (SELECT author, day, CAST(epoch(day) AS BIGINT) // 86400 - row_number() OVER (PARTITION BY author ORDER BY day) AS island FROM d), runs AS (SELECT author, max(day) AS last, count(*) AS n FROM r GROUP BY author, island), s AS (SELECT author, max(n) AS longest, arg_max(n, last) AS current, sum(n) AS days FROM runs GROUP BY 1) SELECT author, count(*) AS entries, CAST(sum(word_count) AS BIGINT) AS words, CAST(max(days) AS BIGINT) AS days, CAST(max(longest) AS BIGINT) AS longest, CAST(max(current) AS BIGINT) AS current, CAST((2 * sum(word_count) * 100 + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS avg_words FROM entries JOIN s USING (author) GROUP BY 1",
    "entries",
)
def _(j):
    return sequences.writing_stats(j.entries, ["author"]).select("author", "entries", "words", "days", "longest", "current", "avg_words")


@query("adjacent_entries", "SELECT entry_id, lag(entry_id) OVER w AS previous_id, lead(entry_id) OVER w AS next_id FROM entries WINDOW w AS (PARTITION BY author ORDER BY entry_date, entry_id)", "entries")
def _(j):
    return sequences.adjacent_entries(j.entries, ["author"])


@query(
    "even_sample_per_year",
    ", r AS (SELECT entry_id, year(entry_date) AS y, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY year(entry_date)) AS n FROM entries WINDOW w AS (PARTITION BY year(entry_date) ORDER BY entry_date, entry_id)), want AS (SELECT DISTINCT y, CAST(round_even(k * ((n - 1) / 9.0), 0) AS BIGINT) AS at FROM (SELECT DISTINCT y, n FROM r), range(10) t(k)) SELECT CAST(r.y AS INTEGER) AS year, entry_id FROM r JOIN want ON r.y = want.y AND r.at = want.at",
    "entries",
)
def _(j):
    return sequences.even_sample(j.entries.withColumn("year", F.year("entry_date")), ["year"], 10).select("year", "entry_id")


@query("chat_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 6")
def _(j):
    return sequences.last_turns(j.table("conversations")).select("conv_id", "turn", "role")


@query("history_retention", "SELECT asked_id FROM (SELECT event_id AS asked_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10 AND ts >= TIMESTAMP '2024-01-20'")
def _(j):
    asked = j.events.select(F.col("event_id").alias("asked_id"), F.col("user_id").alias("conversation"), F.col("ts").alias("asked_at"))
    import datetime

    return sequences.keep_history(asked, 10, datetime.datetime(2024, 1, 20)).select("asked_id")


@query(
    "moving_mood",
    ", d AS (SELECT entry_date, sum(CAST(round(mood_score * 100) AS BIGINT)) AS s, count(mood_score) AS n FROM entries GROUP BY 1), w AS (SELECT entry_date, sum(s) OVER win AS s, sum(n) OVER win AS n FROM d WINDOW win AS (ORDER BY entry_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) SELECT entry_date, CASE WHEN n > 0 THEN CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100.0 END AS avg_mood, CAST(n AS BIGINT) AS n FROM w",
    "entries",
)
def _(j):
    return sequences.moving_mood(j.entries)


@query("mood_rollup", f"SELECT CAST(year(entry_date) AS INTEGER) AS year, CAST(month(entry_date) AS INTEGER) AS month, {avg('mood_score')} AS avg_mood, count(*) AS n FROM entries GROUP BY ROLLUP (year(entry_date), month(entry_date))", "entries")
def _(j):
    return stats.mood_cube(j.entries)


# --- links and names ---


@query("linked_with", f"SELECT note_id, count(*) AS n FROM entry_entities WHERE entry_id IN (SELECT entry_id FROM entry_entities WHERE note_id = {NOTE}) AND note_id <> {NOTE} GROUP BY 1", "entry_entities")
def _(j):
    return links.linked_with(j.entry_entities, NOTE)


@query("note_map_nodes", "SELECT note_id, count(*) AS n FROM entry_entities GROUP BY 1 ORDER BY n DESC, note_id LIMIT 200", "entry_entities")
def _(j):
    return links.note_map(j.entry_entities, 200, 2)[0]


@query("note_map_edges", ", top AS (SELECT note_id FROM entry_entities GROUP BY 1 ORDER BY count(*) DESC, note_id LIMIT 200), e AS (SELECT * FROM entry_entities WHERE note_id IN (SELECT note_id FROM top)) SELECT a.note_id AS a, b.note_id AS b, count(*) AS shared FROM e a JOIN e b ON a.entry_id = b.entry_id AND a.note_id < b.note_id GROUP BY 1, 2 HAVING count(*) >= 2", "entry_entities")
def _(j):
    return links.note_map(j.entry_entities, 200, 2)[1]


@query("note_pairs", "SELECT a.note_id AS a, b.note_id AS b, count(*) AS shared FROM entry_entities a JOIN entry_entities b ON a.entry_id = b.entry_id AND a.note_id < b.note_id GROUP BY 1, 2 HAVING count(*) >= 2", "entry_entities")
def _(j):
    return links.note_pairs(j.written_entities)


@query("tag_cooccurrence", "SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM entry_tags a JOIN entry_tags b ON a.entry_id = b.entry_id AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 2", "entry_tags")
def _(j):
    return links.tag_pairs(j.entry_tags)


@query("tags_with", "SELECT tag, count(*) AS n FROM entry_tags WHERE entry_id IN (SELECT entry_id FROM entry_tags WHERE tag = 'r') AND tag <> 'r' GROUP BY 1", "entry_tags")
def _(j):
    return links.tags_with(j.entry_tags, "r")


def _titles(j: Journal) -> DataFrame:
    return j.notes.select(F.lower("title").alias("key"), "note_id")


TITLES = "titles AS (SELECT lower(title) AS key, note_id FROM notes)"
TARGETS = TITLES + ", targets AS (SELECT key, min(note_id) AS note_id FROM titles GROUP BY 1 UNION ALL SELECT key, min(note_id) FROM note_names WHERE key NOT IN (SELECT key FROM titles) GROUP BY 1 HAVING count(DISTINCT note_id) = 1)"


@query("link_targets", f", {TARGETS} SELECT * FROM targets", "notes", "note_names")
def _(j):
    return links.link_targets(_titles(j), j.note_names)


def _written(j: Journal) -> DataFrame:
    """Lines as links by name: the supplier's name, the part's, a date, and a name of nothing; an entry may say one twice."""
    item = j.table("lineitem")
    named = F.array(
        F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")),
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("lost "), (F.col("l_partkey") % 40).cast("string"))),
        day_key(F.col("l_shipdate")),
    )
    return item.select(F.col("l_orderkey").alias("entry_id"), F.explode(named).alias("target")).where("target IS NOT NULL")


def _writing(j: Journal) -> DataFrame:
    return _written(j).distinct().join(j.entries.select("entry_id", "entry_date"), "entry_id")


WRITING = "writing AS (SELECT DISTINCT t.entry_id, t.target, e.entry_date FROM (SELECT l_orderkey AS entry_id, 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS target FROM lineitem UNION ALL SELECT l_orderkey, 'lost ' || CAST(l_partkey % 40 AS VARCHAR) FROM lineitem WHERE l_partkey % 5 = 0 UNION ALL SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') FROM lineitem) t JOIN entries e USING (entry_id))"


@query("resolved_links", f", {TARGETS}, {WRITING} SELECT DISTINCT entry_id, note_id FROM writing JOIN targets ON target = key", "notes", "note_names", "entries")
def _(j):
    return links.resolve(_writing(j), links.link_targets(_titles(j), j.note_names))


@query("unresolved_targets", f", {TARGETS}, {WRITING} SELECT target, count(DISTINCT entry_id) AS n, max(entry_date) AS last_date FROM writing WHERE target NOT IN (SELECT key FROM targets) AND try_cast(target AS DATE) IS NULL AND target <> 'lost 0' GROUP BY 1", "notes", "note_names", "entries")
def _(j):
    files = j.spark.range(1).select(F.lit("lost 0").alias("key"), F.col("id").alias("entry_id"))
    return links.unresolved(_writing(j), links.link_targets(_titles(j), j.note_names), files)


@query("day_links", f", {WRITING} SELECT DISTINCT w.entry_id, e.entry_id AS day_entry_id FROM writing w JOIN entries e ON w.target = strftime(e.entry_date, '%Y-%m-%d') WHERE w.entry_id <> e.entry_id", "entries")
def _(j):
    files = j.spark.range(0).select(F.lit("").alias("key"), F.col("id").alias("entry_id"))
    return links.day_links(_written(j), j.entries, files, j.entries)


@query("shared_aliases", f", {TITLES}, aliases AS (SELECT note_id, key FROM note_names UNION SELECT note_id, lower(split_part(title, ' ', 2)) FROM notes) SELECT key, count(DISTINCT note_id) AS n_notes, min(note_id) AS first_note FROM aliases WHERE key NOT IN (SELECT key FROM titles) GROUP BY 1 HAVING count(DISTINCT note_id) > 1", "notes", "note_names")
def _(j):
    second = j.notes.select("note_id", F.lower(F.split_part("title", F.lit(" "), F.lit(2))).alias("key"))
    return links.shared_aliases(_titles(j), j.note_names.select("note_id", "key").union(second).distinct())


@query("known_names", "SELECT note_id, key, name FROM note_names UNION ALL SELECT 2000000 + o_custkey, key, key FROM (SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'author ' || CAST(o_custkey AS VARCHAR) ELSE 'supplier#000000001' END AS key FROM orders) WHERE key NOT IN (SELECT key FROM note_names)", "note_names")
def _(j):
    key = F.when(F.col("author") % 2 == 0, F.concat(F.lit("author "), F.col("author").cast("string"))).otherwise(F.lit("supplier#000000001"))
    learned = j.entries.select("author").distinct().select((2_000_000 + F.col("author")).alias("note_id"), key.alias("key"), key.alias("name"))
    return links.known_names(j.note_names, learned)


@query("find_notes", ", f AS (SELECT note_id, 1 AS tier FROM notes WHERE lower(title) = 'red widget' UNION SELECT note_id, 2 FROM note_names WHERE key = 'red widget' UNION SELECT note_id, 3 FROM note_names WHERE contains(key, 'red widget')) SELECT DISTINCT note_id, CAST(tier AS INTEGER) AS tier FROM f WHERE tier = (SELECT min(tier) FROM f)", "notes", "note_names")
def _(j):
    titles = j.notes.select(F.lower("title").alias("key"), "note_id")
    return links.find_notes(j.note_names, titles, " Red Widget")


@query("note_outlinks", ", t AS (SELECT lower(title) AS key, min(note_id) AS note_id FROM notes GROUP BY 1), l AS (SELECT note_id, lower(split_part(title, ' ', 1)) || ' ring' AS target FROM notes) SELECT DISTINCT l.note_id, t.note_id AS other FROM l JOIN t ON l.target = t.key WHERE l.note_id <> t.note_id", "notes")
def _(j):
    targets = j.notes.groupBy(F.lower("title").alias("key")).agg(F.min("note_id").alias("note_id"))
    own = j.notes.select("note_id", F.concat(F.lower(F.split("title", " ")[0]), F.lit(" ring")).alias("target"))
    return links.note_outlinks(own, targets)


@query("fuzzy_names", ", k AS (SELECT DISTINCT lower(title) AS key, length(title) AS n FROM notes WHERE length(title) >= 4) SELECT a.key AS a, b.key AS b, CAST(levenshtein(a.key, b.key) AS BIGINT) AS distance FROM k a JOIN k b ON a.key < b.key AND levenshtein(a.key, b.key) <= floor(0.3 * greatest(a.n, b.n))", "notes")
def _(j):
    return links.near_keys(j.notes.select(F.lower("title").alias("key")), 0.7)


@query("unlinked_orders", "SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(j):
    return j.entries.join(j.entry_entities, "entry_id", "left_anti").select("entry_id")


@query("tags_for_entries", "SELECT entry_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM entry_tags GROUP BY 1", "entry_tags")
def _(j):
    return j.entry_tags.groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


# --- composite analytics ---

COUNTS = ", a AS (SELECT tag, count(*) AS n FROM entry_tags JOIN entries USING (entry_id) WHERE year(entry_date) = 1996 AND month(entry_date) = 3 GROUP BY 1), b AS (SELECT tag, count(*) AS n FROM entry_tags JOIN entries USING (entry_id) WHERE year(entry_date) = 1997 AND month(entry_date) = 3 GROUP BY 1), t AS (SELECT count(*) FILTER (year(entry_date) = 1996 AND month(entry_date) = 3) AS x, count(*) FILTER (year(entry_date) = 1997 AND month(entry_date) = 3) AS y FROM entries), c AS (SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS n_first, coalesce(b.n, 0) AS n_second, CASE WHEN x > 0 THEN round(coalesce(a.n, 0) / x, 6) ELSE 0.0 END AS share_first, CASE WHEN y > 0 THEN round(coalesce(b.n, 0) / y, 6) ELSE 0.0 END AS share_second FROM a FULL JOIN b ON a.tag = b.tag CROSS JOIN t)"


def _two_months(j: Journal) -> tuple[DataFrame, DataFrame]:
    return filters.in_range(j.entries, "1996-03-01", "1996-03-31"), filters.in_range(j.entries, "1997-03-01", "1997-03-31")


@query("compare_periods", COUNTS + " SELECT * FROM c", "entries", "entry_tags")
def _(j):
    return analytics.compare_counts(*_two_months(j), j.entry_tags, "tag")


@query(
    "compare_changes",
    COUNTS + ", d AS (SELECT tag, n_first, n_second, round(share_second - share_first, 6) AS delta FROM c), e AS (SELECT *, CASE WHEN n_first = 0 THEN CASE WHEN n_second >= 2 THEN 'new' END WHEN n_second = 0 THEN CASE WHEN n_first >= 2 THEN 'gone' END WHEN delta > 0 AND n_second >= 2 THEN 'rising' WHEN delta < 0 AND n_first >= 2 THEN 'falling' END AS change FROM d) SELECT tag, n_first, n_second, delta, change FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY abs(delta) DESC, tag) AS rank FROM e WHERE change IS NOT NULL) WHERE rank <= 8",
    "entries", "entry_tags",
)
def _(j):
    return analytics.changes(analytics.compare_counts(*_two_months(j), j.entry_tags, "tag"), "tag")


@query(
    "fell_away_notes",
    ", a AS (SELECT note_id, count(*) AS n FROM entry_entities JOIN entries USING (entry_id) WHERE year(entry_date) = 1997 GROUP BY 1), b AS (SELECT note_id, count(*) AS n FROM entry_entities JOIN entries USING (entry_id) WHERE year(entry_date) = 1998 GROUP BY 1) SELECT a.note_id, a.n AS n_first, coalesce(b.n, 0) AS n_second FROM a LEFT JOIN b ON a.note_id = b.note_id WHERE a.n >= 3 AND 2 * coalesce(b.n, 0) <= a.n ORDER BY a.n - coalesce(b.n, 0) DESC, a.note_id LIMIT 5",
    "entries", "entry_entities",
)
def _(j):
    before, now = filters.in_range(j.entries, "1997-01-01", "1997-12-31"), filters.in_range(j.entries, "1998-01-01", "1998-12-31")
    return analytics.fell_away(before, now, j.entry_entities, "note_id")


@query("review_months", f"SELECT '2001-' || lpad(CAST(m AS VARCHAR), 2, '0') AS month, count(entry_id) AS entry_count, {avg('mood_score')} AS avg_mood FROM range(1, 13) t(m) LEFT JOIN entries ON year(entry_date) = 2001 AND month(entry_date) = m GROUP BY 1", "entries")
def _(j):
    return analytics.review_months(j.entries, 2001)


@query("review_weeks", f"SELECT greatest(CAST(date_trunc('week', entry_date) AS DATE), DATE '1997-05-01') AS week_first, least(CAST(date_trunc('week', entry_date) AS DATE) + 6, DATE '1997-05-31') AS week_last, count(*) AS entry_count, {avg('mood_score')} AS avg_mood FROM entries WHERE entry_date BETWEEN DATE '1997-05-01' AND DATE '1997-05-31' GROUP BY 1, 2", "entries")
def _(j):
    return analytics.review_weeks(j.entries, "1997-05-01", "1997-05-31")


@query(
    "insight_findings",
    SPLIT + f""", base AS (SELECT {avg('mood_score')} AS b FROM entries),
tagged AS (SELECT 'tag' AS kind, tag AS name, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries JOIN entry_tags USING (entry_id) WHERE mood_score IS NOT NULL GROUP BY tag HAVING count(*) >= 3),
noted AS (SELECT 'note' AS kind, title || '/' || kind AS name, count(*) AS n, {avg('mood_score')} AS avg_mood FROM entries JOIN entry_entities USING (entry_id) JOIN notes USING (note_id) WHERE mood_score IS NOT NULL GROUP BY title, kind HAVING count(*) >= 3),
g AS (SELECT DISTINCT key, value, entry_id FROM property_values JOIN entry_entities USING (note_id) WHERE (key, value) IN (SELECT (key, value) FROM property_values GROUP BY key, value HAVING count(DISTINCT note_id) >= 2)),
grouped AS (SELECT 'group' AS kind, key || '=' || value AS name, count(*) AS n, {avg('mood_score')} AS avg_mood FROM g JOIN entries USING (entry_id) WHERE mood_score IS NOT NULL GROUP BY key, value HAVING count(*) >= 3),
found AS (SELECT kind, name, n, avg_mood, round(avg_mood - b, 2) AS magnitude FROM (SELECT * FROM tagged UNION ALL SELECT * FROM noted UNION ALL SELECT * FROM grouped), base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(magnitude) DESC, name) AS rank FROM found WHERE abs(magnitude) >= 0.8),
dow AS (SELECT dayofweek(entry_date) AS k, count(*) AS n, {avg('mood_score')} AS a FROM entries WHERE mood_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
moy AS (SELECT month(entry_date) AS k, count(*) AS n, {avg('mood_score')} AS a FROM entries WHERE mood_score IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
rhythm AS (SELECT 'weekday' AS kind, (SELECT k FROM dow ORDER BY a DESC, k LIMIT 1) AS hk, (SELECT k FROM dow ORDER BY a, k LIMIT 1) AS lk, (SELECT n FROM dow ORDER BY a DESC, k LIMIT 1) AS n, (SELECT max(a) FROM dow) AS hi, (SELECT min(a) FROM dow) AS lo, (SELECT count(*) FROM dow) AS c
  UNION ALL SELECT 'season', (SELECT k FROM moy ORDER BY a DESC, k LIMIT 1), (SELECT k FROM moy ORDER BY a, k LIMIT 1), (SELECT n FROM moy ORDER BY a DESC, k LIMIT 1), (SELECT max(a) FROM moy), (SELECT min(a) FROM moy), (SELECT count(*) FROM moy)),
pairs AS (SELECT a.tag || '+' || b.tag AS name, count(*) AS n, a.tag AS x, b.tag AS y FROM entry_tags a JOIN entry_tags b ON a.entry_id = b.entry_id AND a.tag < b.tag JOIN entries e ON e.entry_id = a.entry_id GROUP BY a.tag, b.tag HAVING count(*) >= 3 ORDER BY n DESC, x, y LIMIT 3)
SELECT kind, name, n, avg_mood, magnitude FROM ranked WHERE rank <= CASE kind WHEN 'tag' THEN 6 WHEN 'note' THEN 5 ELSE 4 END
UNION ALL SELECT kind, CAST(hk AS VARCHAR) || '>' || CAST(lk AS VARCHAR), n, hi, round(hi - lo, 2) FROM rhythm WHERE c >= 2 AND round(hi - lo, 2) >= 0.8
UNION ALL SELECT 'metric', key, n_high, mood_high, round(mood_high - mood_low, 2) FROM split WHERE n_low >= 3 AND n_high >= 3 AND abs(round(mood_high - mood_low, 2)) >= 0.8
UNION ALL SELECT 'together', name, n, NULL, CAST(n AS DOUBLE) FROM pairs""",
    "entries", "entry_tags", "entry_entities", "notes", "property_values", "entry_metrics",
)
def _(j):
    return analytics.insights(j.entries, j.entry_tags, j.entry_entities, j.notes, j.property_values, j.entry_metrics)


def _members(kind: str, key: str) -> str:
    return f""", d AS (SELECT *, {key} AS period FROM entries), m AS (SELECT period, count(*) AS entry_count, {avg('mood_score')} AS avg_mood FROM d GROUP BY 1),
t AS (SELECT period, tag, count(*) AS n, min((entry_date, entry_id, tag)) AS first FROM d JOIN entry_tags USING (entry_id) GROUP BY 1, 2),
r AS (SELECT period, tag, row_number() OVER (PARTITION BY period ORDER BY n DESC, first) AS rank FROM t),
g AS (SELECT period, string_agg(tag, ',' ORDER BY rank) AS dominant_tags FROM r WHERE rank <= 5 GROUP BY 1)
SELECT m.period, entry_count, avg_mood, coalesce(dominant_tags, '') AS dominant_tags FROM m LEFT JOIN g ON g.period = m.period"""


for _kind, _key in (("week", "strftime(entry_date, '%G-W%V')"), ("month", "strftime(entry_date, '%Y-%m')"), ("year", "strftime(entry_date, '%Y')")):
    query(f"member_stats_{_kind}", _members(_kind, _key), "entries", "entry_tags")(lambda j, k=_kind: stats.member_stats(j.entries, j.entry_tags, k))


@query(
    "stale_periods",
    ", was AS (SELECT strftime(entry_date, '%Y-%m') AS period, string_agg(CAST(entry_id AS VARCHAR) || CAST(entry_date AS VARCHAR) || coalesce(CAST(mood_score AS VARCHAR), '-') || CAST(word_count AS VARCHAR), ';' ORDER BY entry_id) AS h FROM entries WHERE entry_id % 1000 <> 1 AND entry_date >= DATE '1995-03-01' GROUP BY 1), now AS (SELECT strftime(entry_date, '%Y-%m') AS period, string_agg(CAST(entry_id AS VARCHAR) || CAST(entry_date AS VARCHAR) || coalesce(CAST(mood_score AS VARCHAR), '-') || CAST(word_count AS VARCHAR), ';' ORDER BY entry_id) AS h FROM entries WHERE entry_date < DATE '2001-07-01' GROUP BY 1) SELECT coalesce(was.period, now.period) AS period, CASE WHEN now.h IS NULL THEN 'gone' WHEN was.h IS NULL THEN 'new' ELSE 'stale' END AS state FROM was FULL JOIN now ON was.period = now.period WHERE was.h IS DISTINCT FROM now.h",
    "entries",
)
def _(j):
    was = incremental.period_hashes(j.entries.where("entry_id % 1000 <> 1 AND entry_date >= DATE '1995-03-01'"), "month")
    return incremental.stale_periods(was, incremental.period_hashes(j.entries.where("entry_date < DATE '2001-07-01'"), "month"))


@query("period_keys", "SELECT entry_id, strftime(entry_date, '%G-W%V') AS week, strftime(entry_date, '%Y-%m') AS month, strftime(entry_date, '%Y') AS year, CAST((1999 - year(entry_date)) * 12 + 6 - month(entry_date) - CASE WHEN 15 < day(entry_date) THEN 1 ELSE 0 END AS INTEGER) AS months FROM entries", "entries")
def _(j):
    day = F.col("entry_date")
    return j.entries.select("entry_id", week_key(day).alias("week"), month_key(day).alias("month"), year_key(day).alias("year"), months_between(day, F.lit("1999-06-15").cast("date")).alias("months"))


@query(
    "digests_overlapping",
    ", m AS (SELECT CAST(date_trunc('month', entry_date) AS DATE) AS first_day, last_day(entry_date) AS last_day, count(*) AS n FROM entries GROUP BY 1, 2) SELECT first_day, last_day, n FROM m WHERE last_day >= DATE '1997-02-10' AND first_day <= DATE '1997-06-10'",
    "entries",
)
def _(j):
    months = j.entries.groupBy(F.date_trunc("month", "entry_date").cast("date").alias("first_day"), F.last_day("entry_date").alias("last_day")).agg(F.count("*").alias("n"))
    return months.where((F.col("last_day") >= F.lit("1997-02-10").cast("date")) & (F.col("first_day") <= F.lit("1997-06-10").cast("date")))


WITHHELD = ", lost AS (SELECT DISTINCT entry_id FROM entry_tags WHERE tag IN ('1-urgent')), hidden AS (SELECT note_id FROM notes WHERE kind = 'promo')"


@query("withheld_view", WITHHELD + " SELECT entry_id, note_id FROM entry_entities WHERE entry_id NOT IN (SELECT entry_id FROM lost) AND note_id NOT IN (SELECT note_id FROM hidden)", "entries", "entry_tags", "notes", "entry_entities")
def _(j):
    out = privacy.withheld_entries(j.entry_tags, ["1-URGENT"])
    tables = {"entries": j.entries, "entry_entities": j.entry_entities}
    return privacy.withhold(tables, out, j.notes.where("kind = 'promo'").select("note_id"))["entry_entities"].select("entry_id", "note_id")


@query(
    "withheld_digests",
    ", lost AS (SELECT DISTINCT entry_date FROM entries JOIN entry_tags USING (entry_id) WHERE tag = '1-urgent'), m AS (SELECT DISTINCT CAST(date_trunc('week', entry_date) AS DATE) AS first_day, CAST(date_trunc('week', entry_date) AS DATE) + 6 AS last_day FROM entries UNION SELECT entry_date, entry_date FROM entries) SELECT first_day, last_day FROM m WHERE NOT EXISTS (SELECT 1 FROM lost WHERE entry_date BETWEEN first_day AND last_day)",
    "entries", "entry_tags",
)
def _(j):
    """Digests of weeks and of single days."""
    out = privacy.withheld_entries(j.entry_tags, ["1-urgent"])
    first = F.date_trunc("week", "entry_date").cast("date")
    periods = j.entries.select(first.alias("first_day"), F.date_add(first, 6).alias("last_day")).union(j.entries.select("entry_date", "entry_date")).distinct()
    return privacy.withhold({"entries": j.entries, "digests": periods}, out, j.notes.limit(0).select("note_id"))["digests"]


# --- search ---


def _terms(j: Journal) -> DataFrame:
    return j.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))


TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\pL\\pN]+'), lambda x: x <> '')"
BM25 = f"""WITH d AS (SELECT doc_id, {TOKENS.format(x="text")} AS t FROM documents), n AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM d),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format(x="text")}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (words / docs)))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)"""


@query("doc_bm25", BM25 + " SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def _(j):
    return search.bm25(j.table("documents"), _terms(j), 10)


@query("doc_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS.format(x='text')}, ' ') || ' ', ' general public license ')")
def _(j):
    return search.phrase_ids(j.table("documents"), "General Public Licénse")


@query("keyword_extract", "SELECT doc_id, array_to_string(list_distinct_ordered[1:8], ',') AS keywords FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN][\\pL\\pN''\\-]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")) AS w FROM documents))")
def _(j):
    return j.table("documents").select("doc_id", F.array_join(text.search_keywords(F.col("text")), ",").alias("keywords"))


@query(
    "best_sentence",
    f"""WITH s AS (SELECT doc_id, sentence, place FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\\n+', '\x01', 'g'), '\x01') AS l FROM documents), LATERAL (SELECT unnest(l) AS sentence, generate_subscripts(l, 1) AS place)),
t AS (SELECT doc_id, place, sentence, unnest(list_distinct({TOKENS.format(x="sentence")})) AS term FROM s), w AS (SELECT * FROM t WHERE term IN ('apache', 'mit', 'public')), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY 1),
c AS (SELECT doc_id, place, sentence, round(sum(1.0 / df), 9) AS score FROM w JOIN df USING (term) GROUP BY 1, 2, 3) SELECT doc_id, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM c) WHERE rank = 1""",
)
def _(j):
    return search.best_sentence_columns(j.table("documents"), ["apache", "mit", "public"])


def _query_vector(j: Journal) -> DataFrame:
    return j.table("embeddings").where("vec_id = 0").select("embedding")


@query("vec_knn_l2", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 25")
def _(j):
    return search.nearest(j.table("embeddings"), _query_vector(j), 25)


@query("vec_cosine_knn", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings WHERE vec_id <> 3 ORDER BY distance, vec_id LIMIT 25")
def _(j):
    return search.similar_to(j.table("embeddings"), 3, 25, "cosine")


@query("vec_knn_filtered", "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE label = 4 ORDER BY distance, vec_id LIMIT 10")
def _(j):
    vectors = j.table("embeddings")
    return search.nearest(vectors, _query_vector(j), 10, allowed=vectors.where("label = 4").select("vec_id"))


CENTROIDS = "c AS (SELECT CAST(label AS INTEGER) AS theme, list(x ORDER BY i) AS centroid FROM (SELECT label, i, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query("nearest_theme", f"WITH {CENTROIDS}, p AS (SELECT vec_id, theme, round(list_distance(CAST(embedding AS DOUBLE[]), centroid), 6) AS d FROM embeddings, c) SELECT vec_id, CAST(arg_min(theme, (d, theme)) AS INTEGER) AS theme, min(d) AS distance FROM p GROUP BY 1")
def _(j):
    vectors = j.table("embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i")
    parts = parts.agg((F.sum(F.round(F.col("v").cast("double") * 1000000).cast("long")).cast("double") / F.count("*") / 1000000).alias("x"))
    centroids = parts.groupBy(F.col("label").alias("theme")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return themes.nearest_theme(vectors.select("vec_id", "embedding"), centroids)


@query("themes_kmeans")
def _(j):
    return themes.group(j.table("embeddings").select("vec_id", "embedding"), 8)


KNN = "k AS (SELECT vec_id AS doc_id, CAST(row_number() OVER (ORDER BY round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6), vec_id) AS INTEGER) AS rank FROM embeddings)"


@query("rrf_fusion", BM25 + f", {KNN}, l AS (SELECT 0 AS list, doc_id, rank FROM k WHERE rank <= 40 UNION ALL SELECT 1, doc_id, rank FROM r WHERE query_id = 5 AND rank <= 40), f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM l GROUP BY 1) SELECT doc_id, score FROM f ORDER BY score DESC, first, doc_id LIMIT 30")
def _(j):
    near = search.nearest(j.table("embeddings"), _query_vector(j), 40)
    near = near.select(F.lit(0).alias("list"), F.col("vec_id").alias("doc_id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    words = search.bm25(j.table("documents"), _terms(j).where("query_id = 5"), 40).select(F.lit(1).alias("list"), "doc_id", "rank")
    return search.fuse(near.union(words), 30)


@query("hybrid_search", BM25.replace("(SELECT DISTINCT item_id AS query_id, unnest(" + TOKENS.format(x="text") + ") AS term FROM benchmark)", "(SELECT 0 AS query_id, unnest(['apache', 'license']) AS term)") + f", {KNN}, l AS (SELECT 0 AS list, doc_id, rank FROM k WHERE rank <= 20 UNION ALL SELECT 1, doc_id, rank FROM r WHERE rank <= 20), f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM l GROUP BY 1) SELECT doc_id, score FROM f ORDER BY score DESC, first, doc_id LIMIT 20")
def _(j):
    return search.hybrid(j.table("documents"), j.table("embeddings"), ["apache", "license"], _query_vector(j), 20)


@query("best_sentence_stemmed")
def _(j):
    return search.best_sentences(j.table("documents").select("doc_id", "text"), "Which licenses were released publicly?")


NAMES = "names AS (SELECT item_id AS note_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN][\\pL\\pN''\\-]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))[1] AS key FROM benchmark)"


@query("unlinked_mentions", f"WITH {NAMES}, t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) || ' ' AS body FROM documents), k AS (SELECT DISTINCT note_id, trim(regexp_replace(key, '[^\\pL\\pN]+', ' ', 'g')) AS key FROM names WHERE length(trim(regexp_replace(key, '[^\\pL\\pN]+', ' ', 'g'))) >= 3) SELECT doc_id AS entry_id, note_id, key FROM t JOIN k ON contains(body, ' ' || key || ' ') WHERE doc_id <> note_id")
def _(j):
    texts = j.table("documents").select(F.col("doc_id").alias("entry_id"), "text")
    names = j.table("benchmark").select(F.col("item_id").alias("note_id"), text.search_keywords(F.col("text"))[0].alias("key")).where("key IS NOT NULL")
    return search.unlinked_mentions(texts, names, names.select(F.col("note_id").alias("entry_id"), "note_id"))


# --- text and sources ---


@query("link_extract", "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS INTEGER) AS n_links, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS INTEGER) AS n_targets FROM pages")
def _(j):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return j.table("pages").select("page_id", found.alias("l")).select("page_id", F.size("l").alias("n_links"), F.size(F.array_distinct("l")).alias("n_targets"))


@query("tag_extract", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?:^|\\s)#([\\pL\\pN_/\\-]+)', 1), lambda x: NOT regexp_full_match(x, '\\pN+')), lambda x: lower(x)))), ',') AS tags FROM documents WHERE contains(text, '#')")
def _(j):
    return j.table("documents").where(F.contains("text", F.lit("#"))).select("doc_id", F.array_join(F.sort_array(text.literal_tags(F.col("text"))), ",").alias("tags"))


@query("section_split", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS n_lines FROM documents")
def _(j):
    return j.table("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).alias("n_lines"))


@query("clean_words", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) AS words FROM documents")
def _(j):
    return j.table("documents").select("doc_id", text.words(F.col("text")).alias("words"))


WRITTEN = "SELECT p_partkey AS note_id, 'See [[Folder/' || p_name || '.md|' || p_brand || ']] and [[' || p_brand || '#Top]], ![[' || p_brand || '.png]] or [[' || p_name || ']]. #' || p_brand AS text, p_name, p_brand FROM (SELECT p_partkey, p_name, replace(p_brand, '#', '-') AS p_brand FROM part)"


@query("note_link_parts", f"SELECT note_id, lower(p_name) || ',' || lower(p_brand) AS keys, lower(p_name) || '=' || p_brand AS labels, lower(p_brand) || '#Top' AS anchors, p_brand || '.png' AS images FROM ({WRITTEN})")
def _(j):
    part = j.table("part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("-")))
    body = F.concat(F.lit("See [[Folder/"), "p_name", F.lit(".md|"), "p_brand", F.lit("]] and [["), "p_brand", F.lit("#Top]], ![["), "p_brand", F.lit(".png]] or [["), "p_name", F.lit("]]. #"), "p_brand")
    pair = lambda rows, mark, second: F.array_join(F.transform(rows, lambda x: F.concat(x["target"], F.lit(mark), x[second])), ",")
    rows = part.select(F.col("p_partkey").alias("note_id"), body.alias("text"))
    return rows.select(
        "note_id", F.array_join(text.link_keys(F.col("text")), ",").alias("keys"), pair(text.link_labels(F.col("text")), "=", "label").alias("labels"),
        pair(text.link_anchors(F.col("text")), "#", "anchor").alias("anchors"), F.array_join(text.image_names(F.col("text")), ",").alias("images"),
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(j):
    return incremental.content_hash(j.table("documents")).select("doc_id", "content_hash")


@query("dedupe_by_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(j):
    return incremental.dedupe_by_hash(incremental.content_hash(j.table("documents")), "doc_id")


@query(
    "change_detection",
    "WITH now AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), was AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'indexed' END AS status FROM documents WHERE doc_id % 3 <> 0) SELECT CAST(coalesce(now.path, was.path) AS VARCHAR) AS path, CASE WHEN now.h IS NULL THEN 'vanished' WHEN was.h IS NULL THEN 'new' WHEN was.h <> now.h THEN 'changed' WHEN status = 'error' THEN 'retry' ELSE 'unchanged' END AS change FROM now FULL JOIN was ON now.path = was.path",
)
def _(j):
    docs = incremental.content_hash(j.table("documents")).select(F.col("doc_id").cast("string").alias("path"), "content_hash", F.lit("entry").alias("kind"), "doc_id")
    was = docs.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "error").otherwise("indexed").alias("status"), "kind")
    return incremental.plan(docs.where("doc_id % 11 <> 0"), was)


@query("upsert", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'xx' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 10000000 + doc_id, 'new' FROM documents WHERE doc_id % 100 = 0")
def _(j):
    docs = j.table("documents").select("doc_id", "lang")
    new = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("xx").alias("lang")).union(docs.where("doc_id % 100 = 0").select(10_000_000 + F.col("doc_id"), F.lit("new")))
    return incremental.upsert(docs, new, ["doc_id"])


@query("metric_parsing", "SELECT event_id, CAST(round(CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS DOUBLE) * 100) AS BIGINT) AS hundredths FROM events")
def _(j):
    return j.events.select("event_id", F.round(text.metric_value(F.get_json_object("props", "$.k")) * 100).cast("long").alias("hundredths"))


@query(
    "export_csv_pivot",
    "SELECT entry_id, entry_date, mood_score, word_count, coalesce((SELECT string_agg(tag, '; ' ORDER BY tag) FROM entry_tags t WHERE t.entry_id = e.entry_id), '') AS tags, (SELECT value FROM entry_metrics m WHERE m.entry_id = e.entry_id AND key = 'lines') AS lines, (SELECT value FROM entry_metrics m WHERE m.entry_id = e.entry_id AND key = 'quantity') AS quantity FROM entries e",
    "entries", "entry_tags", "entry_metrics",
)
def _(j):
    return export.csv_rows(j.entries, j.entry_tags, j.entry_metrics, ["lines", "quantity"])


# --- events ---


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def _(j):
    return streams.tumbling(j.events)


@query("event_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start FROM events, range(2) t(k)) GROUP BY 1")
def _(j):
    return streams.sliding(j.events)


@query(
    "event_session_debounce",
    "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last_ts, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type FROM s GROUP BY user_id, k",
)
def _(j):
    return streams.sessions(j.events)


@query(
    "event_last_per_user",
    "SELECT CAST(user_id AS VARCHAR) AS path, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 45 SECONDS",
)
def _(j):
    import datetime

    rows = j.events.select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", F.col("event_type").alias("kind"))
    return incremental.last_events(rows, 45, datetime.datetime(2024, 1, 30, 18)).select("path", "ts", "kind")


from . import more, stored  # noqa: E402, F401  register their queries after these

__all__ = ["oracle_sql", "queries"]

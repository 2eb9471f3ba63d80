"""Registered queries over what is stored first: the full-text index, and streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..operators import broken, digests, quotes, tables
from ..operators.fulltext import FullText
from ..scratch import new_folder
from ..sources.journal import Journal
from ..streaming.debounce import debounced
from .catalog import BM25
from .registry import query

TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\pL\\pN]+'), lambda x: x <> '')"
WORDS = f"SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT doc_id, {TOKENS.format(x='text')} AS t FROM documents)"


def _index(j: Journal) -> FullText:
    return FullText(j.spark, new_folder(j.spark, "fulltext")).apply(j.table("documents").select("doc_id", "text"))


@query("fulltext_phrase_or", f"SELECT doc_id FROM ({WORDS}) WHERE contains(s, ' general public license ') OR contains(s, ' all rights reserved ')")
def _(j):
    return _index(j).match('"General Public Licénse" OR "all rights reserved"')


@query("fulltext_not", f"SELECT doc_id FROM ({WORDS}) WHERE (contains(s, ' license ') OR contains(s, ' licensed ')) AND NOT contains(s, ' apache ') AND NOT contains(s, ' public license ')")
def _(j):
    return _index(j).match('(license OR licensed) NOT apache NOT "public license"')


@query("fulltext_beginning", f"SELECT doc_id FROM ({WORDS}) WHERE contains(s, ' rights reser') OR contains(s, ' public ') AND contains(s, ' licen')")
def _(j):
    return _index(j).match('"rights reser"* OR public licen*')


def _changed(j: Journal) -> FullText:
    marks = j.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = j.table("documents").select("doc_id", "text")
    poor = docs.join(marks.where("quality = 0"), "doc_id", "left_semi").select("doc_id", F.concat(F.lit("Rewritten: "), F.coalesce("text", F.lit("")), F.lit(" end of words")).alias("text"))
    return _index(j).apply(poor).apply(gone=marks.where("toxic = 1").select("doc_id"))


#: Documents as they are after the changes: the toxic ones are gone, and those of low quality say something else.
AFTER = "SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT doc_id, {tokens} AS t FROM (SELECT doc_id, CASE WHEN quality = 0 THEN 'Rewritten: ' || coalesce(text, '') || ' end of words' ELSE text END AS text FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) m USING (doc_id) WHERE coalesce(toxic, 0) = 0))".format(tokens=TOKENS.format(x="text"))


@query("fulltext_after_changes", f"SELECT doc_id FROM ({AFTER}) WHERE contains(s, ' rewritten ') OR contains(s, ' end of words ') OR contains(s, ' general public license ')")
def _(j):
    return _changed(j).match('rewritten OR "end of words" OR "general public license"')


@query("fulltext_after_merge", f"SELECT doc_id FROM ({AFTER}) WHERE NOT contains(s, ' rewritten ') AND contains(s, ' reserved ')")
def _(j):
    return _changed(j).merge().match("reserved NOT rewritten")


@query("fulltext_postings", f"WITH t AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, {TOKENS.format(x='text')} AS t FROM documents)) SELECT term, doc_id, array_to_string(list_sort(list(k - 1)), ',') AS places FROM t WHERE term IN ('license', 'reserved', 'rights') GROUP BY 1, 2")
def _(j):
    from ..operators.fulltext import Words

    found = _index(j).postings([Words(("license",)), Words(("rights", "reserved"))])
    return found.select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("places"))


def _terms(j: Journal) -> DataFrame:
    return j.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))


@query("fulltext_bm25", BM25 + " SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def _(j):
    return _index(j).bm25(_terms(j), 5)


@query(
    "event_debounce_state",
    "WITH g AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ts) OVER () AS newest FROM events) SELECT CAST(user_id AS VARCHAR) AS path, event_type AS kind, event_id FROM g WHERE next - ts >= INTERVAL 30 MINUTES OR next IS NULL AND ts + INTERVAL 30 MINUTES <= newest - INTERVAL 10 MINUTES",
)
def _(j):
    """The whole table as a stream: of each user's bursts the last event, once 30 minutes of quiet are sure."""
    folder = new_folder(j.spark, "debounce")
    events = j.spark.readStream.schema(j.events.schema).parquet(f"{j.folder}/events.parquet*")
    rows = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), "ts", "event_id")
    stream = debounced(rows, 30 * 60, by_event=True).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return j.spark.read.schema("path string, kind string, event_id long").parquet(f"{folder}/rows")


SPANS = (("1993-12-20", "1994-01-10"), ("1996-02-28", "1996-03-01"), ("1998-01-01", "1998-12-31"), ("1980-01-01", "1980-01-02"))


@query(
    "digest_graph_plan",
    ", spans(first, last) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in SPANS) + "), p AS (SELECT 1 AS place, 'month' AS kind, strftime(entry_date, '%Y-%m') AS key, mood_score FROM entries UNION ALL SELECT 2, 'year', strftime(entry_date, '%Y'), mood_score FROM entries UNION ALL SELECT 3, 'week', strftime(entry_date, '%G-W%V'), mood_score FROM entries UNION ALL SELECT 4, 'range', strftime(first, '%Y-%m-%d') || '..' || strftime(last, '%Y-%m-%d'), mood_score FROM entries JOIN spans ON entry_date BETWEEN first AND last), s AS (SELECT place, kind, key, count(*) FILTER (mood_score IS NULL OR mood_score < 10) AS was, count(*) FILTER (mood_score = 10) AS came FROM p GROUP BY ALL) SELECT place, kind, key, CASE WHEN was = 0 THEN 'missing' ELSE 'stale' END AS reason FROM s WHERE came > 0",
    "entries",
)
def _(j):
    """Digests were written before the entries with a mood of 10 came: what is to be written anew, up the graph."""
    spans = j.spark.createDataFrame([(f"{a}..{b}", a, b) for a, b in SPANS], "key string, first string, last string")
    spans = spans.select("key", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    entries = j.entries.withColumn("summary", F.lit(None).cast("string"))
    before = digests.inputs(entries.where("mood_score IS NULL OR mood_score < 10"), spans)
    return digests.plan(digests.inputs(entries, spans), before)


@query(
    "broken_link_reasons",
    """WITH n AS (SELECT p_partkey AS note_id, p_name AS title, lower(p_name) AS key FROM part), t AS (
SELECT DISTINCT CASE p_size % 10 WHEN 0 THEN substr(key, 1, 2) || substr(key, 4) WHEN 1 THEN 'x' || p_partkey || '-nowhere' WHEN 2 THEN '1998-02-' || lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE p_type || p_partkey END AS target, p_size % 10 AS what, p_partkey AS id, title FROM n JOIN part ON p_partkey = note_id WHERE NOT (p_size % 10 = 2 AND p_size < 10))
SELECT target, CASE WHEN what = 0 THEN 'typo' WHEN what = 1 THEN 'missing' WHEN what = 2 THEN CASE WHEN try_cast(target AS DATE) IS NULL THEN 'not_a_date' ELSE 'no_entry' END WHEN what < 6 THEN 'errored' WHEN what < 8 THEN 'private' ELSE 'hidden' END AS reason, CASE WHEN what = 0 THEN any_value(title) END AS "like" FROM t GROUP BY target, what""",
)
def _(j):
    """Every part's name is a note; by its size a part gives a link that finds nothing, for one of seven reasons."""
    part = j.table("part").withColumn("what", F.col("p_size") % 10)
    key = F.lower("p_name")
    other = F.concat("p_type", F.col("p_partkey").cast("string"))
    target = F.when(F.col("what") == 0, F.concat(F.substring(key, 1, 2), F.substring(key, 4, 999))).when(F.col("what") == 1, F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit("-nowhere")))
    target = target.when(F.col("what") == 2, F.concat(F.lit("1998-02-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).otherwise(other)
    rows = part.where("NOT (what = 2 AND p_size < 10)").select(target.alias("target"), "what", "p_partkey")
    files = rows.where("what > 2").select(F.col("target").alias("key"), F.col("target").alias("path"), "what")
    tracked = files.where("what < 8").select("key", "path", F.when(F.col("what") < 6, "error").otherwise("private").alias("status"), F.lit(None).cast("string").alias("error_message"))
    hidden = files.where("what >= 8").select("key", "path", F.lit("hidden").alias("state"))
    names = part.select(key.alias("key"), F.col("p_name").alias("name"), F.col("p_name").alias("title"), F.col("p_partkey").alias("note_id"))
    shared = j.spark.createDataFrame([], "key string, titles array<string>")
    lost = rows.groupBy("target").agg(F.count("*").alias("entries"), F.lit(0).alias("notes"), F.lit(None).cast("date").alias("last"))
    return broken.diagnose(lost, tracked, hidden, shared, names).select("target", "reason", "like")


@query(
    "sql_bursts",
    "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 20 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(j):
    tables.register(j.spark)
    return j.spark.sql("SELECT key, first, last, n FROM bursts(TABLE(SELECT user_id, ts FROM {events}), 1200)", events=j.events)


@query(
    "sql_links",
    """WITH l AS (SELECT entry_id, 'See [[' || key || '#Part|' || substr(key, 1, 3) || ']] and [[Pic.heic]] and [[x/' || name || '.md]]' AS text, key FROM (SELECT p_partkey AS entry_id, lower(p_name) AS key, p_name AS name FROM part))
SELECT entry_id, place, target, anchor, label FROM (SELECT entry_id, CAST(0 AS BIGINT) AS place, key AS target, 'Part' AS anchor, substr(key, 1, 3) AS label FROM l UNION ALL SELECT entry_id, 1, NULL, NULL, NULL FROM l UNION ALL SELECT entry_id, 2, key, NULL, NULL FROM l)""",
)
def _(j):
    tables.register(j.spark)
    texts = j.table("part").select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("See [["), F.lower("p_name"), F.lit("#Part|"), F.substring(F.lower("p_name"), 1, 3), F.lit("]] and [[Pic.heic]] and [[x/"), F.col("p_name"), F.lit(".md]]")).alias("text"))
    return j.spark.sql("SELECT entry_id, l.place, l.target, l.anchor, l.label FROM {texts} AS t, LATERAL text_links(t.text) AS l", texts=texts)


@query(
    "sql_json_parameters",
    "SELECT entry_id, entry_date, mood_score FROM entries WHERE author IN (SELECT author FROM (SELECT author, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, author LIMIT 5)) AND entry_date <= DATE '1996-06-30' AND mood_score >= 4",
    "entries",
)
def _(j):
    """The entries of the five busiest authors, whose ids are handed over as JSON."""
    busiest = j.entries.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(5)
    ids = j.entries.join(busiest, "author", "left_semi").agg(F.to_json(F.collect_list("entry_id"))).first()[0]
    return tables.chosen(j.entries, ids, until="1996-06-30", mood=4.0).select("entry_id", "entry_date", "mood_score")


@query(
    "quotes_for_days",
    f"""WITH e AS (SELECT DATE '2020-01-01' + CAST(n_chars % 500 AS INTEGER) AS entry_date, doc_id, text, string_split(text, chr(10))[1] AS part FROM documents),
c AS (SELECT * FROM e WHERE entry_date IN (SELECT DATE '2020-01-01' + CAST(length(text) AS INTEGER) FROM benchmark)),
s AS (SELECT entry_date, doc_id, part, unnest(l) AS sentence, generate_subscripts(l, 1) AS place FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\\n+', '\x01', 'g'), '\x01') AS l FROM c)),
w AS (SELECT *, unnest(list_distinct({TOKENS.format(x="sentence")})) AS term FROM s), t AS (SELECT * FROM w WHERE term IN ('the', 'license', 'and', 'public')),
h AS (SELECT doc_id, term, count(*) AS hits FROM t GROUP BY 1, 2),
d AS (SELECT entry_date, doc_id, place, sentence, round(sum(1.0 / hits) * (CASE WHEN contains(part, sentence) THEN 1.5 ELSE 1.0 END), 9) AS score FROM t JOIN h USING (doc_id, term) GROUP BY entry_date, doc_id, place, sentence, part),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY score DESC, doc_id, place) AS nth FROM d),
f AS (SELECT *, coalesce(list_min(list_filter([instr(lower(sentence), x) for x in ['the', 'license', 'and', 'public']], lambda x: x > 0)), 1) - 1 AS first FROM r WHERE nth = 1),
g AS (SELECT *, greatest(0, least(first - 20, length(sentence) - 60)) AS start FROM f)
SELECT entry_date, doc_id AS entry_id, CASE WHEN length(sentence) <= 60 THEN sentence ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END) || trim(substr(sentence, start + 1, 60)) || (CASE WHEN start + 60 < length(sentence) THEN '…' ELSE '' END) END AS quote, score FROM g""",
)
def _(j):
    """Documents as entries, their days from their length; the days cited are those that the benchmark's items give."""
    first = F.to_date(F.lit("2020-01-01"))
    entries = j.table("documents").select(F.date_add(first, (F.col("n_chars") % 500).cast("int")).alias("entry_date"), F.col("doc_id").alias("entry_id"), "text")
    days = j.table("benchmark").select(F.date_add(first, F.length("text")).alias("entry_date"))
    parts = entries.select("entry_id", F.split("text", "\n")[0].alias("part"))
    return quotes.for_days(entries, days, ["the", "license", "and", "public"], parts, 60)

"""More registered queries: lookups, sorts, links in reverse, search in parts, digests' inputs, the writer's profile, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.periods import day_key
from ..operators import incremental, links, lookups, parts, profile, search, themes
from ..sources.journal import Journal
from .registry import avg, query

# --- lookups ---


@query("notes_in_order", ", w AS (SELECT note_id, min(place) AS place FROM (SELECT l_partkey AS note_id, l_linenumber AS place FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)) GROUP BY 1) SELECT place, note_id, title FROM w JOIN notes USING (note_id)", "notes")
def _(j):
    item = j.table("lineitem")
    last = item.agg(F.max("l_orderkey").alias("l_orderkey"))
    wanted = item.join(F.broadcast(last), "l_orderkey", "left_semi").select(F.col("l_partkey").alias("note_id"), F.col("l_linenumber").alias("place"))
    return lookups.in_order(j.notes.select("note_id", "title"), wanted, "note_id")


@query("entry_exists", "SELECT count(*) > 0 AS found FROM entries WHERE mood_score = 10 AND word_count > 1000", "entries")
def _(j):
    return lookups.exists(j.entries.where("mood_score = 10 AND word_count > 1000"))


FILES = "files AS (SELECT 'e/' || o_custkey || '/' || o_orderkey || '.md' AS path, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'error' ELSE 'private' END AS status, o_orderkey AS entry_id FROM orders)"


def _files(j: Journal) -> DataFrame:
    path = F.concat(F.lit("e/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".md"))
    state = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "error").otherwise("private")
    return j.table("orders").select(path.alias("path"), state.alias("status"), F.col("o_orderkey").alias("entry_id"))


@query("indexed_entries", f"WITH {FILES} SELECT entry_id FROM files WHERE status = 'indexed'")
def _(j):
    files = _files(j)
    return lookups.with_status(files.select("entry_id", F.col("path").alias("file_path")), files).select("entry_id")


@query("files_overview", f"WITH {FILES} SELECT path, status FROM files ORDER BY status = 'indexed', lower(path), path LIMIT 200")
def _(j):
    return lookups.status_first(_files(j)).select("path", "status").limit(200)


@query("files_by_glob", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^e/[^/]*7/[^/]*[.]md$')")
def _(j):
    return lookups.glob_match(_files(j), "e/*7/*.md").select("path")


@query("notes_by_name", "SELECT CAST(row_number() OVER (ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), title, note_id) AS INTEGER) AS place, note_id FROM notes ORDER BY 1 LIMIT 100", "notes")
def _(j):
    ordered = lookups.named_in_order(j.notes, "title").orderBy(lookups.ascii_lower(F.col("title")), "title", "note_id").limit(100)
    return ordered.select(F.row_number().over(Window.orderBy(lookups.ascii_lower(F.col("title")), "title", "note_id")).alias("place"), "note_id")


@query("browse_page_total", "SELECT entry_id, entry_date, (SELECT count(*) FROM entries) AS total FROM entries ORDER BY entry_date DESC, entry_id DESC LIMIT 50 OFFSET 100", "entries")
def _(j):
    return lookups.page_with_total(j.entries.select("entry_id", "entry_date"), 50, 100, F.desc("entry_date"), F.desc("entry_id"))


@query("metrics_named", "SELECT DISTINCT key FROM entry_metrics WHERE contains(' how did quantity change with lines ', ' ' || key || ' ')", "entry_metrics")
def _(j):
    return lookups.metrics_named(j.entry_metrics, "How did Quantity change, with lines?")


SNIPPET = """WITH t AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents), h AS (SELECT doc_id, list_reverse(regexp_split_to_array(substr(text, 1, p - 1), '[.!?…\n]'))[1] AS a, regexp_extract(substr(text, p), '^[^.!?…\n]*[.!?…]?') AS z FROM t WHERE p > 0)
SELECT doc_id, CASE WHEN length(trim(a || z)) <= 160 THEN trim(a || z) WHEN length(trim(z)) <= 160 THEN trim(z) ELSE regexp_replace(substr(trim(z), 1, 159), '\\s+\\S*$', '') || '…' END AS snippet FROM h"""


@query("match_snippets", SNIPPET)
def _(j):
    found = j.table("documents").select("doc_id", lookups.snippet(F.col("text"), F.lit("license")).alias("snippet"))
    return found.where("snippet IS NOT NULL")


# --- links in reverse ---

SHIPPED = "shipped AS (SELECT DISTINCT l_orderkey AS entry_id, e.entry_id AS day_entry_id FROM lineitem JOIN entries e ON strftime(l_shipdate, '%Y-%m-%d') = strftime(e.entry_date, '%Y-%m-%d') WHERE l_orderkey <> e.entry_id)"


@query("reverse_day_links", f", {SHIPPED}, day AS (SELECT entry_id FROM entries WHERE entry_date = (SELECT max(entry_date) FROM entries WHERE entry_date < DATE '1998-01-01')) SELECT DISTINCT entry_id FROM shipped WHERE day_entry_id IN (SELECT entry_id FROM day) AND entry_id NOT IN (SELECT entry_id FROM day)", "entries")
def _(j):
    written = j.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), day_key(F.col("l_shipdate")).alias("target"))
    last = j.entries.where("entry_date < DATE '1998-01-01'").agg(F.max("entry_date").alias("entry_date"))
    files = j.spark.range(0).select(F.lit("").alias("key"), F.col("id").alias("entry_id"))
    return lookups.reverse_day_links(written, j.entries.join(F.broadcast(last), "entry_date", "left_semi"), files)


NOTE_LINKS = "note_links AS (SELECT note_id, lower(split_part(title, ' ', 1)) || ' ring' AS target FROM notes)"


def _note_links(j: Journal) -> DataFrame:
    return j.notes.select("note_id", F.concat(F.lower(F.split("title", " ")[0]), F.lit(" ring")).alias("target"))


@query("target_writers", f", {NOTE_LINKS}, l AS (SELECT l_orderkey AS entry_id, lower(split_part(p_name, ' ', 1)) || ' ring' AS target FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT DISTINCT 'entry' AS kind, entry_id AS id FROM l WHERE target = 'red ring' UNION SELECT 'note', note_id FROM note_links WHERE target = 'red ring'", "notes")
def _(j):
    named = j.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lower(F.split("p_name", " ")[0]), F.lit(" ring")).alias("target"))
    written = j.table("lineitem").join(named, "l_partkey").select(F.col("l_orderkey").alias("entry_id"), "target")
    return lookups.writers(written, _note_links(j), "red ring")


@query("note_backlinks", f", {NOTE_LINKS}, t AS (SELECT lower(title) AS key, note_id FROM notes), of AS (SELECT min(note_id) AS note_id FROM t WHERE key IN (SELECT target FROM note_links)) SELECT DISTINCT note_id FROM note_links WHERE target IN (SELECT key FROM t WHERE note_id = (SELECT note_id FROM of)) AND note_id <> (SELECT note_id FROM of)", "notes")
def _(j):
    targets = j.notes.select(F.lower("title").alias("key"), "note_id")
    linked = targets.join(_note_links(j).select(F.col("target").alias("key")), "key", "left_semi").agg(F.min("note_id").alias("n")).first().n
    return lookups.backlinks(_note_links(j), targets, -1 if linked is None else linked)


@query("similar_tags")
def _(j):
    return links.similar_tags(j.notes.select(F.explode(F.split("title", " ")).alias("tag")))


# --- search in parts ---

TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\pL\\pN]+'), lambda x: x <> '')"


def _bm25(docs: str, terms: str) -> str:
    """The scores of one query over docs (id, body), as a list of subqueries that ends in s (id, score)."""
    return f"""d AS ({docs}), tok AS (SELECT id, {TOKENS.format(x="body")} AS t FROM d), n AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM tok),
p AS (SELECT id, len(t) AS length, unnest(t) AS term FROM tok), tf AS (SELECT id, length, term, count(*) AS tf FROM p WHERE term IN ({terms}) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT id, round(sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (words / docs)))), 6) AS score FROM tf JOIN df USING (term) CROSS JOIN n GROUP BY 1)"""


def _terms(j: Journal, *terms: str) -> DataFrame:
    return j.spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, terms))).alias("term"))


@query("notes_search", "," + _bm25("SELECT note_id AS id, title || ' ' || names || ' ' || kind AS body FROM notes JOIN (SELECT note_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS names FROM note_names GROUP BY 1) USING (note_id)", "'red', 'steel'") + " SELECT id AS note_id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s ORDER BY score DESC, id LIMIT 20", "notes", "note_names")
def _(j):
    notes = j.notes.select("note_id", "title", F.col("kind").alias("text"))
    return parts.notes_search(notes, j.note_names, _terms(j, "red", "steel"), 20).select("note_id", "score", "rank")


LINES = "SELECT doc_id * 10000 + k AS id, doc_id, l[k + 1] AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)"


def _sections(j: Journal) -> DataFrame:
    lines = j.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.select((F.col("doc_id") * 10000 + F.col("k")).alias("section_id"), F.col("doc_id").alias("entry_id"), F.lit("").alias("heading"), "text")


@query("sections_search", "WITH " + _bm25(LINES, "'apache', 'license', 'public'") + ", e AS (SELECT doc_id, max((score, -id)) AS b FROM s JOIN d USING (id) GROUP BY 1) SELECT doc_id AS entry_id, -b[2] AS section_id, b[1] AS score, CAST(row_number() OVER (ORDER BY b[1] DESC, doc_id) AS INTEGER) AS rank FROM e ORDER BY b[1] DESC, doc_id LIMIT 25")
def _(j):
    return parts.sections_search(_sections(j), _terms(j, "apache", "license", "public"), 25).select("entry_id", "section_id", "score", "rank")


@query("section_vectors", "SELECT label AS entry_id, arg_min(vec_id, (d, vec_id)) AS section_id, min(d) AS distance FROM (SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS d FROM embeddings) GROUP BY 1 ORDER BY distance, entry_id LIMIT 10")
def _(j):
    vectors = j.table("embeddings")
    return parts.section_vectors(vectors.select(F.col("vec_id").alias("section_id"), F.col("label").alias("entry_id"), "embedding"), vectors.where("vec_id = 0").select("embedding"), 10)


@query("photos_search", "WITH " + _bm25("SELECT page_id AS id, url AS body FROM pages", "'news', 'example', 'com'") + " SELECT id AS entry_id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s ORDER BY score DESC, id LIMIT 20")
def _(j):
    photos = j.table("pages").select(F.col("page_id").alias("photo_id"), F.col("page_id").alias("entry_id"), F.col("url").alias("description"))
    return parts.photos_search(photos, _terms(j, "news", "example", "com"), 20).select("entry_id", "rank")


BOOST = "linked AS (SELECT entry_id, entry_date FROM entries WHERE entry_id IN (SELECT entry_id FROM entry_entities WHERE note_id IN (SELECT note_id FROM notes WHERE kind = 'promo'))), boost AS (SELECT entry_id, CAST(row_number() OVER (ORDER BY entry_date DESC, entry_id DESC) AS INTEGER) AS rank FROM linked ORDER BY entry_date DESC, entry_id DESC LIMIT 20)"


@query("linked_boost", f", {BOOST} SELECT entry_id AS doc_id, rank FROM boost", "entries", "notes", "entry_entities")
def _(j):
    return parts.linked_boost(j.entry_entities, j.notes.where("kind = 'promo'"), j.entries, 20)


@query("retrieve_boosted", f", {BOOST}, m AS (SELECT entry_id, CAST(row_number() OVER (ORDER BY word_count DESC, entry_id) AS INTEGER) AS rank FROM entries ORDER BY word_count DESC, entry_id LIMIT 20), f AS (SELECT entry_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM (SELECT 0 AS list, * FROM m UNION ALL SELECT 1, * FROM boost) GROUP BY 1), t AS (SELECT * FROM f ORDER BY score DESC, first, entry_id LIMIT 15) SELECT entry_id, entry_date, CAST(row_number() OVER (ORDER BY score DESC, entry_date DESC, entry_id DESC) AS INTEGER) AS place FROM t JOIN entries USING (entry_id)", "entries", "notes", "entry_entities")
def _(j):
    order = Window.orderBy(F.desc("word_count"), "entry_id")
    longest = j.entries.orderBy(F.desc("word_count"), "entry_id").limit(20).select(F.col("entry_id").alias("doc_id"), F.row_number().over(order).alias("rank"))
    return parts.retrieve(j.entries, [longest, parts.linked_boost(j.entry_entities, j.notes.where("kind = 'promo'"), j.entries, 20)], 15)


@query("retrieve_newest", "SELECT entry_id, entry_date, CAST(row_number() OVER (ORDER BY entry_date DESC, entry_id DESC) AS INTEGER) AS place FROM entries ORDER BY entry_date DESC, entry_id DESC LIMIT 8", "entries")
def _(j):
    nothing = j.spark.range(0).select(F.col("id").alias("doc_id"), F.lit(1).alias("rank"))
    return parts.retrieve(j.entries, [nothing], 8)


@query("notes_for_answer", ", c AS (SELECT entry_id FROM entries ORDER BY entry_date DESC, entry_id DESC LIMIT 40), m AS (SELECT note_id, CAST(row_number() OVER (ORDER BY note_id) AS BIGINT) AS rank FROM notes WHERE note_id <= 3), r AS (SELECT note_id, (0, rank) AS f FROM m UNION ALL SELECT note_id, (1, -count(*)) FROM entry_entities WHERE entry_id IN (SELECT entry_id FROM c) GROUP BY 1), o AS (SELECT note_id, min(f) AS f FROM r GROUP BY 1) SELECT note_id, CAST(row_number() OVER (ORDER BY f, note_id) AS INTEGER) AS place FROM o ORDER BY f, note_id LIMIT 12", "entries", "notes", "entry_entities")
def _(j):
    matched = j.notes.where("note_id <= 3").select("note_id", F.row_number().over(Window.orderBy("note_id")).alias("rank"))
    return parts.notes_for_answer(matched, j.entry_entities, j.entries.orderBy(F.desc("entry_date"), F.desc("entry_id")).limit(40))


# --- digests of notes ---


@query("note_digest_inputs", f", u AS (SELECT {avg('mood_score')} AS usual_mood FROM entries) SELECT note_id, count(*) AS mentions, {avg('mood_score')} AS avg_mood, any_value(usual_mood) AS usual_mood, min(entry_date) AS first_date, max(entry_date) AS last_date FROM entry_entities JOIN entries USING (entry_id), u GROUP BY 1 HAVING count(*) >= 8", "entries", "entry_entities")
def _(j):
    return parts.digest_inputs(j.entries, j.entry_entities).drop("input_hash")


@query("note_digest_sample", ", r AS (SELECT note_id, entry_id, entry_date, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY note_id, year(entry_date)) AS n FROM entry_entities JOIN entries USING (entry_id) WINDOW w AS (PARTITION BY note_id, year(entry_date) ORDER BY entry_date, entry_id)), k AS (SELECT unnest(range(6)) AS k) SELECT note_id, entry_id, entry_date FROM r WHERE n <= 6 OR pos IN (SELECT CAST(round_even(k * (n - 1) / 5.0, 0) AS BIGINT) FROM k)", "entries", "entry_entities")
def _(j):
    return parts.digest_sample(j.entries, j.entry_entities)


@query("stale_note_digests", ", now AS (SELECT note_id, count(*) AS n FROM entry_entities GROUP BY 1 HAVING count(*) >= 8), was AS (SELECT note_id, count(*) AS n FROM entry_entities JOIN entries USING (entry_id) WHERE entry_date < DATE '1998-01-01' GROUP BY 1 HAVING count(*) >= 8) SELECT CAST(coalesce(now.note_id, was.note_id) AS VARCHAR) AS period, CASE WHEN now.n IS NULL THEN 'gone' WHEN was.n IS NULL THEN 'new' ELSE 'stale' END AS state FROM now FULL JOIN was ON now.note_id = was.note_id WHERE now.n IS DISTINCT FROM was.n", "entries", "entry_entities")
def _(j):
    hashes = lambda entries: parts.digest_inputs(entries, j.entry_entities).select(F.col("note_id").cast("string").alias("period"), "input_hash")
    return incremental.stale_periods(hashes(j.entries.where("entry_date < DATE '1998-01-01'")), hashes(j.entries))


# --- the writer's profile ---


def _hashed(j: Journal) -> DataFrame:
    return j.entries.select("entry_id", "entry_date", F.md5(F.col("entry_id").cast("string")).alias("text_hash"))


HASHED = "hashed AS (SELECT entry_id, entry_date, md5(CAST(entry_id AS VARCHAR)) AS text_hash FROM entries)"


@query("unread_entries", f", {HASHED} SELECT entry_id FROM hashed WHERE text_hash NOT IN (SELECT text_hash FROM hashed WHERE entry_date < DATE '1997-06-01')", "entries")
def _(j):
    rows = _hashed(j)
    return profile.unread(rows, rows.where("entry_date < DATE '1997-06-01'")).select("entry_id")


@query("scan_batches", ", r AS (SELECT year(entry_date) AS y, (row_number() OVER (PARTITION BY year(entry_date) ORDER BY entry_date, entry_id) - 1) // 8 AS k FROM entries) SELECT y || '-' || k AS batch, count(*) AS n FROM r GROUP BY 1", "entries")
def _(j):
    return profile.batches(j.entries).groupBy("batch").agg(F.count("*").alias("n"))


FACTS = "facts AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS text_hash, CAST(o_orderdate AS DATE) AS entry_date, o_orderpriority AS category, 'buys as ' || o_custkey AS fact FROM orders UNION ALL SELECT md5(CAST(o_orderkey AS VARCHAR)), CAST(o_orderdate AS DATE) + 1, 'wrong day', 'x' FROM orders UNION ALL SELECT md5(CAST(o_orderkey AS VARCHAR)), CAST(o_orderdate AS DATE), o_orderpriority, upper('buys as ' || o_custkey) FROM orders)"


def _facts(j: Journal) -> DataFrame:
    own = j.table("orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("text_hash"), F.to_date("o_orderdate").alias("entry_date"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("buys as "), F.col("o_custkey").cast("string")).alias("fact"))
    wrong = own.select("text_hash", F.date_add("entry_date", 1).alias("entry_date"), F.lit("wrong day"), F.lit("x"))
    return own.union(wrong).union(own.select("text_hash", "entry_date", "category", F.upper("fact")))


@query("profile_facts", f", {HASHED}, {FACTS}, g AS (SELECT f.*, row_number() OVER (PARTITION BY text_hash, lower(trim(fact)) ORDER BY entry_date, fact) AS rank FROM facts f WHERE (text_hash, entry_date) IN (SELECT (text_hash, entry_date) FROM hashed)) SELECT text_hash, entry_date, category, fact, false AS folded FROM g WHERE rank = 1", "entries")
def _(j):
    none = _facts(j).limit(0).withColumn("folded", F.lit(False))
    return profile.add_facts(none, _facts(j), _hashed(j))


# --- themes ---


@query("theme_tags", ", p AS (SELECT vec_id AS entry_id, label AS theme FROM embeddings), c AS (SELECT theme, tag, count(*) AS n FROM p JOIN entry_tags USING (entry_id) GROUP BY 1, 2) SELECT theme, tag, n, CAST(row_number() OVER (PARTITION BY theme ORDER BY n DESC, tag) AS INTEGER) AS rank FROM c QUALIFY rank <= 8", "entry_tags")
def _(j):
    placed = j.table("embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("theme"))
    return themes.shared_names(placed, j.entry_tags.select("entry_id", F.col("tag").alias("name")), 8).withColumnRenamed("name", "tag")


@query("themes_in_range", ", p AS (SELECT vec_id AS entry_id, label AS theme FROM embeddings) SELECT theme, count(*) AS n FROM p JOIN entries USING (entry_id) WHERE entry_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, theme LIMIT 5", "entries")
def _(j):
    placed = j.table("embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("theme"))
    return themes.in_range(placed, j.entries, "1996-01-01", "1997-12-31")


@query("themes_status", "SELECT count(*) AS total, count(*) FILTER (vec_id % 5 <> 0) AS stored, count(*) FILTER (vec_id % 5 = 0) AS placed, count(*) FILTER (vec_id % 5 = 0) > 0.2 * count(*) AS stale FROM embeddings")
def _(j):
    vectors = j.table("embeddings")
    return themes.status(vectors.where("vec_id % 5 <> 0").select("vec_id"), vectors.select("vec_id"))


@query("theme_newest", ", p AS (SELECT vec_id AS entry_id, label AS theme FROM embeddings) SELECT theme, entry_id, entry_date, CAST(row_number() OVER (PARTITION BY theme ORDER BY entry_date DESC, entry_id DESC) AS INTEGER) AS rank FROM p JOIN entries USING (entry_id) QUALIFY rank <= 30", "entries")
def _(j):
    placed = j.table("embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("theme"))
    return themes.newest(placed, j.entries)


@query("keyword_tokens", f"SELECT doc_id, CAST(len({TOKENS.format(x='text')}) AS INTEGER) AS n_tokens FROM documents")
def _(j):
    return j.table("documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("stored_postings_bm25", "WITH " + _bm25("SELECT doc_id AS id, text AS body FROM documents", "'public', 'license'") + " SELECT id AS doc_id, score FROM s ORDER BY score DESC, id LIMIT 15")
def _(j):
    stored = search.postings(j.table("documents"))
    return search.bm25(None, _terms(j, "public", "license"), 15, stored=stored).select("doc_id", "score")

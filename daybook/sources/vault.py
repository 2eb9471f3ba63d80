"""A folder of Markdown files as DataFrames: listing, parsing, and the child tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import folded
from . import markdown

FILES = "path string, content_hash string, kind string, text string"
ENTRIES = (
    "path string, ordinal int, entry_date date, raw_text string, word_count long, private boolean, tags array<string>, links array<string>, "
    "labels array<array<string>>, anchors array<array<string>>, sections array<struct<heading:string,start_line:int,end_line:int,text:string>>, frontmatter map<string,array<string>>"
)
NOTES = "path string, title string, kind string, raw_text string, private boolean, aliases array<string>, links array<string>, properties map<string,array<string>>"


def listing(spark: SparkSession, folder: str, rules: markdown.Rules = markdown.Rules()) -> DataFrame:
    """(path, content_hash, kind, text) of the Markdown files below a folder; kind is null for entries."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})")
    found = files.select(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")).alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("text"))

    def kinds(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            keep = pa.array([not markdown.ignored(p, rules.ignore) for p in paths], pa.bool_())
            kind = pa.array([markdown.note_kind(p, rules) for p in paths], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("content_hash"), kind, batch.column("text")], ["path", "content_hash", "kind", "text"]).filter(keep)

    return found.mapInArrow(kinds, FILES)


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    maps = [f.name for f in schema if pa.types.is_map(f.type)]
    for row in rows:
        for name in maps:
            row[name] = list(row[name].items())
    return pa.RecordBatch.from_pylist(rows, schema)


def entries(files: DataFrame, rules: markdown.Rules = markdown.Rules()) -> DataFrame:
    """Parsed entries, without private ones. entry_id follows from path and place, so it is the same in every run."""
    item = pa.struct([("heading", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])
    texts, pairs = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
    schema = pa.schema(
        [("path", pa.string()), ("ordinal", pa.int32()), ("entry_date", pa.date32()), ("raw_text", pa.string()), ("word_count", pa.int64()), ("private", pa.bool_()), ("tags", texts), ("links", texts),
         ("labels", pairs), ("anchors", pairs), ("sections", pa.list_(item)), ("frontmatter", pa.map_(pa.string(), texts))]
    )

    def parse(batches):
        for batch in batches:
            rows = [e for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for e in markdown.entries(p, t or "", rules)]
            yield _arrow(rows, schema)

    parsed = files.where("kind IS NULL").select("path", "text").mapInArrow(parse, ENTRIES)
    return parsed.where("NOT private").withColumn("entry_id", F.xxhash64("path", "ordinal"))


def notes(files: DataFrame, rules: markdown.Rules = markdown.Rules()) -> DataFrame:
    texts = pa.list_(pa.string())
    schema = pa.schema([("path", pa.string()), ("title", pa.string()), ("kind", pa.string()), ("raw_text", pa.string()), ("private", pa.bool_()), ("aliases", texts), ("links", texts), ("properties", pa.map_(pa.string(), texts))])

    def parse(batches):
        for batch in batches:
            rows = [markdown.note(p, t or "", k, rules) for p, t, k in zip(*(batch.column(x).to_pylist() for x in ("path", "text", "kind")), strict=True)]
            yield _arrow(rows, schema)

    parsed = files.where("kind IS NOT NULL").select("path", "text", "kind").mapInArrow(parse, NOTES)
    return parsed.where("NOT private").withColumn("note_id", F.xxhash64("path"))


def child_tables(entries_: DataFrame, notes_: DataFrame, *keep: str) -> dict[str, DataFrame]:
    """Links, tags, sections, names and properties, exploded; with the columns `keep` of the file's row."""
    entry = lambda *columns: entries_.select("entry_id", *columns, *keep)
    note = lambda *columns: notes_.select("note_id", *columns, *keep)
    properties = note(F.explode("properties").alias("name", "values"))
    return {
        "entry_links": entry(F.explode("links").alias("target")),
        "entry_link_labels": entry(F.explode("labels").alias("l")).select("entry_id", F.col("l")[0].alias("target"), F.col("l")[1].alias("label"), *keep),
        "entry_link_anchors": entry(F.explode("anchors").alias("l")).select("entry_id", F.col("l")[0].alias("target"), F.col("l")[1].alias("anchor"), *keep),
        "entry_tags": entry(F.explode("tags").alias("tag")),
        "entry_sections": entry(F.posexplode("sections").alias("place", "s")).select("entry_id", "place", "s.*", *keep),
        "note_names": note(F.explode(F.concat(F.array("title"), "aliases")).alias("name")).select("note_id", folded(F.col("name")).alias("key"), "name", *keep).distinct(),
        "titles": note(folded(F.col("title")).alias("key")).select("key", "note_id", *keep),
        "note_property_values": properties.select("note_id", F.lower("name").alias("key"), "name", F.explode("values").alias("value"), *keep),
        "note_links": note(F.explode("links").alias("target")),
    }


def headers(files: DataFrame) -> DataFrame:
    """(path, frontmatter) of listed files: the properties alone, nothing below them is read."""
    texts = pa.list_(pa.string())
    schema = pa.schema([("path", pa.string()), ("frontmatter", pa.map_(pa.string(), texts))])

    def parse(batches):
        for batch in batches:
            rows = [{"path": p, "frontmatter": markdown.header(t or "")[0]} for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield _arrow(rows, schema)

    top = F.regexp_extract("text", r"(?s)^(\x{FEFF}?---[ \t]*\r?\n.*?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$))", 1)
    return files.select("path", top.alias("text")).mapInArrow(parse, "path string, frontmatter map<string,array<string>>")


def images(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path) of the files that embedded names mean: by their path, else the file of that name that is nearest to the root, the
    first by path of equals. `files` (path): hidden folders are left out."""
    shown = files.where(~F.col("path").rlike(r"(^|/)\.")).select("path", F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("base"), F.size(F.split("path", "/")).alias("depth"))
    wanted = names.select("name", F.lower(F.regexp_extract("name", r"([^/]*)$", 1)).alias("base")).distinct()
    exact = (F.lower("path") == F.lower("name")).cast("int")
    found = wanted.join(shown, "base").groupBy("name").agg(F.min(F.struct((-exact).alias("by"), "depth", "path")).alias("f"))
    return found.select("name", F.col("f.path").alias("path"))


#: Where a notes app keeps its settings of daily notes and of files it leaves out.
APP_FOLDER, DAILY, GENERAL = ".obsidian", "daily-notes.json", "app.json"


def app_settings(vault: str) -> dict:
    """What a notes app says of a vault: date format, folder and template of daily notes, and what it leaves out; empty without it."""
    import json
    from pathlib import Path

    out = {}
    for file, keys in ((DAILY, {"format": "date_format", "folder": "folder", "template": "template"}), (GENERAL, {"userIgnoreFilters": "ignore"})):
        path = Path(vault) / APP_FOLDER / file
        try:
            found = json.loads(path.read_text(encoding="utf-8-sig")) if path.exists() else {}
        except ValueError:
            found = {}
        out |= {ours: found[theirs] for theirs, ours in keys.items() if isinstance(found, dict) and found.get(theirs)}
    return out


def advice(vault: str, rules: markdown.Rules) -> list[str]:
    """Where the settings differ from the notes app's."""
    from ..operators.lookups import date_format

    own, said = app_settings(vault), []
    if "date_format" in own and date_format(own["date_format"].rpartition("/")[2]) != rules.date_format:
        said.append(f"daily notes are named {own['date_format']}: set date_format to {date_format(own['date_format'].rpartition('/')[2])}")
    for key in ("template", "ignore"):
        for path in [own[key]] if isinstance(own.get(key), str) else own.get(key, []):
            if path not in rules.ignore:
                said.append(f"{path} is no daily note: add it to ignore")
    return said

"""Text rules as columns: link keys, tags, names, keywords, numbers in properties, CSV guards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from .lines import sentences, stem

#: Endings of files that a link may name but that are no notes, and of images that a model can look at.
ATTACHMENTS = tuple("png jpg jpeg gif webp svg bmp avif heic tif tiff mp4 mov webm mkv avi m4v mp3 wav m4a ogg flac opus pdf canvas".split())
IMAGES = tuple("png jpg jpeg gif webp bmp avif heic tif tiff".split())
#: Words that say nothing in a search.
STOP_WORDS = (
    "the and for with that this was were are have has had not you your but about from what when where which who how did does "
    "been they them their there here his her she him its our out into than then over just like any all can will would could should"
).split()


def folded(name: Column) -> Column:
    """Case folded, as Python's str.casefold: ß is ss, and a closing sigma the same letter as any other."""
    return F.translate(F.lower(F.upper(name)), "ς", "σ")


def link_key(target: Column) -> Column:
    """What a link names: no label, heading or block, the last part of the path, no .md, folded case; null for attachments."""
    bare = F.regexp_replace(target, r"[|#^].*$", "")
    last = F.trim(F.regexp_replace(bare, r"^.*/", ""))
    key = folded(F.regexp_replace(last, r"(?i)\.md$", ""))
    return F.when((key != "") & ~key.rlike(rf"\.({'|'.join(ATTACHMENTS)})$"), key)


def links(text: Column) -> Column:
    """Targets between double square brackets, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def link_keys(text: Column) -> Column:
    keys = F.transform(links(text), lambda t: link_key(t))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def link_labels(text: Column) -> Column:
    """(target, label) of links whose shown text differs from what they name."""
    pairs = F.transform(F.filter(links(text), lambda t: F.contains(t, F.lit("|"))), lambda t: F.struct(link_key(t).alias("target"), F.trim(F.regexp_replace(t, r"^[^|]*\|", "")).alias("label")))
    return F.array_distinct(F.filter(pairs, lambda p: p["target"].isNotNull() & (p["label"] != "") & (folded(p["label"]) != p["target"])))


def link_anchors(text: Column) -> Column:
    """(target, anchor) of links to a heading or block."""
    pairs = F.transform(F.filter(links(text), lambda t: F.contains(t, F.lit("#"))), lambda t: F.struct(link_key(t).alias("target"), F.trim(F.regexp_replace(F.regexp_replace(t, r"\|.*$", ""), r"^[^#]*#", "")).alias("anchor")))
    return F.array_distinct(F.filter(pairs, lambda p: p["target"].isNotNull() & (p["anchor"] != "")))


def shown_text(target: Column) -> Column:
    """How a link reads: its label, else the name, with `A > B` for a heading; a block shows nothing."""
    bare = F.regexp_replace(target, r"#\^.*$", "")
    return F.when(F.contains(target, F.lit("|")), F.regexp_replace(target, r"^[^|]*\|", "")).otherwise(F.regexp_replace(F.regexp_replace(bare, r"^.*/", ""), "#", " > "))


def image_names(text: Column) -> Column:
    """Images embedded in either notation, no web addresses, escapes undone."""
    ends = "|".join(IMAGES)
    wiki = F.regexp_extract_all(text, F.lit(rf"(?i)!\[\[([^\[\]|#]+\.(?:{ends}))(?:[|#][^\[\]]*)?\]\]"), F.lit(1))
    written = F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1)), lambda d: F.trim(d))
    # in angle brackets a name may hold spaces; else a title follows the first one
    places = F.transform(written, lambda d: F.when(F.startswith(d, F.lit("<")), F.substring_index(F.substring_index(d, "<", -1), ">", 1)).otherwise(F.substring_index(d, " ", 1)))
    mark = F.filter(places, lambda d: F.lower(F.substring_index(d, ".", -1)).isin(*IMAGES) & F.contains(d, F.lit(".")) & ~F.contains(d, F.lit(":")))
    return F.array_distinct(F.concat(F.transform(wiki, lambda n: F.trim(n)), F.transform(mark, lambda n: F.try_url_decode(n))))


def strip_comments(text: Column) -> Column:
    """Without %%...%%; an open one runs to the end."""
    return F.regexp_replace(text, r"(?s)%%.*?(?:%%|\z)", "")


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(tag), r"^#+", ""))


def literal_tags(text: Column) -> Column:
    """#tags: after white space or the start, not of digits alone; lower case, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\S)#([\p{L}\p{N}_/\-]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda t: ~t.rlike(r"^\p{N}+$")), lambda t: F.lower(t)))


def final_tags(reading: Column, own: Column, merge: dict[str, str], ignored: tuple[str, ...] = ()) -> Column:
    """The model's tags, then the file's: normalised, merged, without ignored ones, each once."""
    names = F.filter(F.transform(F.concat(reading, own), lambda t: tag_name(t)), lambda t: t != "")
    if merge:
        table = F.create_map(*(F.lit(x) for pair in resolve_merges(merge).items() for x in pair))
        names = F.transform(names, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.array_distinct(F.filter(names, lambda t: ~t.isin(*ignored)) if ignored else names)


def resolve_merges(merge: dict[str, str]) -> dict[str, str]:
    """Every tag with the last one of its chain; ValueError for a cycle."""
    out = {}
    for tag in merge:
        seen, at = {tag}, merge[tag]
        while at in merge:
            if at in seen:
                raise ValueError(f"tags merge in a cycle: {at}")
            seen.add(at)
            at = merge[at]
        out[tag] = at
    return out


def words(text: Column) -> Column:
    """Letters and digits in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Words for keyword search: lower case without accents."""
    bare = F.regexp_replace(F.call_function("lower", text), r"\p{M}+", "")
    folded = F.translate(bare, ACCENTED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Accented letters and what a search takes them for.
ACCENTED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def search_keywords(text: Column, most: int = 8) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'\-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOP_WORDS))), 1, most)


def name_key(label: Column) -> Column:
    """A name in lower case, spaces folded, without a closing 's."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\s+", " "))), "['’]s$", "")


def metric_value(raw: Column) -> Column:
    """A property's number: 7 7,5 -2 7h 8k 7:30 yes; null for ranges, dates and other text."""
    text = F.lower(F.trim(raw))
    number = F.regexp_extract(text, r"^(-?\d+(?:[.,]\d+)?)\s*(k?)\s*[\p{L}%]*$", 1)
    thousands = F.regexp_extract(text, r"^(-?\d+(?:[.,]\d+)?)\s*(k)$", 2) == "k"
    plain = F.regexp_replace(number, ",", ".").try_cast("double") * F.when(thousands, 1000.0).otherwise(1.0)
    clock = F.regexp_extract(text, r"^(\d{1,2}):([0-5]\d)$", 1).try_cast("double") + F.regexp_extract(text, r"^(\d{1,2}):([0-5]\d)$", 2).try_cast("double") / 60
    clock = F.round(clock, 2)
    return F.when(text.isin("true", "yes"), 1.0).when(text.isin("false", "no"), 0.0).when(text.rlike(r"^\d{1,2}:[0-5]\d$"), clock).otherwise(plain)


def mood_scale(raw: Column, low: float = 1.0, high: float = 10.0, top: float = 10.0) -> Column:
    """A mood written on low..high (or as v/high), clamped and stretched to 1..top, two places."""
    text = F.trim(raw)
    value = F.regexp_replace(F.regexp_extract(text, r"^(-?\d+(?:[.,]\d+)?)(?:/(\d+))?$", 1), ",", ".").try_cast("double")
    own = F.coalesce(F.regexp_extract(text, r"^(-?\d+(?:[.,]\d+)?)(?:/(\d+))?$", 2).try_cast("double"), F.lit(float(high)))
    held = F.greatest(F.lit(float(low)), F.least(value, own))
    return F.when(value.isNotNull() & (own > low), F.round(1 + (held - low) * (top - 1) / (own - low), 2))


def csv_guard(cell: Column) -> Column:
    """A text cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def clip(text: Column, most: int) -> Column:
    """At most so many characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def relative_path(path: Column, root: str) -> Column:
    """The path below a root; null for one that isn't."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1)))


def app_url(vault: str, path: Column) -> Column:
    """A link that opens a vault's file in a notes app; the file's name goes without .md."""
    bare = F.regexp_replace(path, r"\.md$", "")
    return F.concat(F.lit(f"obsidian://open?vault={_quoted(vault)}&file="), F.regexp_replace(F.url_encode(bare), r"\+", "%20"))


def _quoted(text: str) -> str:
    from urllib.parse import quote

    return quote(text, safe="")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# --- plain Python, for Arrow functions and the driver ---


def terms(text: str) -> set[str]:
    return {stem(w) for w in re.findall(r"\w+", text.lower()) if len(w) > 2 and w not in STOP_WORDS}


def words_among(text: str, stems: set[str]) -> dict[str, str]:
    """Words of a text, in lower case, with their stems, where these are among `stems`: its values are `terms(text) & stems`.

    A word, case folded, begins with its stem. So a text that holds none of the stems isn't cut into words, and of another each word
    is stemmed once, if it begins as one of them does.
    """
    lower = text.lower()
    folded = lower if lower.isascii() else lower.casefold()
    near = [s for s in stems if s in folded]
    if not near:
        return {}
    least = min(map(len, near))
    begin = {s[:least] for s in near}
    words = {w for w in re.findall(r"\w+", lower) if len(w) > 2 and w.casefold()[:least] in begin}
    return {w: s for w in words if w not in STOP_WORDS and (s := stem(w)) in stems}


def stems_of(part: str, words: dict[str, str]) -> set[str]:
    """Stems of a sentence of a text by what `words_among` gives for the whole text."""
    return {words[w] for w in re.findall(r"\w+", part.lower()) if w in words}

"""Rules of texts against their cases: stems, sentences, explicit days, link keys, images, sections, stand-in words."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from daybook.functions import lines, periods, text
from daybook.operators import links
from daybook.sources import markdown


@pytest.mark.parametrize(("words", "stem"), [("hike hiked hiking hikes", "hik"), ("run running runs", "run"), ("stopped stop", "stop"), ("called call", "call"), ("passed pass", "pass"), ("slowly slow", "slow"), ("focus", "focus"), ("analysis", "analysis"), ("classes class", "class"), ("bus", "bus"), ("the", "the"), ("ice", "ice"), ("'tis-", "tis"), ("sing", "sing"), ("Ärzte", "ärzt")])
def test_stems(words, stem):
    assert {lines.stem(w) for w in words.split()} == {stem}


def test_sentences():
    said = "# Title\n\n- [ ] Call Ann. She waits!\n1. First item\n| a | b |\n```py\nno.code()\n```\n  * nested (e.g. this) ends? Yes\nLast line…\n~~~\nopen fence. Not told."
    assert lines.sentences(said) == ["Call Ann.", "She waits!", "First item", "nested (e.g.", "this) ends?", "Yes", "Last line…"]
    assert lines.sentences("") == [] and lines.sentences("- ") == [] and lines.sentences("3.5 litres. 2) no") == ["3.5 litres.", "2) no"]


TODAY = date(2024, 6, 15)
DAYS = {
    "what happened on July 4th?": date(2023, 7, 4), "on 4 July 2021": date(2021, 7, 4), "on the 3rd of may": date(2024, 5, 3), "dec. 20": date(2023, 12, 20), "2024-03-02": date(2024, 3, 2),
    "yesterday's walk": date(2024, 6, 14), "how was today": TODAY, "June 15": TODAY, "June 16": date(2023, 6, 16), "february 30": None, "march 2024": None, "2024-13-01": None, "may I ask": None, "no day": None,
    "since July 4th": None, "over 2024-03-02": None, "during july 4": None, "through 4 July": None, "till yesterday": None, "throughout 2024-03-02": None, "between 1 May and 3 May": None, "feb 29": date(2024, 2, 29), "feb 29 2023": None,
}


@pytest.mark.parametrize("question", DAYS)
def test_explicit_days(question):
    assert periods.explicit_day(question, TODAY) == DAYS[question]


def test_attachments_are_no_notes(spark):
    targets = ["photo.heic", "clip.mkv", "Board.canvas", "a/song.OPUS", "data.csv", "x.zip", "Note", "Note.md", "v1.2 plan"]
    rows = spark.createDataFrame([(t,) for t in targets], "t string").select("t", text.link_key(F.col("t")).alias("key")).collect()
    want = {t: None for t in targets[:4]} | {"data.csv": "data.csv", "x.zip": "x.zip", "Note": "note", "Note.md": "note", "v1.2 plan": "v1.2 plan"}
    assert {r.t: r.key for r in rows} == want == {t: markdown.link_key(t) for t in targets}


def test_images(spark):
    said = "![[a.heic]] ![[b b.PNG|300]] ![x](c%20c.avif) ![](<d d.tif>) ![t](e.jpg \"title\") ![u](https://h.org/f.png) ![[g.pdf]] ![v](h.svg) ![w](i.jpeg"
    assert spark.createDataFrame([(said,)], "t string").select(text.image_names(F.col("t")).alias("i")).first().i == ["a.heic", "b b.PNG", "c c.avif", "d d.tif", "e.jpg"]


def test_sections_by_their_path():
    note = "# A\nx\n## B\ny\n# C\n## B\nz\n```\n# no\n```\n- one ^p\n- two ^q\n\npara\nmore ^r"
    assert markdown.find_section(note, "A#B") == "## B\ny" and markdown.find_section(note, "C#B").startswith("## B\nz")
    assert markdown.find_section(note, "Renamed#b") == "## B\ny" and markdown.find_section(note, "a").startswith("# A\nx\n## B")
    assert markdown.find_section(note, "^q") == "- two" and markdown.find_section(note, "^r") == "para\nmore" and markdown.find_section(note, "^s") is None
    assert markdown.find_section(note, "no") is None and markdown.find_section(note, "#") is None


def test_task_boxes_go():
    assert markdown.clean("- [x] done [[A]]\n  * [/] half\n1. [ ] stays\n- [link] no")[0] == "- done A\n  * half\n1. [ ] stays\n- [link] no"


def test_labels_of_stand_in_words_are_no_names(spark):
    rows = [(k, 1, label) for k in range(3) for label in ("her and them", "Those", "Aunt May", "you and I's")]
    labels = spark.createDataFrame(rows, "entry_id long, note_id long, label string")
    found = links.learned_names(labels, spark.createDataFrame([], "note_id long, key string, name string"))
    assert {r.name for r in found.collect()} == {"Aunt May"}

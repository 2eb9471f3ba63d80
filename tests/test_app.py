"""A small vault from files to answers."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from daybook import app, config, serve
from daybook.operators import history


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    (root / "Links/People").mkdir(parents=True)
    (root / "Links/People/Jane Roe.md").write_text("---\naliases: [Jane]\nRelation: Friend\n---\nKeeps bees.")
    (root / "Links/People/Sam.md").write_text("---\nRelation: Family\n---\nCousin.")
    for k in range(1, 11):
        mood, link, tag = (3, "[[Sam]]", "work") if k % 2 else (9, "[[Jane Roe|Jane]] and [[Lost Place]]", "garden")
        (root / f"2024-01-{k:02d}.md").write_text(f"---\nmood: {mood}\nsleep: {k / 2}\n---\nA day of {tag} with {link}. #{tag}\n")
    (root / "2024-02-01.md").write_text("Saw Jane at the market. #therapy")
    (root / "settings.toml").write_text('withheld_tags = []\n[tags.merge]\ngarden = "outdoors"\n')
    settings = config.load(str(root / "settings.toml"))
    settings.vault.path = str(root)
    folder = str(tmp_path_factory.mktemp("tables"))
    plan = app.index(spark, settings, folder)
    assert {r.change for r in plan.collect()} == {"new"}
    (root / "2024-01-01.md").write_text("---\nmood: 3\nsleep: 0.5\n---\nA day of work with [[Sam]], again. #work")
    assert {r.path: r.change for r in app.index(spark, settings, folder).collect()}["2024-01-01.md"] == "changed"
    return app.Daybook.open(spark, folder)


def test_questions(book):
    assert [(r.month, r.avg_mood, r.entry_count) for r in book.mood().collect()] == [("2024-01", 6.0, 10), ("2024-02", None, 1)]
    assert book.mood(about="Jane").first().avg_mood == 9.0 and book.mood(group="relation=family").first().avg_mood == 3.0
    assert {r.tag: r.n for r in book.tags().collect()} == {"work": 5, "outdoors": 5, "therapy": 1}
    assert book.streaks().first().longest == 10
    assert [(r.target, r.n) for r in book.unresolved().collect()] == [("lost place", 5)]
    assert [r.entry_date for r in book.unlinked().collect()] == [dt.date(2024, 2, 1)]
    assert {r.key: r.n for r in book.metrics().collect()} == {"mood": 10, "sleep": 10}
    assert {r.value: r.entries for r in book.groups("Relation").collect()} == {"Friend": 5, "Family": 5}
    assert ("tag", "work") in {(r.kind, r.name) for r in book.insights().collect()}
    assert book.search("market").first().sentence.startswith("Saw Jane")
    assert {(r.of, r.name): r.change for r in book.compare("2024-01", "2024-02").collect()}[("tag", "work")] == "gone"
    assert book.review("2024").count() == 12 and book.digest("year").first().entry_count == 11
    assert book.on_this_day(dt.date(2025, 1, 3)).first().entry_date == dt.date(2024, 1, 3)
    assert book.show(dt.date(2024, 1, 2)).first().tags == ["outdoors"]
    assert book.export().count() == 11 and book.lapsed(today=dt.date(2026, 1, 1)).count() == 2


def test_broken_links_and_hybrid_search(book):
    lost = book.broken().collect()
    assert [(r.target, r.entries, r.reason) for r in lost] == [("lost place", 5, "missing")]

    class Near:
        name = "near"

        def embed(self, text):
            return book.table("entry_vectors").orderBy("entry_id").first().embedding

    first = book.table("entry_vectors").orderBy("entry_id").first().entry_id
    assert first in {r.entry_id for r in book.search("zebra", client=Near()).collect()}
    both = book.search("market", client=Near()).collect()
    assert {first} < {r.entry_id for r in both} and any(r.sentence and r.sentence.startswith("Saw Jane") for r in both)


def test_withheld(book):
    hidden = app.Daybook(book.spark, book.folder, book.version, ("therapy",), ("people",))
    assert hidden.entries.count() == 0 and app.Daybook(book.spark, book.folder, book.version, ("therapy",)).entries.count() == 10


def test_more_questions(book, tmp_path):
    jane = book.note("jane").first()
    assert (jane.title, jane.mentions) == ("Jane Roe", 5)
    near = book.similar(dt.date(2024, 1, 2), 3).collect()
    assert len(near) == 3 and dt.date(2024, 1, 2) not in {r.entry_date for r in near}
    stage, said = book.ask("what about the market in 2024-02?", today=dt.date(2024, 6, 1)).first()
    assert stage in ("fast", "precise") and said
    assert book.rollup("month").count() == 2 and all(r.ok for r in book.doctor().collect())
    assert app.init(book.spark, str(tmp_path / "s.toml")).first().made and not app.init(book.spark, str(tmp_path / "s.toml")).first().made
    assert config.load(str(tmp_path / "s.toml")).vault.notes_path == "Links"


def test_serving(book):
    import io
    import threading
    import urllib.error
    import urllib.request

    rpc = serve.Rpc(book)
    say = lambda **m: json.loads(json.dumps(rpc.reply(json.dumps({"jsonrpc": "2.0", **m}))))
    assert len(say(id=1, method="tools/list")["result"]["tools"]) == len(serve.QUESTIONS) and say(id=2, method="ping")["result"] == {}
    called = say(id=3, method="tools/call", params={"name": "mood", "arguments": {"about": "Jane"}})["result"]
    assert not called["isError"] and json.loads(called["content"][0]["text"])[0]["avg_mood"] == 9.0
    assert say(id=4, method="tools/call", params={"name": "note", "arguments": {}})["result"]["isError"] and say(id=5, method="no")["error"]["code"] == -32601
    assert rpc.reply("{") is not None and rpc.reply('{"method": "notifications/initialized"}') is None
    out = io.StringIO()
    rpc.serve(io.StringIO('{"id": 1, "method": "ping"}\n\n'), out)
    assert json.loads(out.getvalue())["id"] == 1
    assert "text" not in serve.asked(book, "day", {"day": "2024-01-02"}, raw=False)[0]
    server = serve.http_server(book, answer=lambda q: iter(["a", q]))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api/"
    assert json.load(urllib.request.urlopen(base + "streaks"))[0]["longest"] == 10
    assert urllib.request.urlopen(base + "ask?question=b").read().decode() == 'data: "a"\n\ndata: "b"\n\n'
    for path, headers, code in (("nothing", {}, 404), ("note", {}, 400), ("mood", {"Sec-Fetch-Site": "cross-site"}, 403), ("mood", {"Host": "evil.example"}, 403)):
        with pytest.raises(urllib.error.HTTPError) as wrong:
            urllib.request.urlopen(urllib.request.Request(base + path, headers=headers))
        assert wrong.value.code == code
    server.shutdown()
    assert serve.completions(book, "notes", "ja") == ["Jane", "Jane Roe"] and serve.completions(book, "months", "2024-0") == ["2024-01", "2024-02"]
    assert "mood" in serve.completion_script(["mood", "ask"]) and "complete -c" in serve.completion_script(["mood"], "fish")


def test_history(spark):
    asked = spark.createDataFrame([], "asked_id long, conversation string, asked_at timestamp, source string, question string, stage string, answer string")
    for k in range(3):
        asked = history.record(asked, "a" if k < 2 else "b", dt.datetime(2024, 1, 1 + k), "cli" if k < 2 else "web", f"q{k}", "fast", "x")
    assert [r.question for r in history.recent(asked, 2).collect()] == ["q2", "q1"] and history.get(asked, 2).first().question == "q1"
    assert [r.question for r in history.last_conversation(asked, "cli").collect()] == ["q0", "q1"]
    assert history.delete(asked, 1).count() == 2 and history.clear(asked).count() == 0 and history.counts(asked).first().conversations == 2


def test_commands(book):
    got = app.run(book.spark, ["--tables", book.folder, "mood", "--since", "2024-01-05", "--tag", "work"]).collect()
    assert [(r.month, r.entry_count) for r in got] == [("2024-01", 3)]


def test_settings_are_checked(tmp_path):
    for bad in ("[vault]\nmood_scale_max = 0", "[vault]\nsplit = '('", "[nothing]\nx = 1", "[tags.merge]\na = 'b'\nb = 'a'", "[indexing]\ndetail_long_words = 1"):
        (tmp_path / "x.toml").write_text("﻿" + bad)
        with pytest.raises(config.Invalid):
            config.load(str(tmp_path / "x.toml"))

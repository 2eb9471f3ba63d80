"""The incremental index: what is asked of the model, what is written, what readers see, what settings make anew, and the watch."""

from __future__ import annotations

import json
import random
from datetime import datetime
from pathlib import Path

import pytest

from daybook import app, config
from daybook.operators import buckets, calls


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(buckets, "BUCKETS", 8)


class Counting:
    """A client that writes down every call; `broken` is a file that makes calls fail while it is there."""

    name = "counting"

    def __init__(self, folder, broken="", weights=None):
        self.folder, self.broken, self.weights = str(folder), str(broken), weights

    def _note(self, kind, text):
        if self.broken and Path(self.broken).exists():
            raise ConnectionError("no model")
        with (Path(self.folder) / "calls").open("a") as f:
            f.write(json.dumps([kind, text]) + "\n")

    def complete(self, prompt):
        self._note("text", prompt)
        if "unreadable" in prompt:
            raise ValueError("no")
        return json.dumps({"summary": prompt[:9], "mood": len(prompt) % 10, "tags": ["read"]})

    def embed(self, text):
        self._note("vector", text)
        return [float(len(text)), 1.0]

    def calls(self):
        file = Path(self.folder) / "calls"
        found = [json.loads(x)[0] for x in file.read_text().splitlines()] if file.exists() else []
        file.unlink(missing_ok=True)
        return found.count("text"), found.count("vector")


def settings_of(root):
    found = config.Config()
    found.vault.path = str(root)
    found.vault.notes_path = "Links"
    return found


def state(spark, folder):
    book = app.Daybook.open(spark, folder)
    names = sorted(book.store.tables)
    return {n: sorted((json.dumps(r.asDict(True), default=str, sort_keys=True) for r in book.table(n).collect())) for n in names}


def vault_of(root, n=6):
    (root / "Links").mkdir(parents=True)
    (root / "Links/Ann.md").write_text("---\naliases: [Annie]\n---\nA friend.")
    for k in range(1, n + 1):
        (root / f"2024-01-{k:02d}.md").write_text(f"---\nsleep: {k}\n---\nDay {k} with [[Ann]]. #tag{k % 2}")


def test_one_reading_and_one_embedding_an_entry(spark, tmp_path):
    root, folder, client = tmp_path / "vault", str(tmp_path / "tables"), Counting(tmp_path)
    vault_of(root, 6)
    own = settings_of(root)
    app.index(spark, own, folder, client)
    assert client.calls() == (6, 6)
    files = {p for p in Path(folder, "data").rglob("*.parquet")}
    assert {r.change for r in app.index(spark, own, folder, client).collect()} == {"unchanged"}
    assert client.calls() == (0, 0) and {p for p in Path(folder, "data").rglob("*.parquet")} == files
    old = app.Daybook.open(spark, folder)
    before = old.entries.collect()
    (root / "2024-01-03.md").write_text("Day three, told anew.")
    (root / "2024-01-04.md").unlink()
    (root / "2024-01-09.md").write_text("---\nsleep: 1\n---\nDay 1 with [[Ann]]. #tag1")
    assert {r.path for r in app.index(spark, own, folder, client, dry_run=True).where("change <> 'unchanged'").collect()} == {"2024-01-03.md", "2024-01-04.md", "2024-01-09.md"}
    assert client.calls() == (0, 0)
    app.index(spark, own, folder, client)
    assert client.calls() == (1, 1)  # the ninth says what the first does
    touched = {b.name for b in Path(folder, "data/entries/2").glob("bucket=*")}
    store = buckets.BucketStore(spark, folder)
    mark = lambda p: spark.createDataFrame([(p,)], "p string").select(store.bucket("p").alias("b")).first().b
    assert touched <= {f"bucket={mark(p)}" for p in ("2024-01-03.md", "2024-01-04.md", "2024-01-09.md")}
    assert old.entries.collect() == before  # a reader that opened the old commit still sees it whole
    fresh = str(tmp_path / "fresh")
    app.index(spark, own, fresh, Counting(tmp_path))
    assert state(spark, fresh) == state(spark, folder)
    client.calls()
    heavier = Counting(tmp_path, weights="b")
    app.index(spark, own, folder, heavier, force=True)
    assert heavier.calls() == (5, 5)  # other weights are another model; six entries, two of which say the same
    assert store.vacuum() == [] and buckets.BucketStore(spark, folder).vacuum() and state(spark, fresh) == state(spark, folder)


def test_a_run_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root, folder, broken = tmp_path / "vault", str(tmp_path / "tables"), tmp_path / "broken"
    client = Counting(tmp_path, broken)
    vault_of(root, 3)
    own = settings_of(root)
    app.index(spark, own, folder, client)
    before = state(spark, folder)
    (root / "2024-01-02.md").write_text("Other words, unreadable.")
    broken.touch()
    with pytest.raises(Exception, match="ConnectionError"):
        app.index(spark, own, folder, client)
    broken.unlink()
    assert state(spark, folder) == before and not list(Path(folder, "staged").iterdir())
    monkeypatch.setattr(buckets.BucketStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        app.index(spark, own, folder, client)
    monkeypatch.undo()
    assert state(spark, folder) == before
    client.calls()
    app.index(spark, own, folder, client)
    # the embedding is known from the broken run; a failed reading is asked again, and its file is in error until it works
    assert client.calls() == (1, 0)
    files = {r.path: r.status for r in app.Daybook.open(spark, folder).table("files").collect()}
    assert files["2024-01-02.md"] == "error" and files["2024-01-01.md"] == "indexed"
    assert {r.path: r.change for r in app.index(spark, own, folder, client, dry_run=True).collect()}["2024-01-02.md"] == "retry"


def test_settings_make_their_tables_anew(spark, tmp_path):
    """Whatever a setting changes, the tables are those of a full run with it; the model isn't asked."""
    root, folder, client = tmp_path / "vault", str(tmp_path / "tables"), Counting(tmp_path)
    vault_of(root, 4)
    own = settings_of(root)
    app.index(spark, own, folder, client)
    client.calls()
    for k, (change, rewritten) in enumerate([(lambda: own.tags.merge.update(tag1="odd"), {"entry_tags"}), (lambda: setattr(own.metrics, "keys", ["sleep"]), {"entry_metrics"}), (lambda: setattr(own.metrics, "mood_key", "sleep"), {"entries"})], 2):
        change()
        app.index(spark, own, folder, client)
        assert client.calls() == (0, 0)
        assert {p.parent.name for p in Path(folder, "data").glob(f"*/{k}")} == rewritten
    fresh = str(tmp_path / "fresh")
    app.index(spark, own, fresh, Counting(tmp_path))
    assert state(spark, fresh) == state(spark, folder)
    assert app.index(spark, own, folder, client).where("change <> 'unchanged'").isEmpty()
    own.vault.notes_path = "Elsewhere"
    assert {r.change for r in app.index(spark, own, folder, client, dry_run=True).collect()} >= {"switching", "forced"}


def test_named_files_alone(spark, tmp_path):
    root, folder, client = tmp_path / "vault", str(tmp_path / "tables"), Counting(tmp_path)
    vault_of(root, 3)
    own = settings_of(root)
    app.index(spark, own, folder, client)
    for k in (1, 2):
        (root / f"2024-01-0{k}.md").write_text(f"changed {k}")
    (root / "2024-01-03.md").unlink()
    assert {r.path: r.change for r in app.index(spark, own, folder, client, named=["2024-01-01.md"]).collect()} == {"2024-01-01.md": "changed"}
    assert sorted(r.text for r in app.Daybook.open(spark, folder).entries.collect()) != [] and app.Daybook.open(spark, folder).entries.count() == 3
    app.index(spark, own, folder, client, named=spark.createDataFrame([("2024-01-03.md",)], "path string"))
    assert app.Daybook.open(spark, folder).entries.count() == 2


def test_the_log_asks_each_prompt_once(spark, tmp_path):
    client, log = Counting(tmp_path), calls.CallLog(spark, str(tmp_path / "log"))
    rng = random.Random(2)
    for _ in range(3):
        prompts = [(k, rng.choice(["a", "b", "c", "unreadable", "é" * 9])) for k in range(30)]
        found = {r.id: (r.value, r.error) for r in log.answers(spark.createDataFrame(prompts, "id long, prompt string").repartition(5), client, "text").collect()}
        assert len(found) == 30 and all((found[k][1] is not None) == (p == "unreadable") for k, p in prompts)
    assert client.calls()[0] == 4 + 3  # four prompts once, the failing one in every run


def test_due_files_wait_while_the_model_is_away(spark, tmp_path):
    root, folder, broken, waiting = tmp_path / "vault", str(tmp_path / "tables"), tmp_path / "broken", str(tmp_path / "again")
    client, own = Counting(tmp_path, broken), settings_of(root)
    vault_of(root, 2)
    app.index(spark, own, folder, client)
    (root / "2024-01-05.md").write_text("A new day.")
    (root / "2024-01-01.md").unlink()
    at = datetime(2024, 1, 5)
    due = spark.createDataFrame([("2024-01-05.md", "change", at, 2, 0), ("2024-01-01.md", "delete", at, 2, 0)], "path string, kind string, ts timestamp, event_id long, attempts int")
    broken.touch()
    assert not app.apply_due(spark, own, folder, due, waiting, client) and app.Daybook.open(spark, folder).version == 1
    again = spark.read.parquet(waiting)
    assert sorted((r.path, r.attempts) for r in again.collect()) == [("2024-01-01.md", 1), ("2024-01-05.md", 1)]
    broken.unlink()
    assert app.apply_due(spark, own, folder, again, waiting, client) and app.apply_due(spark, own, folder, due.limit(0), waiting, client)
    assert sorted(r.file_path for r in app.Daybook.open(spark, folder).entries.collect()) == ["2024-01-02.md", "2024-01-05.md"]

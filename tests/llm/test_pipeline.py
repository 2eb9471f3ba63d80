"""The pipeline's stages one after the other, and the catalog's SQL on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from daybook.llm import catalog, common, suffix

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into every stage, and what comes out of the last, each written and read again."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 100


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = ({r.doc_id: shingles(r.text) for r in df.collect()} for df in stages[1:3])
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    kept = list(after.items())
    assert not any(near(x, y) for k, (_, x) in enumerate(kept) for _, y in kept[:k])
    assert all(any(near(x, y) for j, y in before.items() if j < i) for i, x in before.items() if i not in after)


def test_repeated_passages_are_cut(stages):
    """Strings of LENGTH bytes that stand anywhere else, and strings of LEAST bytes that another document holds."""
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    texts = {i: r.text.encode() for i, r in before.items()}
    windows = lambda b, n: (b[p : p + n] for p in range(len(b) - n + 1))
    seen, owners = Counter(), {}
    for i, b in texts.items():
        seen.update(windows(b, suffix.LENGTH))
        for x in windows(b, suffix.LEAST):
            owners.setdefault(x, set()).add(i)
    for i, b in texts.items():
        again = any(seen[x] > 1 for x in windows(b, suffix.LENGTH)) or any(len(owners[x]) > 1 for x in windows(b, suffix.LEAST))
        assert (after[i].text != before[i].text) == again and after[i].n_chars == len(after[i].text)


def test_contaminated_documents_go(stages):
    items = [shingles(r[0].lower()) for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    before, after = ({r.doc_id: shingles(r.text.lower()) for r in df.collect()} for df in stages[3:5])
    held = {i for i, x in before.items() if any(y and 100 * len(x & y) >= 75 * len(y) for y in items)}
    assert set(after) == set(before) - held


def test_the_mix(stages):
    found = stages[5].agg({"size": "sum", "taken": "sum"}).first()
    assert abs(found["sum(taken)"] / found["sum(size)"] - 1.5) < 0.02


def test_run_applies_the_stages_in_turn(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, f: d.where("doc_id < 9")), ("b", lambda s, d, f: d.where("doc_id > 5"))])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == [6, 7, 8]


def test_a_run_leaves_only_its_result(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:])
    found = corpus_pipeline.run(spark, DATA)
    assert found.count() > 100
    assert [p.parent.name.rsplit("-", 1)[0] + "/" + p.name for p in tmp_path.glob("*/*")] == ["daybook-pipeline/2"]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_and_repeated_ids(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert stage(spark, docs.limit(0), DATA).count() == 0
    long_ = " ".join(f"w{n}" for n in range(200))
    rows = [(1, None, "en", "a", 0), (1, "", None, None, 0), (1, long_, "en", "a", 5), (1, long_ + " more", "en", "b", 5), (None, long_, "en", "a", 5), (None, None, None, None, None), (1, long_, "en", "a", 5)]
    found = stage(spark, spark.createDataFrame(rows, docs.schema), DATA)
    assert 0 <= found.count() <= len(rows) and (k == 4 or found.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = sorted(map(rounded, cursor.fetchall()), key=repr)
    found = catalog.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((rounded(r) for r in found.select(*columns).collect()), key=repr) == want

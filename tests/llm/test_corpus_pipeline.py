"""The stages one after the other, each against brute force on its own input, and the guard around the package."""

from __future__ import annotations

import os
import random
import re
import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa
import pytest

import corpus_pipeline
from fleetwatch.llm import exact_dedup, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Every stage's output, written and read again."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choices(words, k=70))
    docs, labels = [], []
    for i in range(420):
        text = rng.choices(words, k=rng.randrange(30, 160))
        if i % 7 == 0:
            text[3:3] = ["wretch", "and", "vermin"]
        if i % 10 == 1:
            text.insert(5, passage)
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(i % 7 == 0)))
    docs += [(500 + i, docs[10 + i][1].upper(), "en", "s", 0) for i in range(20)]
    docs += [(600 + i, docs[40 + i][1].replace(" ", " x ", 1), "en", "s", 0) for i in range(20)]
    docs += [(700, None, None, None, None), (701, "", "en", "s", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/stage{k}")
        out.append(spark.read.parquet(f"{folder}/stage{k}"))
    return str(folder), [[tuple(r) for r in df.collect()] for df in out], out


def test_columns_stay_until_the_last_stage(stored):
    assert all(df.columns == stored[2][0].columns for df in stored[2][:-1])


def test_toxic_documents_go_and_clean_ones_stay(stored):
    before, after = ({r[0] for r in rows} for rows in stored[1][:2])
    toxic = {i for i in before if i < 420 and i % 7 == 0}
    clean = {i for i in before if i < 420 and i % 7}
    assert len(after & toxic) <= 2 and len(clean - after) <= 2


def test_exact_copies_go(stored):
    before, after = stored[1][1:3]
    best = {}
    for doc_id, text, *_ in before:
        key = (text or "").translate(LOWER)
        best[key] = max(doc_id, best.get(key, doc_id))
    assert {r[0] for r in after} == set(best.values()) and len(after) < len(before)


def _shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_of_each_near_copy_stays(stored):
    before, after = stored[1][2:4]
    sets = {r[0]: _shingles(r[1]) for r in before}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r[0] for r in after} == {i for i in sets if find(i) == i} and len(after) < len(before)


def test_repeated_passages_go(stored):
    before, after = stored[1][3:5]
    seen, expected = set(), {}
    for doc_id, text, *_ in sorted(before):
        w = WORD.findall(text or "")
        covered = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                covered[s : s + 20] = [True] * 20
            seen.add(window)
        expected[doc_id] = text if not any(covered) else " ".join(x for x, c in zip(w, covered) if not c)
    assert {r[0]: r[1] for r in after} == expected and expected != {r[0]: r[1] for r in before}


def test_every_document_is_packed(stored):
    before, after = stored[1][4:6]
    assert {r[0] for r in before} == {r[0] for r in after}


def test_run_gives_the_rows_of_the_stages(spark, stored):
    folder, tables, _ = stored
    got = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(r[:5] for r in tables[-1])


def test_entry_point_works_without_the_package(tmp_path):
    """As after deleting ``corpus_pipeline.py`` and the ``llm`` folders."""
    import shutil

    shutil.copytree(f"{ROOT}/fleetwatch", tmp_path / "fleetwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)


def test_idle_workers_keep_no_memory_of_other_operators(monkeypatch):
    """What packing keeps in a Python worker goes when another operator's task begins; freed memory goes back at its end."""
    seen = []
    monkeypatch.setitem(words.sys.modules, words.WORKER_MEMORY, SimpleNamespace(by_path={}))
    monkeypatch.setattr(words, "hand_back", lambda: seen.append("back"))
    run = words.tidy(lambda batches: (seen.append(words.WORKER_MEMORY in words.sys.modules) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2]
    assert seen == ["back", False, False, "back"]


def test_stages_send_small_batches_to_python(spark):
    """The texts of a task are not one Arrow batch; a smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

    docs = spark.range(6000).selectExpr("id as doc_id", "'a b' as text").coalesce(1)
    try:
        for rows, want in ((10_000, 2000), (0, 2000), (500, 500)):
            spark.conf.set(key, rows)
            corpus_pipeline.drop_copies(spark, docs, "")
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) == want
    finally:
        spark.conf.set(key, before)

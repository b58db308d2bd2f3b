"""Exact dedup, n-gram join and substring dedup against brute force, with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import exact_dedup, ngram_join, substring
from fleetwatch.llm.components import components
from fleetwatch.llm.words import WordHasher, chunks, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id long, sha string, doc string, `row` long, own string, `__maybe` boolean, flags string, short string"
LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus(seed: int = 3, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "A-B"]
    passage = " ".join(rng.choices(words, k=60))
    base = rng.choices(words, k=150)
    rows = []
    for i in range(n):
        kind = i % 6
        own = rng.choices(words, k=rng.randrange(1, 200))
        if kind == 1:
            own = [*own[:20], passage, *own[20:40]]
        if kind == 2:
            own = list(base)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(len(own))] = rng.choice(words)
        if kind == 3:
            own = ["again"] * rng.randrange(1, 90)
        rows.append((i, (" " if i % 4 else "\t\n ").join(own), "en", "s", 1))
    rows += [(n, rows[1][1].upper(), "en", "s", 1), (n + 1, rows[1][1], "en", "s", 1)]
    rows += [(n + 2, None, None, None, None), (n + 3, "", "en", "s", 0), (n + 4, " \n ", "en", "s", 0)]
    rows += [(n + 5, "x " * 30_000, "en", "s", 1)]
    return rows


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def _clashing(docs):
    names = [c.split()[0].strip("`") for c in CLASHING.split(", ")]
    return docs.select("*", *[F.lit(None).cast(c.split()[1]).alias(n) for n, c in zip(names, CLASHING.split(", "))])


# exact dedup


def _expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return {
        (d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for d in ids
    }


def test_copies_match_brute_force(spark):
    rows = _corpus()
    got = exact_dedup.copies(_docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert {tuple(r) for r in got.collect()} == _expected_copies(rows)


def test_only_a_to_z_is_lowered(spark):
    rows = [(1, "ÀB", "", "", 0), (2, "àb", "", "", 0), (3, "Àb", "", "", 0), (4, "àB", "", "", 0)]
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(_docs(spark, rows)).collect()}
    assert kept == {3, 4}


def test_filter_misses_no_repeat_when_it_is_far_too_small(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", exact_dedup.BITMAP_BITS)
    rows = [(i, f"text {i // 2}", "", "", 0) for i in range(20_000)]
    assert exact_dedup.copies(_docs(spark, rows)).where("kept").count() == 10_000


def test_one_of_repeated_rows_and_null_ids_stays(spark):
    rows = [(5, "a", "", "", 0), (5, "A", "", "", 0), (None, "a", "", "", 0), (None, "b", "", "", 0), (None, "B", "", "", 0)]
    docs = _docs(spark, rows)
    table = exact_dedup.copies(docs)
    assert table.where("kept").count() == 2 and table.count() == 5
    assert sorted(str(r["doc_id"]) for r in exact_dedup.exact_dedup(docs).collect()) == ["5", "None"]


def test_exact_dedup_keeps_columns_also_clashing_ones(spark):
    rows = _corpus()
    docs = _clashing(_docs(spark, rows))
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {d for d, _, _, kept, _ in _expected_copies(rows) if kept}


def test_main_path_has_no_python(spark):
    plan = exact_dedup.copies(_docs(spark, _corpus(n=6)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# n-gram join


def _sets(rows, size=5):
    out = {}
    for doc_id, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        out[doc_id] = frozenset(runs)
    return out


def _expected_components(rows):
    sets, parent = _sets(rows), {}
    for d in sets:
        parent[d] = d

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("seed", [3, 8])
def test_components_match_brute_force(spark, seed):
    rows = _corpus(seed)
    assert {tuple(r) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()} == _expected_components(rows)


@pytest.mark.parametrize("level", [0, 20])
def test_links_do_not_depend_on_the_frequency_estimate(spark, monkeypatch, level):
    """Every shingle taken for rare, or for frequent: all lists are then joined, and prefixes are longer."""
    import numpy as np

    levels = lambda docs: np.full(ngram_join.SLOTS, level, np.uint8)
    monkeypatch.setattr(ngram_join, "frequency_levels", levels)
    rows = _corpus(5)
    assert {tuple(r) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()} == _expected_components(rows)


@pytest.mark.parametrize("short, square", [(2, 4), (0, 512)])
def test_long_lists_give_the_same_components(spark, monkeypatch, short, square):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "SQUARE", square)
    rows = _corpus(5, 240)
    assert {tuple(r) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect()} == _expected_components(rows)


def test_chosen_matches_grow_with_the_cost_of_the_prefix():
    import numpy as np

    bounds = np.array([0, 40, 80])
    assert ngram_join.chosen_matches(np.ones(80), bounds).tolist() == [1, 1]
    often = np.concatenate([np.ones(40), np.full(40, 1000.0)])
    assert ngram_join.chosen_matches(often, bounds).tolist()[1] > 1


@pytest.mark.parametrize("together", [2**20, 50])
def test_levels_count_every_shingle_of_every_set(spark, monkeypatch, together):
    import numpy as np
    import pyarrow as pa

    from fleetwatch.llm.words import WordHasher, chunks

    monkeypatch.setattr(ngram_join, "TOGETHER", together)
    rows, counts = _corpus(), defaultdict(int)
    for chunk in chunks(pa.array([r[1] for r in rows])):
        for token in ngram_join.shingle_sets(chunk, WordHasher(lower=True))[0].tolist():
            counts[token] += 1
    expected = np.zeros(ngram_join.SLOTS, np.uint8)
    for token, n in counts.items():
        if n >= ngram_join.LEAST_COUNT:
            slot = token % ngram_join.SLOTS
            expected[slot] = max(expected[slot], n.bit_length() - 1)
    assert expected.any() and (ngram_join.frequency_levels(_docs(spark, rows)) == expected).all()


def test_the_driver_sends_few_bytes_and_short_plans(spark, monkeypatch):
    """Levels go to the tasks deflated, and no plan holds how a filter is made."""
    import numpy as np
    from pyspark.cloudpickle import dumps

    docs, sent = _docs(spark, _corpus()), []
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda df, run, schema: sent.append(len(dumps(run))))
    ngram_join.prefixes(docs.withColumnRenamed("doc_id", "id"), np.zeros(ngram_join.SLOTS, np.uint8))
    assert sent[0] < 2**20
    monkeypatch.undo()
    plan = ngram_join._only(docs.withColumnRenamed("doc_id", "id"), docs.select(F.col("doc_id").alias("id")))
    assert "bitmap_construct_agg" not in plan._jdf.queryExecution().toString()


def test_one_of_each_component_stays_with_its_columns(spark):
    rows = _corpus()
    docs = _clashing(_docs(spark, rows))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {d for d, _, c in _expected_components(rows) if d == c}


def test_rows_without_id_are_linked_with_nothing(spark):
    rows = [(None, "a b c d e f", "", "", 0), (None, "a b c d e f", "", "", 0), (7, "a b c d e f", "", "", 0)]
    got = sorted(map(str, ngram_join.near_duplicates(_docs(spark, rows)).collect()))
    assert [g.count("None") for g in got] == [0, 2, 2]
    assert ngram_join.one_of_each(_docs(spark, rows)).count() == 3


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b), (5, b), (5, a), (9, f"{a} z"), (11, c), (12, f"{c} z"), (12, c), (12, c), (13, "q r"), (5, ""), (14, "q s")]
    docs = _docs(spark, [(i, t, "", "", 0) for i, t in rows])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted(
        [(3, 56, 3), (5, 56, 3), (5, 56, 3), (9, 57, 3), (11, 56, 11), (12, 57, 11), (12, 56, 11), (12, 56, 11)]
        + [(13, 1, 13), (14, 1, 14), (5, 0, 5)]
    )


def test_components_of_long_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    cycle = [(201, 202), (202, 203), (203, 201), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + cycle, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 201 for i in (201, 202, 203)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# substring dedup


def _expected_kept(rows, span=20):
    first, out = set(), {}
    for doc_id, text, *_ in sorted(rows):
        w = WORD.findall(text or "")
        covered = [False] * len(w)
        for s in range(len(w) - span + 1):
            window = tuple(w[s : s + span])
            if window in first:
                covered[s : s + span] = [True] * span
            first.add(window)
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        out[doc_id] = (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 9])
def test_substring_dedup_matches_brute_force(spark, seed):
    rows = _corpus(seed)
    got = substring.remove_repeats(_docs(spark, rows))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == _expected_kept(rows)


def test_chunks_do_not_change_what_is_removed(spark, monkeypatch):
    rows = _corpus()
    monkeypatch.setattr(substring, "CHUNK", 700)
    got = substring.remove_repeats(_docs(spark, rows))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == _expected_kept(rows)


def test_maximal_repeats_cover_the_removed_words(spark):
    rows = _corpus()
    for r in substring.remove_repeats(_docs(spark, rows)).collect():
        assert sum(x["n"] for x in r["repeats"]) == r["n_removed"]
        assert all(x["n"] >= substring.SPAN for x in r["repeats"])


def test_without_repeats_leaves_clean_documents_alone(spark):
    rows = _corpus()
    docs = _clashing(_docs(spark, rows))
    got = substring.without_repeats(docs)
    expected = _expected_kept(rows)
    assert got.columns == docs.columns and got.count() == len(rows)
    for r in got.collect():
        before = next(x for x in rows if x[0] == r["doc_id"])
        n_words, removed, digest = expected[r["doc_id"]]
        if removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest and r["n_chars"] == len(r["text"])
        else:
            assert (r["text"], r["n_chars"]) == (before[1], before[4])


def test_repeated_rows_are_equally_early(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0), (2, text, "", "", 0)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.remove_repeats(_docs(spark, rows)).collect())
    assert got == [("1", 30), ("1", 30), ("2", 30), ("None", 0)]
    without_null = substring.remove_repeats(_docs(spark, [r for r in rows if r[0] is not None]))
    assert sorted((r["doc_id"], r["n_removed"]) for r in without_null.collect()) == [(1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize(
    "operator",
    [
        exact_dedup.copies,
        exact_dedup.exact_dedup,
        ngram_join.near_duplicates,
        ngram_join.one_of_each,
        substring.remove_repeats,
        substring.without_repeats,
    ],
)
def test_empty_tables_give_empty_tables(spark, operator):
    assert operator(_docs(spark, [])).count() == 0


def test_slices_of_a_batch_hold_every_row_once():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 0, 3, 50, 1, 1, 1)]
    batch = pa.RecordBatch.from_pydict({"a": list(range(7)), "text_a": texts, "text_b": [None, *texts[1:]]})
    parts = list(ngram_join.slices(batch, ("text_a", "text_b"), 12))
    assert [p.column("a").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]


def test_anchors_of_a_chunk_need_little_memory():
    """Sums over bytes and copied windows are bounded, and hashes are those of one pass over all bytes."""
    words = [f"w{i % 7919:x}" for i in range(700_000)]
    chunk = next(chunks(pa.array([" ".join(words)]), substring.CHUNK))
    w = words_of(chunk)
    hasher = WordHasher()
    whole = WordHasher()._hashes(chunk.data, w.start, w.end)
    tracemalloc.start()
    try:
        hashes = hasher(chunk.data, w.start, w.end)
        found = substring.anchors_of(hashes, w.text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (hashes == whole).all()
    assert found[1].sum() == len(words) - substring.SPAN + 1
    assert peak < 100e6  # 156 MB before

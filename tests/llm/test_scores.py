"""Toxicity and quality scores: the automaton against edit distances, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import quality, toxicity
from fleetwatch.llm.toxicity import Lexicon, LexiconAutomaton, Scanner

LABELS = "doc_id long, quality int, toxic int"


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(zip(row[1:], row, b), lambda left, t: min(left + 1, t[0] + 1, t[1] + (x != t[2])), initial=i))
    return row[-1]


def test_automaton_agrees_with_edit_distances():
    rng = random.Random(1)
    spell = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = sorted({spell(rng.randrange(5, 8)) + rng.choice(["", "$"]) for _ in range(12)})
    automaton = LexiconAutomaton(entries)
    for _ in range(1500):
        word = spell(rng.randrange(0, 10))
        expected = {}
        for number, entry in enumerate(entries):
            if entry.endswith("$"):
                best = _distance(word, entry[:-1])
            else:
                best = min(_distance(word[:k], entry) for k in range(len(word) + 1))
            if best <= 1:
                expected[number] = best
        assert dict(automaton.match(word)) == expected, word


def test_short_entries_match_without_edits_only():
    assert LexiconAutomaton(["bad$"]).match("bed") == () and LexiconAutomaton(["bad$"]).match("bad") == ((0, 0),)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("you IDIOT!", [(0, 0, False)]),
        ("an id1ot here", [(0, 1, False)]),
        ("an idiiot here", [(0, 1, False)]),
        ("an idot here", [(0, 1, False)]),
        ("the “idiot” of the title", [(0, 0, True)]),
        ('he wrote "such an idiot" there', [(0, 0, True)]),
        ("they called him idiot once", [(0, 0, True)]),
        ("an idol and a patriot", []),
        ("", []),
    ],
)
def test_hits_and_their_context(text, expected):
    assert Scanner(["idiot$"]).hits(text)[0] == expected


def test_quotation_counts_on_its_own():
    lexicon = Lexicon(["idiot$"], {(0, 0): 4.0})
    plain, quoted = (lexicon.features([(0, 0, q)], 10) for q in (False, True))
    assert plain[2] == 4.0 and quoted[2] == 0.0 and quoted[3] == 4.0


def _documents(n=900, seed=4):
    """Plain documents; every sixth is abusive, every fifth is noise."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 9))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 120))
        bad, poor = i % 6 == 0, i % 5 == 0
        if bad:
            for w in rng.sample(["wretch", "vermin", "dimwit"], 2):
                text.insert(rng.randrange(len(text)), w)
        text = " ".join(w + rng.choice(["###", "%%%"]) for w in text) if poor else " ".join(text) + "."
        docs.append((i, text))
        labels.append((i, int(not poor), int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = _documents()
    docs = [*docs, (5000, None), (5001, ""), (5002, "ok " * 50_000), (None, "a wretch and vermin."), (7, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], LABELS).withColumn("text", F.lit("t"))
    run = lambda f: [tuple(r) for r in f(frame, marks).select("doc_id", "held_out", "score", "predicted").collect()]
    return run(toxicity.toxicity), run(quality.quality), labels, len(docs)


@pytest.mark.parametrize("which, label", [(0, 2), (1, 1)])
def test_held_out_documents_are_told_apart(scored, which, label):
    rows, truth = scored[which], {r[0]: r[label] for r in scored[2]}
    assert len(rows) == scored[3]
    assert all(0 <= s <= 1 for _, _, s, _ in rows)
    held = [(truth[d], p) for d, h, _, p in rows if h and d in truth]
    assert len(held) > 100 and np.mean([t == p for t, p in held]) > 0.97


@pytest.mark.parametrize("which, divisor, rest", [(0, 5, 0), (1, 4, 2)])
def test_folds_follow_the_id(scored, which, divisor, rest):
    import zlib

    for doc_id, held, _, _ in scored[which]:
        assert held == (zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == rest)


def test_copies_get_equal_scores_and_a_null_is_an_empty_text(scored):
    for rows in scored[:2]:
        by = {}
        for d, _, s, _ in rows:
            by.setdefault(d, set()).add(s)
        assert len(by[7]) == 1 and by[5000] == by[5001]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = _documents(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    import zlib

    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    scores = lambda marks: sorted(map(tuple, toxicity.toxicity(frame, spark.createDataFrame(marks, LABELS)).collect()))
    assert scores(labels) == scores(turned)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_no_labels_and_no_documents(spark, operator):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    assert {r["score"] for r in operator(docs, none).collect()} == {0.0}
    assert operator(docs.limit(0), none).count() == 0
    one_kind = spark.createDataFrame([(i, 1, 1) for i in range(40)], LABELS)
    many = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    assert {r["score"] for r in operator(many, one_kind).collect()} == {1.0}


def test_drop_toxic_keeps_clean_documents_and_columns(spark):
    docs, labels = _documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("score", F.lit(2))
    got = toxicity.drop_toxic(frame, spark.createDataFrame(labels, LABELS))
    kept = {r["doc_id"] for r in got.collect()}
    assert got.columns == frame.columns
    bad = {d for d, _, t in labels if t}
    assert len(kept & bad) <= 3 and len(kept - bad) >= len(docs) - len(bad) - 3


def test_ranking_orders_pairs_and_cuts_at_the_quantile():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.75).astype(float)
    x = rng.normal(size=(400, quality.FEATURES))
    x[:, 3] += 3 * y
    ranking = quality.Ranking(x, y)
    scores = ranking.scores(x)
    good, bad = scores[y == 1], scores[y == 0]
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert abs((scores >= quality.THRESHOLD).mean() - y.mean()) < 0.01
    better, worse = quality.preference_pairs(y, 1000)
    assert len(better) == 1000 and y[better].all() and not y[worse].any()


def test_every_labelled_row_outside_the_fold_teaches(spark):
    import zlib

    docs, labels = _documents(900)
    found = quality.described(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = quality.teaching(found, spark.createDataFrame(labels, LABELS))
    wanted = {d for d, _, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    assert {r["doc_id"] for r in rows.collect()} == wanted
    # In blocks of any size each row counts once, and no block lacks the rarer label.
    packed = quality.blocks(rows, 40, 8).collect()
    assert len(packed) > 10 and sum(np.frombuffer(r["own"], bool).sum() for r in packed) == len(wanted)
    assert all(0 < np.frombuffer(r["y"]).mean() < 1 for r in packed)
    small, whole = (quality.learn(found, spark.createDataFrame(labels, LABELS), n) for n in (40, 8_000))
    assert small.rate == whole.rate and np.allclose(small.mean, whole.mean) and np.allclose(small.scale, whole.scale)
    texts = np.array([r["f"] for r in found.orderBy("doc_id").collect()])
    same = (small.scores(texts) >= quality.THRESHOLD) == (whole.scores(texts) >= quality.THRESHOLD)
    assert same.mean() > 0.98


def test_no_significant_term_is_cut_from_the_lexicon(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "zz" for i in range(900)]
    rows = [(" ".join(words), 1)] * 40 + [("0 1 2", 0)] * 400
    entries = toxicity.learn_entries(spark.createDataFrame(rows, "text string, label int"))
    assert {e[:3] for e in entries} == {w[:3] for w in words}


def test_whole_words_of_four_letters_allow_one_edit():
    assert dict(LexiconAutomaton(["scum$"]).match("skum")) == {0: 1} and LexiconAutomaton(["scum"]).match("skum") == ()


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_scores_do_not_depend_on_partitions(spark, operator):
    """Near copies teach once; which of them does must not depend on where they lie."""
    rng = random.Random(4)
    words = ["idiot", "scum", "the", "house", "garden", "wonderful", "is", "and", "away", "BUY", "a,", "of."]
    rows, marks = [], []
    for i in range(240):
        toxic = i % 3 == 0
        text = " ".join(rng.choices(words[:2] + words if toxic else words[2:], k=rng.randrange(4, 40)))
        for copy in range(1 + i % 4):
            key = 10 * i + copy
            rows.append((key, f"{text} {copy}" if copy else text))
            marks.append((key, int(not toxic and i % 2 == 0), int(toxic)))
    found = []
    for parts, shuffle in ((1, "1"), (5, "3"), (13, "8")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        labels = spark.createDataFrame(marks, LABELS).repartition(parts)
        found.append({r["doc_id"]: r["score"] for r in operator(docs, labels).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(found[0].values())) > 20
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=1e-12)

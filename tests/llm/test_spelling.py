"""Spelling variants against brute force, and the bound on the grams that one edit affects."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fleetwatch.llm import spelling
from fleetwatch.llm.exact_dedup import UPPER
from fleetwatch.llm.gram_index import Grams, plain

SCHEMA = "doc_id long, text string, word string, n long"
LOWER = str.maketrans(UPPER, UPPER.lower())


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out.update(word[:i] + c + word[i + 1 :] for c in letters)
    return out - {word}


def counts(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def expected(rows):
    words = counts(rows)
    letters = {c for w in words for c in w}
    form, out = {}, []
    near = {w: [x for x in edits(w, letters) if x in words] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    syllables = ["ab", "ba", "an", "na", "é", "le", "À", "tion", "q", "aa", "÷"]
    stems = ["".join(rng.choices(syllables, k=rng.randrange(2, 6))) for _ in range(120)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "a" * 400]
    rows = []
    for i in range(n):
        words = rng.choices(stems, weights=[1 + 300 // (j + 1) for j in range(len(stems))], k=200)
        for j in range(0, len(words), 9):
            at = rng.randrange(len(words[j]))
            words[j] = words[j][:at] + rng.choice(["", "z", words[j][at] * 2]) + words[j][at + 1 :]
        rows.append((i, rng.choice([" ", ", ", "1", "_\n"]).join(words).title() if i % 5 else " ".join(words), "x", 1))
    rows += [(n, None, "x", 1), (n + 1, "", "x", 1), (None, "ababab " * 9, "x", 1), (3, "Étaient étaient ÉTAIENT", "x", 1)]
    rows += [rows[4], rows[4], (n + 2, "longword " * 30_000, "x", 1)]
    return rows


@pytest.mark.parametrize("frequent", [0, 5, 64])
def test_groups_equal_brute_force(spark, frequent):
    rows = corpus(1)
    got = spelling.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(5), frequent=frequent)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    result = sorted(map(tuple, got.collect()))
    assert result == expected(rows)
    assert sum(r[4] for r in result) > 100 and sum(r[1] != r[2] and r[1] is not None for r in result) > 0


def test_empty_tables_and_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "x", 1), (2, "tiny four", "x", 1), (3, "lonely", "x", 1)]
    assert spelling.group_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


def _nodes(rng, words, longest):
    """Prefix-closed expanded nodes of random words."""
    out = set()
    for w in words:
        for p in range(len(w) - 1):
            for size in range(2, longest):
                g = w[p : p + size]
                if len(g) < size or (size > 2 and g[:-1] not in out) or rng.random() < 0.4:
                    break
                out.add(g)
    return frozenset(out)


@pytest.mark.parametrize("longest", [3, 4, 6])
def test_no_edit_affects_more_grams_than_the_bound(longest):
    rng = random.Random(longest)
    for _ in range(60):
        words = ["".join(rng.choices("abc", k=rng.randrange(5, 11))) for _ in range(4)]
        grams = Grams(_nodes(rng, words, longest), {}, longest)
        for w in words:
            spans = grams.spans(w)
            bound = grams.affected(w, spans)
            for other in edits(w, "abcd"):
                theirs = Counter(other[p:e] for p, e in grams.spans(other))
                shared = Counter(w[p:e] for p, e in spans) & theirs
                assert len(spans) - sum(shared.values()) <= bound


def test_lists_of_near_words_meet():
    rng = random.Random(7)
    pairs = defaultdict(int)
    words = ["".join(rng.choices("abcd", k=rng.randrange(5, 10))) for _ in range(80)]
    for w in words:
        for p in range(len(w) - 1):
            pairs[w[p : p + 2]] += 1
    grams = Grams(_nodes(rng, words, 4), dict(pairs))
    for w in words:
        mine, left = grams.lists(w)
        for other in edits(w, "abcd"):
            if len(other) < max(5, len(w)):
                continue
            theirs, their_left = grams.lists(other)
            a, b = (mine, theirs) if max(left, their_left) > 0 else (plain(grams).lists(w)[0], plain(grams).lists(other)[0])
            shifts = {0, len(other) - len(w)}
            assert any(g == h and q - p in shifts for g, p in a for h, q in b), (w, other)
            assert plain(grams).lists(w)[1] >= 2

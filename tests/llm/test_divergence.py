"""The divergence audit and its packed counting against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fleetwatch.llm import divergence, packed_terms
from fleetwatch.llm.exact_dedup import UPPER
from fleetwatch.llm.words import chunks

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int"
LOWER = str.maketrans(UPPER, UPPER.lower())
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def expected(rows, least_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = terms(text)
        counts[key].update(found)
        docs[key[0]].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            over = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    stems = ["a", "of", "seven77", "eightabc", "nineletter", "sixteenlettersxx", "seventeenlettersx", "ÉÉÉÉÉÉÉÉ", "日本語" * 9, "z" * 300]
    stems += ["".join(rng.choices("abcéZ", k=rng.randrange(1, 30))) for _ in range(60)]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        words = rng.choices(stems[: 20 + 10 * (i % 5)], k=rng.randrange(0, 120))
        rows.append((i, rng.choice([" ", "1", "\n", "[", "@"]).join(words), "xx" if i % 4 else "yy", source, 1, 1))
    rows += [(n, None, None, None, 1, 1), (n + 1, "only here", "", "", 1, 1), (n + 2, "", "zz", "a", 1, 1), (n + 3, "12 3", "zz", None, 1, 1)]
    rows += [(None, "Seven77 of a", "xx", "s1", 1, 1)] * 3 + [(7, "word " * 40_000, "xx", "s2", 1, 1)]
    return rows


@pytest.mark.parametrize("small_groups", [0, 1000])
def test_audit_equals_brute_force(spark, small_groups):
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(6), small_groups=small_groups)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_other_limits(spark):
    rows = corpus(4, 30)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=1, top=3)
    assert sorted(map(tuple, got.collect())) == expected(rows, 1, 3)


def test_empty_and_wordless_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "en", "a", 1, 1), (2, "1 2", "en", "b", 1, 1)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counting_a_chunk():
    texts = [r[1] for r in corpus(3)]
    group = np.arange(len(texts)) % 3
    want, want_docs = Counter(), Counter()
    for i, text in enumerate(texts):
        found = [(int(group[i]), t) for t in terms(text)]
        want.update(found)
        want_docs.update(set(found))
    got, got_docs = Counter(), Counter()
    for chunk in chunks(pa.array(texts), 3000):
        for own, w0, w1, tail, n, docs in packed_terms.counted(chunk, divergence._INSIDE, group[chunk.first : chunk.last]):
            for i in range(len(own)):
                whole = int(w0[i]).to_bytes(8, "big") + int(w1[i]).to_bytes(8, "big") + (tail[i] if tail else b"")
                term = whole.rstrip(b"\0").decode()
                got[int(own[i]), term] += int(n[i])
                got_docs[int(own[i]), term] += int(docs[i])
    assert got == want and got_docs == want_docs


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 5000).astype(np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64) >> np.uint64(60)
    assert (packed_terms.radix_order(a, b) == np.lexsort((np.arange(5000), b, a))).all()


def test_pairs_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    holders = [[{"source": f"s{j}", "p": int(rng.integers(1, 10**9)), "p0": 5 + j} for j in range(9) if rng.random() < 0.6] for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"] * 25, "holders": holders})

    def sums():
        total = Counter()
        for out in divergence._corrections(iter([batch])):
            for r in out.to_pylist():
                total[r["lang"], r["source"], r["item"]] += r["value"]
        return total

    whole = sums()
    monkeypatch.setattr(divergence, "PAIRS", 1)
    assert sums() == whole

"""Byte BPE, packing and nearest neighbours against the libraries and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import ann, bpe, packing
from fleetwatch.llm.queries import BYTE_RANKS, WORD_VOCABULARY, vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

TEXTS = [
    "", None, "   ", "a  b\n\n c\t\td ", "x\x1c\x1dy \x1e z", "don't I'LL 'll  's", "日本語 テキスト 123 ½²", "é ́x \xa0 y z", "🙂🙂 ok ​",
    "a" * 5000, "ab " * 3000 + " ", "ǅ ɐ ʰ ٣ Ⅷ ̀", "\x00\x01 \x85 \x85a", "<|endoftext|> x<|startoftext|>y", "ſ'ſ K İ ẞ", "THON, thon. Thon%%%",
    "same text", "same text", "word " * 40_000,
]


def _docs(spark, texts=TEXTS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("block", "ids", "length", "bin", "row", "start"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(4)


@pytest.mark.parametrize("block_bytes", [40, 32 << 20])
def test_byte_bpe_equals_the_library(spark, block_bytes):
    import tiktoken

    path = vocabulary(BYTE_RANKS)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    expected = set()
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        expected.add((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    got = bpe.encode_and_decode(_docs(spark), path, block_bytes, word_buckets=7)
    assert {tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == expected


def test_byte_bpe_of_nothing(spark):
    assert bpe.encode_and_decode(_docs(spark).limit(0), vocabulary(BYTE_RANKS)).count() == 0


def _check_packing(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        raw = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(raw) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for doc_id, whole in ids.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(whole)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    return len(sequences)


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    texts = TEXTS + [f"number {i} " * (i % 190) for i in range(800)]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    n = _check_packing(packing.pack(_docs(spark, texts), vocabulary(WORD_VOCABULARY)).collect(), ids)
    assert n <= 1.03 * sum(map(len, ids.values())) / packing.LENGTH + 1


def test_packing_ranks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rows = packing.pack(_docs(spark, ["a b"] * 300), vocabulary(WORD_VOCABULARY)).collect()
    _check_packing(rows, {i: [320, 321, packing.END_ID] for i in range(300)})
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 300


def test_packing_of_nothing_and_of_repeated_rows(spark):
    docs = _docs(spark)
    assert packing.pack(docs.limit(0), vocabulary(WORD_VOCABULARY)).count() == 0
    twice = packing.pack(docs.union(docs), vocabulary(WORD_VOCABULARY))
    assert twice.count() == 2 * packing.pack(docs, vocabulary(WORD_VOCABULARY)).count()


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        size, value, capacity = rng.integers(1, 9, 4), rng.normal(size=4), 15
        best = 0.0
        for counts in itertools.product(*(range(capacity // s + 1) for s in size.tolist())):
            if np.dot(counts, size) <= capacity:
                best = max(best, float(np.dot(counts, value)))
        got, counts = packing.best_filling(value, size, capacity)
        assert got == pytest.approx(best) and np.dot(counts, value) == pytest.approx(best)


def test_patterns_meet_the_demand_with_few_sequences():
    rng = np.random.default_rng(4)
    size = np.arange(1, 65)
    demand = rng.integers(0, 900, 64)
    keep = demand > 0
    plan = packing.whole_patterns(demand[keep], size[keep], 64)
    met = sum(times * column for times, column in plan)
    assert (met == demand[keep]).all() and all(column @ size[keep] <= 64 for _, column in plan)
    assert sum(times for times, _ in plan) <= 1.02 * (demand @ size) / 64 + 64


# nearest neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(n=3000, dims=32, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = (centres[rng.integers(0, 40, n)] + 0.7 * rng.normal(size=(n, dims))).astype(np.float32)
    x[500:900] = x[500]
    return x


def test_recall_and_exact_scores(spark):
    x = _vectors()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = defaultdict(dict)
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS).withColumn("v", F.lit(1)).withColumn("list", F.lit(1))).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, len(x), 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(x)), far))[:10]
        found = [got[q][k] for k in range(1, 11)]
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and q not in [v for v, _ in found]
        assert all(abs(s - far[v]) < 1e-12 for v, s in found)
        hits += len(set(best.tolist()) & {v for v, _ in found})
        if 500 <= q < 900:  # of hundreds of equal vectors, those with the smallest ids
            assert [v for v, _ in found] == best.tolist()
    assert hits / (len(x) // 100 * 10) >= 0.9


def test_parts_of_a_list_give_the_same_neighbours(spark, monkeypatch):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(_vectors(1000))]
    frame = spark.createDataFrame(rows, VECTORS)
    before = sorted(map(tuple, ann.nearest(frame).collect()))
    monkeypatch.setattr(ann, "SHELF_ROWS", 16)
    assert sorted(map(tuple, ann.nearest(frame).collect())) == before


def test_vectors_that_cannot_be_compared(spark):
    good = [(i, [float(i), 1.0], 1) for i in range(5)]
    bad = [(100, None, 1), (200, [0.0, 0.0], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1)]
    bad += [(500, [1.0, None], 1), (600, [1.0], 1), (None, [1.0, 1.0], 1), (700, [], 1)]
    got = ann.nearest(spark.createDataFrame(good + bad, VECTORS)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (0, k, k, float(k)) for k in range(1, 5)
    ]


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.nearest(spark.createDataFrame([(7, [1.0], 1)], VECTORS)).count() == 0
    assert ann.nearest(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0


def test_word_memory_ages_and_gives_the_same_ids(monkeypatch):
    """With room for a few words only, words are learned again; ids stay those of the library."""
    path = vocabulary(WORD_VOCABULARY)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé,'0B", k=rng.randrange(1, 9))) for _ in range(300)] + ["日本", "<|x|>", "a\x1cb"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(200)] + ["", "w " * 5000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "MEMORY", 20_000)
    for most in (1, 500, 10_000):
        encode = packing.WordEncoder(path)
        encode.state.words, encode.state.runs, encode.state.held = {}, {}, 0
        found = [i for chunk in packing._chunks(texts, most) for i in encode.texts(chunk)]
        assert [list(np.frombuffer(f, "<u4")) for f in found] == want
        assert encode.state.held < 200_000


def test_words_that_come_again_outlive_the_memory_of_others(monkeypatch):
    path = vocabulary(WORD_VOCABULARY)
    monkeypatch.setattr(packing, "MEMORY", 40_000)
    monkeypatch.setattr(packing, "BATCH", 16)
    packing.sys.modules.pop(packing.WORKER_MEMORY, None)
    encode = packing.WordEncoder(path)
    plain, asked = encode.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **settings):
            asked.append(list(texts))
            return plain.encode_batch_fast(texts, **settings)

    encode.tokenizer = Counted()
    try:
        for i in range(40):
            text = "the common words " + " ".join(f"rare{i:x}q{j:x}w" for j in range(50))
            want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert encode(text) == want
        assert sum("common" in batch for batch in asked) == 1  # each time the memory was emptied, before
        assert max(map(len, asked)) <= 16
        assert encode.state.held < 40_000
    finally:
        packing.sys.modules.pop(packing.WORKER_MEMORY, None)



def test_parts_of_texts_are_remembered_once_with_any_neighbours(monkeypatch):
    """Runs, not words with their punctuation, are encoded; ids stay those of the library."""
    path = vocabulary(WORD_VOCABULARY)
    monkeypatch.setitem(packing.sys.modules, packing.WORKER_MEMORY, packing.SimpleNamespace(by_path={}))
    encode = packing.WordEncoder(path)
    letters = [f"{a}{b}é" for a in "abcdefg" for b in "hijklmn"]
    ends = [",", ".", "!", "!?", "%%%", "-", ";"]
    texts = [" ".join(w + e for w in letters for e in ends), "Don't  don 't x'\tS", "İ ǅ ß\u0085'll", "  a", "日本, a日", "<| a |>", " ", ""]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(np.frombuffer(encode.texts(texts[:1])[0], "<u4")) == want[0]
    assert len(encode.state.words) + len(encode.state.runs) == len(letters) + len(ends)
    assert [list(np.frombuffer(f, "<u4")) for f in encode.texts(texts)] == want

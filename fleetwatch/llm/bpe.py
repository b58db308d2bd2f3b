"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts texts into pre-tokens with their positions, in blocks of bounded size. A block keeps its
   distinct words once; positions are numbers of words, stored in a table bucketed by block.
2. The words of all blocks meet by the hash of the word. There each distinct word is encoded once, and its ids
   are decoded by the table of token bytes.
3. Ids and bytes join the positions by block, the bucketed table staying where it is, and each document is
   reassembled by position.

A frequent word is one entry of each block, however often it occurs, so no key grows with its frequency.
Nulls and empty texts have no tokens. Repeated rows give repeated rows. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.session import new_path

BLOCK_BYTES = 32 << 20  # of text; a longer text is a block of its own
BUCKETS = 64  # files of the table of positions
# The pre-token pattern of the vocabulary, with its classes spelled out for the two matchers.
_SPACE = "\t-\r \x85\xa0"
_MORE_SPACE = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
_LATIN = re.compile(_PATTERN.format(l=_LETTER, n=_NUMBER, s=_SPACE))
_BEYOND = re.compile("[^\x00-\u024f]")

BLOCKS = (
    "block long, kind int, bucket int, docs array<long>, sizes array<int>, codes binary, words binary, "
    "lengths binary, order binary"
)
IDS = "block long, bucket int, ids binary, counts binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _any_text() -> re.Pattern:
    import regex

    return regex.compile(_PATTERN.format(l=r"\p{L}", n=r"\p{N}", s=_SPACE + _MORE_SPACE))


class Splitter:
    """Pre-tokens of a text; texts beyond Latin letters take the matcher that knows all letters."""

    def __init__(self):
        self.latin, self.any = _LATIN.findall, _any_text().findall

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if _BEYOND.search(text) else self.latin(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ids of a word, and bytes of ids, for one rank file; read once per worker process."""

    def __init__(self, path: str):
        held = sys.modules.setdefault("_corpus_ranks", SimpleNamespace(by_path={}))
        if path not in held.by_path:
            import tiktoken

            ranks = read_ranks(path)
            # Every word is encoded on its own, so the library's own pattern takes it whole.
            encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
            token_bytes = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                token_bytes[rank] = token
            held.by_path[path] = encoding.encode_ordinary, token_bytes
        self.encode, self.token_bytes = held.by_path[path]


class Block:
    """Distinct words of consecutive texts, and the number of the word at each position."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        self.codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc_id)
        self.sizes.append(len(words))
        self.bytes += len(text)

    def rows(self, block: int, buckets: int) -> Iterator[dict]:
        """One row of positions, and one row of words per bucket of the word's hash.

        Numbers are given anew by frequency and stored byte by byte, so that the table compresses well.
        """
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        by_count = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable")
        anew = np.empty(len(by_count), np.uint32)
        anew[by_count] = np.arange(len(by_count), dtype=np.uint32)
        split: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for w, number in self.numbers.items():
            raw = w.encode()
            split[zlib.crc32(raw) % buckets].append((raw, int(anew[number])))
        order = []
        for bucket, words in enumerate(split):
            if not words:
                continue
            words.sort()
            order.append(np.array([n for _, n in words], np.uint32))
            yield {
                "block": block,
                "kind": 1,
                "bucket": bucket,
                "words": b"".join(w for w, _ in words),
                "lengths": np.array([len(w) for w, _ in words], "<u4").tobytes(),
            }
        yield {
            "block": block,
            "kind": 0,
            "bucket": -1,
            "docs": self.docs,
            "sizes": self.sizes,
            "codes": _planes(anew[codes]),
            "order": _planes(np.concatenate(order) if order else np.zeros(0, np.uint32)),
        }


def _planes(values: np.ndarray) -> bytes:
    """First all low bytes, then all second bytes, and so on."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split_into_blocks(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("kind", pa.int32()),
            ("bucket", pa.int32()),
            ("docs", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int32())),
            ("codes", pa.binary()),
            ("words", pa.binary()),
            ("lengths", pa.binary()),
            ("order", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = Splitter(), 0
        name = TaskContext.get().partitionId() << 32
        held = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                if held.docs and held.bytes + len(text) > block_bytes:
                    yield from _batches(held.rows(name + n, buckets), schema)
                    held, n = Block(), n + 1
                held.add(doc_id, text, split(text))
        if held.docs:
            yield from _batches(held.rows(name + n, buckets), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _encode_words(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """Ids of each word of each block; all blocks' rows of one bucket of words are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, ids, counts = row["words"], 0, [], []
                for n in np.frombuffer(row["lengths"], "<u4").tolist():
                    word = raw[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = tuple(vocabulary.encode(word.decode()))
                    ids.extend(got)
                    counts.append(len(got))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([row["bucket"]], pa.int32()),
                        pa.array([np.array(ids, "<u4").tobytes()], pa.binary()),
                        pa.array([np.array(counts, "<u4").tobytes()], pa.binary()),
                    ],
                    names=["block", "bucket", "ids", "counts"],
                )

    return (
        words.select("block", "bucket", "words", "lengths")
        .repartition(buckets, "bucket")
        .mapInArrow(run, IDS)
    )


def _reassemble(path: str):
    def run(positions: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        token_bytes = Vocabulary(path).token_bytes
        texts, raws, sizes = [], [], []
        for _, row in ids.sort_values("bucket").iterrows():
            values = np.frombuffer(row["ids"], "<u4").tolist()
            at = 0
            for n in np.frombuffer(row["counts"], "<u4").tolist():
                own = values[at : at + n]
                at += n
                texts.append(" ".join(map(str, own)))
                raws.append(b"".join([token_bytes[i] for i in own]))
                sizes.append(n)
        out = []
        for _, row in positions.iterrows():
            order, codes = _values(row["order"]), _values(row["codes"])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes = place[codes] if len(codes) else codes.astype(np.int64)
            n_tokens = np.array(sizes, np.int64)[codes] if len(codes) else codes
            at = 0
            for doc_id, n in zip(row["docs"], row["sizes"]):
                own = codes[at : at + n].tolist()
                text = " ".join(map(texts.__getitem__, own))
                raw = b"".join(map(raws.__getitem__, own))
                out.append(
                    (
                        doc_id,
                        int(n_tokens[at : at + n].sum()),
                        hashlib.sha256(text.encode()).hexdigest(),
                        hashlib.sha256(raw).hexdigest(),
                    )
                )
                at += n
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def encode_and_decode(
    docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, word_buckets: int | None = None
) -> DataFrame:
    """Per document: number of tokens, digest of its ids, digest of the bytes that they decode to."""
    spark = docs.sparkSession
    buckets = word_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"positions_{uuid.uuid4().hex}"
    (
        _split_into_blocks(docs, buckets, block_bytes)
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", new_path(spark, "blocks"))
        .bucketBy(BUCKETS, "block")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    positions = blocks.where("kind = 0").select("block", "docs", "sizes", "codes", "order")
    ids = _encode_words(blocks.where("kind = 1"), path, buckets)
    return positions.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(_reassemble(path), RESULT)

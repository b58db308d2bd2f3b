"""Counting terms of many texts as packed integers.

A term is a run of bytes for which ``inside`` holds. Terms of up to 8 bytes are one 64-bit word, those of up to 16 two
words, big-endian and filled with zeros, so that words compare as the bytes do. They are put in order by a radix
sort over 16-bit digits and counted by runs. Longer terms are sorted as bytes, in buckets of similar lengths.
"""

from __future__ import annotations

import numpy as np

from fleetwatch.llm.words import LOWER, Chunk

WORD = 8


def runs(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the terms of a chunk in order; no term spans two texts."""
    n = len(chunk.data)
    within = inside[chunk.data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = within[:-1]
    after = np.zeros(n, bool)
    after[:-1] = within[1:]
    start = np.flatnonzero(within & (~before | edge[:n]))
    end = np.flatnonzero(within & (~after | edge[1:])) + 1
    text = np.searchsorted(chunk.offsets, start, "right") - 1
    return start, end - start, text


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray, word: int) -> np.ndarray:
    """Bytes ``8 * word`` to ``8 * word + 7`` of each term as one integer; zeros beyond its end."""
    padded = np.concatenate([data, np.zeros(WORD * (word + 2), np.uint8)])
    views = np.ndarray((len(padded) - WORD + 1,), ">u8", padded.data, strides=(1,))
    value = views[start + WORD * word].astype(np.uint64)
    left = np.clip(length - WORD * word, 0, WORD)
    mask = ~((np.uint64(1) << ((WORD - np.arange(1, WORD)) * 8).astype(np.uint64)) - np.uint64(1))
    masks = np.concatenate([[np.uint64(0)], mask, [~np.uint64(0)]]).astype(np.uint64)
    return value & masks[left]


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by unsigned keys, the first key first: least digits first, 16 bits a pass."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        key = key.astype(np.uint64)
        most = int(key.max()) if len(key) else 0
        for shift in range(0, max(most.bit_length(), 1), 16):
            digit = (key[order] >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit, kind="stable")]  # a radix sort for 16-bit integers
    return order


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def run_counts(order: np.ndarray, keys: tuple[np.ndarray, ...], text: np.ndarray):
    """(representative, occurrences, texts) of each run of equal keys; texts ascend within a run."""
    if not len(order):
        return order, order, order
    new = _changes(*[k[order] for k in keys])
    first = np.flatnonzero(new)
    new_text = new | _changes(text[order])
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(new_text.astype(np.int64), first)


def counted(chunk: Chunk, inside: np.ndarray, group_of_text: np.ndarray):
    """Per (group, term) of a chunk: group, the two words, the rest of the bytes or None, occurrences and texts."""
    data = LOWER[chunk.data]
    start, length, text = runs(chunk, inside)
    group = group_of_text[text]
    for chosen, n_words in ((length <= WORD, 1), ((length > WORD) & (length <= 2 * WORD), 2)):
        at, size, own, of = start[chosen], length[chosen], group[chosen], text[chosen]
        words = [packed(data, at, size, w) for w in range(n_words)]
        keys = (own, *words)
        head, n, texts = run_counts(radix_order(*keys), keys, of)
        second = words[1][head] if n_words > 1 else np.zeros(len(head), np.uint64)
        yield own[head], words[0][head], second, None, n, texts
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for width in np.unique(bucket[length > 2 * WORD]):
        chosen = (bucket == width) & (length > 2 * WORD)
        at, size, own, of = start[chosen], length[chosen], group[chosen], text[chosen]
        wide = 1 << int(width)
        ends = np.repeat(np.cumsum(size) - size, size)
        inner = np.arange(int(size.sum())) - ends
        cells = np.zeros((len(at), wide), np.uint8)
        cells[np.repeat(np.arange(len(at)), size), inner] = data[np.repeat(at, size) + inner]
        terms = cells.view(f"S{wide}").ravel()
        order = np.argsort(terms, kind="stable")
        order = order[np.argsort(own[order], kind="stable")]
        head, n, texts = run_counts(order, (own, terms), of)
        words = [packed(data, at[head], size[head], w) for w in range(2)]
        yield own[head], *words, [t[2 * WORD :] for t in terms[head].tolist()], n, texts

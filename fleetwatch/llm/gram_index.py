"""Grams of variable length, and how many of them one edit can change.

Every pair of neighbouring characters is a gram. A gram that is frequent in the vocabulary is *expanded*: instead of it,
the grams one character longer are used, up to ``LONGEST``. So the dictionary is the frequency-pruned trie of grams,
and is known by its expanded nodes alone. A word takes the longest gram at each place, but for those that
lie within an earlier one.

One edit changes the grams over its place. It may also let a gram on its left become longer (if what lies before the edit is
an expanded node), and hide a gram on its right within a longer one. ``affected`` counts these for the worst
place and kind of edit. Two words one edit apart share all other grams, each at the same distance from the
beginning or from the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SHORTEST, LONGEST = 2, 4


@dataclass(frozen=True)
class Grams:
    """The dictionary: expanded nodes, and the counts of pairs of characters, which order the grams."""

    expanded: frozenset[str] = frozenset()
    pairs: dict[str, int] = field(default_factory=dict)
    longest: int = LONGEST
    #: What may follow an unknown character inside an expanded node.
    tails: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        tails = frozenset(g[k:] for g in self.expanded for k in range(1, len(g)))
        object.__setattr__(self, "tails", tails)

    def spans(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a word, starts and ends ascending."""
        out, reach, n = [], 0, len(word)
        for p in range(n - 1):
            e = p + SHORTEST
            while e < n and e - p < self.longest and word[p:e] in self.expanded:
                e += 1
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def affected(self, word: str, spans: list[tuple[int, int]]) -> int:
        """How many of the grams one edit can change at most."""
        worst, n, most = 0, len(word), self.longest
        for i in range(n + 1):
            grows = next((p for p in range(max(0, i - most + 1), i - 1) if word[p:i] in self.expanded), n)
            replaced = inserted = 0
            for p, e in spans:
                if e <= i:  # left of the edit
                    replaced += p >= grows
                    inserted += p >= grows
                    continue
                if p <= i:
                    replaced += 1
                    inserted += p < i or (e + 1 <= i + most and word[i : e - 1] in self.tails)
                    continue
                replaced += e <= i + most and word[i + 1 : e - 1] in self.tails
                inserted += e + 1 <= i + most and word[i : e - 1] in self.tails
            worst = max(worst, inserted, replaced if i < n else 0)
        return worst

    def weight(self, gram: str) -> float:
        """An estimate of how frequent a gram is: a chain of pairs. It only orders the grams."""
        out = float(self.pairs.get(gram[:2], 1))
        for k in range(1, len(gram) - 1):
            out *= self.pairs.get(gram[k : k + 2], 1) / max(self.starts.get(gram[k], 1), 1)
        return out

    @property
    def starts(self) -> dict[str, int]:
        """Number of pairs that begin with a character."""
        found = self.__dict__.get("_starts")
        if found is None:
            found = {}
            for pair, n in self.pairs.items():
                found[pair[0]] = found.get(pair[0], 0) + n
            object.__setattr__(self, "_starts", found)
        return found

    def lists(self, word: str) -> tuple[list[tuple[str, int]], int]:
        """(gram, place) of the lists to merge for a word, and how many of its grams one edit leaves at least.

        Near words share all but ``affected`` grams, so the rarest ``affected + 1`` of one and of the other have one in
        common; the longer lists need not be merged.
        """
        spans = self.spans(word)
        affected = self.affected(word, spans)
        ranked = sorted((self.weight(word[p:e]), word[p:e], p) for p, e in spans)
        return [(g, p) for _, g, p in ranked[: affected + 1]], len(spans) - affected


def plain(grams: Grams) -> Grams:
    """The same order without expanded nodes: all grams are pairs, of which one edit changes two at most."""
    return Grams(frozenset(), grams.pairs, grams.longest)

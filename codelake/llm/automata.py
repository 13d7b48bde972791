"""Minimal acyclic automata with word numbers, and search with one error, on whole arrays of words.

Words are rows of a byte matrix (Latin-1 letters, zeros behind them). `Automaton` is
built from sorted words: the trie of their prefixes, whose nodes are merged from the
leaves up where they have the same continuations. Every transition also says how many
words come before those behind it, so that the numbers along a word's path add up to
its place in the order (minimal perfect hashing): a path needs no string to say
which word it has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from .shingles import mix, seeded

#: Queries that are searched at a time.
PORTION = 4096


def matrix(words: list[bytes], width: int) -> np.ndarray:
    """A row of `width` bytes for each word."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8)


def backward(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The words of a matrix from last to first letter."""
    at = lengths[:, None] - 1 - np.arange(rows.shape[1])
    return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), axis=1), 0).astype(np.uint8)


class Automaton:
    """Of sorted, distinct words (rows of a matrix); state 0 is dead."""

    def __init__(self, rows: np.ndarray, seed: int = 0) -> None:
        self.words, width = rows.shape
        letters = np.unique(rows)
        letters = letters[letters > 0]
        #: A byte's letter number, from 0 on; bytes of no word have the number behind the last.
        self.code = np.full(256, len(letters), np.int64)
        self.code[letters] = np.arange(len(letters))
        self.letters = len(letters)
        lengths = (rows > 0).sum(axis=1)
        parent, label, final, height, count = self._trie(rows, lengths)
        state = self._merge(parent, label, final, height, seed)
        self.states = int(state.max(initial=0)) + 1
        self.root = int(state[0])
        self.next = np.zeros((self.states, self.letters + 1), np.int32)
        self.next[state[parent[1:]], label[1:]] = state[1:]
        self.final = np.zeros(self.states, bool)
        self.final[state] = final
        held = np.zeros(self.states, np.int32)
        held[state] = count
        below = held[self.next]
        # Words before those behind a transition: the one that ends here, and those of lower letters.
        self.before = (np.cumsum(below, axis=1, dtype=np.int32) - below + self.final[:, None]).astype(np.int32)
        # States are told apart by 64-bit hashes; an automaton that holds as many words as were given, and each under its number, is right.
        if held[self.root] != self.words or not self._numbered(rows, lengths):
            self.__init__(rows, seed + 1)

    def _trie(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each node, the root first and parents before children: parent, letter, whether a word ends, longest way down, words below."""
        n, width = rows.shape
        same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
        shared = np.concatenate([[-1], np.minimum(same, lengths[:-1])]) if n else np.zeros(0, np.int64)
        parents, labels, finals, counts, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, bool)], [np.array([n])], np.zeros(n, np.int64)
        made = 1
        for depth in range(1, width + 1):
            alive = np.flatnonzero(lengths >= depth)
            if not len(alive):
                break
            # A node starts where the least shared prefix since the last word that is long enough is too short.
            least = np.minimum.reduceat(shared[: alive[-1] + 1], np.r_[0, alive[:-1] + 1])
            starts = least < depth
            starts[0] = True
            node = made + np.cumsum(starts) - 1
            first = alive[starts]
            parents.append(at[first])
            labels.append(self.code[rows[first, depth - 1]])
            ends = np.zeros(int(starts.sum()), bool)
            ends[node[lengths[alive] == depth] - made] = True
            finals.append(ends)
            counts.append(np.bincount(node - made, minlength=len(first)))
            at[alive] = node
            made += len(first)
        parent, label, final, count = (np.concatenate(x) for x in (parents, labels, finals, counts))
        height = np.zeros(made, np.int64)
        ends = np.cumsum([len(x) for x in parents])
        for lo, hi in zip(ends[:-1][::-1], ends[1:][::-1]):  # deepest nodes first
            np.maximum.at(height, parent[lo:hi], height[lo:hi] + 1)
        return parent, label, final, height, count

    @staticmethod
    def _merge(parent: np.ndarray, label: np.ndarray, final: np.ndarray, height: np.ndarray, seed: int) -> np.ndarray:
        """The state of each node: nodes of one height with the same end and the same letters to the same states are one."""
        key = seeded(seed)
        says = np.where(final, mix(np.array([key + np.uint64(1)]))[0], np.uint64(0))
        state = np.zeros(len(parent), np.int64)
        order = np.argsort(height, kind="stable")
        bounds = np.searchsorted(height[order], np.arange(int(height.max(initial=0)) + 2))
        made = 1
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            nodes = order[lo:hi]
            kinds, own = np.unique(says[nodes], return_inverse=True)
            state[nodes] = made + own
            made += len(kinds)
            below = nodes[nodes > 0]
            with np.errstate(over="ignore"):
                np.add.at(says, parent[below], mix(mix(state[below].astype(np.uint64) ^ key) + label[below].astype(np.uint64)))
        return state

    def _numbered(self, rows: np.ndarray, lengths: np.ndarray) -> bool:
        state, number = np.full(self.words, self.root, np.int64), np.zeros(self.words, np.int64)
        for depth in range(rows.shape[1]):
            on = np.flatnonzero(lengths > depth)
            letter = self.code[rows[on, depth]]
            number[on] += self.before[state[on], letter]
            state[on] = self.next[state[on], letter]
        return bool((number == np.arange(self.words)).all() and self.final[state].all())

    def near(self, rows: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the words that share a row's first `exact` letters and differ by one letter behind them, once each."""
        found = [self._near(rows[lo : lo + PORTION], lengths[lo : lo + PORTION], exact[lo : lo + PORTION], lo) for lo in range(0, len(rows), PORTION)]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pairs // max(self.words, 1), pairs % max(self.words, 1)

    def _near(self, rows: np.ndarray, lengths: np.ndarray, exact: np.ndarray, first: int) -> np.ndarray:
        codes = np.concatenate([self.code[rows], np.full((len(rows), 1), self.letters)], axis=1)
        state, number = np.full(len(rows), self.root, np.int64), np.zeros(len(rows), np.int64)
        ways = []  # (row, state, number, place from which the rest must match)
        for i in range(int(lengths.max(initial=0)) + 1):
            here = np.flatnonzero((exact <= i) & (i <= lengths) & (state > 0))
            inside = here[i < lengths[here]]
            ways.append((inside, state[inside], number[inside], np.full(len(inside), i + 1)))  # a letter too many
            row, letter = np.nonzero(self.next[state[here]])
            row = here[row]
            to, upto = self.next[state[row], letter], number[row] + self.before[state[row], letter]
            ways.append((row, to, upto, np.full(len(row), i)))  # one missing
            other = (i < lengths[row]) & (codes[row, i] != letter)
            ways.append((row[other], to[other], upto[other], np.full(int(other.sum()), i + 1)))  # another one
            number += np.where(state > 0, self.before[state, codes[:, i]], 0)
            state = np.where(i < lengths, self.next[state, codes[:, i]], 0)
        row, state, number, place = (np.concatenate(x) for x in zip(*ways))
        done = []
        while len(row):
            ended = place == lengths[row]
            hit = ended & self.final[state]
            done.append((row[hit] + first) * self.words + number[hit])
            go = ~ended
            row, state, number, place = row[go], state[go], number[go], place[go]
            letter = codes[row, place]
            number, state, place = number + self.before[state, letter], self.next[state, letter], place + 1
            go = state > 0
            row, state, number, place = row[go], state[go], number[go], place[go]
        return np.concatenate(done) if done else np.zeros(0, np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _hashes(word: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """The polynomial hash of a word, and of the word without each of its letters."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(word) - 1, _BASE, np.uint64)])
        upto = np.cumsum((word.astype(np.uint64) + np.uint64(1)) * powers)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        return upto[-1], np.r_[np.uint64(0), upto[:-1]] + (upto[-1] - upto) * back


def one_apart(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    i = int(differ[0]) if len(differ) else least
    if abs(len(a) - len(b)) > 1 or len(a) == len(b) == i:
        return False
    return bool(np.array_equal(a[i + (len(a) >= len(b)) :], b[i + (len(b) >= len(a)) :]))


def long_pairs(words: list[np.ndarray], asks: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int]]:
    """(i, j) of words, i one that asks and j one that is held, that differ by one letter: such words without one letter have equal hashes.

    For words of any length; needs a number for each letter.
    """
    hashes = [_hashes(w) for w in words]
    size = [len(w) for w in words]
    whole = pd.DataFrame({"i": range(len(words)), "h": [h for h, _ in hashes]})
    less = pd.DataFrame({"i": np.repeat(np.arange(len(words)), size), "at": np.concatenate([np.arange(n) for n in size]) if size else [], "h": np.concatenate([x for _, x in hashes]) if size else []})
    a, b = (lambda t: t[asks[t["i"]]]), (lambda t: t[held[t["i"]]].rename(columns={"i": "j"}))
    met = [a(less).merge(b(whole), on="h"), a(whole).merge(b(less), on="h"), a(less).merge(b(less), on=["h", "at"])] if words else []
    pairs = {(i, j) for m in met for i, j in zip(m["i"], m["j"]) if i != j}
    return ((i, j) for i, j in sorted(pairs) if one_apart(words[i], words[j]))

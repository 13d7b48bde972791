"""Operator 11: licence statements and texts, by matching statistics against a suffix automaton of templates.

The templates' words form one generalised suffix automaton: its states are the classes
of word runs that stand at the same places of the templates. A text's words are
streamed through it; after each word the state tells the longest run ending there that
any template holds, its suffix links the shorter ones. A run that a template can't
continue is a longest match of that place (of LEAST words or more). Matches of one
template are chained where both text and template go on, with at most GAP words of the
text between them, so that the chain covers the most words of the template. A chain
that covers SHARE of a template is a span and gives the template's label; the largest
share that any chain of a text covers is its score.

Pairs of words that follow each other in no template can't stand in a match, so only
stretches without such a pair reach the automaton. Beside that, the places of the
phrases in PHRASES are counted; their labels always stay.

Each text is looked at on its own and whole, in pieces of BLOCK bytes: nothing is
shuffled, and no text is sent to the driver. The templates (a parameter, bounded by
what their owner writes) go to every task. Null texts count as empty: no words, no
labels, score 0. A null doc_id stays null; repeated rows give a row each; of equally
good chains the one that ends first counts. A label without words is refused. An empty
table gives an empty result. Columns other than doc_id and text are left behind,
whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, read_table, small_batches
from .licence_texts import TEMPLATES

#: Words of the shortest match; of the text between two matches of a chain at most; share of a template that makes a span.
LEAST, GAP, SHARE = 4, 40, 0.7
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
# Phrases that are always reported, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Lower-case letters, digits and all bytes of other characters stand for themselves, all else parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a piece of it at a time."""
    data = text.encode().translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class SuffixAutomaton:
    """Of several sequences of numbers; state 0 is the empty run."""

    sequences: list[list[int]]
    to: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        places: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(self.sequences):
            state = 0
            for end, x in enumerate(sequence):
                state = self._grown(state, x)
                places.extend([] for _ in range(len(self.to) - len(places)))
                places[state].append((t, end))
        self.places = self._handed_down(places)

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.to.append(to)
        self.link.append(link)
        return len(self.to) - 1

    def _own(self, above: int, x: int) -> int:
        """The state of the longest run of `above` and x; longer runs that share its state are parted from it."""
        held = self.to[above][x]
        if self.length[held] == self.length[above] + 1:
            return held
        shorter = self._state(self.length[above] + 1, dict(self.to[held]), self.link[held])
        self.link[held] = shorter
        while above >= 0 and self.to[above].get(x) == held:
            self.to[above][x] = shorter
            above = self.link[above]
        return shorter

    def _grown(self, last: int, x: int) -> int:
        if x in self.to[last]:  # an earlier sequence has gone this way
            return self._own(last, x)
        new = self._state(self.length[last] + 1, {}, 0)
        above = last
        while above >= 0 and x not in self.to[above]:
            self.to[above][x] = new
            above = self.link[above]
        self.link[new] = self._own(above, x) if above >= 0 else 0
        return new

    def _handed_down(self, places: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Of each state (sequence, end, length): all places that share LEAST or more last words with its runs; length 0 stands for the whole run."""
        longest_first = sorted(range(1, len(self.to)), key=lambda s: -self.length[s])
        own = [set(p) for p in places] + [set() for _ in range(len(self.to) - len(places))]
        for s in longest_first:
            if self.link[s] > 0:
                own[self.link[s]] |= own[s]
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.to]
        for s in reversed(longest_first):
            above = self.link[s]
            if self.length[s] >= LEAST:
                found[s] = [(t, end, 0) for t, end in sorted(own[s])]
                if self.length[above] >= LEAST:
                    found[s] += [(t, end, k or self.length[above]) for t, end, k in found[above] if (t, end) not in own[s]]
        return found

    def matches(self, run: Iterable[int]) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, its start, the run's start, length) of all longest matches of LEAST or more."""
        state = length = at = 0
        for at, x in enumerate([*run, None]):
            for t, end, k in self.places[state] if length >= LEAST else ():
                k = k or length
                after = self.sequences[t][end + 1] if end + 1 < len(self.sequences[t]) else None
                if k >= LEAST and (after is None or after != x):
                    yield t, end - k + 1, at - k, k
            while state and x not in self.to[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.to[state]:
                state, length = self.to[state][x], length + 1


def chains(matches: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(covered, start, end) of the best chains of matches (place in the template, place in the text, length), which share no match.

    Each match extends the chain before it that covers most with it, if both places go
    on and at most `gap` words of the text lie between; words that two matches share count once.
    """
    m = sorted(matches, key=lambda x: (x[1], x[0]))
    covered, before, low = [k for *_, k in m], [-1] * len(m), 0
    widest = max((k for *_, k in m), default=0)
    for i, (p, q, k) in enumerate(m):
        while m[low][1] + widest + gap < q:
            low += 1
        for j in range(low, i):
            a, b, n = m[j]
            new = k - max(0, a + n - p, b + n - q)
            if a < p and b < q and b + n + gap >= q and 0 < new and covered[j] + new > covered[i]:
                covered[i], before[i] = covered[j] + new, j
    used, out = [False] * len(m), []
    for i in sorted(range(len(m)), key=lambda i: (-covered[i], m[i][1] + m[i][2])):
        way, j = [], i
        while j >= 0 and not used[j]:
            way.append(j)
            j = before[j]
        if way and j < 0:
            for x in way:
                used[x] = True
            out.append((covered[i], m[way[-1]][1], m[i][1] + m[i][2]))
    return out


class Scanner:
    """Templates (label, text) made ready; calls give what a text holds."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, share: float = SHARE) -> None:
        self.templates, self.share = list(templates), share
        texts = [[w for part in words_of(text) for w in part] for _, text in self.templates]
        if not all(texts):
            raise ValueError("a template has no words")
        #: Numbers of words; 0 stands for all others.
        self.numbers: dict[bytes, int] = {}
        for words in [*texts, *(phrase.encode().split() for phrase, _ in PHRASES)]:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.automaton = SuffixAutomaton([[self.numbers[w] for w in words] for words in texts])
        self.follows = np.zeros((len(self.numbers) + 1,) * 2, bool)
        for s in self.automaton.sequences:
            self.follows[s[:-1], s[1:]] = True
        self.phrases = [([self.numbers[w] for w in phrase.encode().split()], label) for phrase, label in PHRASES]

    def __call__(self, text: str) -> dict:
        parts = [np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words)) for words in words_of(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts, base = [], set()
        for phrase, label in self.phrases:
            n = max(len(ids) - len(phrase) + 1, 0)
            here = np.flatnonzero(np.logical_and.reduce([ids[j : j + n] == x for j, x in enumerate(phrase)]))
            starts.append(here)
            base |= {label} if len(here) else set()
        places = np.concatenate(starts)
        spans, score = self._spans(ids)
        return {
            "n_words": len(ids), "n_base": len(places), "first_word": int(places.min()) if len(places) else None, "last_word": int(places.max()) if len(places) else None,
            "base_labels": sorted(base), "labels": sorted(base | {s["label"] for s in spans}), "score": score, "spans": spans,
        }

    def _spans(self, ids: np.ndarray) -> tuple[list[dict], float]:
        linked = np.r_[False, self.follows[ids[:-1], ids[1:]], False] if len(ids) else np.zeros(2, bool)
        edge = np.flatnonzero(linked[1:] != linked[:-1])
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in edge.reshape(-1, 2):
            if hi - lo + 1 >= LEAST:
                for t, p, q, k in self.automaton.matches(ids[lo : hi + 1].tolist()):
                    by_template.setdefault(t, []).append((p, int(lo) + q, k))
        spans, score = [], 0.0
        for t, found in by_template.items():
            size = len(self.automaton.sequences[t])
            for covered, start, end in chains(found):
                score = max(score, covered / size)
                if covered >= self.share * size:
                    spans.append({"label": self.templates[t][0], "template": t, "start": start, "end": end, "covered": covered / size})
        return sorted(spans, key=lambda s: (s["start"], s["end"], s["template"])), score


FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
    ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
])


def find_licences(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """For each document its words, the phrases' places and labels, all labels, the score, and spans (label, template, start, end in words, covered)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(templates, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": doc_id, **shared.value(text.as_py())} for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, FOUND)

    kind = "label string, template int, start long, end long, covered double"
    return id_and_text(docs).mapInArrow(
        run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<{kind}>>".replace("end long", "`end` long")
    )


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(read_table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ","), "spans": F.array_join(spans, ",")})

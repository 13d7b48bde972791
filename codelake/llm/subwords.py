"""Byte-level BPE over whole texts, remembering the ids of words already seen.

A byte-level BPE tokenizer cuts a text before it merges, and never across the
border between a white-space-led word and the next. Encoding such words one by
one therefore gives the ids of the whole text, and words recur so often that
most of the work is a dictionary look-up. Texts that hold a special token's string,
which the tokenizer turns into that token, are left to it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_memory

#: Unicode White_Space, which is what the tokenizer's own splitting pattern goes by.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: What no plain text holds, by the rules of RE2.
_UNEVEN = r"[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| [ \n]|\n |\n\n\n|[ \n]\z|\A[ \n]|\A\z"
#: Marks that may end a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: How a byte-level vocabulary writes a blank and a line end.
BLANK, LINE_END = "\u0120", "\u010a"
#: Words beyond this length are encoded each time.
_LONGEST = 48


class Subwords:
    """encode(texts) gives one array of ids per text. Memory is bounded by `remember` words of plain texts and of others each."""

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer.encode_special_tokens = True  # no word is one
        self.dtype = np.dtype("<u2") if self._tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._leads = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._leads[[i for piece, i in self._tokenizer.get_vocab().items() if piece[0] in (BLANK, LINE_END)]] = True
        self._remember = remember
        # Words of plain texts (those without a line end stand for the word and the blank before it), words of others, and marks.
        self._plain: dict[str, bytes] = {"\n": np.array([self._tokenizer.token_to_id(LINE_END)], self.dtype).tobytes()}
        self._known: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}

    def _encode_whole(self, text: str) -> np.ndarray:
        """With special tokens as such."""
        self._tokenizer.encode_special_tokens = False
        try:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        finally:
            self._tokenizer.encode_special_tokens = True

    def _led(self, words: list[str]) -> list[bytes]:
        """Encodes many words as one text, each with one blank or line end before it: only a word's first id begins with one."""
        found, size = [], self.dtype.itemsize
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            [made] = self._tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(made.ids, self.dtype)
            data, cut = ids.tobytes(), [*(np.flatnonzero(self._leads[ids]) * size).tolist(), len(ids) * size]
            if len(cut) == len(part) + 1:
                found += [data[a:b] for a, b in zip(cut, cut[1:])]
            else:  # a word holds a character that the tokenizer writes with another blank
                found += self._pieces(part).values()
        return found

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The words of texts that aren't plain."""
        led = [w for w in words if w[0] == " " and len(w) > 1 and w[1] != " "]
        return self._pieces(list(words.difference(led))) | dict(zip(led, self._led(led)))

    def _learn_plain(self, words: set[str]) -> dict[str, bytes]:
        """The words of plain texts."""
        stems, marked = [], []
        for word in words:
            stem = word.rstrip(_MARKS)
            if len(stem) < len(word) and stem and stem[-1] <= "\xff" and stem[-1].isalnum():
                marked.append((word, stem, word[len(stem) :]))
            else:
                stems.append(word)
        new = {*stems, *(stem for _, stem, _ in marked if stem not in self._plain)}
        stems = list(new)
        made = dict(zip(stems, self._led([w if w[0] == "\n" else f" {w}" for w in stems])))
        for word, stem, marks in marked:
            if (end := self._marks.get(marks)) is None:
                end = np.array(self._tokenizer.encode(marks, add_special_tokens=False).ids, self.dtype).tobytes()
                if len(marks) <= 4:
                    self._marks[marks] = end
            made[word] = (made[stem] if stem in made else self._plain[stem]) + end
        return made

    def _pieces(self, words: list[str]) -> dict[str, bytes]:
        """Encodes words as pieces of one text; word_ids says which piece an id came from."""
        made = self._tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        data, size = np.array(made.ids, self.dtype).tobytes(), self.dtype.itemsize
        cut = (np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(words) + 1)) * size).tolist()
        return {w: data[lo:hi] for w, lo, hi in zip(words, cut, cut[1:])}

    def _ids(self, words: list[str], known: dict[str, bytes], learn: Callable) -> list[bytes]:
        """The ids of each word."""
        found = list(map(known.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        made = learn({words[k] for k in gaps}) if gaps else {}
        for k in gaps:
            found[k] = made[words[k]]
        known.update((w, ids) for w, ids in made.items() if len(w) <= _LONGEST)
        if len(known) > self._remember:
            # The oldest entries are the commonest words.
            for w in list(known)[self._remember // 2 :]:
                del known[w]
        return found

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        # A line end put before each text, so that its first word is a line's first word, is taken off again.
        split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        words = split.flatten().dictionary_encode()
        ids = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self._plain, self._learn_plain)
        flat, codes = np.frombuffer(b"".join(ids), self.dtype), words.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        n = sizes[codes]
        ends = np.cumsum(n)
        # What to add to an id's place among all to get its place among those of different words.
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
        at = np.repeat(shift, n)
        at += np.arange(len(at))
        borders = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        made = flat[at]
        return [made[lo + 1 : hi] for lo, hi in zip(borders.tolist(), borders[1:].tolist())]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        found: list = [None] * len(texts)
        whole = np.zeros(len(texts), bool)
        for special in self._special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        plain = ~(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) | whole)
        if plain.any():
            for i, ids in zip(np.flatnonzero(plain).tolist(), self._encode_plain(texts.filter(pa.array(plain)))):
                found[i] = ids
        others = np.flatnonzero(~(plain | whole)).tolist()
        split = [_WORDS.findall(text) for text in texts.take(pa.array(others, pa.int64())).to_pylist()]
        words = list(set().union(*split))
        ids_of = dict(zip(words, self._ids(words, self._known, self._learn)))
        for i, text in zip(others, split):
            found[i] = np.frombuffer(b"".join(map(ids_of.__getitem__, text)), self.dtype)
        for i in np.flatnonzero(whole).tolist():
            found[i] = self._encode_whole(texts[i].as_py())
        return found


def subwords(path: str) -> Subwords:
    """One for each Python worker, so that what one task has learned serves the next of the same operator."""
    only_memory("subwords", _loaded.cache_clear)
    return _loaded(path)


@cache
def _loaded(path: str) -> Subwords:
    return Subwords(path)

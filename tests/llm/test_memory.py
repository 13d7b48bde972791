"""What one Python worker holds: Spark gives it to one operator after another."""

import tracemalloc

import numpy as np

from codelake.llm import common, quality, shingles
from codelake.llm.subwords import subwords

VECTORS = np.random.default_rng(3).normal(size=(quality.ENTRIES, quality.DIMENSIONS)).astype(np.float32)


def peak(f, *args) -> float:
    tracemalloc.start()
    f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_a_batch_of_texts_is_pooled_a_few_texts_at_a_time():
    texts = [f"word{i % 90} " * 500 for i in range(1000)]
    assert peak(quality.pooled, texts, VECTORS) < 40


def test_a_batch_of_texts_adds_to_word_vectors_in_parts():
    texts = [f"Some{i % 90} words 12 12 here " * (i % 200) for i in range(600)]
    parts, whole, each = (np.zeros((quality.ENTRIES, quality.DIMENSIONS)) for _ in range(3))
    for part in common.parts_of(texts):
        quality.add_around(parts, part)
    quality.add_around(whole, texts)
    for text in texts:
        quality.add_around(each, [text])
    assert whole.any() and (parts == whole).all() and (each == whole).all()
    assert (quality.pooled(texts, VECTORS) == np.concatenate([quality._pooled([t], VECTORS) for t in texts])).all()


def test_parts_are_all_texts_in_order():
    for texts in ([], [""], ["", "abc", "", "defgh", "i"], ["x" * 50, "y"], ["y", "x" * 50, ""]):
        for most in (1, 3, 4, 100):
            parts = list(common.parts_of(texts, most))
            assert [t for p in parts for t in p] == texts
            assert all(p and (len(p) == 1 or sum(map(len, p)) <= most) for p in parts)
    assert quality.pooled([], VECTORS).shape == (0, quality.pooled([""], VECTORS).shape[1])


def test_the_words_of_one_operator_go_when_another_begins():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    quality.read_words(["some words"])
    assert quality._entries and not shingles._words
    shingles.word_hashes([["some", "words"]])
    assert shingles._words and not quality._entries
    first = subwords(path)
    assert subwords(path) is first and not shingles._words
    quality.read_words(["some words"])
    assert quality._entries and subwords(path) is not first and not quality._entries

"""What a Python worker holds while it encodes and scores texts: numbers, not strings."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fitgrid.llm import tokens
from fitgrid.llm.toxicity import SpanTagger


@pytest.fixture
def words():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghij", k=8)) for _ in range(60_000)]


def test_known_words_take_little_room(words):
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    encoder.encode(["warm up"])
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for at in range(0, len(words), 5000):
            encoder.encode(pa.array([" ".join(words[at:at + 5000])]))
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 60 * len(words)


def test_ids_stay_right_when_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE_ENTRIES", 40)
    encoder, rng = tokens.WordEncoder(tokens.vocabulary_path()), random.Random(6)
    few = ["the", "word,", "(x)", "12.", "\u00e9t\u00e9!", "...", "\u6f22\u5b57", "a;b", "don't", "<|endoftext|>", "&&", "\r"]
    for _ in range(60):
        texts = ["".join(rng.choice(few + ["w%d" % rng.randrange(300)]) + rng.choice([" ", "\n", " ", "  "])
                         for _ in range(rng.randrange(12))).rstrip(" ") for _ in range(5)] + ["", None]
        assert encoder.encode(pa.array(texts, pa.string())) == [
            np.asarray(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_that_the_vocabulary_marks_otherwise():
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    encoder.begins = {mark: np.zeros_like(starts) for mark, starts in encoder.begins.items()}
    texts = ["one two, three\nfour one", "two\ntwo. five"]
    assert encoder.encode(texts) == encoder._whole(texts)


def test_scoring_holds_numbers_of_words(words):
    texts = [" ".join(words[at:at + 300] * 5) for at in range(0, len(words), 300)]
    n = sum(map(len, (t.split() for t in texts)))
    tagger = SpanTagger({"abc": 2.0, "ja": 1.0}, -3.0, [0.1, -0.2, 0.3, 0.1], (-1.0, 1.0, 1.0))
    tagger.known = dict.fromkeys(words, 0.0)
    tracemalloc.start()
    try:
        tagger.tag(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90 * n

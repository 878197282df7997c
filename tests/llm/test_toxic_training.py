"""Training holds whatever the shares of the sample, and scores equal those summed over all paths."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from fitgrid.llm import toxicity

BAD = ["scum", "moron", "trash", "clown", "idiot"]


def text_of(pick, toxic):
    """Words of three syllables, most of them rare; a toxic text holds one or two bad ones."""
    words = ["".join(pick.choices(["ra", "ne", "ti", "on", "sel", "qua", "mi", "dor", "ul", "est", "vi", "cap"], k=3)) for _ in range(60)]
    for _ in range(pick.randint(1, 2) if toxic else 0):
        words[pick.randrange(60)] = pick.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def shares_kept():
    """(clean kept, toxic caught) of texts not learnt from, by the sizes of the sample."""
    pick = random.Random(8)
    pool = {label: [text_of(pick, label) for _ in range(1500)] for label in (0, 1)}
    test = {label: [text_of(pick, label) for _ in range(600)] for label in (0, 1)}
    found = {}
    for clean, toxic in ((329, 329), (800, 800), (1500, 1500), (1500, 329), (300, 1500)):
        tagger = toxicity.fit_tagger(
            pool[0][:clean] + pool[1][:toxic], [0] * clean + [1] * toxic, rounds=25, labelled=(90_000, 10_000))
        score = {label: tagger.score(*tagger.tag(texts)) for label, texts in test.items()}
        found[clean, toxic] = (score[0] < 0.3).mean(), (score[1] >= 0.3).mean()
    return found


def test_shares_of_the_sample_do_not_matter(shares_kept):
    assert all(min(x) >= 0.95 for x in shares_kept.values()), shares_kept
    for i in (0, 1):
        values = [x[i] for x in shares_kept.values()]
        assert max(values) - min(values) <= 0.03, shares_kept


def test_a_count_is_worth_what_the_sample_makes_it():
    def tells(clean, toxic, features, n):
        holders = np.zeros((2, features))
        holders[0, 0], holders[1, 0] = clean, toxic
        holders[:, 1:] = 10
        return bool(toxicity.telling_features(holders, np.asarray(n))[0][0])
    assert not tells(0, 4, 1000, (329, 329)) and tells(0, 30, 1000, (329, 329))
    assert tells(0, 8, 1000, (3000, 329)) and not tells(0, 8, 1000, (329, 329))  # rare classes make a count telling
    assert not tells(30, 30, 1000, (500, 500)) and not tells(30, 0, 1000, (500, 500))
    empty = toxicity.telling_features(np.zeros((2, 0)), np.asarray([5, 5]))
    assert [len(x) for x in empty] == [0, 0]


def test_more_hints_never_speak_for_harmlessness():
    pick = np.random.default_rng(3)
    y = pick.integers(0, 2, 400).astype(float)
    x = np.column_stack((y * 3 + pick.standard_normal(400), -y + 0.1 * pick.standard_normal(400)))
    w = toxicity._logistic(x, y, np.ones(400))
    assert w[1] > 0 and w[2] == 0


def marginals_by_paths(emission, trans):
    """Probability of state 1 per token, from the weight of every path of states."""
    total, on = 0.0, np.zeros(len(emission))
    for path in itertools.product((0, 1), repeat=len(emission)):
        weight = math.exp(sum(e for e, s in zip(emission, path, strict=True) if s)
                          + sum(trans[2 * a + b] for a, b in itertools.pairwise(path)))
        total += weight
        on += weight * np.asarray(path)
    return on / total


def test_scores_and_spans_path_by_path(spark):
    tagger = toxicity.SpanTagger({"scum$": 4.0, "scu": 2.5, "mor": 3.0, "nice$": -2.0}, -2.0, [0.4, -0.6, -0.2, 0.9], (-1.0, 0.8, 1.7))
    texts = ["You scum, MORON and scums", "nice nice", "", None, "É scum moron\nscum nice a b", "MORON", "İ scum", "scum " * 9]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "scum", "x", 1), (0, texts[0], "x", 1)]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, p int"), tagger).collect()
    assert len(got) == len(rows)
    for r, (i, text, *_) in zip(sorted(got, key=str), sorted(rows, key=lambda x: str((x[0],))), strict=True):
        assert r.doc_id == i
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        found = list(re.finditer(r"\w+", (text or "").lower() if text != "İ scum" else "i scum"))
        emission = [tagger.bias + sum(tagger.weights.get(f, 0) for f in toxicity.token_features(m.group())) for m in found]
        p = marginals_by_paths(emission, tagger.transitions) if found else np.zeros(0)
        top = math.log(p.max() / (1 - p.max())) if found else -12.0
        many = math.log1p(sum(x for x in p if x > 0.1))
        b, w1, w2 = tagger.score_weights
        assert by_id[i].score == pytest.approx(1 / (1 + math.exp(-(b + w1 * top + w2 * many))), rel=1e-9), text
        assert by_id[i].predicted == (by_id[i].score >= 0.3)
        if text != "İ scum":
            assert [(s.start, s.end) for s in by_id[i].spans] == [m.span() for m, q in zip(found, p, strict=True) if q >= 0.5]
            assert [s.p for s in by_id[i].spans] == pytest.approx([q for q in p if q >= 0.5])

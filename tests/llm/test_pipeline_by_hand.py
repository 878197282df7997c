"""Every stage of the pipeline beside a plain version of it, on a small table with clashing columns, nulls and repeats."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fitgrid.llm import toxicity
from fitgrid.llm.tokens import WordEncoder, vocabulary_path
from fitgrid.session import scratch_path

EXTRA = ("size", "times", "score", "predicted", "spans", "source_size", "target", "taken", "print", "n_lines", "component_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
SHARED = ["A passage that many of the documents repeat", "another line of more than twenty characters"]
SPACE = " \t\n\x0b\f\r"


def plain(rows):
    return [r[:5] for r in rows]


@pytest.fixture(scope="module")
def inputs(spark):
    pick = random.Random(11)
    pool = ["".join(pick.choices(["ra", "ne", "ti", "on", "sel", "qua", "mi", "dor"], k=3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        toxic = i % 4 == 1
        words = pick.choices(pool, k=pick.randint(8, 60))
        for _ in range(2 if toxic else 0):
            words[pick.randrange(len(words))] = pick.choice(["Scum", "moron", "trash"])
        text = " ".join(words)
        if i % 9 == 0:
            text = "\n".join([text, pick.choice(SHARED), "end"])
        rows.append([i, text, "en", pick.choice(["hot", "hot", "b", None])])
        if i % 5:
            labels.append((i, int(toxic)))
    for i in range(40):  # exact and near copies
        text = rows[pick.choice([3, 4, 7, 8])][1]
        rows.append([300 + i, text + pick.choice(["", " tail", "\nmore"]), "en", pick.choice(["hot", "c"])])
    rows += [[400, None, None, "hot"], [401, "", "en", "b"], [402, " \n ", "en", "c"], [None, rows[3][1], "en", "hot"],
             [3, rows[3][1], "en", "hot"], [403, "w " * 5000, "en", "long"]]
    rows = [(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows]
    folder = scratch_path(spark, "tables")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def probability(tagger, text):
    """Score of a text, token by token."""
    words = re.findall(r"\w+", (text or "").lower())
    e = [tagger.bias + sum(tagger.weights.get(f, 0.0) for f in toxicity.token_features(w)) for w in words]
    t = [math.exp(x) for x in tagger.transitions]
    forward, backward = [], [1.0] * len(e)
    for k, x in enumerate(e):
        x = math.exp(max(-40, min(40, x)))
        forward.append(x if k == 0 else x * (t[1] + forward[-1] * t[3]) / (t[0] + forward[-1] * t[2]))
    for k in range(len(e) - 2, -1, -1):
        x = math.exp(max(-40, min(40, e[k + 1]))) * backward[k + 1]
        backward[k] = (t[2] + t[3] * x) / (t[0] + t[1] * x)
    p = [f * b / (1 + f * b) for f, b in zip(forward, backward, strict=True)]
    top = min(max(max(p), 6e-6), 1 - 6e-6) if p else 0.0
    x1 = math.log(top / (1 - top)) if p else -12.0
    b, w1, w2 = tagger.score_weights
    return 1 / (1 + math.exp(-(b + w1 * x1 + w2 * math.log1p(sum(q for q in p if q > 0.1)))))


def cut_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACE))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    out = []
    for r in rows:
        kept = [x for x in (r[1] or "").split("\n")
                if r[0] is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r[0]]
        text = "\n".join(kept)
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def one_of_each(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    named = [r for r in rows if r[0] is not None]
    sets, root = [shingles(r[1]) for r in named], list(range(len(named)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(named)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) or named[i][0] == named[j][0]:
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(named):
        least[top(i)] = min(least.get(top(i), r), r, key=lambda x: x[0])
    return list(least.values()) + [r for r in rows if r[0] is None]


def mixed(rows, pick):
    """Documents as often as the queues are served: one entry at a time, by virtual finish time."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    names = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    entries = []
    for s in names:
        queued = 0
        for i in sorted((i for i, r in enumerate(rows) if r[3] == s and size[i]), key=lambda i: pick[rows[i][0]]):
            queued += size[i]
            entries += [((k * total[s] + queued) / target[s], names.index(s), pick[rows[i][0]], k, i) for k in (0, 1)]
    out, served, budget = [], 0, sum(target.values())
    for *_, i in sorted(entries):
        served += size[i]
        if served <= budget + 1e-6:
            out.append(rows[i])
    return out


def test_stages_by_hand(spark, inputs):
    folder, docs = inputs
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = scratch_path(spark, "by-hand")
        out.write.parquet(path)
        return spark.read.parquet(path)

    def rows_of(df):
        return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    tagger = toxicity.tagger_for(docs, labels)
    clean = run("toxicity", docs)
    want = [r for r in rows_of(docs) if probability(tagger, r[1]) < 0.3]
    assert Counter(rows_of(clean)) == Counter(want) and 150 < len(want) < 260

    cut = run("line dedup", clean)
    want = cut_lines(want)
    assert Counter(rows_of(cut)) == Counter(want)

    single = run("jaccard join", cut)
    want = one_of_each(want)
    assert Counter(rows_of(single)) == Counter(want)

    pick = {r.doc_id: r.pick for r in single.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("pick")).collect()}
    mix = run("mixing", single)
    want = mixed(want, pick)
    assert Counter(rows_of(mix)) == Counter(want)

    pieces = run("packing", mix).collect()
    encode, ids = WordEncoder(vocabulary_path()).encode, Counter()
    for _, text, *_ in want:
        ids[encode([text or ""])[0] + np.asarray([1], "<u4").tobytes()] += 1
    assert sum(p.length for p in pieces) == sum(len(x) // 4 * n for x, n in ids.items())
    assert Counter(p.doc_tokens for p in pieces if p.start == 0) == Counter(len(x) // 4 for x, n in ids.items() for _ in range(n))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(2048 - sum(n for _, n in x) for x in by_sequence.values()) < 2048


def test_empty_table(spark, inputs):
    folder, docs = inputs
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns

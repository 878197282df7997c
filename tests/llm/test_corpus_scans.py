"""Source divergence, licence scans and spelling variants against brute-force versions."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fitgrid.llm import divergence, licenses, spelling

DOCS = "doc_id long, text string, lang string, source string, n int, word string, labels int, rank int, term string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# --- source divergence

def divergence_of(rows, least, top):
    seen = [(lang or "", source or "", [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in seen}:
        own = [x for x in seen if x[0] == lang]
        docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = {t for t, n in docs.items() if n >= least}
        total = Counter(t for _, _, terms in own for t in terms if t in kept)
        counts = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)

        def p(count, t):
            return 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept))
        for s, count in counts.items():
            pairs = [(-sum(abs(p(count, t) - p(other, t)) for t in kept), o.encode(), o) for o, other in counts.items() if o != s]
            terms = [(p(total, t) - p(count, t), t.encode(), t) for t in kept if count[t] and p(count, t) > p(total, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **how):
    return sorted(tuple(r) for r in divergence.audit_sources(table_of(spark, rows), **how).collect())


def test_divergence(spark, monkeypatch):
    pick = random.Random(5)
    pool = ["Éa", "éa", "the", "THE", "x1y", "naïve", "a_b", "中文", "zz", "K", "tie", "eit"]
    rows = [(i, " ".join(pick.choices(pool, k=pick.randint(0, 12))), pick.choice(["en", "de", None, ""]),
             pick.choice(["s0", "s1", None, "", "é"])) for i in range(150)]
    rows += [(1, None, "en", "void"), (1, None, "en", "void"), (None, "the the", "en", "s0"), (7, "lone", "xx", "a"),
             (8, "1 2 3", "xx", "b"), (9, "the\x00the " * 3000, "en", "long"), (9, "", "only", "one")]
    for least, top in ((3, 50), (10, 2)):
        assert audited(spark, rows, min_documents=least, top=top) == divergence_of(rows, least, top)
    monkeypatch.setattr(divergence, "_CELLS", 9)  # many shards of a few terms each
    assert audited(spark, rows, min_documents=3) == divergence_of(rows, 3, 50)
    assert audited(spark, []) == []


def test_partial_counts_are_sent_and_added_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_CHARS", 40)
    monkeypatch.setattr(divergence, "_ROWS", 5)
    import pyarrow as pa
    texts = ["a b c d e f g h", "a b", "", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "i j k l m n o p q r"] * 9
    batches = [pa.record_batch({"text": texts, "lang": ["x"] * 45, "source": ["s", "t", "s"] * 15})]
    count, docs = Counter(), Counter()
    sent = list(divergence._partial_counts(iter(batches)))
    assert len(sent) > 1
    for batch in sent:
        for r in batch.to_pylist():
            count[r["source"], r["term"]] += r["count"]
            docs[r["source"], r["term"]] += r["docs"]
    want = [(("s", "t", "s")[i % 3], t.split()) for i, t in enumerate(texts)]
    assert count == Counter((s, w) for s, t in want for w in t)
    assert docs == Counter((s, w) for s, t in want for w in set(t))


# --- licences

def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


TEXTS = [
    None, "", "MIT License", "the MIT-license, an Apache\nLicense; CC-BY 4.0 and cc by", "permit licenses mitlicense é mit licensé",
    "gnu general public license gnu general public license", "mit mit license apache apache license license",
    "Licensed under the Apache License, Version 2.0.", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\ncode",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "SPDX-License-Identifier: (MIT OR", "é " * 20000 + "CC BY-NC-SA",
    "mit license\x00mit\x0blicense mit license",
]


def test_licences(spark):
    pick = random.Random(2)
    pool = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "x", "é", "spdx", "identifier", "version", "3"]
    texts = TEXTS + ["".join(w + pick.choice([" ", "-", "\n", ", ", ""]) for w in pick.choices(pool, k=40)) for _ in range(200)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "mit license", None, None), (2, "MIT License", "en", "s")]
    got = licenses.scan_licenses(table_of(spark, rows), keep=("doc_id", "labels", "word")).collect()
    assert got[0].__fields__ == ["doc_id", "word", *licenses._FIELDS.names]
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in got) == Counter(
        (i, n, k, a, b, tuple(labels)) for i, t, _, _ in rows for n, k, a, b, labels in [base_of(t)])
    assert all(set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got[:len(TEXTS)]}
    assert by_id[0].labels == [] and by_id[0].score == 0 and by_id[0].asks is None
    assert by_id[7].labels == ["apache", "apache-2.0"] and by_id[7].score == 0.9
    assert by_id[8].labels == ["bsd-3-clause", "gpl-2.0", "mit"] and by_id[8].asks == licenses.NOTICE
    assert by_id[8].expressions == ["((MIT OR GPL-2.0-only) AND BSD-3-Clause)"]
    assert by_id[9].asks == licenses.FILES and by_id[9].labels == ["gpl-2.0"]
    assert by_id[10].expressions == [] and by_id[10].labels == []
    assert by_id[11].labels == ["cc-by", "cc-by-nc", "cc-by-nc-sa"] and by_id[11].first_word == 20000
    assert licenses.scan_licenses(table_of(spark, [])).count() == 0


def tree_value(tree):
    """(text, asks) of an expression given as nested tuples."""
    if isinstance(tree, str):
        return tree, licenses._licence(tree).asks
    operator, left, right = tree
    (a, x), (b, y) = tree_value(left), tree_value(right)
    if operator == "with":
        return f"{a} WITH {b}", None if x is None else min(x, licenses.FILES)
    known = [v for v in (x, y) if v is not None]
    value = min(known, default=None) if operator == "or" else max(known) if len(known) == 2 else None
    return f"({a} {operator.upper()} {b})", value


def test_expressions():
    names = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LicenseRef-own", "AGPL-3.0", "CC0-1.0", "DocumentRef-a:LicenseRef-b"]
    ranks = {"or": 1, "and": 2}
    pick = random.Random(9)

    def grown(depth):
        if depth == 0 or pick.random() < 0.3:
            name = pick.choice(names)
            return ("with", name, "Classpath-exception-2.0") if pick.random() < 0.2 else name
        return pick.choice(["or", "and"]), grown(depth - 1), grown(depth - 1)

    def written(tree, rank=0):
        """With only the brackets that precedence and order from the left call for."""
        if isinstance(tree, str):
            return tree
        operator, left, right = tree
        if operator == "with":
            return f"{left} with {right}"
        own = ranks[operator]
        text = f"{written(left, own)} {operator} {written(right, own + 1)}"
        return f"({text})" if own < rank else text

    for _ in range(300):
        tree = grown(4)
        terms = licenses.evaluate(": " + written(tree))
        assert (terms.text, terms.asks) == tree_value(tree)
    assert licenses.evaluate("MIT and others were used here").text == "(MIT AND others)"
    assert licenses.evaluate("MIT and").text == "MIT"
    assert licenses.evaluate("MIT. Or not").text == "MIT"
    assert licenses.evaluate("MIT */").text == "MIT" and licenses.evaluate("(MIT) x").text == "MIT"
    for none in ("", ")", "and MIT", "(MIT", "(MIT OR", "()", "* MIT", "(MIT OR)"):
        assert licenses.evaluate(none) is None, none


# --- spelling

def words_of(rows, noise, least_chars, least):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(n, ratio=5):
    near = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(x, key=lambda o: (-n[o], o)) for w, x in near.items()}
    form = {w: o for w, o in best.items() if n[o] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()), key=str)


def test_words(spark):
    pick = random.Random(4)
    pool = ["Größe", "ÄNDERUNG", "straßen", "naïveté", "ab", "abcdef", "ABCDEF", "×÷×÷×÷×", "hyphen-word", "x9letters", "żółćęą"]
    rows = [(pick.randrange(50), " ".join(pick.choices(pool, k=pick.randint(0, 30))), "en", "s") for _ in range(120)]
    rows += [(None, "abcdef abcdefg", None, None), (3, None, "en", "s"), (3, "", "en", "s"), (4, "longword " * 20000, "en", "s")]
    for noise in (199, 3, 1):
        got = spelling.words(table_of(spark, rows), noise=noise)
        assert {r.word: r.n for r in got.collect()} == words_of(rows, noise, 6, 5)
    assert spelling.spelling_variants(table_of(spark, [])).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_variants(spark, levels):
    pick = random.Random(levels)
    found = {}
    for _ in range(60):  # chains of edits over a small alphabet: many near words, repeats of letters, ties
        word = "".join(pick.choices("aabé", k=pick.randint(6, 14)))
        for _ in range(8):
            found[word] = pick.choice([5, 5, 6, 25, 30, 125, 700, 9000])
            i = pick.randrange(len(word) + 1)
            word = word[:i] + pick.choice(["", "a", "é", "z"]) + word[i + pick.randrange(2):]
            if len(word) < 6:
                break
    table = spark.createDataFrame(list(found.items()), "word string, n long")
    got = spelling.group_variants(table, levels=levels).collect()
    assert sorted((tuple(r) for r in got), key=str) == variants_of(found)
    assert any(r.root != r.form for r in got if r.form)


def test_every_single_edit_is_found_once(spark):
    pick = random.Random(1)
    pairs = set()
    for size in range(6, 15):
        word = "".join(pick.choices("abcde", k=size))
        for i in range(size + 1):
            pairs.add((word, word[:i] + "x" + word[i:]))
            if i < size:
                pairs.add((word, word[:i] + "x" + word[i + 1:]))
                if size > 6:
                    pairs.add((word, word[:i] + word[i + 1:]))
    every = sorted({w for p in pairs for w in p})
    want = {frozenset(p) for p in itertools.combinations(every, 2) if one_edit(*p)}
    assert {frozenset(p) for p in pairs} <= want
    got = spelling.near_words(spark.createDataFrame([(w,) for w in every], "word string")).collect()
    assert len(got) == len(want) and {frozenset(r) for r in got} == want

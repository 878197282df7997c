"""Each corpus operator against a brute-force version, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from fitgrid.llm import chat, jaccard, line_dedup, mixing, neighbours, packing, pii, token_files, toxicity, vector_dedup
from fitgrid.llm.components import connected_components
from fitgrid.llm.tokens import WordEncoder, vocabulary_path
from fitgrid.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, words int, print int, h1 int"
LINE = "The same long line in many documents"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[k] if sources else "s", None, "x", 1, 2, 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, f"{LINE}\nown"), (2, f"  {LINE.upper()}\t\nx\n{LINE}"), (3, LINE), (5, None), (6, ""), (7, "a\n\nb\n"),
       (8, "é" * 25 + "\nÉ"), (9, "É" * 25), (10, "é" * 25), (11, "é" * 25), (3, LINE), (None, LINE), (12, "w " * 30000)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def test_lines(spark):
    holders = defaultdict(set)
    for i, t in ODD:
        for line in (t or "").split("\n"):
            if i is not None and len(lower(line.strip(" \t\n\x0b\f\r"))) >= 20:
                holders[lower(line.strip(" \t\n\x0b\f\r"))].add(i)
    want = Counter()
    for i, t in ODD:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\f\r")) for x in lines]
        kept = [x for x, k in zip(lines, keys) if i is None or len(holders.get(k, ())) < 3 or max(holders[k]) == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = line_dedup.dedup_lines(docs_of(spark, ODD))
    assert set(got.columns) == {c.split()[0] for c in DOCS.split(", ")} | {"n_lines", "n_dropped"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x_y@d-e.f.g", "@", ".", "_", "1.2.3.4", "999.1.1.1", ".5", "0012", "4111111111111111", "-", " ",
            "4111 1111-1111 1111 ", "+1 (964) 555-6364", "+12", "é", "\U0001f600", "user.name", "\n", "\\", "$", "'"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "a" * 100_000), (903, "1." * 20_000), (904, "a@b.c " * 300), (904, "a@b.c " * 300)]
    rows = pii.personal_data(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    known = dict(texts)
    for r in rows:
        spans = base_spans(known[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (known[r.doc_id], spans, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS[:4]]
        assert set(spans) <= set(r.spans.split(","))
    assert pii.personal_data(docs_of(spark, [])).count() == 0


def test_reliable_labelers_are_recognised():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        good = [int(truth) if rng.random() < 0.95 else int(not truth) for _ in range(3)]
        counts[0, (*good, rng.choice([0, 1, 2]), 2)] += 1
    patterns = [(k, v, n) for (k, v), n in sorted(counts.items())]
    post, rates = pii.estimate_reliabilities(patterns)
    assert rates[0, 1][1] > 0.9 and rates[0, 0][0] > 0.9 and abs(rates[3, 1][1] - rates[3, 0][1]) < 0.15
    weights = pii.train_span_classifier(patterns, post)
    score = lambda votes: sum(weights.get(f, 0) for f in [("kind", 0), *enumerate(votes)])
    assert score((1, 1, 1, 2, 2)) > 0 > score((0, 0, 0, 2, 2))


def test_word_encoder_equals_the_tokenizer():
    encoder, rng = WordEncoder(vocabulary_path()), random.Random(2)
    bits = [" ", "  ", "\n", "\t", "\r", "a", "Be", "é", "1", "　", "\xa0", ".", "'s", "!!", "\x85", "<|endoftext|>", "漢"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert encoder.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in plain]


def test_token_files(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs_of(spark, [x for x in ODD if x[0] not in (None, 3)]), path, vocabulary_path())
    encoder, at = WordEncoder(vocabulary_path()), 0
    rows = {r.doc_id: r for r in token_files.token_digests(spark, path).collect()}
    light = {r.doc_id: (r.start, r.n_tokens) for r in token_files.token_metadata(spark, path).collect()}
    for i, t in sorted(x for x in ODD if x[0] not in (None, 3)):
        ids = encoder.encode([t or ""])[0] + bytes(4)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        assert light[i] == (at, len(ids) // 4)
        at += len(ids) // 4
    empty = scratch_path(spark, "tokens")
    token_files.write_token_files(docs_of(spark, []), empty, vocabulary_path())
    assert token_files.token_digests(spark, empty).count() == 0


def test_packing(spark):
    window, encoder, rng = 64, WordEncoder(vocabulary_path()), random.Random(3)
    texts = [(i, " ".join("ab" for _ in range(rng.choice([5, 20, 31, 42, 63, 64, 200])))) for i in range(200)]
    texts += [(900, None), (901, ""), (902, "one two"), (902, "one two")]
    rows = packing.pack_documents(docs_of(spark, texts), vocabulary_path(), window).collect()
    known, pieces, sequences = dict(texts), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in known.items():
        ids = encoder.encode([t or ""])[0] + np.asarray([1], "<u4").tobytes()
        spans = sorted((r.start, r.length) for r in pieces[i])
        copies = sum(k == i for k, _ in texts)
        assert sum(n for _, n in spans) == copies * len(ids) // 4
        for r in pieces[i]:
            assert r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(sum(r.length for r in p) < window for p in sequences.values()) <= 1
    assert packing.pack_documents(docs_of(spark, []), vocabulary_path()).count() == 0


def test_repeats_never_use_more_than_there_is():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 50) for n in range(1, 64)}
    combinations = packing.fill_combinations(histogram, 64, 20)
    counts = packing.solve_repeats(combinations, histogram)
    used = Counter()
    for c, n in zip(combinations, counts):
        assert sum(c) == 64
        for length in c:
            used[length] += n
    assert all(used[n] <= histogram[n] for n in used) and sum(counts) > 0


def test_chat(spark):
    rng = random.Random(6)
    bits = ["<|", "<\\|", "\\", "|>", "<|im_end|>", "\n", " ", "é", "hi", "<|im_start|>user", "<|im_sep|>", "\n\n", "  "]
    rows = [(c, t, rng.choice(["user", "assistant", None, "sys<|tem"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))]))
            for c in range(40) for t in range(5)] + [(None, 0, "user", "x"), (3, None, "assistant", "first"), (50, 0, "assistant", "")]
    rows += [(60, i, "assistant", "long " * 50) for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table, vocabulary_path())).collect()}
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(table.limit(0), vocabulary_path()).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_jaccard(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts, i = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.randint(1, 14)):
            copy = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            texts.append((i, " ".join(copy[rng.choice([0, 0, 3]):])))
            i += 1
    texts += [(i, None), (i + 1, ""), (i + 2, "A b"), (i + 3, "a\tB"), (i + 4, " \n"), (i + 5, texts[0][1].upper())]
    texts += [texts[3], (None, texts[3][1])]
    sets = {k: shingles(t) for k, t in texts if k is not None}
    group = {k: k for k in sets}
    for _ in range(20):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    rows = jaccard.near_duplicates(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id])
    kept = jaccard.one_of_each_group(docs_of(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(group.values()))
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0


def test_long_chains_of_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in rng.standard_normal((30, 16)):
        for _ in range(8):
            rows.append((c + rng.standard_normal(16) * 0.08).tolist())
    rows += [rows[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    return rows, spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")


def test_neighbours(spark):
    rows, table = vectors(spark)
    good = {i: np.asarray(v) for i, v in enumerate(rows[:-6])}
    cos = lambda a, b: (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b))
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, candidate_block=37, query_block=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-round(cos(good[q], v), 12), i) for i, v in good.items() if i != q)[:5]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in best]
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in best], atol=1e-9)
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0


def test_vector_links(spark):
    rows, table = vectors(spark)
    x = np.asarray(rows[:-6])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    for _ in range(40):
        for i, j in zip(*np.nonzero(linked)):
            root[i] = root[j] = min(root[i], root[j])
    got = vector_dedup.near_duplicate_vectors(table, tables=40, bits=6, block=16).collect()
    assert len(got) == len(rows)
    for r in got:
        n = int(linked[r.vec_id].sum()) if r.vec_id < len(x) else 0
        assert (r.n_links, r.component_id, r.kept) == (n, root[r.vec_id], root[r.vec_id] == r.vec_id)
    assert vector_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    sources = [rng.choice(["hot"] * 5 + ["b", "c", None, "zz"]) for _ in range(600)]
    texts = [(i, "w " * rng.randint(0, 40) if rng.random() < 0.95 else None) for i in range(599)] + [(5, "w w w")]
    table = docs_of(spark, texts, sources)
    rows = mixing.mix_sources(table, keep=["doc_id", "source"]).collect()
    sizes, by_source = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.source] += r.size
        by_source[r.source].append(r)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for s, own in by_source.items():
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 80 and all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert sorted(rows, key=str) == sorted(mixing.mix_sources(table, keep=["doc_id", "source"]).collect(), key=str)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(10)
    lengths = np.asarray([3, 0, 1, 5, 4])
    emission, trans = rng.standard_normal(lengths.sum()), rng.standard_normal(4)
    got, at = toxicity.marginals(emission, lengths, trans), 0
    for n in lengths:
        mass, total = np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + t] * s for t, s in enumerate(path))
                       + sum(trans[2 * a + b] for a, b in zip(path, path[1:])))
            total += w
            mass += w * np.asarray(path)
        assert np.allclose(got[at:at + n], mass / total)
        at += n


def test_toxicity(spark):
    rng = random.Random(11)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    texts, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(["Vile", "awfulest"])
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    texts += [(900, None), (901, ""), (902, "İ vile")]
    labels += [(None, 1), (3, None), (5000, 1)]
    table = docs_of(spark, texts)
    tagger = toxicity.tagger_for(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score_documents(table, tagger).collect()}
    truth = dict((i, t) for i, t in labels[:400])
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].predicted == truth[i] for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[900].predicted == rows[901].predicted == 0
    known = dict(texts)
    spans = [known[i][s["start"]:s["end"]] for i in unseen for s in rows[i].spans]
    assert spans and set(spans) <= {"Vile", "awfulest"}
    blank = toxicity.tagger_for(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_documents(table, blank).collect()} == {0}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] < 200 and counts[1] == counts[0] and counts[2] < counts[1] and counts[3] > counts[2]
    first = docs.orderBy("doc_id", "start", "sequence_id").collect()
    again = corpus_pipeline.run(spark, folder).orderBy("doc_id", "start", "sequence_id")
    assert sorted(r.ids_crc32 for r in first) == sorted(r.ids_crc32 for r in again.collect())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_nearest_neighbours", "op7_embedding_dedup", "op9_chat_formatting"])
def test_query_equals_its_twin(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from check_twins import oracle, rows_of
    from fitgrid.llm.queries import QUERIES, TWINS
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = oracle("/root/testdata/sf0.001").execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cursor.fetchall())


def test_token_files_with_repeated_and_missing_ids(spark):
    rows = [(5, "b b"), (None, "none"), (5, "a"), (5, None), (5, "a"), (2, "first"), (None, None), (7, " two  spaces")]
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs_of(spark, rows), path, vocabulary_path())
    encode, key = WordEncoder(vocabulary_path()).encode, lambda i: -1 if i is None else i
    got = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x) // 4, zlib.crc32(x)) for i, t in rows for x in [encode([t or ""])[0] + bytes(4)])
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def test_token_file_layout(spark):
    """Ids are delta-coded without a dictionary, pages are indexed, and one document is read without the others' pages."""
    import glob
    import pyarrow.parquet as pq
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choices(["alpha", "beta", "gamma", "delta", "x1", "!"], k=200))) for i in range(3000)]
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(
        docs_of(spark, rows).coalesce(1), path, vocabulary_path(), row_group_bytes=200 << 10, page_bytes=8 << 10)
    files = glob.glob(f"{path}/*.parquet")
    footers = [pq.ParquetFile(f).metadata for f in files]
    columns = {m.row_group(0).column(k).path_in_schema: m.row_group(0).column(k) for m in footers for k in range(m.num_columns)}
    tokens = columns["tokens.list.element"]
    assert "DELTA_BINARY_PACKED" in tokens.encodings and not tokens.has_dictionary_page
    assert columns["part"].has_dictionary_page
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert sum(m.num_rows for m in footers) == 3000 and sum(m.num_row_groups for m in footers) > len(files)
    assert all(m.row_group(g).total_byte_size < 500 << 10 for m in footers for g in range(m.num_row_groups))
    one = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path).where("doc_id = 1234")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)]" in plan
    assert [len(r.tokens) for r in one.collect()] == [one.first().n_tokens]
    light = token_files.token_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in light

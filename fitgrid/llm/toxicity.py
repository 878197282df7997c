"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrid.llm.common import fingerprint, stored, whole
from fitgrid.llm.tokens import forget_words, text_batches

_TOKEN = re.compile(r"\w+")
PREFIXES = range(3, 9)
_CACHE_ENTRIES = 300_000
_LOG_RATIO = 2.0  # how much more frequent among toxic documents a feature must be to mark a token


def token_features(word: str) -> list[str]:
    """The word itself and its beginnings; suffix marks keep words and beginnings apart."""
    return [word + "$"] + [word[:n] for n in PREFIXES if n < len(word)]


def _ratios(emission: np.ndarray, starts: np.ndarray, active: list[int], trans: np.ndarray) -> tuple:
    """Forward and backward odds of the second state for chains laid out step by step, longest chain first.

    ``starts[t]`` is where step t begins in ``emission``; its first ``active[t]``
    chains still run.
    """
    t00, t01, t10, t11 = trans
    forward, backward = np.empty_like(emission), np.ones_like(emission)
    odds = np.zeros(active[0]) if active else np.zeros(0)
    for t, n in enumerate(active):
        e = emission[starts[t]:starts[t] + n]
        odds = e.copy() if t == 0 else e * (t01 + odds[:n] * t11) / (t00 + odds[:n] * t10)
        forward[starts[t]:starts[t] + n] = odds
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        x = emission[starts[t + 1]:starts[t + 1] + n] * backward[starts[t + 1]:starts[t + 1] + n]
        backward[starts[t]:starts[t] + n] = (t10 + t11 * x) / (t00 + t01 * x)
    return forward, backward


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Where each token of concatenated chains goes in the step-by-step layout."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max()) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    starts = np.concatenate(([0], np.cumsum(active)))[:-1].astype(np.int64) if longest else np.zeros(0, np.int64)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = starts[step] + np.repeat(rank, lengths) if longest else np.zeros(0, np.int64)
    return place, starts, active.tolist(), step


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward probability of the toxic state for every token of concatenated chains.

    ``emission`` holds log-odds per token, ``transitions`` the four log weights
    00, 01, 10, 11. With two states the recursions run on odds, for all chains of
    a batch at once.
    """
    place, starts, active, _ = _layout(lengths)
    laid = np.empty_like(emission)
    laid[place] = np.exp(np.clip(emission, -40, 40))
    forward, backward = _ratios(laid, starts, active, np.exp(transitions))
    odds = (forward * backward)[place]
    return odds / (1 + odds)


class SpanTagger:
    """Feature weights, transitions, and the map from marginals to a document score."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: Sequence[float], score: Sequence[float]):
        self.weights, self.bias = weights, bias
        self.transitions, self.score_weights = np.asarray(transitions), tuple(score)
        self.known: dict[str, float] = {}

    def emission(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_ENTRIES:
            known.clear()
        for word in set(words).difference(known):
            get = self.weights.get
            known[word] = self.bias + sum(get(f, 0.0) for f in token_features(word))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        # text by text: the words of all texts together are many times their numbers
        told = [self.emission(_TOKEN.findall((text or "").lower())) for text in texts]
        lengths = np.asarray([len(x) for x in told], np.int64)
        return marginals(np.concatenate([np.zeros(0), *told]), lengths, self.transitions), lengths

    def summary(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per document: log-odds of its surest token, and how many tokens are likely toxic."""
        ends = np.cumsum(lengths)
        out = np.zeros((len(lengths), 2))
        out[:, 0] = -12.0
        some = lengths > 0
        begins = (ends - lengths)[some]
        if some.any():
            top = np.clip(np.maximum.reduceat(p, begins), 6e-6, 1 - 6e-6)
            out[some, 0] = np.log(top / (1 - top))
            out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0.0), begins))
        return out

    def score(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        b, w1, w2 = self.score_weights
        x = self.summary(p, lengths)
        return 1 / (1 + np.exp(-np.clip(b + w1 * x[:, 0] + w2 * x[:, 1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights of a logistic fit; a weight below zero is left out, as more hints never speak for harmlessness."""
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack((np.ones(len(x)), x[:, used]))
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            out = np.zeros(1 + x.shape[1])
            out[0], out[1:][used] = w[0], w[1:]
            return out
        used[np.flatnonzero(used)[np.argmin(w[1:])]] = False


def telling_features(
    holders: np.ndarray, documents: np.ndarray, false_share: float = 0.1, rarest: float = 0.001,
) -> tuple[np.ndarray, np.ndarray]:
    """(speak for toxicity, tell anything at all) from ``holders[class, feature]`` among ``documents[class]`` texts.

    If a feature were as frequent in both classes, its toxic holders would be a
    draw from all its holders; the divergence of what is seen from what is drawn,
    times the holders, bounds the logarithm of that chance. Features with too few
    holders to reach a chance of ``rarest`` whatever their classes are not
    tested. Of the others those are taken whose share of false ones is bounded by
    ``false_share`` (step-up over the sorted chances), so the demand rises with
    the number of features, and how many texts of a class have been seen decides
    what a count is worth.
    """
    n = np.maximum(1, documents).astype(float)
    total = holders.sum(axis=0)
    share = n[1] / n.sum()
    expected = np.stack((total * (1 - share), total * share))
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(holders > 0, holders * np.log(holders / expected), 0.0).sum(axis=0)
    able = total * -math.log(min(share, 1 - share)) >= -math.log(rarest)
    order = np.argsort(-np.where(able, evidence, -1.0), kind="stable")
    tested = max(1, int(able.sum()))
    passes = evidence[order] >= np.log(tested / (false_share * np.arange(1, len(order) + 1)))
    last = int(np.flatnonzero(passes & able[order])[-1]) + 1 if (passes & able[order]).any() else 0
    tells = np.zeros(len(total), bool)
    tells[order[:last]] = True
    ratio = np.log((holders[1] + 0.1) / (n[1] + 0.2)) - np.log((holders[0] + 0.1) / (n[0] + 0.2))
    return tells & (ratio > _LOG_RATIO), tells


class _Coded:
    """Texts as word numbers, and the features of the words."""

    def __init__(self, texts: Sequence[str]):
        vocabulary: dict[str, int] = {}
        coded = []
        for text in texts:  # numbers at once: the words of all texts together would not fit a small driver
            words = _TOKEN.findall((text or "").lower())
            coded.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        self.lengths = np.asarray([len(c) for c in coded], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int32), *coded])
        del coded
        self.vocabulary = list(vocabulary)
        self.words = len(vocabulary)
        # features by 64-bit hash: their names would take more room than all the rest
        hashes, sizes = array("q"), array("q")
        for word in self.vocabulary:
            found = token_features(word)
            hashes.extend(map(hash, found))
            sizes.append(len(found))
        self.rows = np.repeat(np.arange(self.words, dtype=np.int32), np.asarray(sizes, np.int64))
        self.hashes, columns = np.unique(np.asarray(hashes, np.int64), return_inverse=True)
        self.columns = columns.astype(np.int32)

    def names(self, used: np.ndarray) -> list[str]:
        """The features that ``used`` marks, in their order."""
        place = {h: i for i, h in enumerate(self.hashes[used].tolist())}
        out = [""] * len(place)
        for word in self.vocabulary:
            for f in token_features(word):
                if (i := place.get(hash(f))) is not None:
                    out[i] = f
        return out

    def holders(self, labels: np.ndarray) -> np.ndarray:
        """How many texts of each class hold a feature."""
        seen = np.zeros((2, len(self.hashes)))
        first = np.concatenate(([0], np.cumsum(np.bincount(self.rows, minlength=self.words))))
        ends = np.cumsum(self.lengths)
        for end, n, label in zip(ends, self.lengths, labels, strict=True):
            words = np.unique(self.ids[end - n:end])
            sizes = first[words + 1] - first[words]
            at = np.repeat(first[words], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            seen[label, np.unique(self.columns[at])] += 1
        return seen


def _fit_field(texts: Sequence[str], labels: np.ndarray, rounds: int) -> SpanTagger:
    """Weights and transitions of the field, from token labels that the texts' own labels suggest."""
    coded = _Coded(texts)
    ids, lengths, rows, columns, words = coded.ids, coded.lengths, coded.rows, coded.columns, coded.words
    strong, useful = telling_features(coded.holders(labels), np.bincount(labels, minlength=2))
    names = coded.names(useful)
    del coded
    renumber = np.full(len(useful), -1)
    renumber[useful] = np.arange(useful.sum())
    word_strong = np.zeros(words, bool)
    word_strong[rows[strong[columns]]] = True
    keep = useful[columns]
    rows, columns = rows[keep], renumber[columns[keep]]

    place, starts, active, _ = _layout(lengths)
    laid_label = np.empty(len(ids), np.float32)
    laid_label[place] = word_strong[ids] & np.repeat(labels == 1, lengths)
    laid_ids = np.empty_like(ids)
    laid_ids[place] = ids
    del ids, place
    w, bias, trans = np.zeros(len(names)), -4.0, np.zeros(4)
    rates = [np.zeros_like(w), 0.0, np.zeros(4)]
    for _ in range(rounds):
        per_word = bias + np.bincount(rows, w[columns], words)
        laid = np.exp(np.clip(per_word, -40, 40)).astype(np.float32)[laid_ids]
        t00, t01, t10, t11 = t = np.exp(trans)
        forward, backward = _ratios(laid, starts, active, t)
        slope_t = np.zeros(4)
        for s in range(1, len(active)):
            m = active[s]
            a, b = slice(starts[s - 1], starts[s - 1] + m), slice(starts[s], starts[s] + m)
            x, r = laid[b] * backward[b], forward[a]
            parts = np.stack((np.full(m, t00), t01 * x, r * t10, r * t11 * x))
            y0, y1 = laid_label[a], laid_label[b]
            told = np.stack(((1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1))
            slope_t += (told - parts / parts.sum(axis=0)).sum(axis=1)
        forward *= backward  # odds of the toxic state
        error = np.subtract(laid_label, forward / (1 + forward), out=backward)
        slope_w = np.bincount(columns, np.bincount(laid_ids, error, words)[rows], len(w)) - 0.05 * w
        slope_b = error.sum(dtype=np.float64)
        rates[0] += slope_w**2
        rates[1] += slope_b**2
        rates[2] += slope_t**2
        w += 0.8 * slope_w / np.sqrt(rates[0] + 1e-8)
        bias += 0.3 * slope_b / math.sqrt(rates[1] + 1e-8)
        trans += 0.1 * slope_t / np.sqrt(rates[2] + 1e-8)
    return SpanTagger(dict(zip(names, w.tolist(), strict=True)), float(bias), trans, (0.0, 0.0, 0.0))


def fit_tagger(
    texts: Sequence[str], toxic: Sequence[int], rounds: int = 40, labelled: Sequence[int] | None = None, fold: int = 4,
    least_apart: int = 50,
) -> SpanTagger:
    """Train on labelled documents.

    A document's label says little about its single words, so tokens are
    labelled first: a feature speaks for toxicity when toxic documents hold it
    more often than chance allows (``telling_features``), and a token of a toxic
    document is toxic when one of its features does. The field then learns from
    these token labels, by gradient steps on its likelihood, what a single
    feature cannot say: sums of features and neighbours.

    The map from marginals to a score is fitted on every ``fold``-th text of each
    class, which the field has not seen: there a word that only chance made
    telling tells nothing. Where that leaves fewer than ``least_apart`` texts of a
    class to judge by, all texts serve both ends. ``labelled`` counts the texts of each class that the
    sample stands for; its classes weigh as they do there, so that scores do not
    depend on how many of each were taken.
    """
    labels = np.asarray(toxic, np.int64)
    number = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        number[labels == label] = np.arange((labels == label).sum())
    apart = number % fold == fold - 1
    if min(np.bincount(labels[apart], minlength=2)) < least_apart:
        apart[:] = False
    learn = np.flatnonzero(~apart)
    tagger = _fit_field([texts[i] for i in learn], labels[learn], rounds)
    judge = np.flatnonzero(apart) if apart.any() else learn
    told = [tagger.summary(*tagger.tag([texts[i] for i in judge[at:at + 100]])) for at in range(0, len(judge), 100)]
    taken = np.maximum(1, np.bincount(labels[judge], minlength=2))
    stands_for = np.asarray(labelled if labelled else np.bincount(labels, minlength=2), float)
    weight = stands_for / stands_for.sum() * taken.sum() / taken
    tagger.score_weights = tuple(_logistic(np.concatenate(told), labels[judge].astype(float), weight[labels[judge]]).tolist())
    tagger.known = {}
    return tagger


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """Labels to learn from: ``doc_id, toxic``, each once."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def labelled_counts(documents: DataFrame, labels: DataFrame) -> list[int]:
    """How many labels of each class the sample stands for: those to learn from whose document is there."""
    there = _known(labels).join(documents.select("doc_id"), "doc_id", "left_semi")
    found = {r["toxic"]: r["count"] for r in there.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    return [found.get(label, 0) for label in (0, 1)]


def _fill(candidates: DataFrame, per_class: int, max_chars: int) -> list:
    """Of ``candidates`` those in the sample: per class in order, each one that still fits, over all of them.

    A class has half of the characters and what the other leaves of its half. A
    query asks only for texts that fit what is left, so what one query passes
    over can never fit later; the driver holds at most ``2 * per_class`` of its rows.
    """
    order = [F.col("chars") > max_chars // 20, *[c for c in candidates.columns if c not in ("toxic", "chars")]]

    def fill(label: int, room: int) -> dict:
        own: dict = {}
        while len(own) < per_class:
            fits = candidates.where((F.col("toxic") == label) & (F.col("chars") <= room))
            more = [r for r in fits.orderBy(*order).limit(per_class + len(own)).collect() if r not in own]
            for r in more:
                if len(own) < per_class and r["chars"] <= room:
                    own[r] = r["chars"]
                    room -= r["chars"]
            if not more:
                break
        return own

    taken = [fill(label, max_chars // 2) for label in (0, 1)]
    for label in (0, 1):
        taken[label] = fill(label, max_chars - sum(taken[1 - label].values()))
    return [r for own in taken for r in own]


def training_rows(
    documents: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000_000,
) -> list:
    """At most ``per_class`` labelled texts of each class, of at most ``max_chars`` characters together, none held out.

    Rows are chosen by a hash of the id, evenly over the corpus, and whole. Only
    labels whose document is there take a place. A text that does not fit what
    is left of the bound is passed over and later ones follow; texts of over a
    twentieth of the bound come last, so that a few of them do not use it up.
    A class thus stays below ``per_class`` only when it has no further text
    that fits. Equal texts of one id are one row; of its different texts the
    second and later ones come after the first ones of all ids, ``per_class`` of
    an id at most. Rows without id or label are passed over.
    """
    known = _known(labels).withColumn("pick", F.xxhash64(F.lit(3), "doc_id"))
    key = ["doc_id", "mark", "chars"]
    texts = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", fingerprint(whole()).alias("mark"), F.char_length(whole()).alias("chars"), whole().alias("text"))
    own = Window.partitionBy("doc_id").orderBy("mark", "chars")
    labelled = texts.select(key).where(F.col("chars") <= max_chars).join(known.select("doc_id"), "doc_id", "left_semi")
    numbered = labelled.distinct().withColumn(
        "number", F.row_number().over(own)).where(F.col("number") <= per_class)
    candidates = stored(numbered.join(known, "doc_id").select(
        "number", "pick", "doc_id", "mark", "toxic", "chars"), "training-candidates")
    chosen = documents.sparkSession.createDataFrame(_fill(candidates, per_class, max_chars), candidates.schema)
    rows = texts.join(F.broadcast(chosen), key).groupBy(*key, "toxic").agg(F.min("text").alias("text"))
    ordered = rows.orderBy("doc_id", "toxic", "mark").select("doc_id", "text", "toxic")
    return list(ordered.toLocalIterator())  # part by part: all parts at once would stand in the driver's buffers together


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score_documents(
    documents: DataFrame, tagger: SpanTagger, keep: Sequence[str] = ("doc_id",), threshold: float = 0.3,
    span_p: float = 0.5, prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` with ``score, predicted, spans`` of every whole text; spans are offsets of likely toxic tokens.

    A null or empty text has no tokens and gets the score of a text without
    hints. Each row is scored alone, repeated rows alike. The three names carry
    ``prefix``; a kept column that still has one of them gives way to it.
    """
    made = [prefix + c for c in ("score", "predicted", "spans")]
    keep = [c for c in keep if c not in made]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch, texts in text_batches(batches, "__text", 2_000_000):
            p, lengths = tagger.tag(texts)
            score = tagger.score(p, lengths)
            ends = np.cumsum(lengths)
            spans: list[list] = [[] for _ in texts]
            hits = np.flatnonzero(p >= span_p)
            for i in np.unique(np.searchsorted(ends, hits, side="right")):
                own = p[ends[i] - lengths[i]:ends[i]]
                # offsets are those of the lower-cased text; where that changes lengths, of its characters one by one
                text = texts[i].lower()
                if len(text) != len(texts[i]):
                    text = "".join(c.lower() if len(c.lower()) == 1 else c for c in texts[i])
                for m, q in zip(_TOKEN.finditer(text), own, strict=False):
                    if q >= span_p:
                        spans[i].append({"start": m.start(), "end": m.end(), "p": float(q)})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(score),
                 pa.array((score >= threshold).astype(np.int32)), pa.array(spans, _SPANS)],
                [*keep, *made])
    rows = documents.select(*keep, F.col("text").alias("__text"))
    schema = T.StructType([*documents.select(*keep).schema.fields,
        T.StructField(made[0], T.DoubleType()), T.StructField(made[1], T.IntegerType()),
        T.StructField(made[2], T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
            T.StructField("p", T.DoubleType())])))])
    return rows.mapInArrow(work, schema)


def tagger_for(documents: DataFrame, labels: DataFrame) -> SpanTagger:
    """A tagger fitted to the labelled sample.

    Labels of one class only, or none, and empty documents give a tagger that
    scores every text as harmless. Labels of both classes of which the sample
    has but one are an error: nothing would be rejected.
    """
    rows = training_rows(documents, labels)
    sizes = Counter(r["toxic"] for r in rows)
    if len(sizes) == 2:
        counts = labelled_counts(documents, labels)
        return fit_tagger([r["text"] for r in rows], [r["toxic"] for r in rows], labelled=counts)
    toxic = F.col("toxic").cast("int")
    if labels.where(F.col("doc_id").isNotNull() & toxic.isin(0, 1)).select(toxic).distinct().count() == 2 \
            and not documents.isEmpty():
        raise ValueError(f"labels hold both classes, but the texts to learn from do not: {sizes[0]} harmless, {sizes[1]} toxic")
    return SpanTagger({}, -12.0, [0.0] * 4, (-12.0, 0.0, 0.0))

"""Personal data spans: fixed patterns, and a classifier trained without labels on the votes of weak labelers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.llm.common import fingerprint, whole

KINDS = ("email", "ip", "card", "phone", "secret")

# The contract's patterns. Look-behinds and possessive loops only
# spare starts inside a run that already failed; \G lets a match begin where the
# last one of its kind ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider forms that only the votes can settle.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+(.\x20-])[\x20]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.])",
    "secret": r"(?i)(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\x22']?[a-z0-9_+/-]{12,}+[\x22']?|AKIA[0-9A-Z]{16}",
}
# A quick test that most texts fail.
HINT = {"email": "@", "phone": "+"}

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUES = {
    "email": r"(?i)mail|contact|write|reply|@", "ip": r"(?i)\bip\b|host|server|address|addr",
    "card": r"(?i)card|visa|master|amex|pay", "phone": r"(?i)phone|tel|call|fax|mobile|cell",
    "secret": r"(?i)login|secret|token|pass|key",
}
_KNOWN = {  # gazetteers: top-level domains, issuers, calling codes, credential names
    "email": r"(?i)(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|jp)$",
    "ip": r"^(?!0)(?!255)(?!127\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:password|token|akia|api|secret)",
}
_SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){4}[0-9]{0,3}$", "phone": r"^\+[0-9]{1,3}[\x20-]?\(?[0-9]{2,4}\)?[\x20-]?[0-9]",
    "secret": r"(?i)[a-z0-9_+/-]{16,}",
}
LABELERS = ("shape", "checksum", "gazetteer", "context", "edges")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    return F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("i")),
        lambda acc, d: F.struct(
            (acc["total"] + F.when(acc["i"] % 2 == 0, d.cast("int")).otherwise(
                (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))).alias("total"),
            (acc["i"] + 1).alias("i")),
        lambda acc: acc["total"] % 10 == 0)


def _valid(kind: str) -> Column:
    """The contract's test of a base match."""
    hit = F.col("hit")
    n = F.char_length(_digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(hit))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _matches(documents: DataFrame, kind: str, pattern: str, base: bool) -> DataFrame:
    """Every match with its code point offsets, from the pieces between matches.

    Lengths are summed over the matches of one row by a window, so a text with
    very many matches costs no more than its matches.
    """
    able = F.col("text").contains(HINT[kind]) if base and kind in HINT else F.col("text").rlike(pattern)
    pieces = documents.where(able).withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "print", "row",
        F.posexplode(F.arrays_zip(
            F.split("text", pattern, -1).alias("gap"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))).alias("i", "z")
    ).select("doc_id", "print", "row", "i", F.char_length("z.gap").alias("gap"),
             F.right("z.gap", F.lit(24)).alias("left"), F.left("z.gap", F.lit(1)).alias("head"), "z.hit")
    order = Window.partitionBy("doc_id", "print", "row").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(
        F.sum(F.char_length("hit")).over(before), F.lit(0))
    placed = pieces.withColumn("start", start).withColumn("right", F.lead("head").over(order)).where(
        F.col("hit").isNotNull())
    return placed.select(
        "doc_id", "print", F.lit(KINDS.index(kind)).alias("kind"), "start",
        (F.col("start") + F.char_length("hit")).alias("end"), "hit", "left", "right",
        (_valid(kind) if base else F.lit(False)).alias("base"))


def candidates(documents: DataFrame) -> DataFrame:
    """Base spans, failed base matches and loose matches of every text, each with five votes.

    A vote is 1 for personal data, 0 against, 2 for no opinion.
    """
    texts = documents.select("doc_id", fingerprint(F.col("text")).alias("print"), whole().alias("text"))
    parts = [_matches(texts, k, p, True) for k, p in BASE.items()]
    parts += [_matches(texts, k, p, False) for k, p in LOOSE.items()]
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)

    def by_kind(rules: dict[str, str], of: Column, against: int) -> Column:
        chosen = F.lit(None).cast("boolean")
        for kind, rule in rules.items():
            chosen = F.when(F.col("kind") == KINDS.index(kind), of.rlike(rule)).otherwise(chosen)
        return F.when(chosen, 1).otherwise(against)

    hit, digits = F.col("hit"), _digits(F.col("hit"))
    n = F.char_length(digits)
    checks = {
        "ip": hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "card": n.between(13, 19) & luhn(digits),
        "phone": n.between(8, 15), "secret": hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
    }
    checksum = F.lit(2)
    for kind, passes in checks.items():
        checksum = F.when(F.col("kind") == KINDS.index(kind), F.when(passes, 1).otherwise(0)).otherwise(checksum)
    inside = F.col("left").rlike(r"[A-Za-z0-9]$") | F.col("right").rlike(r"^[A-Za-z0-9]")
    return spans.select(
        "doc_id", "print", "kind", "start", "end", "base",
        by_kind(_SHAPES, hit, 0).alias("shape"), checksum.alias("checksum"),
        by_kind(_KNOWN, hit, 0).alias("gazetteer"), by_kind(_CUES, F.col("left"), 2).alias("context"),
        F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(2).alias("edges"))


def estimate_reliabilities(patterns: Sequence[tuple], rounds: int = 50) -> tuple[list, dict]:
    """Expectation-maximisation over vote patterns ``(kind, votes, count)``.

    Returns each pattern's posterior of being personal data and, per labeler,
    its vote probabilities for both classes. The first posteriors are the share
    of votes in favour. There are at most ``5 * 3**5`` patterns at any size.
    """
    post = []
    for _, votes, _ in patterns:
        said = [v for v in votes if v != 2]
        post.append((sum(said) + 0.5) / (len(said) + 1))
    rates: dict = {}
    for _ in range(rounds):
        total, prior = {}, {}
        rates = {}
        for (kind, votes, count), p in zip(patterns, post, strict=True):
            prior.setdefault(kind, [1.0, 1.0])
            for label, share in ((1, p), (0, 1 - p)):
                prior[kind][label] += share * count
                for j, v in enumerate(votes):
                    key = (j, label)
                    # a labeler is believed to be right rather than wrong until data say otherwise
                    rates.setdefault(key, [4.0 if v0 == label else 2.0 if v0 == 2 else 1.0 for v0 in (0, 1, 2)])
                    rates[key][v] += share * count
        for key, counts in rates.items():
            total[key] = sum(counts)
        post = []
        for kind, votes, _ in patterns:
            logs = []
            for label in (0, 1):
                logs.append(math.log(prior[kind][label] / sum(prior[kind])) + sum(
                    math.log(rates[j, label][v] / total[j, label]) for j, v in enumerate(votes)))
            post.append(1 / (1 + math.exp(min(50.0, logs[0] - logs[1]))))
    return post, {k: [c / sum(v) for c in v] for k, v in rates.items()}


def train_span_classifier(patterns: Sequence[tuple], post: Sequence[float], steps: int = 400) -> dict:
    """Logistic weights over (labeler, vote) and kind, fitted to the posteriors and weighted by log count."""
    weights: dict = {}
    scale = [math.log1p(count) for _, _, count in patterns]
    whole_scale = sum(scale) or 1.0
    for _ in range(steps):
        slope: dict = {}
        for (kind, votes, _), target, s in zip(patterns, post, scale, strict=True):
            features = [("kind", kind), *enumerate(votes)]
            z = sum(weights.get(f, 0.0) for f in features)
            error = s * (target - 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            for f in features:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = 0.999 * weights.get(f, 0.0) + 2.0 * g / whole_scale
    return weights


def _score(weights: dict) -> Column:
    z = F.lit(0.0)
    for (name, value), w in sorted(weights.items(), key=str):
        column = "kind" if name == "kind" else LABELERS[name]
        z = z + F.when(F.col(column) == value, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_personal_data(documents: DataFrame, spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Kept spans, ``doc_id, print, kind, start, end, base``, of the candidates ``spans``.

    Base spans stay whatever the classifier says. Another candidate stays when
    its score reaches the threshold and it meets no base span of its document.
    Only the counts of vote patterns come to the driver.
    """
    counted = spans.groupBy("kind", *LABELERS).count().collect()
    patterns = sorted((r["kind"], tuple(r[c] for c in LABELERS), r["count"]) for r in counted)
    post, _ = estimate_reliabilities(patterns)
    scored = spans.withColumn("score", _score(train_span_classifier(patterns, post)))
    line = Window.partitionBy("doc_id", "print").orderBy("start", "end", "kind")
    base_end = F.when(F.col("base"), F.col("end"))
    base_start = F.when(F.col("base"), F.col("start"))
    before = F.max(base_end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(line.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (
        after.isNull() | (after >= F.col("end")))
    return scored.withColumn("free", free).where(
        F.col("base") | (F.col("free") & (F.col("score") >= threshold))
    ).select("doc_id", "print", "kind", "start", "end", "base").distinct()


def personal_data(documents: DataFrame, threshold: float = 0.5, label: str = "spans") -> DataFrame:
    """One row per document: base counts, digest of the base spans, and all spans as text.

    A null text is empty. Rows that repeat a doc_id are told apart by their
    text; a null doc_id is matched like any other. An empty table gives no rows.
    """
    from fitgrid.llm.common import stored

    kept = find_personal_data(documents, stored(candidates(documents), label), threshold)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    text = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct("kind", "start", "end", text.alias("text"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["text"]), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    per_document = kept.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(
        *counts, F.collect_list(F.when(F.col("base"), entry)).alias("base_spans"),
        F.collect_list(entry).alias("all_spans")).select(
        "d", "p", *[f"n_{k}" for k in KINDS[:4]], joined(F.col("base_spans")).alias("base_text"),
        joined(F.col("all_spans")).alias("spans"))
    rows = documents.select("doc_id", fingerprint(F.col("text")).alias("print"))
    return rows.join(
        per_document, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left"
    ).select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.coalesce("base_text", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))

"""From fragments to facts, axis decisions and assembled evaluations.

Inputs are long tables of (document_id, position, section, text) or values read
from them. Reductions keep one row per (document, kind) and combine before the
shuffle, so one very long document does not gather in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.functions import text as T
from fitgrid.operators.keyed import moved, top_per_key
from fitgrid.schemas import axis_array
from fitgrid.session import checkpointed

Registry = Mapping[str, Callable[[Column], Column]]


def registered(registry: Registry, name: str, parse: Callable[[Column], Column]) -> dict:
    """The registry with one more parser; a name is taken once."""
    if name in registry:
        raise ValueError(f"fact {name} already has a parser")
    return {**registry, name: parse}


def fact_values(fragments: DataFrame, registry: Registry) -> DataFrame:
    """One row per value stated in a fragment; all kinds are read in a single pass."""
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), parse(F.col("text")).alias("values"))
        for kind, parse in registry.items()])
    return (
        fragments.select("document_id", "position", "text", F.inline(kinds))
        .select("document_id", "position", "kind", "text", F.explode("values").alias("value"))
    )


def reduce_facts(values: DataFrame) -> DataFrame:
    """Known when one distinct value is stated, conflicting when several are.

    The smallest and largest value decide that without keeping the set.
    """
    first = F.min_by(F.struct("value", "text"), "position")
    return values.groupBy("document_id", "kind").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), first.alias("first"),
        F.count("*").alias("mentions"),
    ).select(
        "document_id", "kind",
        F.when(F.col("low") == F.col("high"), "known").otherwise("conflicting").alias("status"),
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"),
        F.when(F.col("low") == F.col("high"), T.excerpt(F.col("first.text"))).alias("excerpt"),
        "mentions")


def facts_of(fragments: DataFrame, kinds: list[str], registry: Registry = T.FACTS) -> DataFrame:
    """Every document × asked kind, unknown where nothing is stated."""
    chosen = {k: registry[k] for k in kinds}
    known = reduce_facts(fact_values(fragments, chosen))
    every = fragments.select("document_id").distinct().select(
        "document_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return every.join(moved(known), ["document_id", "kind"], "left").withColumn(
        "status", F.coalesce("status", F.lit("unknown"))).fillna(0, ["mentions"])


def rule_axis_rows(fragments: DataFrame) -> DataFrame:
    """(document, axis, anchor, position) for wording that decides an axis by itself."""
    axes = F.array(
        F.struct(F.lit("work_location").alias("axis_key"), T.work_location_anchors(F.col("text")).alias("a")),
        F.struct(F.lit("schedule_flexibility").alias("axis_key"), T.schedule_values(F.col("text")).alias("a")))
    return (
        fragments.select("document_id", "position", F.inline(axes))
        .select("document_id", "axis_key", "position", F.explode(F.col("a").cast("array<int>")).alias("anchor"))
        .distinct()
    )


def rule_axis_decisions(rows: DataFrame) -> DataFrame:
    same = F.min("anchor") == F.max("anchor")
    return rows.groupBy("document_id", "axis_key").agg(
        F.when(same, "known").otherwise("conflicting").alias("status"),
        F.when(same, F.min("anchor")).alias("anchor_value"),
        F.count_distinct("position").alias("evidence_fragments"),
        F.min("position").alias("first_position"))


def technology_mentions(fragments: DataFrame) -> DataFrame:
    """Documents per technology."""
    return (
        fragments.select("document_id", F.explode(T.technology_values(F.col("text"))).alias("technology"))
        .groupBy("technology").agg(F.count_distinct("document_id").alias("documents"))
    )


# Heading words of the quoted sections, tried in this order.
SECTION_HEADINGS = {
    "workStyle": r"働き方|勤務形態|勤務時間|就業時間|リモート|出社|在宅|work\s*style|working hours|remote",
    "requirements": (
        r"求める|必須(?:スキル|条件|要件|経験)?|応募資格|応募条件|歓迎|望ましい|尚可|人物像|requirement|"
        r"qualification|must have|nice to have|preferred|what we(?:'re| are) looking for"),
    "duties": (
        r"業務内容|仕事内容|職務内容|業務詳細|担当業務|お任せ|ミッション|役割|具体的な業務|responsibilit|"
        r"what you(?:'ll| will) do|job description|about the (?:role|job)|the role"),
}


def section_quotes(fragments: DataFrame) -> DataFrame:
    """Fragments filed under the section their heading names; text is redacted."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(SECTION_HEADINGS.items()):
        kind = F.when(F.col("section").rlike(f"(?iu){pattern}"), name).otherwise(kind)
    return (
        fragments.withColumn("kind", kind)
        .where(F.col("kind").isNotNull() & (F.trim("text") != F.trim("section")))
        .select("document_id", "kind", "position", T.redact(F.col("section")).alias("section"),
                T.redact(F.col("text")).alias("text"))
    )


def prefer_structured(text_facts: DataFrame, structured: DataFrame) -> DataFrame:
    """Structured value when the text agrees or is silent; conflicting when it differs."""
    s = structured.select("document_id", "kind", F.col("value").alias("declared"))
    declared, stated = F.col("declared"), F.col("value")
    differs = (F.col("status") == "known") & (stated != declared)
    return text_facts.join(s, ["document_id", "kind"], "left").select(
        "document_id", "kind",
        F.when(declared.isNull(), F.col("status")).when(differs, "conflicting").otherwise("known")
        .alias("status"),
        F.when(declared.isNull(), stated).when(~differs, declared).alias("value"))


def merge_locations(structured: DataFrame, text_facts: DataFrame) -> DataFrame:
    """Structured places first, then the text's; an unknown side changes nothing."""
    joined = structured.select("document_id", F.col("places").alias("a")).join(
        text_facts.select("document_id", F.col("places").alias("b")), "document_id", "full")
    none = F.array().cast("array<string>")
    return joined.select("document_id", F.array_distinct(
        F.concat(F.coalesce("a", none), F.coalesce("b", none))).alias("places"))


# Field fallback ------------------------------------------------------------------------------

def section_groups(fragments: DataFrame) -> DataFrame:
    """Runs of consecutive fragments under one section, joined to one text.

    A fragment of another section, or of none, ends a run.
    """
    over = Window.partitionBy("document_id").orderBy("position")
    starts = F.when(F.lag("section").over(over).eqNullSafe(F.col("section")), 0).otherwise(1)
    runs = fragments.withColumn("starts", starts).withColumn("run", F.sum("starts").over(over)).drop("starts")
    named = runs.where("section is not null and section <> ''")
    return _joined(named, "document_id", "section", "run").where("pieces > 1")


def _joined(fragments: DataFrame, *keys: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return fragments.groupBy(*keys).agg(
        F.min("position").alias("position"), F.count("*").alias("pieces"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text"))


def field_with_fallback(fragments: DataFrame, kind: str, parse: Callable[[Column], Column]) -> DataFrame:
    """Read a field from single fragments, else from section groups, else from the whole text.

    Each pass only sees documents the pass before left open, so whole texts are
    put together for the few documents that need them.
    """
    def read(texts: DataFrame) -> DataFrame:
        return reduce_facts(fact_values(texts, {kind: parse}))
    # Facts are one short row per document and are read twice below, texts are not read again for them.
    single = checkpointed(read(fragments))
    open_1 = fragments.join(single.select("document_id"), "document_id", "left_anti")
    grouped = checkpointed(read(section_groups(open_1)))
    open_2 = open_1.join(grouped.select("document_id"), "document_id", "left_anti")
    whole = read(_joined(open_2, "document_id"))
    return (
        single.withColumn("read_from", F.lit("fragment"))
        .unionByName(grouped.withColumn("read_from", F.lit("section")))
        .unionByName(shortest_runs(whole, open_2, parse).withColumn("read_from", F.lit("whole")))
        .select("document_id", "kind", "status", "value", "excerpt", "read_from")
    )


def shortest_runs(facts: DataFrame, fragments: DataFrame, parse: Callable[[Column], Column]) -> DataFrame:
    """Replace the excerpt of a whole-text fact by the shortest run of fragments stating the value."""
    pieces = fragments.groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"])
        .alias("pieces"))
    spans = F.sequence(F.lit(1), F.size("pieces"))
    runs = (
        facts.where("status = 'known'").join(pieces, "document_id")
        .select("document_id", "value", "pieces", F.explode(spans).alias("n"))
        .select("document_id", "value", "pieces", "n",
                F.explode(F.sequence(F.lit(1), F.size("pieces") - F.col("n") + 1)).alias("start"))
        .select("document_id", "value", "n", "start",
                F.array_join(F.slice("pieces", F.col("start"), F.col("n")), " ").alias("run"))
        .where(F.array_contains(parse(F.col("run")), F.col("value")))
        .groupBy("document_id").agg(F.min_by("run", F.struct("n", "start")).alias("run"))
    )
    return facts.join(runs, "document_id", "left").withColumn(
        "excerpt", F.coalesce(T.excerpt(F.col("run")), F.col("excerpt"))).drop("run")


# Model judgements ----------------------------------------------------------------------------

# What a judgement must reach.
MIN_CONFIDENCE = MIN_GROUNDING = 0.8
MIN_EVIDENCE_SHARE = 0.1
MIN_RANGE_SHARE = 0.15

# Wording that cannot support an axis.
_BOILERPLATE = (
    r"(?iu)range of change in (?:job description|work location)|work as determined by the company|"
    r"変更の範囲|業務内容.{0,12}変更|就業場所.{0,12}変更|会社(?:の|が)定める(?:業務|場所)")
_SCHEDULE_ONLY = (
    r"(?iu)working hours?|working hour system|flextime|flex[- ]?time|core time|discretionary labor|"
    r"勤務時間|フレックス|コアタイム|裁量労働")
_OWN_DECISIONS = (
    r"(?iu)planning|design|architecture|technical decisions?|decision[- ]making|requirements?|"
    r"priorit(?:y|ies)|roadmap|implementation approach|設計|要件|技術選定|優先順位|方針|進め方|意思決定")


def eligible_evidence(evidence: DataFrame) -> DataFrame:
    text = F.col("text")
    schedule = (F.col("axis_key") == "autonomy") & text.rlike(_SCHEDULE_ONLY) & ~text.rlike(_OWN_DECISIONS)
    return evidence.where(~text.rlike(_BOILERPLATE) & ~schedule)


def evidence_top_k(evidence: DataFrame, k: int) -> DataFrame:
    """Strongest fragments per (document, axis) with a share worth citing."""
    return top_per_key(
        evidence.where(F.col("probability") >= MIN_EVIDENCE_SHARE), ["document_id", "axis_key"],
        [F.col("probability").desc(), F.col("position").asc()], k, rank="evidence_rank")


def axis_judgements(choices: DataFrame, evidence: DataFrame) -> DataFrame:
    """Model probabilities → known, range, conflicting or unknown per (document, axis).

    ``choices`` is long: (document_id, axis_key, choice, probability, confidence).
    """
    def share(choice: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("choice") == choice, F.col("probability"))), F.lit(0.0))
    best = F.max_by(F.struct("choice", "probability", "confidence"),
                    F.struct("probability", F.length("choice") * -1, "choice"))
    judged = choices.groupBy("document_id", "axis_key").agg(
        share("0").alias("p0"), share("50").alias("p50"), share("100").alias("p100"), best.alias("best"))
    support = eligible_evidence(evidence).groupBy("document_id", "axis_key").agg(
        F.round(F.sum("probability"), 9).alias("grounding"),
        F.count_if(F.col("probability") >= MIN_EVIDENCE_SHARE).alias("citable"))
    rows = judged.join(moved(support), ["document_id", "axis_key"], "left")
    certainty = F.least(F.col("best.probability"), F.col("best.confidence"))
    grounded = F.coalesce((F.col("grounding") >= MIN_GROUNDING) & (F.col("citable") > 0), F.lit(False))
    sure = (F.col("best.choice") != "none") & (certainty >= MIN_CONFIDENCE)
    def pair(low: str, high: str) -> Column:
        a, b = F.col(low), F.col(high)
        return (a >= MIN_RANGE_SHARE) & (b >= MIN_RANGE_SHARE) & (a + b >= MIN_CONFIDENCE)
    first, second = pair("p0", "p50"), pair("p50", "p100")
    status = (F.when(~grounded, "unknown")
              .when(sure & (F.col("best.choice") == "conflicting"), "conflicting").when(sure, "known")
              .when(first | second, "range").otherwise("unknown"))
    known = F.col("status") == "known"
    ranged = F.col("status") == "range"
    return rows.withColumn("status", status).select(
        "document_id", "axis_key", "status",
        F.when(known, F.expr("try_cast(best.choice as int)")).when(ranged, F.when(first, 0).otherwise(50)).alias("anchor_value"),
        F.when(ranged, F.when(first, 50).otherwise(100)).alias("anchor_max"))


def left_open(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions (document_id, axis_key, ...) on axes no rule decided: only those go to the model."""
    return asked.join(moved(rules.select("document_id", "axis_key")), ["document_id", "axis_key"], "left_anti")


def located_facts(
    facts: DataFrame, located: DataFrame, fragments: DataFrame
) -> DataFrame:
    """Fill unknown facts from fragments named for them; known facts are left alone."""
    text, kind = F.col("text"), F.col("kind")
    named = located.join(facts.where("status = 'unknown'").select("document_id", "kind"),
                         ["document_id", "kind"], "left_semi")
    values = (F.when(kind == "salary", T.located_salary_values(F.col("section"), text))
              .when(kind == "employmentType", T.located_employment_values(text))
              .when(kind == "location", T.prefectures_in(text))
              .otherwise(F.array().cast("array<string>")))
    read = named.join(fragments, ["document_id", "position"]).select(
        "document_id", "position", "kind", "text", F.explode(values).alias("value"))
    places = read.where(kind == "location").groupBy("document_id", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("value")), "、").alias("value")
    ).withColumn("status", F.lit("known"))
    found = reduce_facts(read.where(kind != "location")).select("document_id", "kind", "value", "status") \
        .unionByName(places.select("document_id", "kind", "value", "status"))
    extra = found.select("document_id", "kind", F.col("value").alias("v"), F.col("status").alias("s"))
    return facts.join(extra, ["document_id", "kind"], "left").select(
        "document_id", "kind", F.coalesce("s", "status").alias("status"),
        F.coalesce("value", "v").alias("value"),
        F.when(F.col("s").isNotNull(), "located").otherwise("read").alias("method"))


def assemble_evaluations(documents: DataFrame, rules: DataFrame, model: DataFrame) -> DataFrame:
    """Eight axis rows per document: rules first, then the model, else unknown.

    ``documents``: (document_id, called). The model is called once for a document
    and answers for every axis the rules left open: one it gives no decision for
    is its unknown. Without a call such axes are unknown by default.
    """
    r = rules.select("document_id", "axis_key", F.struct("status", "anchor_value").alias("rule"))
    m = model.select("document_id", "axis_key", F.struct("status", "anchor_value", "anchor_max").alias("model"))
    every = documents.select("document_id", "called", F.inline(axis_array()))
    by_rule, by_model = F.col("rule").isNotNull(), F.col("rule").isNull() & F.col("called")
    return (
        every.join(moved(r), ["document_id", "axis_key"], "left")
        .join(moved(m), ["document_id", "axis_key"], "left")
        .select(
            "document_id", "axis_idx", "axis_key",
            F.coalesce("rule.status", F.when(by_model, F.col("model.status")), F.lit("unknown")).alias("status"),
            F.when(by_rule, F.col("rule.anchor_value")).when(by_model, F.col("model.anchor_value")).alias("anchor_value"),
            F.when(by_model, F.col("model.anchor_max")).alias("anchor_max"),
            F.when(by_rule, "rule").when(by_model, "model").otherwise("deterministic").alias("method"))
    )


def source_set_hashes(
    sources: DataFrame, content: str = "content_hash", hashed: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """One hash per evaluation over the sorted hashes of the few documents it rests on.

    Content shorter than its hash is moved as it is and ``hashed`` where it has arrived.
    """
    hashes = F.array_distinct(F.transform(F.collect_set(content), hashed))
    return sources.groupBy("evaluation_id").agg(
        F.sha2(F.array_join(F.array_sort(hashes), ","), 256).alias("source_set_hash"))


def typed_conditions(payloads: DataFrame, prefectures: DataFrame) -> DataFrame:
    """Fact payloads (JSON per kind) → one typed row per document; place names become codes."""
    schema = "struct<status:string, value:string>"
    parsed = payloads.select("document_id", "kind", F.from_json("payload", schema).alias("p"))
    def pick(kind: str, field: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(f"p.{field}")))
    rows = parsed.groupBy("document_id").agg(
        pick("salary", "status").alias("salary_status"), pick("salary", "value").alias("salary"),
        pick("location", "status").alias("location_status"), pick("location", "value").alias("places"),
        pick("fullRemote", "status").alias("remote_status"), pick("fullRemote", "value").alias("remote"),
        pick("employmentType", "value").alias("employment_type"))
    names = F.map_from_entries(F.collect_list(F.struct("prefecture_name", "prefecture_code")))
    codes = prefectures.agg(names).scalar()  # 47 fixed entries
    return rows.withColumn("codes", codes).select(
        "document_id", "salary_status",
        F.split_part("salary", F.lit("-"), F.lit(1)).try_cast("bigint").alias("salary_minimum"),
        F.split_part("salary", F.lit("-"), F.lit(2)).try_cast("bigint").alias("salary_maximum"),
        "location_status",
        F.array_join(F.transform(F.split("places", "、"), lambda n: F.col("codes")[n]), ",").alias("prefecture_codes"),
        "remote_status", F.col("remote").try_cast("boolean").alias("full_remote"), "employment_type")


def content_duplicates(documents: DataFrame) -> DataFrame:
    """Contents held by more than one document, white space and fetch time aside."""
    return documents.groupBy(F.sha2(T.squeezed(F.col("text")), 256).alias("content_hash")).agg(
        F.count("*").alias("documents"), F.min("document_id").alias("first_document_id")
    ).where("documents > 1")


def evaluation_quality(fragments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Size and axis outcome per document."""
    size = fragments.groupBy("document_id").agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("fragments"))
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"{status}_axes")
    axes = decisions.groupBy("document_id").agg(
        of("known"), of("range"), of("unknown"), of("conflicting"),
        F.count_if(F.col("method") != "rule").alias("open_after_rules"))
    return size.join(moved(axes), "document_id")

"""Text, fact and axis-decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import Domain
from fitgrid.functions import text as T
from fitgrid.operators import chunks, facts
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin
from fitgrid.schemas import prefecture_table
from fitgrid.session import checkpointed

_EMAIL = r"'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'"
_SECRET = r"'\b(?:sk-[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{20,})\b'"
_BEARER = r"'(?i)\bBearer[\s\x{3000}\x{a0}]+[A-Za-z0-9._~-]{16,}\b'"
_PHONE = r"'\+?[0-9][0-9 ()-]{8,}[0-9]'"


@query("redact_text", f"""
    with a as (select source, text, regexp_replace(text, {_EMAIL}, '[email]', 'g') as t1 from documents),
    b as (select *, regexp_replace(t1, {_SECRET}, '[secret]', 'g') as t2 from a),
    c as (select *, regexp_replace(t2, {_BEARER}, '[secret]', 'g') as t3 from b)
    select source, kind, sum(n)::bigint as hits, sum(sign(n))::bigint as documents from (
      select source, 'email' as kind, len(regexp_extract_all(text, {_EMAIL})) as n from c
      union all select source, 'secret', len(regexp_extract_all(t1, {_SECRET})) from c
      union all select source, 'bearer', len(regexp_extract_all(t2, {_BEARER})) from c
      union all select source, 'phone', len(regexp_extract_all(t3, {_PHONE})) from c) z group by 1, 2""")
def redact_text(d: Domain):
    kinds = [kind for kind, _, _ in T.REDACTIONS]
    per_source = T.redacted_step_by_step(d.documents, "text").groupBy("source").agg(*[
        agg for k in kinds for agg in (
            F.sum(f"hits_{k}").alias(f"hits_{k}"), F.count_if(F.col(f"hits_{k}") > 0).alias(f"documents_{k}"))])
    return per_source.select("source", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"hits_{k}").alias("hits"), F.col(f"documents_{k}").alias("documents"))
        for k in kinds])))


@query("redacted_documents", f"""
    select doc_id as document_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      {_EMAIL}, '[email]', 'g'), {_SECRET}, '[secret]', 'g'), {_BEARER}, '[secret]', 'g'), {_PHONE}, '[phone]', 'g')) as text_hash
    from documents""")
def redacted_documents(d: Domain):
    return T.redacted_step_by_step(d.documents, "text").select(
        F.col("doc_id").alias("document_id"), F.sha2("redacted", 256).alias("text_hash"))


@query("content_duplicates", r"""
    select content_hash, count(*) as documents, min(doc_id) as first_document_id from (
      select doc_id, sha256(trim(regexp_replace(text, '[\s\x{b}\x{3000}\x{a0}]+', ' ', 'g'))) as content_hash from documents) z
    group by 1 having count(*) > 1""")
def content_duplicates(d: Domain):
    return facts.content_duplicates(d.documents.select(F.col("doc_id").alias("document_id"), "text"))


@query("bounded_chunks")
def bounded_chunks(d: Domain):
    return chunks.bounded_chunks(d.documents.select(F.col("doc_id").alias("document_id"), "text"), 800)


@query("chunk_coverage", r"""
    select doc_id as document_id, length(regexp_replace(text, '[\s\x{b}\x{3000}\x{a0}]+', '', 'g')) as visible_chars,
      true as within_limit from documents where length(regexp_replace(text, '[\s\x{b}\x{3000}\x{a0}]+', '', 'g')) > 0""")
def chunk_coverage(d: Domain):
    """Loss check of the chunks: visible characters per document, and that each chunk fits."""
    made = chunks.bounded_chunks(d.documents.select(F.col("doc_id").alias("document_id"), "text"), 800)
    visible = F.length(F.regexp_replace("chunk", r"[\s　 ]+", ""))
    return made.groupBy("document_id").agg(
        F.sum(visible).alias("visible_chars"), F.bool_and(F.length("chunk") <= 800).alias("within_limit"))


# Facts ---------------------------------------------------------------------------------------

_SALARY = r"'年収 ([0-9]+)万円〜([0-9]+)万円'"
_SALARY_VALUES = f"""salary_values as (select document_id, position, text,
      (regexp_extract(text, {_SALARY}, 1)::bigint * 10000) || '-' || (regexp_extract(text, {_SALARY}, 2)::bigint * 10000) as value
      from posting_fragments where regexp_matches(text, {_SALARY}))"""
_REDUCED = """select document_id, kind, case when min(value) = max(value) then 'known' else 'conflicting' end as status,
      case when min(value) = max(value) then min(value) end as value,
      case when min(value) = max(value) then substr(arg_min(text, position), 1, 240) end as excerpt, count(*) as mentions
      from {} group by 1, 2"""


@query("salary_facts", twin(_REDUCED.format("(select *, 'salary' as kind from salary_values) v"), extra=_SALARY_VALUES))
def salary_facts(d: Domain):
    return facts.reduce_facts(facts.fact_values(d.posting_fragments, {"salary": T.salary_values}))


_STYLE_VALUES = """style_values as (
      select document_id, position, text, 'fullRemote' as kind, case when text = 'フルリモート可' then 'true' else 'false' end as value
        from posting_fragments where text in ('フルリモート可', '原則出社です。')
      union all select document_id, position, text, 'weeklyOfficeDays', '2' from posting_fragments where text = '週2日出社。'
      union all select document_id, position, text, 'scheduleFlexibility',
        case text when 'コアタイムなし' then '100' when 'フレックスタイム制' then '50' else '0' end
        from posting_fragments where text in ('コアタイムなし', 'フレックスタイム制', '固定勤務時間')
      union all select document_id, position, text, 'employmentType', case when text like '%正社員' then 'FULL_TIME' else 'CONTRACTOR' end
        from posting_fragments where text in ('雇用形態 正社員', '雇用形態 業務委託'))"""
_PLACE_VALUES = """place_values as (select document_id, position, text, 'location' as kind,
      case regexp_extract(text, '勤務地： (.+?) 休日', 1) when 'Yokohama' then '神奈川県' when '福岡市' then '福岡県'
        else regexp_extract(text, '勤務地： (.+?) 休日', 1) end as value
      from posting_fragments where text like '勤務地：%' and text not like '%将来的%')"""


@query("work_style_facts", twin(_REDUCED.format("style_values"), extra=_STYLE_VALUES))
def work_style_facts(d: Domain):
    kinds = ["fullRemote", "weeklyOfficeDays", "scheduleFlexibility", "employmentType"]
    return facts.reduce_facts(facts.fact_values(d.posting_fragments, {k: T.FACTS[k] for k in kinds}))


@query("location_facts", twin("select document_id, value as places from place_values", extra=_PLACE_VALUES))
def location_facts(d: Domain):
    return facts.reduce_facts(
        facts.fact_values(d.posting_fragments, {"location": T.location_values})
    ).select("document_id", F.col("value").alias("places"))


_ALL_VALUES = ", ".join([_SALARY_VALUES, _STYLE_VALUES, _PLACE_VALUES]) + f""",
    all_values as (select document_id, position, text, 'salary' as kind, value from salary_values
      union all select document_id, position, text, kind, value from style_values
      union all select document_id, position, text, kind, value from place_values),
    all_facts as (select p.p_partkey as document_id, k.kind, coalesce(r.status, 'unknown') as status, r.value
      from part p cross join (values ('salary'), ('location'), ('fullRemote'), ('weeklyOfficeDays'),
        ('scheduleFlexibility'), ('employmentType'), ('targetRole')) k(kind)
      left join ({_REDUCED.format('all_values')}) r on r.document_id = p.p_partkey and r.kind = k.kind)"""


@query("fact_reduction", twin(
    "select kind, status, count(*) as documents, count(distinct value) as distinct_values from all_facts group by 1, 2",
    extra=_ALL_VALUES))
def fact_reduction(d: Domain):
    return facts.facts_of(d.posting_fragments, list(T.FACTS)).groupBy("kind", "status").agg(
        F.count("*").alias("documents"), F.count_distinct("value").alias("distinct_values"))


@query("fact_parser_registry", twin("""
    select document_id, kind, count(*) as mentions, min(value) as value from (
      select document_id, 'contact' as kind, regexp_extract(text, 'hr([0-9]+)@', 1) as value
      from posting_fragments where regexp_matches(text, 'hr[0-9]+@')) z group by 1, 2"""))
def fact_parser_registry(d: Domain):
    """A parser added from outside, run through the same reduction as the built-in ones."""
    registry = facts.registered(
        T.FACTS, "contact", lambda t: F.regexp_extract_all(t, F.lit(r"hr([0-9]+)@"), 1))
    return facts.reduce_facts(facts.fact_values(
        d.posting_fragments, {"contact": registry["contact"]})).select(
            "document_id", "kind", "mentions", "value")


@query("tech_mentions", twin("""
    select technology, count(distinct document_id) as documents from (
      select document_id, unnest(string_split(substr(text, 9), '、')) as technology from posting_fragments where text like '技術スタック: %'
      union all select document_id, unnest(['TypeScript', 'AWS']) from posting_fragments where text like 'We use TypeScript%') z
    group by 1"""))
def tech_mentions(d: Domain):
    return facts.technology_mentions(d.posting_fragments)


@query("section_quotes", twin(f"""
    select document_id, case when section in ('働き方', '勤務時間') then 'workStyle' when section = '求める人物像' then 'requirements' else 'duties' end as kind,
      position, section, regexp_replace(text, {_EMAIL}, '[email]', 'g') as text
    from posting_fragments where section in ('働き方', '勤務時間', '求める人物像', '業務内容')"""))
def section_quotes(d: Domain):
    return facts.section_quotes(d.posting_fragments)


@query("structured_preference", twin("""
    select f.document_id, f.kind,
      case when f.document_id % 4 <> 0 then f.status when f.value <> 'true' then 'conflicting' else 'known' end as status,
      case when f.document_id % 4 <> 0 then f.value when f.value <> 'true' then null else 'true' end as value
    from all_facts f where f.kind = 'fullRemote'""", extra=_ALL_VALUES))
def structured_preference(d: Domain):
    read = facts.facts_of(d.posting_fragments, ["fullRemote"])
    declared = d.raw("part").where("p_partkey % 4 = 0").select(
        F.col("p_partkey").alias("document_id"), F.lit("fullRemote").alias("kind"), F.lit("true").alias("value"))
    return facts.prefer_structured(read, declared)


@query("location_merge", twin("""
    select p_partkey as document_id, case
        when p_partkey % 3 = 0 then case when f.value is null or f.value = '東京都' then '東京都' else '東京都;' || f.value end
        else f.value end as places
    from part left join all_facts f on f.document_id = p_partkey and f.kind = 'location'
    where p_partkey % 3 = 0 or f.value is not null""", extra=_ALL_VALUES))
def location_merge(d: Domain):
    stated = facts.reduce_facts(facts.fact_values(d.posting_fragments, {"location": T.location_values})) \
        .where("status = 'known'").select("document_id", F.split("value", "、").alias("places"))
    declared = d.raw("part").where("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("document_id"), F.array(F.lit("東京都")).alias("places"))
    return facts.merge_locations(declared, stated).withColumn("places", F.array_join("places", ";"))


def split_labels(d: Domain):
    """Postings in which the label 年収 stands apart from its amount."""
    two = F.split("text", " ", 2)
    apart = (F.col("position") == 1) & (F.col("document_id") % 5).isin(2, 3) & (F.size(two) == 2)
    pieces = F.when(apart, F.array(
        F.struct(F.lit(0).alias("position"), F.when(F.col("document_id") % 5 == 2, F.col("section"))
                 .otherwise("条件").alias("section"), two[0].alias("text")),
        F.struct(F.lit(1).alias("position"), F.col("section"), two[1].alias("text")),
    )).otherwise(F.array(F.struct("position", "section", "text")))
    return d.posting_fragments.select("document_id", F.inline(pieces))


@query("field_fallback", twin("""
    select v.document_id, case when count(*) filter (where not apart) = 0 or min(value) filter (where not apart) = max(value) filter (where not apart)
        then 'known' else 'conflicting' end as status,
      case when count(*) filter (where not apart) = 0 then max(value)
        when min(value) filter (where not apart) = max(value) filter (where not apart) then min(value) filter (where not apart) end as value,
      case when count(*) filter (where not apart) > 0 then 'fragment' when document_id % 5 = 2 then 'section' else 'whole' end as read_from
    from (select *, position = 1 and document_id % 5 in (2, 3) as apart from salary_values) v group by v.document_id""",
    extra=_SALARY_VALUES))
def field_fallback(d: Domain):
    return facts.field_with_fallback(split_labels(d), "salary", T.salary_values).select(
        "document_id", "status", "value", "read_from")


# Axis decisions ------------------------------------------------------------------------------

_RULES = """rule_rows as (
      select document_id, position, 'work_location' as axis_key, case text when '週2日出社。' then 50 when 'フルリモート可' then 100 else 0 end as anchor
        from posting_fragments where position = 2
      union all select document_id, position, 'schedule_flexibility', case text when 'コアタイムなし' then 100 when 'フレックスタイム制' then 50 else 0 end
        from posting_fragments where position = 3),
    rule_decisions as (select document_id, axis_key, case when min(anchor) = max(anchor) then 'known' else 'conflicting' end as status,
      case when min(anchor) = max(anchor) then min(anchor) end as anchor_value, count(distinct position) as evidence_fragments,
      min(position) as first_position from rule_rows group by 1, 2)"""


@query("rule_axis_decisions", twin("select * from rule_decisions", extra=_RULES))
def rule_axis_decisions(d: Domain):
    return facts.rule_axis_decisions(facts.rule_axis_rows(d.posting_fragments))


def choices(judgements):
    total = F.col("w0") + F.col("w50") + F.col("w100")
    options = F.array(*[
        F.struct(F.lit(c).alias("choice"), (F.col(w) / total).alias("probability"))
        for c, w in (("0", "w0"), ("50", "w50"), ("100", "w100"))])
    return judgements.select("document_id", "axis_key", F.inline(options)).withColumn(
        "confidence", F.col("probability"))


def evidence(d: Domain):
    return d.judgement_evidence.withColumn("probability", F.col("weight") / F.lit(100.0))


_JUDGED = """shares as (select document_id, axis_key, w0::double / (w0 + w50 + w100) as p0, w50::double / (w0 + w50 + w100) as p50,
      w100::double / (w0 + w50 + w100) as p100 from judgements),
    support as (select document_id, axis_key, round(sum(weight) / 100.0::double, 9) as grounding, count(*) filter (where weight >= 10) as citable
      from judgement_evidence where text <> '変更の範囲：会社の定める業務' and not (axis_key = 'autonomy' and text like 'フレックス%') group by 1, 2),
    judged as (select document_id, axis_key, status, case status when 'known' then case when p0 >= 0.8 then 0 when p50 >= 0.8 then 50 else 100 end
          when 'range' then case when first_pair then 0 else 50 end end as anchor_value,
        case status when 'range' then case when first_pair then 50 else 100 end end as anchor_max
      from (select *, case when not coalesce(grounding >= 0.8 and citable > 0, false) then 'unknown'
          when greatest(p0, p50, p100) >= 0.8 then 'known' when first_pair or second_pair then 'range' else 'unknown' end as status
        from (select *, p0 >= 0.15 and p50 >= 0.15 and p0 + p50 >= 0.8 as first_pair, p50 >= 0.15 and p100 >= 0.15 and p50 + p100 >= 0.8 as second_pair
          from shares left join support using (document_id, axis_key)) y) x)"""


@query("axis_judgement", twin("select * from judged", extra=_JUDGED))
def axis_judgement(d: Domain):
    return facts.axis_judgements(choices(d.judgements), evidence(d))


@query("evidence_top_k", twin("""
    select document_id, axis_key, position, evidence_rank from (select *, row_number() over (
        partition by document_id, axis_key order by weight desc, position) as evidence_rank
      from judgement_evidence where weight >= 10) z where evidence_rank <= 2"""))
def evidence_top_k(d: Domain):
    return facts.evidence_top_k(evidence(d), 2).select("document_id", "axis_key", "position", "evidence_rank")


_ASSEMBLED = _RULES + ", " + _JUDGED + """,
    assembled as (select p.p_partkey as document_id, a.axis_idx, a.axis_key, coalesce(r.status, m.status, 'unknown') as status,
      case when r.status is not null then r.anchor_value else m.anchor_value end as anchor_value,
      case when r.status is null then m.anchor_max end as anchor_max,
      case when r.status is not null then 'rule' when m.status is not null then 'model' else 'deterministic' end as method
      from part p cross join ax a left join rule_decisions r on r.document_id = p.p_partkey and r.axis_key = a.axis_key
      left join judged m on m.document_id = p.p_partkey and m.axis_key = a.axis_key)"""


def assembled(d: Domain, called: str = "document_id is not null"):
    """Axis rows of every document; ``called`` says for which of them the model was asked."""
    documents = d.raw("part").select(F.col("p_partkey").alias("document_id")).withColumn("called", F.expr(called))
    # Short rows that are used twice; the texts are not read again for them.
    rules = checkpointed(facts.rule_axis_decisions(facts.rule_axis_rows(d.posting_fragments)).select(
        "document_id", "axis_key", "status", "anchor_value"))
    asked = facts.left_open(d.judgements.where(called), rules)
    model = facts.axis_judgements(choices(asked), evidence(d).where(called))
    return facts.assemble_evaluations(documents, rules, model)


@query("evaluation_assembly", twin("select * from assembled", extra=_ASSEMBLED))
def evaluation_assembly(d: Domain):
    return assembled(d)


@query("source_set_hash", twin("""
    select evaluation_id, sha256(string_agg(h, ',' order by h)) as source_set_hash from (
      select distinct evaluation_id, sha256(strftime(fetched_at, '%Y-%m-%d')) as h from evaluation_sources) z group by 1"""))
def source_set_hash(d: Domain):
    days = d.evaluation_sources.select("evaluation_id", F.to_date("fetched_at").alias("day"))
    return facts.source_set_hashes(days, "day", lambda day: F.sha2(F.date_format(day, "yyyy-MM-dd"), 256))


@query("evaluation_quality", twin("""
    select document_id, chars, fragments, known_axes, range_axes, unknown_axes, conflicting_axes, open_after_rules from
      (select document_id, sum(length(text))::bigint as chars, count(*) as fragments from posting_fragments group by 1) s
      join (select document_id, count(*) filter (where status = 'known') as known_axes, count(*) filter (where status = 'range') as range_axes,
        count(*) filter (where status = 'unknown') as unknown_axes, count(*) filter (where status = 'conflicting') as conflicting_axes,
        count(*) filter (where method <> 'rule') as open_after_rules from assembled group by 1) a using (document_id)""",
    extra=_ASSEMBLED))
def evaluation_quality(d: Domain):
    return facts.evaluation_quality(d.posting_fragments, assembled(d))


@query("located_facts", twin("""
    select document_id, kind, case when filled then 'known' else status end as status,
      case when filled then (['東京都', '大阪府', '北海道', '神奈川県', '福岡県'])[document_id % 5 + 1] else value end as value,
      case when filled then 'located' else 'read' end as method
    from (select *, kind = 'location' and status = 'unknown' as filled from all_facts where kind in ('location', 'salary')) z""",
    extra=_ALL_VALUES))
def located_facts(d: Domain):
    read = checkpointed(facts.facts_of(d.posting_fragments, ["location", "salary"]))
    # A locator named the place fragment for every document and the pay fragment for the monthly ones.
    named = d.raw("part").select(
        F.col("p_partkey").alias("document_id"),
        F.inline(F.array(F.struct(F.lit("location").alias("kind"), F.lit(5).alias("position")),
                         F.struct(F.lit("salary").alias("kind"), F.lit(1).alias("position")))))
    return facts.located_facts(read, named, d.posting_fragments)


@query("job_conditions", twin("""
    select p.p_partkey as document_id, s.status as salary_status, split_part(s.value, '-', 1)::bigint as salary_minimum,
      split_part(s.value, '-', 2)::bigint as salary_maximum, l.status as location_status, r.prefecture_code as prefecture_codes,
      f.status as remote_status, f.value::boolean as full_remote, e.value as employment_type
    from part p join all_facts s on s.document_id = p_partkey and s.kind = 'salary'
    join all_facts l on l.document_id = p_partkey and l.kind = 'location' left join prefs r on r.prefecture_name = l.value
    join all_facts f on f.document_id = p_partkey and f.kind = 'fullRemote'
    join all_facts e on e.document_id = p_partkey and e.kind = 'employmentType'""", extra=_ALL_VALUES))
def job_conditions(d: Domain):
    read = facts.facts_of(d.posting_fragments, ["salary", "location", "fullRemote", "employmentType"])
    payloads = read.select("document_id", "kind", F.to_json(F.struct("status", "value")).alias("payload"))
    return facts.typed_conditions(payloads, prefecture_table(d.spark))



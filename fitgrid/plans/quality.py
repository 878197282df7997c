"""Loading, audit, privacy and url queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import Domain, ntz
from fitgrid.functions import urls as U
from fitgrid.operators import audits, privacy
from fitgrid.operators.keyed import moved
from fitgrid.plans.core import comparisons, constraint_inputs
from fitgrid.operators import matching
from fitgrid.plans.registry import query
from fitgrid.plans.text import _ASSEMBLED, assembled
from fitgrid.plans.twins import twin
from fitgrid.schemas import PREFECTURES, RAW_TABLES, prefecture_table
from fitgrid.sources.tables import load_tables


@query("load_tables", " union all ".join(
    f"select '{name}' as table_name, {len(schema)} as n_columns, count(*) as n_rows from {name}"
    for name, schema in RAW_TABLES.items()))
def load_tables_report(d: Domain):
    report = None
    for name, table in load_tables(d.spark, d.directory).items():
        line = table.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(table.columns)).alias("n_columns"), "n_rows")
        report = line if report is None else report.unionByName(line)
    return report


@query("profile_audit", twin("""
    select profile_version_id, 'axes_incomplete' as rule from p where k % 97 = 0
    union all select k, 'axis_versions_mixed' from p where k % 101 = 0 and axis_catalog_version <> 9
    union all select k, 'axis_value_off_scale' from p where k % 89 = 0
    union all select k, 'role_missing' from p where k % 83 = 0
    union all select k, 'role_blank' from p where k % 79 = 0 and k % 83 <> 0
    union all select k, 'role_repeated' from p where k % 79 = 0 and k % 2 = 0 and k % 83 <> 0
    union all select k, 'salary_not_positive' from p where k % 71 = 0 and k % 5 <> 0
    union all select k, 'prefecture_repeated' from p where k % 47 = 0 and k % 4 <> 0""",
    extra="p as (select *, profile_version_id as k from profile_versions where status = 'completed')"))
def profile_audit(d: Domain):
    """The audit over profiles into which some broken rows were written."""
    k = F.col("profile_version_id")
    axes = moved(d.profile_axis_values).join(
        d.profile_versions.select("profile_version_id", "axis_catalog_version"), "profile_version_id").where((k % 97 != 0) | (F.col("axis_key") != "autonomy"))
    axes = axes.select(
        "profile_version_id", "axis_key", "importance",
        F.when((k % 89 == 0) & (F.col("axis_key") == "work_change"), 101).otherwise(F.col("preference")).alias("preference"),
        F.when((k % 101 == 0) & (F.col("axis_key") == "role_breadth"), 9)
        .otherwise(F.col("axis_catalog_version")).alias("axis_version"))
    roles = d.target_roles.where(k % 83 != 0).withColumn(
        "role_text", F.when(k % 79 == 0, " ").otherwise(F.col("role_text")))
    constraints = d.career_constraints.withColumn(
        "min_salary", F.when((k % 71 == 0) & F.col("min_salary").isNotNull(), 0).otherwise(F.col("min_salary")))
    return audits.profile_audit(d.profile_versions, axes, roles, constraints)


@query("integrity_audit", twin("""
    select 'anchor_without_value' as rule, count(*) filter (where observation_status in ('known', 'stale', 'range') and anchor_value is null) as violations from evaluated_axis_values
    union all select 'value_without_status', count(*) filter (where observation_status in ('unknown', 'conflicting') and anchor_value is not null) from evaluated_axis_values
    union all select 'range_without_maximum', count(*) filter (where observation_status = 'range' and (anchor_max is null or anchor_max - anchor_value <> 50)) from evaluated_axis_values
    union all select 'maximum_without_range', count(*) filter (where observation_status <> 'range' and anchor_max is not null) from evaluated_axis_values
    union all select 'anchor_not_documented', count(*) filter (where anchor_value not in (0, 50, 100)) from evaluated_axis_values
    union all select 'close_beyond_limit', count(*) filter (where comparison_status = 'close' and coalesce(difference_max, difference) > 25) from axis_results
    union all select 'different_within_limit', count(*) filter (where comparison_status = 'different' and difference <= 25) from axis_results
    union all select 'difference_without_value', count(*) filter (where comparison_status in ('unknown', 'conflicting', 'stale', 'excluded') and difference is not null) from axis_results
    union all select 'reason_without_need', count(*) filter (where status in ('met', 'not_required') and reason is not null) from constraint_results
    union all select 'reason_missing', count(*) filter (where status in ('unmet', 'unknown') and reason is null) from constraint_results
    union all select 'evaluation_profile_missing', count(*) from evaluations where l_orderkey not in (select profile_version_id from profile_versions where status = 'completed')
    union all select 'match_evaluation_missing', count(*) from match_results where evaluation_id not in (select evaluation_id from evaluations)
    union all select 'line_key_repeated', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) z"""))
def integrity_audit(d: Domain):
    results = matching.constraint_rows(
        constraint_inputs(d), matching.salary_result(), matching.location_result(), matching.remote_result())
    done = d.profile_versions.where("status = 'completed'").select(F.col("profile_version_id").alias("l_orderkey"))
    parts = [
        audits.rule_counts(d.evaluated_axis_values, audits.axis_value_rules()),
        audits.rule_counts(comparisons(d), audits.comparison_rules()),
        audits.rule_counts(results, audits.constraint_rules()),
        audits.missing_parents(d.evaluations, done, "l_orderkey", "evaluation_profile_missing"),
        audits.missing_parents(d.match_results, d.evaluations, "evaluation_id", "match_evaluation_missing"),
        audits.repeated_keys(d.raw("lineitem"), ["l_orderkey", "l_linenumber"], "line_key_repeated"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


_PARTLY_CALLED = _ASSEMBLED.removesuffix(")") + " and m.document_id % 3 <> 0)"


@query("evaluation_payload_audit", twin("""
    select document_id, unnest(rules) as rule from (
      select document_id, list_filter([case when bool_or(status in ('known', 'range') and cited = 0) then 'evidence_missing' end,
        case when bool_or(dangling > 0) then 'evidence_dangling' end], lambda x: x is not null) as rules
      from (select a.document_id, a.axis_key, a.status, coalesce(e.n, 0) as cited, coalesce(e.dangling, 0) as dangling
        from assembled a left join (select document_id, axis_key, count(*) as n, count(*) filter (where position = 3 and document_id % 10 <> 1) as dangling
          from judgement_evidence where axis_key <> 'autonomy' and weight >= 20 group by 1, 2) e using (document_id, axis_key)) z group by 1) y""",
    extra=_PARTLY_CALLED))
def evaluation_payload_audit(d: Domain):
    cited = d.judgement_evidence.where("axis_key <> 'autonomy' and weight >= 20").select(
        "document_id", "axis_key", (F.col("position") + 1).alias("position"))
    # In the audited payloads the model was not called for every third document.
    return audits.payload_audit(assembled(d, "document_id % 3 <> 0"), cited, d.posting_fragments)


@query("owner_scoped_read", twin("""
    select profile_version_id, axis_key, preference from profile_axis_values join profile_versions using (profile_version_id)
    where user_id % 10 = 3"""))
def owner_scoped_read(d: Domain):
    owners = d.users.where("user_id % 10 = 3")
    return privacy.owned_rows(
        d.profile_axis_values, d.profile_versions, "profile_version_id", owners
    ).select("profile_version_id", "axis_key", "preference")


@query("accessible_results", twin("""
    select o_custkey as user_id, o_orderkey as request_id, case o_orderstatus when 'F' then 'completed' else 'running' end as status, l.l_partkey as job_posting_id
    from orders left join (select distinct l_orderkey, l_partkey from lineitem where l_linenumber <= 2) l on l_orderkey = o_orderkey
    where o_custkey % 10 = 3"""))
def accessible_results(d: Domain):
    o = d.raw("orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"),
                        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    access = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("request_id"))
    results = d.raw("lineitem").where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("job_posting_id")).distinct()
    return privacy.readable_results(requests, access, results, d.users.where("user_id % 10 = 3")).select(
        "user_id", "request_id", "status", "job_posting_id")


@query("active_shares", twin("""
    select token, shared_at, match_result_id from (select *, row_number() over (partition by match_result_id order by shared_at desc, token desc) as r
      from (select match_result_id, created_at as shared_at, sha256('a' || match_result_id) as token from match_results where match_result_id % 3 <> 0
        union all select match_result_id, created_at + interval 1 day, sha256('b' || match_result_id) from match_results where match_result_id % 2 = 0) s) z where r = 1"""))
def active_shares(d: Domain):
    key = F.col("match_result_id")
    def link(mark, revoked, later):
        return F.struct(
            F.sha2(F.concat(F.lit(mark), key.cast("string")), 256).alias("token"),
            (F.col("created_at") + F.expr(f"interval {later} day")).alias("shared_at"),
            F.when(revoked, F.col("created_at")).alias("revoked_at"))
    shares = d.match_results.select("match_result_id", "user_id", F.inline(F.array(
        link("a", key % 3 == 0, 0), link("b", key % 2 != 0, 1))))
    return privacy.live_shares(shares)


@query("prefecture_codes", twin("""
    select p_partkey as job_posting_id, n.name as prefecture_name, prefecture_code, prefecture_code is null as is_error from part
    join (select prefecture_code::int as i, prefecture_name as name from prefs union all values (48, '東京'), (49, ''), (50, '大阪')) n on n.i = 1 + p_partkey % 50
    left join prefs on prefs.prefecture_name = n.name"""))
def prefecture_codes(d: Domain):
    table = prefecture_table(d.spark)
    names = F.concat(F.array(*[F.lit(n) for n in PREFECTURES]),
                     F.array(F.lit("東京"), F.lit(""), F.lit("大阪")))
    seen = d.raw("part").select(
        F.col("p_partkey").alias("job_posting_id"),
        F.element_at(names, (1 + F.col("p_partkey") % 50).cast("int")).alias("prefecture_name"))
    return privacy.prefecture_lookup(seen, table).select(
        "job_posting_id", "prefecture_name", "prefecture_code", "is_error")


SECRET = "test-secret"
_IPAD = bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()


def _hmac_twin(message: str) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({message}))))"


@query("daily_pseudonyms", f"""
    select event_id, user_id, {_hmac_twin("strftime(ts, '%Y-%m-%d') || '|203.0.' || (user_id % 200) || '.' || (event_id % 250)")} as ip_key,
      case when event_id % 11 <> 0 then {_hmac_twin("strftime(ts, '%Y-%m-%d') || '|agent ' || (user_id % 7)")} end as ua_key from events""")
def daily_pseudonyms(d: Domain):
    user, event = F.col("user_id"), F.col("event_id")
    ip = F.concat(F.lit("203.0."), (user % 200).cast("string"), F.lit("."), (event % 250).cast("string"))
    raw = d.events.select(
        "event_id", "user_id", "ts",
        F.concat(F.lit("10.0.0.1, "), F.when(event % 3 == 0, F.lit("::ffff:")).otherwise(""), ip).alias("forwarded_for"),
        F.when(event % 11 == 0, " ").otherwise(F.concat(F.lit("agent "), (user % 7).cast("string"))).alias("user_agent"))
    return privacy.daily_pseudonyms(raw, SECRET)


@query("source_text_retention", """
    select doc_id as document_id, fetched_at, text_hash, text is null as removed from (
      select doc_id, timestamp '2024-01-01' + to_days(cast(doc_id % 60 as int)) as fetched_at, sha256(text) as text_hash,
        case when doc_id not in (select doc_id from documents where doc_id % 60 <= 20) then text end as text
      from documents) z""")
def source_text_retention(d: Domain):
    documents = d.documents.select(
        F.col("doc_id").alias("document_id"), "text", F.sha2("text", 256).alias("text_hash"),
        (ntz("2024-01-01") + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))).alias("fetched_at"))
    return privacy.retain_texts(documents, ntz("2024-02-20"), 30).select(
        "document_id", "fetched_at", "text_hash", F.col("text").isNull().alias("removed"))


@query("event_retention", """
    select event_type as kind, count(*) filter (where not keep) as removed, count(*) filter (where keep) as kept from (
      select event_type, case event_type when 'click' then ts > timestamp '2024-01-24' when 'view' then ts > timestamp '2024-01-30'
        when 'error' then ts > timestamp '2024-01-17' else true end as keep from events) z group by 1""")
def event_retention(d: Domain):
    rows = d.events.select("event_id", "ts", F.col("event_type").alias("kind"))
    marked = privacy.retention_split(rows, {"click": 7, "view": 1, "error": 14}, ntz("2024-01-31"))
    return marked.groupBy("kind").agg(
        F.count_if(~F.col("keep")).alias("removed"), F.count_if(F.col("keep")).alias("kept"))


@query("erase_users", twin("""
    select 'profiles' as table_name, count(*) filter (where c_custkey % 50 = 7) as removed_rows, count(*) filter (where c_custkey % 50 <> 7) as kept_rows from customer
    union all select 'profile_versions', count(*) filter (where user_id % 50 = 7), count(*) filter (where user_id % 50 <> 7) from profile_versions
    union all select 'profile_axis_values', count(*) filter (where user_id % 50 = 7), count(*) filter (where user_id % 50 <> 7) from profile_axis_values join profile_versions using (profile_version_id)
    union all select 'match_results', count(*) filter (where user_id % 50 = 7), count(*) filter (where user_id % 50 <> 7) from match_results"""))
def erase_users(d: Domain):
    tables = {"profiles": d.users, "profile_versions": d.profile_versions,
              "profile_axis_values": d.profile_axis_values, "match_results": d.match_results}
    lineage = {"profiles": None, "profile_versions": None,
               "profile_axis_values": ("profile_versions", "profile_version_id"), "match_results": None}
    left = privacy.erase_users(tables, lineage, d.users.where("user_id % 50 = 7"))
    return privacy.erasure_report(tables, left)


# Urls and addresses --------------------------------------------------------------------------

_LISTED = r"""raw_urls as (select url from pages union all select url || '&utm_source=a&utm_medium=b' from pages
      union all select 'https://User@host' || page_id || '.example.com/' from pages
      union all select 'https://HOST' || (page_id % 9) || '.Example.com:443/a?utm_term=x#part' from pages
      union all select 'https://10.0.0.' || page_id || '/x' from pages union all select 'https://db' || page_id || '.internal/' from pages)"""


def raw_urls(d: Domain):
    key = F.col("page_id").cast("string")
    return d.pages.select(F.explode(F.array(
        F.col("url"), F.concat("url", F.lit("&utm_source=a&utm_medium=b")),
        F.concat(F.lit("https://User@host"), key, F.lit(".example.com/")),
        F.concat(F.lit("https://HOST"), (F.col("page_id") % 9).cast("string"), F.lit(".Example.com:443/a?utm_term=x#part")),
        F.concat(F.lit("https://10.0.0."), key, F.lit("/x")),
        F.concat(F.lit("https://db"), key, F.lit(".internal/")))).alias("url"))


@query("canonical_urls", twin(r"""
    select canonical_url, count(*) as raw_urls, count(distinct url) as distinct_raw_urls from (
      select url, case when regexp_matches(url, '^https://') and not contains(host, '@') and not regexp_matches(host, '^[0-9.]+$') and not host like '%.internal'
          then 'https://' || lower(regexp_replace(host, ':443$', '')) || case when p = '' then '/' else p end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical_url
      from (select url, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as p,
          list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^utm_(source|medium|campaign|term|content)(=|$)')) as kept from raw_urls) z) y
    group by 1""", extra=_LISTED))
def canonical_urls(d: Domain):
    return raw_urls(d).select("url", U.canonical_url(F.col("url")).alias("canonical_url")).groupBy(
        "canonical_url").agg(F.count("*").alias("raw_urls"), F.count_distinct("url").alias("distinct_raw_urls"))


def _blocked_twin() -> str:
    ranges = ", ".join(f"({low}, {high})" for low, high in map(U.block_bounds, U.BLOCKED_IPV4))
    return f"""with a as (select event_id, 'v4' as family, (event_id * 37) % 256 as o1, (event_id * 11) % 256 as o2, event_id % 3 as o3, user_id % 256 as o4 from events)
      select event_id, o1 || '.' || o2 || '.' || o3 || '.' || o4 as address,
        exists (select 1 from (values {ranges}) r(lo, hi) where ((o1 * 256 + o2) * 256 + o3) * 256 + o4 between lo and hi) as blocked from a
      union all select event_id, (['2001:db8::', '2001:4860::', '2002::', '3fff:0fff::', '3fff:1000::', 'fe80::', '2400:cb00::', '::'])[1 + event_id % 8] || printf('%x', 1 + user_id),
        event_id % 8 not in (1, 4, 6) from events"""


@query("non_public_addresses", _blocked_twin())
def non_public_addresses(d: Domain):
    event, user = F.col("event_id"), F.col("user_id")
    parts = [(event * 37) % 256, (event * 11) % 256, event % 3, user % 256]
    v4 = F.concat_ws(".", *[p.cast("string") for p in parts])
    prefixes = F.array(*[F.lit(p) for p in (
        "2001:db8::", "2001:4860::", "2002::", "3fff:0fff::", "3fff:1000::", "fe80::", "2400:cb00::", "::")])
    v6 = F.concat(F.element_at(prefixes, (1 + event % 8).cast("int")), F.lower(F.hex(1 + user)))
    rows = d.events.select("event_id", F.explode(F.array(v4, v6)).alias("address"))
    address = F.col("address")
    return rows.select(
        "event_id", "address",
        F.when(F.contains(address, F.lit(":")), U.blocked_ipv6(address)).otherwise(U.blocked_ipv4(address)).alias("blocked"))

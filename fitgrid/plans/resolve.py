"""Search, identity and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrid.bindings import Domain, ntz
from fitgrid.functions.companies import employment_fit
from fitgrid.operators import candidates, ingest
from fitgrid.plans.registry import query
from fitgrid.plans.twins import twin
from fitgrid.session import checkpointed, scratch_path
from fitgrid.sources import sinks


def employment_facts(d: Domain):
    key = F.col("evaluation_id")
    return d.evaluations.where("target_type = 'job'").select(
        "job_posting_id", "evaluation_id", "created_at",
        F.when(key % 3 == 0, "unknown").otherwise("known").alias("status"),
        F.when(key % 2 == 0, "FULL_TIME").otherwise("PART_TIME").alias("employment_type"))


@query("known_postings_search", twin("""
    select query_id, position, job_posting_id, company_name, title, url, t.employment_type from (
      select q.query_id, c.company_name, p.job_posting_id, p.title, p.url,
        row_number() over (partition by q.query_id order by p.job_posting_id desc) as position
      from company_queries q join companies c on contains(lower(c.company_name), lower(trim(q.company))) or contains(lower(trim(q.company)), lower(c.company_name))
      join job_postings p on p.company_id = c.company_id) z
    left join (select job_posting_id, case when evaluation_id % 2 = 0 then 'FULL_TIME' else 'PART_TIME' end as employment_type
      from (select *, row_number() over (partition by job_posting_id order by created_at desc, evaluation_id desc) as r
        from evaluations where target_type = 'job' and evaluation_id % 3 <> 0) y where r = 1) t using (job_posting_id)
    where position <= 10"""))
def known_postings_search(d: Domain):
    return candidates.known_postings(
        d.company_queries, d.companies, d.job_postings, employment_facts(d), limit=10)


_BARE = r"regexp_replace(regexp_replace(lower({}), '株式会社|inc\.?', '', 'g'), '[ .]+', '', 'g')"


@query("same_company_pairs", twin(f"""
    select a.name as "inner", b.name as "outer", a.n as inner_companies, b.n as outer_companies
    from names a join names b on contains(b.name, a.name) where a.name <> b.name or a.n > 1""",
    extra=f"""names as (select name, count(*) as n from (select {_BARE.format('company_name')} as name from companies
      union all select {_BARE.format('company')} from company_queries) z group by 1)"""))
def same_company_pairs(d: Domain):
    return candidates.same_company_pairs(
        d.companies.select("company_name").unionAll(d.company_queries.select(F.col("company").alias("company_name"))))


def raw_candidates(d: Domain):
    """Postings of the searched companies, some listed twice, and of one unrelated company."""
    key = F.col("job_posting_id")
    named = d.companies.join(
        d.raw("supplier").select(F.col("s_suppkey").alias("company_id"),
                                 F.substring("s_name", 1, 17).alias("company")), "company_id")
    near = d.job_postings.join(named, "company_id").join(
        d.company_queries.select("query_id", "company"), "company")
    far = d.job_postings.where(key % 17 == 0).join(named, "company_id").withColumn("query_id", key % 25)
    columns = ["query_id", "job_posting_id", "company_name", "title", "employment_types"]
    source = (F.when(key % 4 == 0, "official").when(key % 4 == 1, "ats").when(key % 4 == 2, "known")
              .otherwise("web"))
    return near.select(*columns).unionByName(far.select(*columns)).select(
        "query_id", "company_name", "title", "employment_types", key.alias("input_order"),
        F.concat(F.lit("https://jobs.example.com/p/"), F.expr("job_posting_id div 2").cast("string")).alias("url"),
        source.alias("source"))


_CANDIDATES = """raw_candidates as (
      select *, 'https://jobs.example.com/p/' || (input_order // 2) as url,
        case input_order % 4 when 0 then 'official' when 1 then 'ats' when 2 then 'known' else 'web' end as source from (
        select q.query_id, c.company_name, p.title, p.declared_type, p.job_posting_id as input_order
          from job_postings p join companies c using (company_id) join supplier s on s.s_suppkey = p.company_id
          join company_queries q on q.company = substr(s.s_name, 1, 17)
        union all select p.job_posting_id % 25, c.company_name, p.title, p.declared_type, p.job_posting_id
          from job_postings p join companies c using (company_id) where p.job_posting_id % 17 = 0) z)"""
_RANKED = _CANDIDATES + f""",
    unique_candidates as (select * from (select *, row_number() over (partition by query_id, url order by input_order) as r
      from raw_candidates) z where r = 1),
    scored as (select u.*, case when q.role_query is null then 0 else len(list_filter(string_split(lower(q.role_query), ' '),
          lambda t: contains(lower(u.title), t))) end as matched_terms, case when q.role_query is null then 0 else 2 end as total_terms
      from unique_candidates u join company_queries q on q.query_id = u.query_id
      where contains({_BARE.format('u.company_name')}, {_BARE.format('q.company')})
        and (q.employment_type is null or u.declared_type = upper(q.employment_type))),
    ranked as (select query_id, 'c' || position as candidate_id, position, url, title, company_name, source, matched_terms, total_terms
      from (select *, row_number() over (partition by query_id order by matched_terms desc,
        case source when 'official' then 0 when 'ats' then 1 when 'known' then 2 else 3 end, input_order) as position from scored) z
      where position <= 20)"""


@query("rank_candidates", twin("select * from ranked", extra=_RANKED))
def rank_candidates(d: Domain):
    return candidates.rank_candidates(d.company_queries, raw_candidates(d), limit=20)


def selections(d: Domain):
    """Stored answers of a selector for every third search and some ids it was never given."""
    key = F.col("query_id")
    choice = F.concat(F.lit("c"), F.when(key % 5 == 0, 99).otherwise(1 + key % 4).cast("string"))
    sure = F.when(key % 2 == 0, 0.9).otherwise(0.6)
    return d.company_queries.where(key % 3 != 2).select(
        "query_id", choice.alias("choice"), sure.alias("confidence"),
        F.create_map(choice, sure, F.lit("c7"), F.when(key % 4 == 0, 0.2).otherwise(0.05)).alias("probabilities"))


_SELECTIONS = """selections as (select query_id, 'c' || case when query_id % 5 = 0 then 99 else 1 + query_id % 4 end as given,
      case when query_id % 2 = 0 then 0.9 else 0.6 end as sure, case when query_id % 4 = 0 then 0.2 else 0.05 end as other
      from company_queries where query_id % 3 <> 2),
    valid as (select s.query_id, s.sure, s.other, s.given, coalesce(r.candidate_id, 'none') as choice
      from selections s left join ranked r on r.query_id = s.query_id and r.candidate_id = s.given)"""


@query("candidate_selector", twin(
    "select query_id, choice, sure as confidence from valid", extra=_RANKED + ", " + _SELECTIONS))
def candidate_selector(d: Domain):
    return candidates.valid_selections(selections(d), rank_candidates(d)).select(
        "query_id", "choice", "confidence")


@query("resolution_decision", twin("""
    select q.query_id,
      case when n is null then 'not_found' when total = 0 then 'candidates' when n_full = 1 or sure_pick then 'resolved' else 'candidates' end as status,
      case when n is null then 'no_candidates' when total = 0 then 'company_listing' when n_full = 1 then 'single_full_match'
        when sure_pick then 'confident_selection' else 'ambiguous' end as reason,
      case when n is null then '' when total = 0 then by_rank when n_full = 1 then full_id when sure_pick then choice
        when choice is not null then by_share else by_rank end as candidate_ids,
      case when n is null then false when total = 0 then n > 3 when n_full = 1 or sure_pick then false else n > 3 end as has_more
    from company_queries q left join (
      select r.query_id, count(*) as n, max(total_terms) as total,
        count(*) filter (where total_terms > 0 and matched_terms = total_terms) as n_full,
        min(candidate_id) filter (where total_terms > 0 and matched_terms = total_terms) as full_id,
        string_agg(candidate_id, ',' order by position) filter (where position <= 3) as by_rank from ranked r group by 1) a using (query_id)
    left join (select query_id, choice, choice <> 'none' and sure >= 0.8 and other <= 0.15 as sure_pick from valid) v using (query_id)
    left join (select query_id, string_agg(candidate_id, ',' order by n) filter (where n <= 3) as by_share from (
        select r.query_id, r.candidate_id, row_number() over (partition by r.query_id order by
          case when r.candidate_id = v.given then v.sure when r.candidate_id = 'c7' then v.other else 0 end desc, position) as n
        from ranked r join valid v using (query_id)) z group by 1) s using (query_id)""",
    extra=_RANKED + ", " + _SELECTIONS))
def resolution_decision(d: Domain):
    ranked = checkpointed(rank_candidates(d))
    return candidates.decide_resolutions(
        d.company_queries, ranked, candidates.valid_selections(selections(d), ranked))


@query("employment_fit", twin("""
    select wanted, case when wanted = 'new_grad' then 'unsaid' when (wanted = 'full_time') = (declared_type = 'FULL_TIME') then 'fits' else 'differs' end as fit,
      count(*) as postings
    from job_postings cross join (values ('full_time'), ('part_time'), ('new_grad')) w(wanted) group by 1, 2"""))
def employment_fit_counts(d: Domain):
    wanted = F.explode(F.array(F.lit("full_time"), F.lit("part_time"), F.lit("new_grad"))).alias("wanted")
    fit = employment_fit(F.col("wanted"), F.col("employment_types"), F.col("title"))
    return d.job_postings.select("title", "employment_types", wanted).groupBy(
        "wanted", F.when(fit, "fits").when(~fit, "differs").otherwise("unsaid").alias("fit")
    ).agg(F.count("*").alias("postings"))


@query("priority_union", twin("""
    select query_id, url, source_rank, input_order from (select *, row_number() over (partition by query_id, url order by source_rank, input_order) as r
      from (select query_id, url, 0 as source_rank, input_order from raw_candidates where source = 'known'
        union all select query_id, url, 1, input_order from raw_candidates where source = 'official'
        union all select query_id, url, 2, input_order from raw_candidates where source in ('ats', 'web')) z) y where r = 1""",
    extra=_CANDIDATES))
def priority_union(d: Domain):
    rows = raw_candidates(d)
    return candidates.priority_union(
        rows.where("source = 'known'"), rows.where("source = 'official'"), rows.where("source in ('ats', 'web')")
    ).select("query_id", "url", "source_rank", "input_order")


@query("registry_site_match", twin(f"""
    select q.query_id, r.domain, r.site, r.records from (select s_suppkey as query_id, {_BARE.format('company_name')} as name
        from companies join supplier on s_suppkey = company_id) q
    join (select name, min(domain) as domain, min(site) as site, count(*) as records from (
        select {_BARE.format('c.company_name')} as name, case when p_partkey % 29 = 0 then 'other.com' else 'corp' || company_id || '.co.jp' end as domain,
          case when p_partkey % 29 = 0 then 'https://www.other.com/' else 'https://www.corp' || company_id || '.co.jp/' end as site
        from part join companies c on c.company_id = p_partkey % (select count(*) from supplier) where p_partkey % 3 <> 0) z
      group by 1 having min(domain) = max(domain)) r on r.name = q.name"""))
def registry_site_match(d: Domain):
    searches = d.companies.select(F.col("company_id").alias("query_id"), F.col("company_name").alias("company"))
    key = F.col("job_posting_id")
    site = F.when(key % 29 == 0, "http://www.other.com/").otherwise(
        F.concat(F.lit("https://www.corp"), F.col("company_id").cast("string"), F.lit(".co.jp/")))
    registry = d.job_postings.join(d.companies, "company_id").select(
        "company_name", site.alias("site"),
        F.when(key % 3 == 0, F.lit("2023-01-01")).alias("closed_on"))
    return candidates.registry_sites(searches, registry)


@query("official_sites", twin("""
    select query_id, position, entity_id, url, score from (select *, row_number() over (partition by query_id order by score, claim_order, url) as position from (
      select p_partkey % n as query_id, p_partkey as entity_id, o as claim_order,
        'https://www.site' || (p_partkey % n) || case o when 1 then '.jp/' when 2 then '.com/' else '.com/p' || p_partkey end as url,
        case when (p_partkey % n) % 3 = 0 and o = 1 then 0 else 2 end + case when o = 2 then 0 else 1 end as score,
        row_number() over (partition by p_partkey % n, case o when 1 then '1' when 2 then '2' else 'p' || p_partkey end order by
          case when (p_partkey % n) % 3 = 0 and o = 1 then 0 else 2 end + case when o = 2 then 0 else 1 end, o, p_partkey) as r
      from part cross join (select count(*) as n from supplier) s cross join (values (1), (2), (3)) c(o)
      where p_partkey % 5 <> 0 and p_partkey % 7 <> 0) z where r = 1) y where position <= 4"""))
def official_sites(d: Domain):
    key = F.col("job_posting_id")
    searches = d.companies.select(F.col("company_id").alias("query_id"), F.col("company_name").alias("company"))
    rows = d.job_postings.join(d.companies, "company_id")
    entities = rows.select(
        key.alias("entity_id"), F.col("company_id").alias("query_id"), F.col("company_name").alias("label"),
        F.when(key % 5 == 0, F.array(F.lit("disambiguation"), F.lit("business")))
        .when(key % 7 == 0, F.array(F.lit("film"))).otherwise(F.array(F.lit("business"))).alias("types"),
        F.lit(False).alias("has_industry"))
    base = F.concat(F.lit("www.site"), F.col("company_id").cast("string"))
    claims = rows.select(key.alias("entity_id"), F.inline(F.array(
        F.struct(F.lit(1).alias("claim_order"), F.concat(F.lit("https://"), base, F.lit(".jp/")).alias("url"),
                 F.lit("normal").alias("rank"), F.array(F.lit("ja")).alias("languages")),
        F.struct(F.lit(2).alias("claim_order"), F.concat(F.lit("http://"), base, F.lit(".com/")).alias("url"),
                 F.lit("preferred").alias("rank"), F.array(F.lit("en")).alias("languages")),
        F.struct(F.lit(3).alias("claim_order"),
                 F.concat(F.lit("https://"), base, F.lit(".com/p"), key.cast("string")).alias("url"),
                 F.lit("normal").alias("rank"), F.array(F.lit("en")).alias("languages")),
        F.struct(F.lit(4).alias("claim_order"), F.concat(F.lit("https://"), base, F.lit(".old/")).alias("url"),
                 F.lit("deprecated").alias("rank"), F.array(F.lit("en")).alias("languages")))))
    return candidates.official_sites(searches, entities, claims, ["business", "enterprise"])


# Ingest --------------------------------------------------------------------------------------

@query("idempotent_append", twin("""
    select case when s.evaluation_id is not null then 'existing' else 'inserted' end as outcome, count(*) as keys, sum(n)::bigint as rows
    from (select l_orderkey * 10 + l_linenumber as evaluation_id, count(*) as n from lineitem group by 1) i
    left join (select evaluation_id from evaluations where evaluation_id % 4 = 0) s using (evaluation_id) group by 1"""))
def idempotent_append(d: Domain):
    incoming = d.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evaluation_id"))
    stored = d.evaluations.where("evaluation_id % 4 = 0")
    return ingest.append_report(incoming, stored, ["evaluation_id"])


@query("upsert_latest_request", twin("""
    select user_id, url_id, event_id, ts from (select *, row_number() over (partition by user_id, url_id order by ts desc, event_id desc) as r
      from requests) z where r = 1"""))
def upsert_latest_request(d: Domain):
    return ingest.latest_requests(d.requests).select("user_id", "url_id", "event_id", "ts")


@query("request_resolution", twin("""
    select u.url_id, case when coalesce(b.is_fresh, false) then 'fresh' when b.evaluation_id is null then 'queued' else 'stale' end as request_status,
      case when not coalesce(b.is_fresh, false) then a.job_id end as job_id,
      not coalesce(b.is_fresh, false) and a.job_id is null as starts_job, b.evaluation_id, b.oldest as oldest_fetched_at
    from (select distinct event_id % 520 as url_id from events) u
    left join (select * from (select *, row_number() over (partition by url_id order by is_fresh desc, created_at desc, job_id desc) as r from (
        select j.url_id, j.job_id, j.evaluation_id, j.created_at, min(s.fetched_at) as oldest, min(s.fetched_at) >= timestamp '1998-01-01' as is_fresh
        from analysis_jobs j join job_sources s using (evaluation_id) where j.status = 'completed'
        group by 1, 2, 3, 4 having bool_or(s.url_id = j.url_id)) z) y where r = 1) b using (url_id)
    left join (select * from (select *, row_number() over (partition by url_id order by created_at, job_id) as r from analysis_jobs
      where status in ('queued', 'running')) z where r = 1) a on a.url_id = u.url_id""",
    extra="""job_sources as (select evaluation_id, (job_id + case when job_id % 9 = 0 then 2 else 0 end) % 500 as url_id,
        created_at - to_days(cast(job_id % 40 as int)) as fetched_at from analysis_jobs where evaluation_id is not null
      union all select evaluation_id, (job_id + 1) % 500, created_at - to_days(cast(job_id % 90 as int)) from analysis_jobs where evaluation_id is not null)"""))
def request_resolution(d: Domain):
    key = F.col("job_id")
    sources = d.analysis_jobs.where("evaluation_id is not null").select(
        "evaluation_id", F.inline(F.array(
            F.struct(((key + F.when(key % 9 == 0, 2).otherwise(0)) % 500).alias("url_id"),
                     (F.col("created_at") - F.make_dt_interval((key % 40).cast("int"))).alias("fetched_at")),
            F.struct(((key + 1) % 500).alias("url_id"),
                     (F.col("created_at") - F.make_dt_interval((key % 90).cast("int"))).alias("fetched_at")))))
    urls = d.events.select((F.col("event_id") % 520).alias("url_id")).distinct()
    return ingest.resolve_requests(urls, d.analysis_jobs, sources, ntz("1998-01-01"))


def submissions(d: Domain):
    return d.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
        F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256)
        .alias("content_hash"))


@query("evaluation_ingest", """
    with s as (select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, sha256(l_partkey || '|' || l_suppkey) as h from lineitem),
    stored as (select l_orderkey, l_linenumber, min(h) as h from s where l_orderkey % 5 = 0 group by 1, 2)
    select g.l_orderkey, g.l_linenumber, submissions, coalesce(t.h, first_h) as content_hash,
      case when t.h is null then case when lo <> first_h or hi <> first_h then 'inserted_with_conflict' else 'inserted' end
        else case when lo <> t.h or hi <> t.h then 'conflict' else 'replayed' end end as outcome
    from (select l_orderkey, l_linenumber, count(*) as submissions, min(h) as lo, max(h) as hi,
        arg_min(h, row(l_shipdate, l_partkey, l_suppkey)) as first_h from s group by 1, 2) g
    left join stored t on t.l_orderkey = g.l_orderkey and t.l_linenumber = g.l_linenumber""")
def evaluation_ingest(d: Domain):
    rows = submissions(d)
    stored = rows.where("l_orderkey % 5 = 0").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("content_hash").alias("content_hash"))
    return ingest.evaluation_outcomes(
        rows, stored, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query("profile_version_ingest", """
    with recursive subs as (select event_id, user_id, ts, event_id - event_id % 3 as k, case when event_id % 3 = 2 then 'b' else 'a' end as payload,
        1 + event_id % 4 as expected from events where event_type in ('signup', 'purchase', 'error')),
    chain as (select distinct user_id, 1::bigint as v, null::timestamp as ts, null::bigint as event_id, [-1::bigint] as keys from events
      union all
      select user_id, v, ts, event_id, keys from (
        select c.user_id, c.v + 1 as v, s.ts, s.event_id, list_append(c.keys, s.k) as keys,
          row_number() over (partition by c.user_id order by s.ts, s.event_id) as r
        from chain c join subs s on s.user_id = c.user_id and s.expected = c.v
          and (c.ts is null or s.ts > c.ts or (s.ts = c.ts and s.event_id > c.event_id)) and not list_contains(c.keys, s.k)) z where r = 1),
    accepted as (select c.user_id, c.v, c.ts, c.event_id, s.k, s.payload from chain c join subs s using (event_id))
    select s.user_id, s.event_id,
      case when a.event_id = s.event_id then 'accepted'
        when a.event_id is not null and (a.ts < s.ts or (a.ts = s.ts and a.event_id < s.event_id)) then case when a.payload = s.payload then 'replayed' else 'idempotency_conflict' end
        else 'version_conflict' end as outcome,
      case when a.event_id = s.event_id then a.v end as new_version
    from subs s left join accepted a on a.user_id = s.user_id and a.k = s.k""")
def profile_version_ingest(d: Domain):
    key = F.col("event_id")
    rows = d.events.where("event_type in ('signup', 'purchase', 'error')").select(
        "event_id", "user_id", "ts", (key - key % 3).alias("idempotency_key"),
        F.when(key % 3 == 2, "b").otherwise("a").alias("payload"), (1 + key % 4).alias("expected_version"))
    latest = d.events.select("user_id").distinct().withColumn("version", F.lit(1).cast("bigint"))
    return ingest.profile_submissions(rows, latest)


@query("posting_identity", """
    with existing as (select p_partkey % 200 as url_id, p_name as title, p_type as employer, min(p_partkey) as id from part
        where p_partkey % 2 = 0 group by 1, 2, 3),
    seen as (select distinct p_partkey % 200 as url_id, p_name as title, p_type as employer from lineitem join part on l_partkey = p_partkey)
    select url_id, title, employer, coalesce(id::varchar, substr(sha256(url_id || '|' || title || '|' || employer), 1, 16)) as posting, id is null as is_new
    from seen left join existing using (url_id, title, employer)""")
def posting_identity(d: Domain):
    part = d.raw("part").select(
        "p_partkey", (F.col("p_partkey") % 200).alias("url_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("employer"))
    existing = part.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "job_posting_id")
    seen = d.raw("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(part, "p_partkey")
    return ingest.posting_identities(seen, existing)


@query("discovery_results_sink", """
    with results as (select l_orderkey as request_id, l_linenumber as position, l_partkey as k, 'https://jobs.example.com/p/' || (l_partkey % 900) as url,
        trim(p_name) as title, 'Company ' || (l_suppkey % 5) as company_name, case l_linenumber % 4 when 0 then 'official' when 1 then 'ats' when 2 then 'web' else 'blog' end as source_kind
      from lineitem join part on l_partkey = p_partkey),
    existing as (select 'https://jobs.example.com/p/' || (p_partkey % 900) as url, p_name as title, 'Company ' || (p_partkey % 5) as company_name, min(p_partkey) as id
      from part group by 1, 2, 3)
    select request_id, position, posting, is_new, source_kind from (
      select *, row_number() over (partition by request_id, posting order by position) as r from (
        select distinct request_id, position, coalesce(id::varchar, substr(sha256(url || '|' || title || '|' || company_name), 1, 16)) as posting, id is null as is_new, source_kind
        from results left join existing using (url, title, company_name) where source_kind <> 'blog') z) y where r = 1""")
def discovery_results_sink(d: Domain):
    part = d.raw("part")
    def url(key):
        return F.concat(F.lit("https://jobs.example.com/p/"), (key % 900).cast("string"))
    line = F.col("l_linenumber")
    results = d.raw("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("request_id"), line.alias("position"), url(F.col("l_partkey")).alias("url"),
        F.concat(F.lit(" "), "p_name").alias("title"),
        F.concat(F.lit("Company "), (F.col("l_suppkey") % 5).cast("string")).alias("company_name"),
        F.when(line % 4 == 0, "official").when(line % 4 == 1, "ats").when(line % 4 == 2, "web")
        .otherwise("blog").alias("source_kind"))
    postings = part.select(
        F.col("p_partkey").alias("job_posting_id"), url(F.col("p_partkey")).alias("url"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("Company "), (F.col("p_partkey") % 5).cast("string")).alias("company_name"))
    verified = ingest.discovery_results(results, postings)
    path = scratch_path(d.spark, "discovery-results")
    for batch in ("first", "again"):  # a job that runs twice under another name stores nothing twice
        sinks.append_new(verified, path, ["request_id", "posting"], [F.col("position").asc()], batch)
    return sinks.read_appended(d.spark, verified.schema, path)
